"""Variant spellings of names: a prefix-filtered q-gram join, verified by soft weighted token similarity.

Every name and alias of an entity is a form, a set of the q-grams of its tokens, each weighing more
the rarer it is. Forms of one dossier and type whose weighted overlap is ``OVERLAP`` of the heavier one
share a gram of their prefixes: the rarest grams, down to where the rest weighs less than that. Frequencies come
from a table of hashed counts, of one size for every collection, so prefixes are cut where the forms are read.
A pair that meets is judged by its tokens: the sum of their weights times the similarity of the best
partners (equal, mistyped, nickname, abbreviation, initial), over the weight of the heavier form; tokens that
contradict each other count against it. So a rare token (a surname, a firm's own word) must agree and
common ones (given names) may be shortened or left out. Forms that say less
than another are linked only if they fit one entity alone.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.components import connected_groups
from weftline.plans.runtime import cut_lineage

#: Letters of a gram, weighted overlap from which forms meet, and hashed counts of grams and of tokens (more make weights finer).
Q, OVERLAP, COUNTS = 3, 0.2, 65_536
#: Forms of one gram that a task compares; grams with more, and with more than this share of all rows (so 10,000 at most), are dealt to squares of blocks.
HOT_FORMS, HOT_SHARE = 512, 1e-4
#: Similarity of tokens that are equal, mistyped, shortened, initials; score from which forms agree; what a contradiction costs, in weights.
EQUAL, TYPED, SHORTENED, INITIAL = 1.0, 0.95, 0.75, 0.5
ALIKE, AGAINST = 0.3, 2.0
#: A token of persons' names is common, a given name, if it stands beside as many different tokens as this share of all forms, and four at least: at most a few thousand tokens are.
COMMON_SHARE, COMMON_LEAST = 0.003, 4
#: Nicknames learnt per given name from quoted forms such as Ann "Nan" Lee.
LEARNT = 50
#: Links between keys that one partition holds when they are merged into groups.
LINK_ROWS = 200_000
#: Words that tell no person or studio apart.
TITLES = {"dr", "mr", "mrs", "ms", "miss", "sir", "dame", "prof", "lord", "lady"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv"}
LEGAL = {"ltd", "limited", "inc", "llc", "llp", "gmbh", "pvt", "plc", "co", "corp", "corporation", "ag", "sa", "bv", "kg", "private"}
GENERIC = {"pictures", "picture", "films", "film", "cinema", "cinemas", "entertainment", "entertainments", "studios", "studio", "media", "works", "productions", "production", "company", "group", "house", "international", "the", "and", "of"}


TOKEN = re.compile(r"\w+").findall


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that turn a into b, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def mistyped(a: str, b: str, short: int = 5, long: int = 8) -> int:
    """Edits between two tokens if they may be one word mistyped, else -1: one from ``short`` letters on, two from ``long``."""
    least = min(len(a), len(b))
    most = 2 if least >= long else 1 if least >= short else 0
    n = edits(a, b, most)
    return n if n <= most else -1


def matched(near: dict[tuple[int, int], int], size: int) -> tuple[list[int], list[int]]:
    """A largest set of pairs (i, j) of ``near`` without a common i or j, by augmenting paths; any number of words."""
    partner: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for _, j in sorted((n, j) for (x, j), n in near.items() if x == i):
            if j not in tried:
                tried.add(j)
                if j not in partner or place(partner[j], tried):
                    partner[j] = i
                    return True
        return False

    for i in range(size):
        place(i, set())
    return [i for _, i in sorted(partner.items())], sorted(partner)


class Frequencies:
    """Hashed counts over all forms: of grams for the join and of tokens for the verification."""

    def __init__(self, forms: int, grams: np.ndarray, tokens: np.ndarray):
        self.forms = max(1, forms)
        self.known: dict[str, float] = {}
        self.coded: dict[str, tuple[int, float]] = {}
        self.gram_weight = np.log(1 + self.forms / np.maximum(1, grams)).tolist()
        self.token_weight = np.log(1 + self.forms / np.maximum(1, tokens)).tolist()

    def grams(self, form: str) -> dict[int, float]:
        """Codes and weights of the distinct grams of a form."""
        out = {}
        for g in grams(form):
            got = self.coded.get(g)
            if got is None:
                if len(self.coded) > 200_000:
                    self.coded.clear()
                c = code(g)
                got = self.coded[g] = (c, self.gram_weight[c % COUNTS])
            out[got[0]] = got[1]
        return out

    def prefix(self, weights: dict[int, float]) -> list[int]:
        """The heaviest grams, until what is left weighs less than OVERLAP of the form."""
        rest = sum(weights.values())
        least, out = OVERLAP * rest - 1e-9, []
        for w, c in sorted(zip(weights.values(), weights), reverse=True):
            if rest < least:
                break
            out.append(c)
            rest -= w
        return out

    def token(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[word] = self.token_weight[code(word) % COUNTS]
        return got


def code(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class Names:
    """Comparison of forms, given the common tokens of persons, the known nicknames (short -> full) and token frequencies."""

    def __init__(self, common: set[str], nicknames: set[tuple[str, str]], frequencies: Frequencies | None = None):
        self.common = common
        self.full: dict[str, set[str]] = {}
        for short, full in nicknames:
            self.full.setdefault(short, set()).add(full)
        self.weight = frequencies.token if frequencies else lambda w: 1.0 if w in common else 2.0
        self.seen: dict[tuple[str, str], tuple] = {}

    def person(self, name: str) -> tuple[str, tuple[str, ...], str]:
        """(surname, given names, quoted nickname)."""
        text = re.sub(r"\([^)]*\)", " ", fold(name))
        quoted = re.search(r"[\"“”']([^\"“”']+)[\"“”']", text)
        nick = ""
        if quoted and quoted.start() > 0 and text[quoted.start() - 1].isspace():
            nick = quoted.group(1).strip()
            text = text[: quoted.start()] + " " + text[quoted.end() :]
        parts = [re.findall(r"\w+", p) for p in text.split(",")]
        parts = [[t for t in p if t not in TITLES and t not in SUFFIXES] or [] for p in parts]
        parts = [p for p in parts if p]
        if not parts:
            return "", (), nick
        if len(parts) > 1:
            return parts[0][-1], (*(t for p in parts[1:] for t in p), *parts[0][:-1]), nick
        tokens = parts[0]
        if len(tokens) == 2 and (tokens[1] in self.common and tokens[0] not in self.common or len(tokens[1]) == 1 < len(tokens[0])):
            return tokens[0], (tokens[1],), nick
        return tokens[-1], tuple(tokens[:-1]), nick

    def studio(self, name: str) -> tuple[str, ...]:
        """The firm's own words, in order of the alphabet."""
        tokens = [(t.rstrip("."), t.endswith(".")) for t in re.findall(r"\w+\.?", fold(name))]
        own = []
        for t, cut in tokens:
            if t in LEGAL or t in GENERIC or (cut and len(t) >= 3 and any(g.startswith(t) for g in GENERIC)):
                continue
            if len(t) >= 5 and any(mistyped(t, g) >= 0 for g in GENERIC if len(g) >= 5):
                continue
            own.append(t)
        return tuple(sorted(own or [t for t, _ in tokens]))

    def given(self, a: str, b: str) -> tuple[float, int]:
        """(similarity, side) of two given names; side 1 or 2 says less, 0 neither; similarity 0 if they contradict each other."""
        if a == b:
            return EQUAL, 0
        if len(a) == 1 or len(b) == 1:
            return (INITIAL, 1 if len(a) == 1 else 2) if a[0] == b[0] else (0.0, 0)
        if b in self.full.get(a, ()):
            return SHORTENED, 1
        if a in self.full.get(b, ()):
            return SHORTENED, 2
        if not (a in self.common and b in self.common) and a not in self.full and b not in self.full and mistyped(a, b, 4) >= 0:
            return TYPED, 0
        if len(a) != len(b) and min(len(a), len(b)) >= 3:
            short, long, side = (a, b, 1) if len(a) < len(b) else (b, a, 2)
            if short not in self.common and (long.startswith(short) or len(short) >= 4 and short in long):
                return SHORTENED, side
        for short, other, side in ((a, b, 1), (b, a, 2)):
            if len(other) >= 5 and any(mistyped(other, f) >= 0 for f in self.full.get(short, ())):
                return SHORTENED, side
        return 0.0, 0

    def soft(self, a: tuple[str, ...], b: tuple[str, ...], partners: list[tuple[str, str, float]], against: list[str]) -> float:
        """Soft weighted similarity of token lists: weights times similarities of partners, less contradictions, over the heavier list."""
        wa, wb = ([self.weight(t) for t in x] for x in (a, b))
        whole = max(sum(wa), sum(wb))
        mean = whole / max(len(a), len(b))
        for_ = sum(max(self.weight(x), self.weight(y)) * sim if sim >= TYPED else min(self.weight(x), self.weight(y)) * sim for x, y, sim in partners)
        return (for_ - sum(AGAINST * max(mean, self.weight(t)) for t in against)) / whole

    def persons(self, a: tuple, b: tuple) -> tuple[int, int]:
        """Surname against surname, given names in order; a further given name of the longer form is left out in the other, no contradiction.

        A surname that contradicts outweighs all the rest, so nothing else is looked at then.
        """
        (sa, ga, na), (sb, gb, nb) = a, b
        if not sa or not sb:
            return 0, 0
        if not ga or not gb:
            return (4, 0) if ga == gb and sa == sb else (0, 0)
        last = EQUAL if sa == sb else TYPED if mistyped(sa, sb) >= 0 else 0.0
        if not last:
            return 0, 0
        fits = [self.given(x, y) for x, y in zip(ga, gb)]
        for nick, other, side in ((na, gb, 2), (nb, ga, 1)):
            if fits[0][0] == 0 and nick and nick == other[0]:
                fits[0] = (SHORTENED, side)
        pairs = [(sa, sb, last), *((x, y, f) for x, y, (f, _) in zip(ga, gb, fits))]
        score = self.soft((sa, *ga), (sb, *gb), [p for p in pairs if p[2]], [x for x, _, f in pairs if not f])
        if score < ALIKE:
            return 0, 0
        less = {s for _, s in fits if s}
        if len(ga) != len(gb):
            less.add(1 if len(ga) < len(gb) else 2)
        if not less:
            return 4, 0
        weakest = min(f for f, _ in fits)
        return (3 if weakest >= TYPED else 2 if weakest >= SHORTENED else 1, less.pop()) if len(less) == 1 else (0, 0)

    def studios(self, a: tuple[str, ...], b: tuple[str, ...]) -> tuple[int, int]:
        """Own words in any order, the best partners first; a word without a partner contradicts, for firms differ by one word."""
        left, right = Counter(a), Counter(b)
        same = left & right
        rest_a, rest_b = list((left - same).elements()), list((right - same).elements())
        partners = [(w, w, EQUAL) for w in same.elements()]
        near = {(i, j): mistyped(x, y) for i, x in enumerate(rest_a) for j, y in enumerate(rest_b) if not (x.isdigit() or y.isdigit())}
        near = {k: v for k, v in near.items() if v >= 0}
        met_a, met_b = matched(near, len(rest_a))
        partners += [(rest_a[i], rest_b[j], TYPED) for i, j in zip(met_a, met_b)]
        against = [x for i, x in enumerate(rest_a) if i not in met_a] + [y for j, y in enumerate(rest_b) if j not in met_b]
        return (4, 0) if self.soft(a, b, partners, against) >= ALIKE else (0, 0)

    def compare(self, kind: str, a: str, b: str) -> tuple[int, int]:
        """(fit, side): 4 the same, 0 different; else ``side`` says less but agrees: 3 leaves names out, 2 shortens them, 1 has an initial."""
        if len(self.seen) > 200_000:
            self.seen = {}
        parse = self.person if kind == "Person" else self.studio
        x, y = (self.seen.get((kind, n)) or self.seen.setdefault((kind, n), parse(n)) for n in (a, b))
        return self.persons(x, y) if kind == "Person" else self.studios(x, y)


def grams(name: str) -> set[str]:
    """Distinct padded q-grams of the folded tokens."""
    out = set()
    for t in TOKEN(fold(name)):
        padded = f"^{t}$"
        out.update([padded[i : i + Q] for i in range(max(1, len(padded) - Q + 1))])
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n) of the hashed gram counts, then of the token counts; slot -1 counts the forms."""
    seen = np.zeros(2 * COUNTS, np.int64)
    forms = 0
    for batch in batches:
        for n in batch.column(0).to_pylist():
            forms += 1
            for c in {code(g) % COUNTS for g in grams(n)} | {COUNTS + code(t) % COUNTS for t in TOKEN(fold(n))}:
                seen[c] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1]])), pa.array(np.concatenate([seen[at], [forms]]))], ["slot", "n"])


def frequencies(forms: DataFrame) -> Frequencies:
    """The frequencies of all forms; what the driver reads is at most 2 * COUNTS + 1 rows."""
    table = np.zeros(2 * COUNTS + 1, np.int64)
    for slot, n in forms.select("form").mapInArrow(_counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        table[slot] = n
    return Frequencies(int(table[-1]), table[:COUNTS], table[COUNTS : 2 * COUNTS])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, quoted = [], []
        for n in batch.column("form").to_pylist():
            text = fold(n)
            rows.append(sorted({t for t in re.findall(r"\w+", text) if t not in TITLES and t not in SUFFIXES and len(t) > 2}))
            m = re.match(r"\s*(\w+)\s+[\"“]([^\"”]+)[\"”]", text)
            quoted.append([m.group(2).strip(), m.group(1)] if m else None)
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(rows, kind), pa.array(quoted, kind)], ["tokens", "quoted"])


def _indexed(known: Frequencies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.prefix(known.grams(n)) for n in batch.column("form").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "prefix"])

    return run


def _met(known: Frequencies, common: set[str], nicknames: set[tuple[str, str]]):
    """Judges the pairs of forms that stand in one cell, each pair only in the cell of the smallest gram that both prefixes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(common, nicknames, known)
        cut: dict[str, tuple] = {}
        cell, members = None, []

        def described(form: str) -> tuple:
            got = cut.get(form)
            if got is None:
                if len(cut) > 100_000:
                    cut.clear()
                weights = known.grams(form)
                got = cut[form] = (weights, sum(weights.values()), frozenset(known.prefix(weights)))
            return got

        def judged() -> list[tuple[int, int, int, int]]:
            out = []
            told = [(*m, *described(m[3])) for m in members] if len(members) > 1 else []
            for n, (fa, kind, gram, x, half, wa, whole_a, pa_) in enumerate(told):
                for fb, other, _, y, side, wb, whole_b, pb in told[n + 1 :]:
                    if min(pa_ & pb) != gram or kind != other or half == side > 0 or fa == fb:
                        continue
                    least = OVERLAP * (whole_a if whole_a > whole_b else whole_b) - 1e-9
                    if sum([wa[c] for c in wa.keys() & wb.keys()]) < least:
                        continue
                    fit, less = names.compare(kind, x, y)
                    if fit:
                        out.append((fa, fb, fit, less))
            return out

        for batch in batches:
            found = []
            for c, *row in zip(*(col.to_pylist() for col in batch.columns)):
                if c != cell:
                    found += judged()
                    cell, members = c, []
                members.append(row)
            yield _rows(found)
        yield _rows(judged())

    return run


def _rows(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*found)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["fa", "fb", "fit", "side"])


def linked_forms(forms: DataFrame, known: Frequencies, common: set[str], nicknames: set[tuple[str, str]], hot_forms: int = HOT_FORMS) -> DataFrame:
    """(fa, fb, fit, side): pairs of forms (form_id) of one scope that agree, as :meth:`Names.compare` says.

    One shuffle brings the forms that share a gram of their prefixes together. A gram with very many
    forms is dealt to blocks i and j of them: cell (i, i) compares a block with itself, (i, j) two blocks.
    """
    schema = ", ".join(f"{c} {forms.schema[c].dataType.simpleString()}" for c in forms.columns)
    listed = forms.mapInArrow(_indexed(known), f"{schema}, prefix array<bigint>")
    rows = cut_lineage(listed.select("form_id", "type", F.explode("prefix").alias("gram"), "form", F.xxhash64("scope", "gram").alias("cell")))
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(float(hot_forms)), rows.agg(F.count("*") * F.lit(HOT_SHARE)).scalar())
    hot = F.broadcast(cut_lineage(counts.where(F.col("n") > least).select("cell", F.ceil(F.col("n") / least).cast("int").alias("blocks"))))
    dealt = rows.join(hot, "cell", "left").withColumn("block", F.pmod(F.xxhash64("form_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    squares = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda i: F.struct(F.least(i, "block").alias("lo"), F.greatest(i, "block").alias("hi")))
    sent = dealt.select(F.explode(squares).alias("at"), "*").select(F.xxhash64("cell", "at.lo", "at.hi").alias("cell"), "form_id", "type", "gram", "form", F.when(F.col("at.lo") == F.col("at.hi"), 0).when(F.col("block") == F.col("at.lo"), 1).otherwise(2).alias("half"))
    return sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(_met(known, common, nicknames), "fa bigint, fb bigint, fit int, side int")


def forms_of(entities: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(scope, type, key, form, form_id): the names and aliases of the rows of these types; a scope is a doc_id and a type."""
    rows = entities.where(F.col("type").isin(*types) & F.col("doc_id").isNotNull() & F.col("key").isNotNull()).select("doc_id", "key", "type", "name", "aliases").dropDuplicates(["doc_id", "key"])
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    forms = rows.select(F.concat_ws("\u0001", "doc_id", "type").alias("scope"), "type", "key", F.explode(every).alias("form")).where("form is not null and trim(form) <> ''").distinct()
    return forms.withColumn("form_id", F.xxhash64("scope", "key", "form"))


def given_names(forms: DataFrame, diminutives: DataFrame) -> tuple[set[str], set[tuple[str, str]]]:
    """(common tokens of persons, nicknames (short, full)): both bounded, the latter by LEARNT a common token and the table of diminutives."""
    persons = forms.where("type = 'Person'").mapInArrow(_tokens, "tokens array<string>, quoted array<string>")
    total = forms.where("type = 'Person'").count()
    beside = persons.select(F.explode("tokens").alias("t"), "tokens").select("t", F.explode("tokens").alias("o")).where("t <> o")
    counts = beside.groupBy("t").agg(F.countDistinct("o").alias("n")).where(F.col("n") >= max(COMMON_LEAST, COMMON_SHARE * total))
    common = {r[0] for r in counts.select("t").collect()}
    learnt = persons.where("quoted is not null").select(F.col("quoted")[0].alias("short"), F.col("quoted")[1].alias("full")).where(F.col("full").isin(list(common)))
    learnt = learnt.groupBy("short", "full").count().withColumn("r", F.row_number().over(Window.partitionBy("full").orderBy(F.desc("count"), "short"))).where(F.col("r") <= LEARNT)
    nicknames = {(r[0], r[1]) for r in learnt.select("short", "full").collect()}
    told = diminutives.where("short_form is not null and canonical is not null").select(F.lower(F.trim("short_form")), F.lower(F.trim("canonical"))).distinct()
    return common, nicknames | {(r[0], r[1]) for r in told.collect()}


def link_variants(entities: DataFrame, diminutives: DataFrame, types: tuple[str, ...] = ("Person", "Studio")) -> DataFrame:
    """(doc_id, type, key, group_key): every entity row that names the same person or studio as another, with its group.

    ``entities`` has (doc_id, key, type, name, aliases), ``diminutives`` (short_form, canonical), both
    any extra columns. Rows are compared within one doc_id and type. Null and blank names and aliases
    and null alias arrays are no forms; rows with the same doc_id and key count once; an empty table
    gives no rows. Order, case, accents, punctuation, titles, typing errors, nicknames, initials and
    left-out middle names may differ; a form that fits two entities that differ is linked to neither.
    """
    forms = cut_lineage(forms_of(entities, types))
    common, nicknames = given_names(forms, diminutives)
    found = linked_forms(forms, frequencies(forms), common, nicknames)
    end = lambda c: forms.select(F.col("form_id").alias(f"f{c}"), F.col("scope").alias(f"scope_{c}"), F.col("key").alias(c))
    found = found.join(end("a"), "fa").join(end("b"), "fb").where("scope_a = scope_b and a <> b")
    turned = F.when(F.col("a") < F.col("b"), F.col("side")).otherwise(F.when(F.col("side") > 0, 3 - F.col("side")).otherwise(0))
    found = found.select(F.col("scope_a").alias("scope"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "fit", turned.alias("side"))
    links = cut_lineage(found.groupBy("scope", "a", "b").agg(F.max(F.struct("fit", "side")).alias("m")).select("scope", "a", "b", "m.fit", "m.side"))
    links = links.coalesce(max(1, links.count() // LINK_ROWS))
    sure = links.where("fit = 4").select("scope", "a", "b")
    for fit in (3, 2, 1):
        groups = connected_groups(sure, "scope", "a", "b")
        own = lambda c: groups.select("scope", F.col("item_key").alias(c), F.col("group_key").alias(f"g{c}"))  # noqa: E731,B023
        weak = links.where(F.col("fit") == fit).join(own("a"), ["scope", "a"], "left").join(own("b"), ["scope", "b"], "left")
        weak = weak.select("scope", F.coalesce("ga", "a").alias("x"), F.coalesce("gb", "b").alias("y"), "side")
        lean = weak.select("scope", F.when(F.col("side") == 1, F.col("x")).otherwise(F.col("y")).alias("less"), F.when(F.col("side") == 1, F.col("y")).otherwise(F.col("x")).alias("more")).where("less <> more")
        fitting = lean.groupBy("scope", "less").agg(F.min("more").alias("more"), F.max("more").alias("other")).where("more = other")
        more = fitting.select("scope", F.col("less").alias("a"), F.col("more").alias("b"))
        sure = cut_lineage(sure.unionByName(more.coalesce(links.rdd.getNumPartitions())))
        sure = sure.coalesce(links.rdd.getNumPartitions())
    groups = connected_groups(sure, "scope", "a", "b")
    part = F.split("scope", "\u0001")
    return groups.select(part[0].alias("doc_id"), part[1].alias("type"), F.col("item_key").alias("key"), "group_key")


def variant_pairs(entities: DataFrame, diminutives: DataFrame) -> DataFrame:
    """(doc_id, left_key, right_key): all pairs of keys of one group of :func:`link_variants`, the smaller key left."""
    groups = link_variants(entities, diminutives)
    left = groups.select("doc_id", "type", "group_key", F.col("key").alias("left_key"))
    right = groups.select("doc_id", "type", "group_key", F.col("key").alias("right_key"))
    return left.join(right, ["doc_id", "type", "group_key"]).where("left_key < right_key").select("doc_id", "left_key", "right_key").distinct()
