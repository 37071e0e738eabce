"""Column functions on text: token estimates, tokenising, sentences, normal forms, keys and narratives."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters a token stands for, and the words that searching ignores.
CHARS_PER_TOKEN = 4
STOP_WORDS = "the and for was were with that this from are has have had its his her their which who whom what when where how did does into than then they them been being you your our not but all any can will would there here".split()
#: Suffix words of a studio's name and of a person's, the articles of titles, the agreed refusal.
STUDIO_WORDS = "pictures studios entertainment films productions inc ltd".split()
PERSON_SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]
ARTICLES = ["the", "a", "an"]
REFUSAL_TEXT = "not found in the provided documents"
#: Punctuation and CJK characters, each a basic token of its own, and runs of anything else but blanks.
MARKS, CJK = r"\p{P}$+<=>^`|~", r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{3040}-\x{30ff}"
BASIC_TOKEN = rf"[{MARKS}{CJK}]|[^\s\p{{Z}}\p{{Cc}}{MARKS}{CJK}]+"
TOKEN = r"(?:\$[\p{Nd}.,]*|\p{Nd}[\p{Nd}.,]*)\p{L}*|\p{L}[\p{L}\p{Nd}']*"


def token_estimate(text: Column) -> Column:
    """ceil(length / 4) tokens; null stays null."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("int")


def is_search_token(token: Column) -> Column:
    """Whether a lower-case match of TOKEN counts: no stop word, and two characters or a figure."""
    return ~token.isin(STOP_WORDS) & ((F.length(token) > 1) | token.rlike(r"^[$\p{Nd}]"))


def raw_tokens(text: Column) -> Column:
    """All matches of TOKEN in the lower-case text, stop words and final marks included."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Lower-case search tokens: figures whole (``$47.3m``, ``3,571``), words of two letters or more but for stop words."""
    trimmed = F.transform(raw_tokens(text), lambda t: F.rtrim(t, F.lit(".,")))
    return F.filter(trimmed, is_search_token)


def query_tokens(text: Column, most: int = 24) -> Column:
    """Distinct search tokens in order of first occurrence, ``most`` at most (the cap of a query, not of a text)."""
    return F.slice(F.array_distinct(search_tokens(text)), 1, most)


def sentences(text: Column) -> Column:
    """Trimmed sentences: split after ``!``, ``?``, a line feed, and a dot not before a digit."""
    parts = F.split(text, r"(?<=[!?\n])|(?<=\.)(?!\p{Nd})")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def evidence_sentences(text: Column) -> Column:
    """Trimmed pieces between dots, line feeds, middle dots, ``!`` and ``?``."""
    parts = F.split(text, r"(?<=[.\n·!?])")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def comparable(text: Column) -> Column:
    """Typography levelled: straight quotes and dashes, single spaces, lower case, trimmed."""
    plain = F.translate(text, "‘’“”–—‑ ", "''\"\"--- ")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def is_grounded(evidence: Column, text: Column) -> Column:
    """Whether the levelled evidence, three characters or more, stands in the levelled text; false for nulls."""
    needle = comparable(evidence)
    return F.coalesce((F.length(needle) >= 3) & (F.instr(comparable(text), needle) > 0), F.lit(False))


def contains_loosely(text: Column, part: Column) -> Column:
    """Containment after levelling and without spaces; an empty part is never contained."""
    tight = lambda c: F.replace(comparable(c), F.lit(" "), F.lit(""))
    return F.coalesce((F.length(tight(part)) > 0) & F.contains(tight(text), tight(part)), F.lit(False))


def repaired_evidence(text: Column, names: Column, most: int = 300) -> Column:
    """The shortest sentence that holds all names, else the text if it does, cut at ``most``.

    Both sides are levelled. Null if a name is missing or blank, if there are no names, or no text.
    """
    needles = F.transform(names, lambda n: comparable(n))
    holds = lambda s: F.forall(needles, lambda n: F.contains(comparable(s), n))
    usable = (F.size(names) > 0) & F.forall(needles, lambda n: F.coalesce(n != "", F.lit(False))) & (F.trim(text) != "")
    fitting = F.filter(evidence_sentences(text), holds)
    best = F.array_min(F.transform(fitting, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s"))))["s"]
    chosen = F.when(F.coalesce(usable, F.lit(False)) & holds(text), F.regexp_replace(F.coalesce(best, text), r"^\s+|\s+$", ""))
    return F.when(F.length(chosen) > most, F.concat(F.rtrim(F.left(chosen, F.lit(most))), F.lit("…"))).otherwise(chosen)


def predicate_name(raw: Column) -> Column:
    """Upper-case predicate with underscores, without arrows, brackets and quotes around it."""
    return F.upper(F.replace(F.btrim(raw, F.lit("-><()[] \"'")), F.lit(" "), F.lit("_")))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Lower case without combining marks, whatever the script."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower())


def slug(folded_text: Column) -> Column:
    return F.btrim(F.regexp_replace(folded_text, "[^a-z0-9]+", "-"), F.lit("-"))


def entity_key(kind: Column, folded_name: Column, year: Column, work_slug: Column) -> Column:
    """``type:slug``, with the year for films and series and the work for characters."""
    base = F.concat_ws(":", F.lower(kind), slug(folded_name))
    dated = F.when(kind.isin("Film", "TVSeries"), F.concat_ws(":", base, year.cast("string")))
    return F.coalesce(dated, F.when(kind == "Character", F.concat_ws(":", base, F.coalesce(work_slug, F.lit("unscoped")))), base)


def key_kind(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def roman_value(text: Column) -> Column:
    """Value of a lower-case roman numeral, null for anything else."""
    value = F.create_map(*[F.lit(x) for pair in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100)) for x in pair])
    marks = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: value[c])
    total = F.aggregate(marks, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, v: F.struct((a["sum"] + v - F.when(a["last"] < v, 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")))
    return F.when(text.rlike("^c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (F.length(text) > 0), total["sum"])


def basic_tokens(folded_text: Column) -> Column:
    """Tokens of folded text as a reranker reads it: words, single punctuation marks, single CJK characters."""
    return F.regexp_extract_all(folded_text, F.lit(BASIC_TOKEN), F.lit(0))


def normal_title(folded_title: Column) -> Column:
    """Titles that mean one work: no article before or after, ``part ii`` as ``part 2``, no dashes and colons."""
    bare = F.regexp_replace(folded_title, rf"^\s*(.*?),\s*({'|'.join(ARTICLES)})\s*$", "$1")
    bare = F.regexp_replace(bare, rf"^({'|'.join(ARTICLES)}) ", "")
    part = r"\b(part|chapter|volume|vol\.?)\s+([ivxlc]+)\b"
    number = roman_value(F.regexp_extract(bare, part, 2))
    counted = F.when(number.isNotNull(), F.regexp_replace(bare, F.lit(part), F.concat(F.lit("$1 "), number.cast("string")))).otherwise(bare)
    return F.trim(F.regexp_replace(F.regexp_replace(counted, r"[:–—-]+", " "), r"\s+", " "))


def trailing_ordinal(title: Column) -> Column:
    """The number or roman numeral a title ends in, or the empty string."""
    last = F.element_at(F.split(title, " "), -1)
    return F.when(last.rlike(r"^(\p{Nd}+|[ivxlc]+)$"), last).otherwise("")


def normal_person(folded_name: Column, nicknames: dict[str, str]) -> Column:
    """Given names in full, no generational suffix, no punctuation but dots."""
    full = F.create_map(*[F.lit(x) for pair in nicknames.items() for x in pair]) if nicknames else None
    tokens = F.split(F.trim(F.regexp_replace(F.regexp_replace(folded_name, r"[^\p{L}\p{Nd}.\s]", " "), r"\s+", " ")), " ")
    kept = F.filter(tokens, lambda t: ~F.regexp_replace(t, r"\.$", "").isin(PERSON_SUFFIXES))
    return F.array_join(F.transform(kept, lambda t: F.coalesce(full[t], t)) if full is not None else kept, " ")


def normal_studio(folded_name: Column) -> Column:
    """A studio's name without the legal and generic words at its end, as long as one word is left."""
    return F.trim(F.regexp_replace(folded_name, rf"(?<=\S)(\s+({'|'.join(STUDIO_WORDS)})[.,]*)+$", ""))


def normal_name(kind: Column, folded_name: Column, nicknames: dict[str, str]) -> Column:
    """The normal form that fits the type: person, studio, title of a work; other names with single spaces."""
    single = F.trim(F.regexp_replace(folded_name, r"\s+", " "))
    return F.when(kind == "Person", normal_person(folded_name, nicknames)).when(kind == "Studio", normal_studio(folded_name)).when(kind.isin("Film", "TVSeries", "Episode", "Work"), normal_title(folded_name)).otherwise(single)


def work_slug(first_work: Column, chunk_subject: Column, section_subject: Column) -> Column:
    """The work that characters of a chunk belong to, from folded names: the first film or series of the reply, else the subject, else ``unscoped``."""
    return F.coalesce(slug(first_work), slug(chunk_subject), slug(section_subject), F.lit("unscoped"))


def preset_guess(question: Column) -> Column:
    """The aggregation a question asks for, by its words."""
    has = lambda *ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(F.lower(question), w))
    return F.when(has("franchise"), "multi-franchise-actors").when(has("award", "won", "wins"), "award-tally-by-studio").when(has("cinematograph", "shot", "photography"), "director-cinematographer-pairs").otherwise("studio-film-count")


def year_guess(question: Column) -> Column:
    """The first year from 1900 to 2100 that stands as a word of its own, null without one."""
    return F.nullif(F.regexp_extract(question, r"(?<![\p{L}\p{Nd}])(19\d{2}|20\d{2}|2100)(?![\p{L}\p{Nd}])", 1), F.lit("")).cast("int")


def filter_description(doctype: Column, year: Column, year_from: Column, year_to: Column, subject: Column, studio: Column) -> Column:
    """What a filter asks for, in words; empty if it asks for nothing."""
    told = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    span = F.concat(F.lit("year "), year_from.cast("string"), F.lit("-"), year_to.cast("string"))
    return F.concat_ws(", ", told("docType=", doctype), told("year=", year), span, told("subject=", subject), told("studio=", studio))


def point_id(text: Column) -> Column:
    """A UUID from the MD5 of a text, the first three groups with their bytes turned, as little-endian machines write them."""
    h = F.md5(text.cast("binary"))
    turned = lambda *at: [F.substring(h, i, 2) for i in at]
    return F.concat(*turned(7, 5, 3, 1), F.lit("-"), *turned(11, 9), F.lit("-"), *turned(15, 13), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def initials_agree(a: Column, b: Column) -> Column:
    """Same length, same surname, every given name equal or the other's initial, one initial at least."""
    x, y = F.split(F.replace(a, F.lit("."), F.lit("")), " "), F.split(F.replace(b, F.lit("."), F.lit("")), " ")
    given = lambda t: F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))
    pairs = F.arrays_zip(given(x).alias("p"), given(y).alias("q"))
    initial = lambda p, q: (F.length(p) == 1) & F.startswith(q, p)
    fits = F.forall(pairs, lambda z: (z["p"] == z["q"]) | initial(z["p"], z["q"]) | initial(z["q"], z["p"]))
    used = F.exists(pairs, lambda z: (z["p"] != z["q"]) & (initial(z["p"], z["q"]) | initial(z["q"], z["p"])))
    return (F.size(x) == F.size(y)) & (F.size(x) >= 2) & (F.element_at(x, -1) == F.element_at(y, -1)) & fits & used


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro-Winkler similarity with a common prefix of four at most and no boost threshold."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`jaro_winkler_value` per row; 0 where a side is null."""
    return pd.Series([jaro_winkler_value(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def context_prefix(subject: Column, year: Column, doctype: Column, summary: Column) -> Column:
    """``Subject (year, doctype) — summary `` before a contextual chunk, with words for what is missing."""
    return F.concat(F.coalesce(subject, F.lit("Unknown subject")), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("year unknown")), F.lit(", "), F.coalesce(doctype, F.lit("document")), F.lit(") — "), F.coalesce(summary, F.lit("")), F.lit(" "))


def section_summary(heading: Column, subject: Column, year: Column, doctype: Column) -> Column:
    """``heading about subject (year) [doctype]``; parts that are null are left out."""
    return F.concat_ws(" ", heading, F.concat(F.lit("about "), subject), F.concat(F.lit("("), year.cast("string"), F.lit(")")), F.concat(F.lit("["), doctype, F.lit("]")))


def years_in(text: Column) -> Column:
    """Distinct years 1800 to 2099 that stand as words of their own."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[89]\d{2}|20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))))


def masked_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}", "#")


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts, nulls as empty, in hex."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def safe_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z][A-Za-z0-9_]{0,63}$")


def looks_factual(sentence: Column) -> Column:
    """15 characters without citation marks, and three search tokens."""
    bare = F.regexp_replace(sentence, r"\[\d+\]", "")
    return (F.length(F.trim(bare)) >= 15) & (F.size(search_tokens(bare)) >= 3)


def question_part(prompt: Column) -> Column:
    """What follows the last line QUESTION of a prompt, or, without one, the last line ``### user``; else the whole prompt, trimmed."""
    text = F.regexp_replace(prompt, "\r\n?", "\n")
    after = lambda mark: F.split(text, rf"(?m)^[ \t]*{mark}[ \t]*$")
    told = F.when(F.size(after("QUESTION")) > 1, F.element_at(after("QUESTION"), -1)).otherwise(F.element_at(after("### user"), -1))
    return F.regexp_replace(told, r"^\s+|\s+$", "")


def is_refusal(answer: Column, phrase: str = REFUSAL_TEXT) -> Column:
    """Whether the answer is the agreed refusal, whatever its case and final dots."""
    return F.coalesce(F.trim(F.lower(F.rtrim(F.trim(answer), F.lit(".")))) == phrase, F.lit(False))


def unmarked(markdown: Column) -> Column:
    """Text without emphasis, code and link marks."""
    links = F.regexp_replace(markdown, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(links, r"(\*\*|__|`)", "")
