"""From lines to sections to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import CHARS_PER_TOKEN, context_prefix, masked_digits, section_summary
from weftline.plans.runtime import cut_lineage

#: Sizes in tokens of fixed and recursive chunks, and the overlap of the latter.
FIXED_TOKENS, RECURSIVE_TOKENS, OVERLAP_TOKENS = 400, 400, 80
SEPARATORS = ("\n\n", "\n", ". ")


def lines_of(pages: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row (keys, n, line) per line; CR LF counts as one break; null texts have no lines."""
    parts = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    return pages.select(*keys, F.posexplode(parts).alias("n", "line"))


def page_offsets(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", gap: int = 2) -> DataFrame:
    """Adds start_char: where each page begins once pages are joined with ``gap`` characters between them."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start_char", F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)))


def joined_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, raw_text): the pages of a document in order, joined by an empty line."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("raw_text"))


def upper_medians(sizes: DataFrame, value: str, doc: str = "doc_id") -> DataFrame:
    """(doc, median): the upper median of a column per document, from counts of its values: a document is never gathered in one row."""
    counts = sizes.groupBy(doc, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(doc).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(doc)))
    return ranked.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(doc).agg(F.min(value).alias("median"))


def scanned_documents(pages: DataFrame, doc: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """Documents whose upper median of characters per page is below ``least``: no text layer worth reading."""
    sizes = pages.select(doc, F.length(F.coalesce(F.col(text), F.lit(""))).alias("size"))
    return upper_medians(sizes, "size", doc).withColumnRenamed("median", "median_chars").where(F.col("median_chars") < least)


def running_lines(lines: DataFrame, least_pages: int = 3, share: float = 0.6, margin: float = 0.1) -> DataFrame:
    """(doc_id, shape, pages): line shapes (digits as #) in the margins of more than ``share`` of the pages of a document.

    ``lines`` has (doc_id, page, text, relative_y).
    """
    total = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("all_pages")).where(F.col("all_pages") >= least_pages)
    edge = lines.where((F.col("relative_y") < margin) | (F.col("relative_y") > 1 - margin)).withColumn("shape", F.trim(masked_digits(F.col("text")))).where("shape <> ''")
    seen = edge.groupBy("doc_id", "shape").agg(F.countDistinct("page").alias("pages"))
    return seen.join(total, "doc_id").where(F.col("pages") > share * F.col("all_pages")).select("doc_id", "shape", "pages")


def without_running_lines(lines: DataFrame, **how: float) -> DataFrame:
    """Lines but for running headers and footers, which are dropped in the margins only."""
    margin = how.get("margin", 0.1)
    marked = lines.withColumn("shape", F.trim(masked_digits(F.col("text")))).withColumn("at_edge", (F.col("relative_y") < margin) | (F.col("relative_y") > 1 - margin))
    drop = running_lines(lines, **how).select("doc_id", "shape", F.lit(True).alias("at_edge"))
    return marked.join(drop, ["doc_id", "shape", "at_edge"], "left_anti").drop("shape", "at_edge")


def rejoined(lines: list[str]) -> list[str]:
    """A word broken by a hyphen at the end of a line takes its rest from the next line, if that begins in lower case."""
    out = list(lines)
    for i in range(len(out) - 1):
        line, nxt = out[i], out[i + 1]
        if len(line) > 1 and line.endswith("-") and line[-2].isalpha() and nxt[:1].islower():
            word, _, rest = nxt.partition(" ")
            out[i], out[i + 1] = line[:-1] + word, rest
    return [x for x in out if x]


def rejoined_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, page, n, text): :func:`rejoined` for the lines (doc_id, page, n, text) of every page, numbered anew; a page is a task's smallest unit."""
    kinds = [lines.schema[c].dataType.simpleString() for c in ("doc_id", "page")]

    def run(table: pa.Table) -> pa.Table:
        own = table.sort_by("n")
        out = rejoined([t or "" for t in own["text"].to_pylist()])
        first = lambda c: pa.array([own[c][0].as_py()] * len(out), own[c].type)
        return pa.table({"doc_id": first("doc_id"), "page": first("page"), "n": pa.array(range(len(out)), pa.int32()), "text": pa.array(out, pa.string())})

    return lines.select("doc_id", "page", "n", "text").groupBy("doc_id", "page").applyInArrow(run, f"doc_id {kinds[0]}, page {kinds[1]}, n int, text string")


def lines_of_words(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """(doc_id, page, n, text, font_size, bold): :func:`grouped_lines` for the words (doc_id, page, baseline, left, text, font_size, bold) of every page."""
    kinds = [words.schema[c].dataType.simpleString() for c in ("doc_id", "page")]
    cols = ["baseline", "x", "text", "font_size", "bold"]

    def run(table: pa.Table) -> pa.Table:
        out = grouped_lines(list(zip(*(table[c].to_pylist() for c in cols))), tolerance)
        first = lambda c: pa.array([table[c][0].as_py()] * len(out), table[c].type)
        text, size, bold = zip(*out)
        return pa.table({"doc_id": first("doc_id"), "page": first("page"), "n": pa.array(range(len(out)), pa.int32()), "text": pa.array(text, pa.string()), "font_size": pa.array(size, pa.float64()), "bold": pa.array(bold, pa.bool_())})

    picked = words.select("doc_id", "page", F.col("baseline").cast("double").alias("baseline"), F.col("left").cast("double").alias("x"), F.coalesce("text", F.lit("")).alias("text"), F.col("font_size").cast("double").alias("font_size"), F.coalesce("bold", F.lit(False)).alias("bold"))
    return picked.groupBy("doc_id", "page").applyInArrow(run, f"doc_id {kinds[0]}, page {kinds[1]}, n int, text string, font_size double, bold boolean")


def grouped_lines(words: list[tuple[float, float, str, float, bool]], tolerance: float = 2.5) -> list[tuple[str, float, bool]]:
    """(text, font size, bold) per line of one page from (baseline, left, text, size, bold) words.

    Words are taken from the top; a word joins the first line whose first baseline is within the tolerance.
    """
    lines: list[tuple[float, list]] = []
    for w in sorted(words, key=lambda w: (-w[0], w[1])):
        home = next((own for base, own in lines if abs(base - w[0]) <= tolerance), None)
        if home is None:
            lines.append((w[0], [w]))
        else:
            home.append(w)
    out = []
    for _, own in lines:
        own.sort(key=lambda w: w[1])
        out.append((" ".join(w[2] for w in own), round(sum(w[3] for w in own) / len(own), 2), 2 * sum(w[4] for w in own) > len(own)))
    return out


def front_matter(line: Column) -> tuple[Column, Column]:
    """(key, value) of a line such as ``year: 2015``; null keys elsewhere; ``null`` and nothing are null values."""
    key = F.lower(F.regexp_extract(line, r"^\s*(?i)(docType|subject|year|studio|market)\s*:\s*(.*)$", 1))
    value = F.trim(F.regexp_extract(line, r"^\s*(?i)(docType|subject|year|studio|market)\s*:\s*(.*)$", 2))
    return F.nullif(key, F.lit("")), F.when(F.lower(value).isin("", "null"), None).otherwise(value)


def is_heading(text: Column, font: Column, bold: Column, median: Column, ratio: float = 1.12) -> Column:
    """Lines of 120 characters at most that are larger, bold and larger than usual, or numbered as a part, section or appendix."""
    named = text.rlike(r"^(#{1,4}\s|PART\s+[IVXLC\d]+|Section\s+\d+|APPENDIX\b)")
    return F.coalesce((F.length(text) <= 120) & (F.length(F.trim(text)) > 0) & ((font >= median * ratio) | (bold & (font > median)) | named), F.lit(False))


def sections(lines: DataFrame) -> DataFrame:
    """Sections of documents given as lines (doc_id, n, page, text, font_size, bold).

    A heading opens a section and belongs to it; what comes before the first is the Preamble.
    Front-matter lines are not text. All since the last heading are one block, which starts empty, waits for the next
    heading and then holds until another block takes its place. Sections
    without text are left out and not counted. Result: (id, doc_id, ordinal, heading, page, doctype,
    subject, year, studio, market, text).
    """
    order = Window.partitionBy("doc_id").orderBy("n")
    median = upper_medians(lines.where("font_size > 0"), "font_size")
    key, value = front_matter(F.col("text"))
    marked = lines.join(median, "doc_id", "left").withColumn("fm_key", key).withColumn("fm_value", value)
    heading = F.col("fm_key").isNull() & is_heading(F.col("text"), F.col("font_size"), F.col("bold"), F.coalesce("median", F.lit(10.0)))
    marked = marked.withColumn("heading", heading).withColumn("sid", F.sum(F.col("heading").cast("int")).over(order))
    fields = ("doctype", "subject", "year", "studio", "market")
    last = lambda f, usable=F.lit(True): F.max_by(F.struct(F.col("fm_value").alias("v")), F.when((F.col("fm_key") == f) & usable, F.col("n")))["v"]
    readable = F.expr("try_cast(fm_value as int)").isNotNull()  # an unreadable year changes nothing
    blocks = marked.where("fm_key is not null").groupBy("doc_id", (F.col("sid") + 1).alias("sid")).agg(F.struct(*[last(f, readable if f == "year" else F.lit(True)).alias(f) for f in fields]).alias("block"))
    body = marked.where("fm_key is null").groupBy("doc_id", "sid").agg(F.array_sort(F.collect_list(F.struct("n", "text", "page"))).alias("rows"), F.bool_or("heading").alias("headed"))
    held = body.join(blocks, ["doc_id", "sid"], "left").withColumn("block", F.last("block", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
    text = F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), r"^\s+|\s+$", "")
    kept = held.withColumn("text", text).where("text <> ''").withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("sid")) - 1)
    return kept.select(
        F.concat("doc_id", F.lit("#s"), F.col("ordinal").cast("string")).alias("id"), "doc_id", "ordinal",
        F.when(F.col("headed"), F.trim(F.regexp_replace(F.col("rows")[0]["text"], r"^#{1,4}\s+", ""))).otherwise("Preamble").alias("heading"),
        F.col("rows")[0]["page"].alias("page"), *[F.col(f"block.{f}").cast("int" if f == "year" else "string").alias(f) for f in fields], "text",
    )


def fixed_chunks(texts: DataFrame, key: str = "id", text: str = "text", tokens: int = FIXED_TOKENS) -> DataFrame:
    """(key, ordinal, start_char, end_char, text): slices of equal length without overlap; blank slices are left out.

    ordinal counts the kept slices of a text. Null and empty texts have none.
    """
    size = tokens * CHARS_PER_TOKEN
    length = F.length(text)
    cut = texts.where(length > 0).select(F.col(key), F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), F.floor((length - 1) / size).cast("int"))).alias("__i"))
    sliced = cut.select(key, "__i", (F.col("__i") * size).alias("start_char"), F.least((F.col("__i") + 1) * size, F.length("__t")).alias("end_char"), F.substring("__t", F.col("__i") * size + 1, F.lit(size)).alias("text"))
    kept = sliced.where(F.col("text").rlike(r"\S"))
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("__i")) - 1).select(key, "ordinal", "start_char", "end_char", "text")


def atoms(text: str, start: int, target: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[tuple[int, int]]:
    """Pieces of at most ``target`` characters, split at the coarsest separator that helps; separators stay on the left."""
    if len(text) <= target:
        if text.strip():
            yield start, start + len(text)
        return
    if not separators:
        for i in range(0, len(text), target):
            yield from atoms(text[i : i + target], start + i, target)
        return
    mark, at = separators[0], 0
    while at < len(text):
        hit = text.find(mark, at)
        end = len(text) if hit < 0 else hit + len(mark)
        yield from atoms(text[at:end], start + at, target, separators[1:])
        at = end


def recursive_spans(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """Atoms packed greedily up to ``target`` characters; the next piece begins ``overlap`` before the end of the last."""
    spans: list[tuple[int, int]] = []
    begin = end = None
    for a, b in atoms(text, 0, target):
        if begin is None:
            begin, end = a, b
        elif b - begin <= target:
            end = b
        else:
            spans.append((begin, end))
            begin, end = max(0, min(a, end - overlap)), b
    if begin is not None:
        spans.append((begin, end))
    return spans


def recursive_chunks(texts: DataFrame, key: str = "id", text: str = "text", tokens: int = RECURSIVE_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(key, ordinal, start_char, end_char, text): chunks that end at paragraphs, lines or sentences and overlap.

    A chunk can be longer than the target by the overlap. Null, empty and blank texts have none.
    """
    target, over = tokens * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ordinal, start, end, piece = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(recursive_spans(t, target, over) if t else []):
                    row.append(i), ordinal.append(k), start.append(a), end.append(b), piece.append(t[a:b])
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int32()) for x in (ordinal, start, end)), pa.array(piece, pa.string())], [key, "ordinal", "start_char", "end_char", "text"])

    return texts.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ordinal int, start_char int, end_char int, text string")


def contextual_chunks(chunks: DataFrame, sections_: DataFrame) -> DataFrame:
    """Chunks (section_id, text, ...) with the prefix that names their section's work, year, kind and summary."""
    told = sections_.select(F.col("id").alias("section_id"), "subject", "year", "doctype", F.coalesce("summary", section_summary(F.col("heading"), F.col("subject"), F.col("year"), F.col("doctype"))).alias("summary"))
    return chunks.join(told, "section_id").withColumn("raw_text", F.col("text")).withColumn("text", F.concat(context_prefix(F.col("subject"), F.col("year"), F.col("doctype"), F.col("summary")), F.col("raw_text")))


def numbered(chunks: DataFrame) -> DataFrame:
    """Adds seq (over fixed, recursive, contextual in turn) and strategy_ordinal per document, and next_id along each strategy."""
    rank = F.array_position(F.array(*map(F.lit, ("fixed", "recursive", "contextual"))), F.col("strategy"))
    place = [F.col("section_ordinal"), F.col("start_char"), F.col("id")]
    every, own = Window.partitionBy("doc_id").orderBy(rank, *place), Window.partitionBy("doc_id", "strategy").orderBy(*place)
    return chunks.withColumn("seq", F.row_number().over(every) - 1).withColumn("strategy_ordinal", F.row_number().over(own) - 1).withColumn("next_id", F.lead("id").over(own))


def overlapping(left: DataFrame, right: DataFrame, best: int, key: str = "id", doc: str = "doc_id", cell: int = 4096) -> DataFrame:
    """(key, other, overlap, rank): for each left span the ``best`` right spans of its document that it overlaps most.

    An interval join by cells of ``cell`` characters: a span meets only those that touch one of its
    cells, and each pair is kept in the first cell they share. Ties go to the earlier, then smaller id.
    """
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start_char") / cell), F.floor((F.col("end_char") - 1) / cell)))
    side = lambda d, p: d.where("end_char > start_char").select(F.col(doc).alias("d"), F.col(key).alias(f"{p}id"), F.col("start_char").alias(f"{p}s"), F.col("end_char").alias(f"{p}e"), cells().alias("cell"))
    met = side(left, "l").join(side(right, "r"), ["d", "cell"]).where("ls < re and le > rs").where(F.col("cell") == F.greatest(F.floor(F.col("ls") / cell), F.floor(F.col("rs") / cell)))
    both = met.withColumn("overlap", F.least("le", "re") - F.greatest("ls", "rs"))
    rank = F.row_number().over(Window.partitionBy("d", "lid").orderBy(F.desc("overlap"), "rs", "rid"))
    return both.withColumn("rank", rank).where(F.col("rank") <= best).select(F.col("d").alias(doc), F.col("lid").alias(key), F.col("rid").alias("other"), "overlap", "rank")


def spread(rows: DataFrame, cap: int, order: str, group: str | None = None) -> DataFrame:
    """``cap`` rows spread evenly over the order (rows floor(i * n / cap)), all if there are no more; per group if one is named.

    Without a group, rows are sorted by ranges and numbered inside their range, so no task holds all.
    """
    if group:
        over = Window.partitionBy(group)
        numbered_ = rows.withColumn("__i", F.row_number().over(over.orderBy(order)) - 1).withColumn("__n", F.count("*").over(over))
    else:
        ranged = cut_lineage(rows.orderBy(order).withColumn("__p", F.spark_partition_id()))
        sizes = ranged.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__c").over(Window.partitionBy()))
        placed = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1).join(F.broadcast(sizes), "__p")
        numbered_ = placed.withColumn("__i", F.col("__i") + F.col("__before")).drop("__p", "__c", "__before")
    hit = F.floor((F.col("__i") * cap + cap - 1) / F.col("__n"))
    chosen = (hit < cap) & (F.floor(hit * F.col("__n") / cap) == F.col("__i"))
    return numbered_.where((F.col("__n") <= cap) | chosen).drop("__i", "__n")


def token_windows(texts: DataFrame, tokens: str = "tokens", budget: int = 254, overlap: float = 0.25) -> DataFrame:
    """Windows (start, end) of at most ``budget`` tokens that overlap by a quarter and reach the end; none for empty arrays."""
    step = max(1, int(budget * (1 - overlap)))
    n = F.size(tokens)
    last = F.when(n <= budget, 0).otherwise(F.ceil((n - budget) / F.lit(step)).cast("int"))
    return texts.where(n > 0).withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step))).withColumn("end", F.least(F.col("start") + budget, n))


def word_pieces(words: list[str], vocabulary: set[str], longest: int = 100) -> list[str]:
    """Greedy longest-match pieces of each word, ``##`` inside; a word that is too long or has no match is [UNK]."""
    out: list[str] = []
    for w in words:
        pieces, at = [], 0
        while at < len(w) <= longest:
            end = next((e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in vocabulary), at)
            if end == at:
                break
            pieces.append(("##" if at else "") + w[at:end])
            at = end
        out += pieces if at == len(w) and pieces else ["[UNK]"]
    return out
