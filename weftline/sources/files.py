"""Files in: JSON settings and markdown; parquet stores out, with replacement by document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import unmarked


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(predicate, from_type, to_type) of a JSON file with relationTypes: [{predicate, from: [...], to: [...]}]."""
    read = spark.read.option("multiLine", True).json(path).select(F.explode("relationTypes").alias("r"))
    return read.select("r.predicate", F.explode("r.from").alias("from_type"), "r.to").select("predicate", "from_type", F.explode("to").alias("to_type"))


def diminutives(spark: SparkSession, path: str) -> DataFrame:
    """(short_form, canonical) of a JSON object of names, lower case."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("short_form", "canonical")).select(F.lower(F.trim("short_form")).alias("short_form"), F.lower(F.trim("canonical")).alias("canonical"))


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, question, expected_contains, expected_path, expected_sections, expect_refusal) of a question file."""
    one = "struct<id:string,question:string,type:string,expectedAnswerContains:array<string>,expectedSections:array<string>,expectedPathContains:array<string>,expectRefusal:boolean>"
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"struct<questions:array<{one}>>")["questions"]).alias("q"))
    return rows.select("q.id", "q.type", "q.question", F.col("q.expectedAnswerContains").alias("expected_contains"), F.col("q.expectedPathContains").alias("expected_path"), F.col("q.expectedSections").alias("expected_sections"), F.col("q.expectRefusal").alias("expect_refusal"))


def flattened_markdown(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, kind, level, line): the visible lines of markdown: heading, row, quote, item, front or text.

    Lines inside fences are kept as code, rules and empty lines are dropped; table rulers are dropped.
    """
    lines = texts.select(F.col(key), F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("n", "line"))
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    order = Window.partitionBy(key).orderBy("n")
    marked = lines.withColumn("fence", fence).withColumn("inside", F.sum(fence.cast("int")).over(order) % 2 == 1)
    line = F.trim("line")
    level = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
    kind = (
        F.when(F.col("inside"), "code").when(level > 0, "heading").when(line.rlike(r"^\|.*\|$"), "row").when(line.startswith(">"), "quote")
        .when(line.rlike(r"^([-*+]|\d+[.)])\s"), "item").when(line.rlike(r"^(?i)(docType|subject|year|studio|market)\s*:"), "front").otherwise("text")
    )
    cells = F.regexp_replace(F.btrim(line, F.lit("| ")), r"\s*\|\s*", " · ")
    shown = F.when(F.col("kind") == "code", F.col("line")).when(F.col("kind") == "row", cells).otherwise(unmarked(F.regexp_replace(line, r"^(#{1,6}|>|[-*+]|\d+[.)])\s+", "")))
    kept = marked.where(~F.col("fence")).withColumn("kind", kind).where((F.col("kind") == "code") | ((line != "") & ~line.rlike(r"^([-*_]\s*){3,}$") & ~line.rlike(r"^\|[\s:|-]+\|$")))
    return kept.select(key, "n", "kind", level.cast("int").alias("level"), shown.alias("line"))


def before_marker(texts: DataFrame, marker: str, text: str = "text") -> DataFrame:
    """Texts up to the first occurrence of a marker, without trailing blanks; whole where it does not occur."""
    at = F.instr(F.col(text), F.lit(marker))
    return texts.withColumn(text, F.when(at > 0, F.rtrim(F.substring(text, F.lit(1), at - 1))).otherwise(F.col(text)))


def first_json_object(text: str | None) -> str | None:
    """The first balanced JSON object in a reply with fences or talk around it; braces in strings do not count."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for body in ([fenced.group(1)] if fenced else []) + [text]:
        start = body.find("{")
        while start >= 0:
            depth, quoted, skip = 0, False, False
            for i in range(start, len(body)):
                c = body[i]
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if depth == 0:
                        return body[start : i + 1]
            start = body.find("{", start + 1)
    return None


def json_objects(replies: DataFrame, key: str, text: str) -> DataFrame:
    """(key, json): the first JSON object of each reply, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([first_json_object(t) for t in b.column(1).to_pylist()], pa.string())], [key, "json"])

    return replies.select(key, text).mapInArrow(run, f"`{key}` {replies.schema[key].dataType.simpleString()}, json string")


def replies_to(prompts: DataFrame, recording: DataFrame, request: list[str]) -> DataFrame:
    """Prompts with the recorded response for the same request key; null where nothing was recorded."""
    from weftline.functions.text import content_key

    keyed = prompts.withColumn("request_key", content_key(*[F.col(c) for c in request]))
    return keyed.join(recording.select(F.col("key").alias("request_key"), "response").dropDuplicates(["request_key"]), "request_key", "left")


def missing_from_cache(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(hash, text): distinct texts whose content key the cache does not hold."""
    from weftline.functions.text import content_key

    wanted = texts.where(F.col(text).isNotNull()).select(content_key(F.lit(model), F.col(text)).alias("hash"), F.col(text)).dropDuplicates(["hash"])
    return wanted.join(cache.select("hash"), "hash", "left_anti")


class ParquetStore:
    """Tables in one folder, partitioned by document, replaced and deleted document by document."""

    def __init__(self, spark: SparkSession, root: str, partition: str = "doc_id"):
        self.spark, self.root, self.partition = spark, root, partition

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Overwrites only the documents that occur in ``rows``."""
        out = rows.repartition(self.partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(self.partition).parquet(f"{self.root}/{name}")

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace stored rows with the same keys; other rows of their documents stay."""
        from weftline.plans.runtime import cut_lineage

        docs = rows.select(self.partition).distinct()
        old = self.read(name).join(docs, self.partition, "left_semi").join(rows.select(*keys).distinct(), keys, "left_anti")
        self.replace(name, cut_lineage(old.unionByName(rows.dropDuplicates(keys), allowMissingColumns=True)))

    def delete(self, name: str, doc: str) -> None:
        """Drops the partition of one document."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{self.partition}={doc}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def delete_document(self, doc: str, names: tuple[str, ...] = ("sections", "chunks", "vectors", "graph_entities", "graph_edges", "graph_mentions")) -> None:
        """The cascade: every table that holds the document."""
        for name in names:
            self.delete(name, doc)


def most_recent(rows: DataFrame, used: str, key: str, keep: int = 50) -> DataFrame:
    """The ``keep`` most recently used rows of a cache, the newest first; ties by key."""
    return rows.orderBy(F.desc(used), key).limit(keep)
