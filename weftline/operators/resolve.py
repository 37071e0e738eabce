"""Entity resolution as the review pipeline does it: greedy clusters around the most mentioned names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import jaro_winkler_value

JARO_WINKLER, COSINE = 0.88, 0.92


def same_initials(a: str, b: str) -> bool:
    x, y = a.replace(".", "").split(), b.replace(".", "").split()
    if len(x) != len(y) or len(x) < 2 or x[-1] != y[-1]:
        return False
    used = False
    for p, q in zip(x[:-1], y[:-1]):
        if p != q:
            if not (len(p) == 1 and q.startswith(p) or len(q) == 1 and p.startswith(q)):
                return False
            used = True
    return used


def similar(a: dict, b: dict) -> bool:
    """Close spelling and close vectors."""
    if jaro_winkler_value(a["norm"], b["norm"]) < JARO_WINKLER or a["vector"] is None or b["vector"] is None:
        return False
    x, y = np.asarray(a["vector"], float), np.asarray(b["vector"], float)
    if len(x) != len(y):
        return False
    size = float(np.linalg.norm(x) * np.linalg.norm(y))
    return size > 0 and float(x @ y) / size >= COSINE


def verdict(a: dict, b: dict) -> str:
    """merge, flag or apart for two entities of one type; a and b have norm, year, work, roles, ordinal and vector."""
    kind = a["type"]
    if kind == "Film":
        if a["year"] is not None and b["year"] is not None and a["year"] != b["year"]:
            return "apart"
        if a["norm"] == b["norm"]:
            return "merge"
        return "apart" if a["ordinal"] != b["ordinal"] else "merge" if similar(a, b) else "apart"
    if kind == "Character":
        return "merge" if a["norm"] == b["norm"] and a["work"] == b["work"] else "apart"
    if kind == "Person":
        if a["norm"] == b["norm"] or same_initials(a["norm"], b["norm"]):
            roles = (set(a["roles"] if a["roles"] is not None else ()), set(b["roles"] if b["roles"] is not None else ()))
            return "flag" if all(roles) and not roles[0] & roles[1] else "merge"
        return "merge" if similar(a, b) else "apart"
    return "merge" if a["norm"] == b["norm"] or similar(a, b) else "apart"


def clusters(rows: list[dict]) -> list[tuple[str, str, str]]:
    """(key, cluster, how) with how member or flagged; each entity is held against the first of each cluster only."""
    heads: list[dict] = []
    by_norm: dict[str, list[dict]] = {}
    out = []
    for r in sorted(rows, key=lambda r: (-(r["mentions"] or 0), r["key"])):
        flagged = []
        exact = by_norm.get(r["norm"], [])
        home = None
        for h in [*exact, *(h for h in heads if h["norm"] != r["norm"])]:
            v = verdict(h, r)
            if v == "merge":
                home = h
                break
            if v == "flag":
                flagged.append(h["key"])
        if home is None:
            heads.append(r)
            by_norm.setdefault(r["norm"], []).append(r)
        out.append((r["key"], home["key"] if home else r["key"], "member"))
        out += [(r["key"], f, "flagged") for f in flagged]
    return out


def resolve(entities: DataFrame) -> DataFrame:
    """(scope, key, cluster, how): greedy, not transitive clusters within one scope and type.

    ``entities`` has (scope, type, key, norm, year, work, ordinal, roles, mentions, vector). Pairs of
    review candidates come out as rows with how = flagged. The order of an entity list decides the
    clusters, so one list is one task: keep scopes to a document, and use the joins of name variants
    for lists beyond memory.
    """
    schema = f"scope {entities.schema['scope'].dataType.simpleString()}, key string, cluster string, how string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        found = clusters(rows)
        return pd.DataFrame([(pdf["scope"].iloc[0], *f) for f in found], columns=["scope", "key", "cluster", "how"])

    return entities.groupBy("scope", "type").applyInPandas(run, schema)


def canonical(entities: DataFrame, found: DataFrame) -> DataFrame:
    """(scope, cluster, name, aliases, mentions): the most mentioned name of each cluster, the others as aliases."""
    members = found.where("how = 'member'").join(entities.select("scope", "key", "name", "mentions"), ["scope", "key"])
    names = members.groupBy("scope", "cluster", "name").agg(F.sum("mentions").alias("m"), F.count("*").alias("n"))
    best = names.groupBy("scope", "cluster").agg(F.max(F.struct("m", "n", "name"))["name"].alias("best"), F.array_sort(F.collect_set("name")).alias("all"), F.sum("m").alias("mentions"))
    return best.select("scope", "cluster", F.col("best").alias("name"), F.array_remove("all", F.col("best")).alias("aliases"), "mentions")


def names_of_several_types(entities: DataFrame, name: str = "name", kind: str = "type") -> DataFrame:
    """(name, types): names that entities of more than one type bear; these never merge."""
    return entities.groupBy(F.lower(F.trim(name)).alias("name")).agg(F.array_sort(F.collect_set(kind)).alias("types")).where(F.size("types") > 1)
