"""Mixing sources to target weights, by temperature, and drawing the documents in budgeted block permutations."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.runtime import cut_lineage

#: Tokens of a block: blocks are permuted as wholes, and only the last one taken is cut inside.
BLOCK_TOKENS = 200_000
#: Blocks that one range of a source's order holds on average: sums run over ranges, then inside the one where the budget ends.
RANGE_BLOCKS = 4_096


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and scaled to sum 1; exponent 1 keeps them, 0 makes them equal."""
    raised = {s: q**exponent for s, q in shares.items() if q > 0}
    total = sum(raised.values())
    return {s: x / total for s, x in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    """Entropy of weights of any sum, in nats; 0 where there are none."""
    total = sum(weights.values())
    return -sum(w / total * log(w / total) for w in weights.values() if w > 0) if total > 0 else 0.0


def poured(rest: float, room: dict[str, float], tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """``rest`` tokens dealt by tempered token shares; a source whose room is full is fixed there and the others are normalised again."""
    out = {s: 0.0 for s in room}
    free = {s for s, r in room.items() if r > 0}
    while free and rest > 0:
        share = tempered({s: float(tokens[s]) for s in free}, exponent)
        full = {s for s in free if rest * share[s] >= room[s]}
        if not full:
            return out | {s: rest * share[s] for s in free}
        for s in full:
            out[s] = room[s]
            rest -= room[s]
        free -= full
    return out


def fit_weights(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], budget: float, steps: int = 60) -> tuple[dict[str, float], float | None]:
    """(tokens to draw per source, exponent): the targets as far as the repetition limits allow, the rest by temperature.

    Every source first gets its target share of the budget, or its limit (tokens times repeats) where
    that is less. What the limits leave over is dealt to the others by their token shares raised to
    one exponent between 1 (as the collection is) and 0 (equally), a source at its limit being fixed
    there and the weights of the others normalised again. The exponent is bisected until the sources
    that had room are mixed with the entropy of their targets; where no exponent gives it, the nearer end holds. The
    exponent is None if the limits leave nothing over. The sum falls short of the budget only if every
    source with a target is at its limit; targets that add up to more than 1 are scaled to 1.
    """
    limits = {s: float(tokens.get(s, 0) * repeats.get(s, 1)) for s in targets}
    scale = 1 / max(1.0, sum(t for t in targets.values() if t > 0))
    able = {s: t * scale for s, t in targets.items() if t > 0 and limits[s] > 0}
    base = {s: min(limits[s], t * budget) for s, t in able.items()}
    rest = budget - sum(base.values())
    if rest <= 1e-9 * budget:
        return {s: base.get(s, 0.0) for s in targets}, None
    room = {s: limits[s] - b for s, b in base.items()}
    mixed = lambda e: {s: base[s] + x for s, x in poured(rest, room, tokens, e).items()}
    among = lambda weights: entropy({s: w for s, w in weights.items() if room[s] > 0})
    over = lambda e: among(mixed(e)) - among(able)
    low, high = 0.0, 1.0
    if over(low) * over(high) > 0:
        exponent = low if abs(over(low)) < abs(over(high)) else high
    else:
        rising = over(high) > 0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if (over(mid) > 0) == rising else (mid, high)
        exponent = (low + high) / 2
    draw = mixed(exponent)
    return {s: draw.get(s, 0.0) for s in targets}, exponent


def placed_blocks(blocks: DataFrame, seed: int) -> DataFrame:
    """``blocks`` (source, block, block_tokens, ranges) with ``before``, the tokens of its source in earlier blocks of a seeded order.

    Blocks fall into ranges by hash; ranges are summed first, blocks only inside their range, so no
    task holds all blocks of a source.
    """
    own = blocks.withColumn("range", F.pmod(F.xxhash64("source", "block", F.lit(seed)), F.col("ranges")))
    sums = own.groupBy("source", "range").agg(F.sum("block_tokens").alias("range_tokens"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    started = sums.select("source", "range", F.coalesce(F.sum("range_tokens").over(earlier("source").orderBy("range")), F.lit(0)).alias("start"))
    inside = F.sum("block_tokens").over(earlier("source", "range").orderBy(F.xxhash64("source", "block", F.lit(seed)), "block"))
    return own.withColumn("inside", F.coalesce(inside, F.lit(0))).join(started, ["source", "range"]).select("source", "block", "block_tokens", (F.col("start") + F.col("inside")).alias("before"))


def mix(sized: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 17, block_tokens: int = BLOCK_TOKENS, range_blocks: int = RANGE_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(drawn documents, shares reached).

    ``sized`` has (doc_id, source, tokens), ``targets`` (source, target_share, max_repeats), a table of
    as many rows as there are sources, which the driver reads. ``budget`` is the size of the mix in
    tokens; by default that of all documents of the target sources, once. :func:`fit_weights` says how
    much each source gives. A source takes whole passes over its documents and then, for the
    rest of its budget, blocks in a seeded random order and the documents of the last block in
    random order while they fit. Drawn documents are (doc_id, source, tokens, repeats), repeats from
    1 to max_repeats. Shares are one row per target: a source without documents, or with a null or
    no target, reaches 0; ``exponent`` is null where no tokens were left to temper. Null sources, texts without tokens and sources without a target are not
    drawn; a doc_id that occurs twice counts once; repeated target rows count once.
    """
    spark = sized.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    goal = {r[0]: (r[1] or 0.0, max(0, r[2] if r[2] is not None else 1)) for r in wanted.collect()}
    own = sized.where(F.col("doc_id").isNotNull() & F.col("source").isin(list(goal)) & (F.col("tokens") > 0))
    own = cut_lineage(own.select("doc_id", "source", "tokens").dropDuplicates(["doc_id"]))
    tokens = {r[0]: r[1] for r in own.groupBy("source").agg(F.sum("tokens")).collect()}
    size = float(sum(tokens.values())) if budget is None else float(budget)
    draw, exponent = fit_weights(tokens, {s: t for s, (t, _) in goal.items()}, {s: r for s, (_, r) in goal.items()}, size)
    number = {s: max(1, n // block_tokens) for s, n in tokens.items()}
    plan = [(s, int(draw[s] // n), float(draw[s] % n), number[s], max(1, number[s] // range_blocks)) for s, n in tokens.items()]
    rules = spark.createDataFrame(plan, "source string, passes int, rest double, blocks bigint, ranges bigint")
    dealt = own.join(F.broadcast(rules), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    before = placed_blocks(dealt.groupBy("source", "block", "ranges").agg(F.sum("tokens").alias("block_tokens")), seed)
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = dealt.join(before, ["source", "block"])
    end = F.col("before") + F.col("block_tokens")
    whole = part.where(end <= F.col("rest")).withColumn("extra", F.lit(1))
    none = part.where(F.col("before") >= F.col("rest")).withColumn("extra", F.lit(0))
    last = part.where((F.col("before") < F.col("rest")) & (end > F.col("rest")))
    last = last.withColumn("extra", (F.col("before") + F.sum("tokens").over(inside) <= F.col("rest")).cast("int"))
    drawn = whole.unionByName(none).unionByName(last).withColumn("repeats", F.col("passes") + F.col("extra")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    reached = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    total = reached.agg(F.sum("tokens"))
    listed = [(s, float(t), r, int(tokens.get(s, 0)), float(round(draw[s], 3)), exponent) for s, (t, r) in sorted(goal.items())]
    known = spark.createDataFrame(listed, "source string, target_share double, max_repeats int, available_tokens bigint, wanted_tokens double, exponent double")
    shares = known.join(reached, "source", "left").withColumn("all_tokens", total.scalar())
    fill = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    actual = F.round(F.coalesce(F.col("tokens") / F.nullif(F.col("all_tokens"), F.lit(0)), F.lit(0.0)), 6).alias("actual_share")
    return drawn, shares.select("source", "target_share", "max_repeats", "available_tokens", "wanted_tokens", "exponent", fill("tokens"), fill("documents"), fill("most_repeats"), actual)
