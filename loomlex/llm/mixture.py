"""Problem 8: mixing sources to target weights by Pfair scheduling.

1. *Amounts.*  With n_i tokens in source i, at most r_i uses of a text and weight w_i (targets of
   the sources that have tokens, scaled to 1), the largest mixture that keeps all shares has
   T = min_i n_i r_i / w_i tokens; source i gives w_i T of them.  Whole passes go over all its
   texts; of the rest, the texts in hash order whose end lies within it are used once more, so a
   source misses its amount by less than one text.
2. *Order.*  Weights become whole numbers a_i / Q.  Q is the least common denominator of the
   weights, so that they are exact; only where that is beyond ``PERIOD`` they are read to 1 / PERIOD
   by largest remainders.  Block k of source i is released at floor(k/w) and due at ceil((k+1)/w);
   in each slot the released block with the earliest deadline runs.  At every slot each source is
   then within one block of its target.  All a_i are due exactly at Q, so one period, computed once,
   serves for all of them.
3. *Place of a use.*  The running sum of tokens within its source gives the block a use begins in,
   the block its slot.  Sums run inside hash buckets, over the buckets of a span and over the spans:
   no source is sorted in one task.

Nulls and edges: texts whose source is NULL or not listed, and empty texts, get repeats 0; a
listed source without tokens gets no weight and is reported with share 0; without any usable
source nothing is drawn; repeated ids are texts of their own; more than ``SOURCES`` listed sources
are refused; a weight that rounds to nothing at 1 / PERIOD still gets one slot.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlex.llm.tokens import token_sizes
from loomlex.session import broadcast_if_small, stage_table, table

#: Slots of a period, at most: the resolution of weights without a smaller common denominator.
PERIOD = 1_000_000
#: Tokens of a block.
BLOCK = 4_096
#: Texts of a hash bucket, about; buckets of a span.
BUCKET, SPAN = 20_000, 1_000
#: Most listed sources; the list is read by the driver.
SOURCES = 10_000


def whole_weights(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Numerators a_i whose sum is the period: exact if one of at most ``period`` slots can be, else by
    largest remainders over ``period``; every positive weight gets at least 1.  Weights are read as the
    decimals they print as, so 0.1 is one tenth."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if w > 0}
    if len(exact) > period:
        raise ValueError(f"{len(exact)} sources don't fit into a period of {period} slots")
    total = sum(exact.values())
    shares = {s: w / total for s, w in exact.items()}
    q = 1
    for w in shares.values():
        q = lcm(q, w.denominator)
        if q > period:
            break
    if q <= period:
        return {s: int(w * q) for s, w in shares.items()}
    out = {s: max(1, int(w * period)) for s, w in shares.items()}
    left = period - sum(out.values())
    if left > 0:  # fewer than there are sources
        for s in sorted(shares, key=lambda s: (int(shares[s] * period) - shares[s] * period, s))[:left]:
            out[s] += 1
    elif left < 0:  # slots given to tiny weights come from those that can spare them, in proportion
        spare = {s: n - 1 for s, n in out.items() if n > 1}
        whole = sum(spare.values())
        take = {s: n * -left // whole for s, n in spare.items()}
        rest = -left - sum(take.values())
        for s in sorted(spare, key=lambda s: (take[s] - spare[s], s))[:rest]:
            take[s] += 1
        for s, n in take.items():
            out[s] -= n
    common = gcd(*out.values())
    return {s: n // common for s, n in out.items()}


def pfair(numerators: dict[str, int], slots: int | None = None) -> list[tuple[int, str, int, int, int]]:
    """The first ``slots`` slots of a period, earliest deadline first: (slot, source, block, release, deadline)."""
    q = sum(numerators.values())
    waiting: list[tuple[int, str, int]] = [(0, s, 0) for s in sorted(numerators)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, str, int, int]] = []
    out = []
    for t in range(q if slots is None else min(q, slots)):
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            a = numerators[s]
            due = -(-(k + 1) * q // a)
            overlap = due * a > (k + 1) * q  # the window meets the next one: such ties go first
            heapq.heappush(ready, (due, -overlap, -a, s, k, release))
        if not ready:
            raise AssertionError("a slot without a released block")
        due, _, _, s, k, release = heapq.heappop(ready)
        out.append((t, s, k, release, due))
        if k + 1 < numerators[s]:
            heapq.heappush(waiting, ((k + 1) * q // numerators[s], s, k + 1))
    return out


def amounts(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int]) -> dict[str, int]:
    """Tokens that each source gives to the largest mixture with the target shares."""
    live = {s: w for s, w in target.items() if w and w > 0 and tokens.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not live:
        return {}
    scale = sum(live.values())
    most = min(tokens[s] * repeats[s] * scale / w for s, w in live.items())
    return {s: min(round(w / scale * most), tokens[s] * repeats[s]) for s, w in live.items()}


def _plan(spark: SparkSession, d: str):
    """Sizes by document with bucket and key, and the driver's few numbers by source."""
    want = table(spark, d, "mixture_target").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(SOURCES + 1).collect()
    if len(want) > SOURCES:
        raise ValueError(f"more than {SOURCES} listed sources")
    sizes = stage_table(token_sizes(table(spark, d, "documents"), ["doc_id", "source"]), "sizes")
    buckets = max(1, -(-sizes.count() // BUCKET))
    key = F.xxhash64("doc_id", F.lit(8))
    sizes = sizes.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    names = [r["source"] for r in want]
    held = {r["source"]: r["n"] for r in sizes.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    target = {r["source"]: r["w"] or 0.0 for r in want}
    return sizes, held, target, amounts(held, target, {r["source"]: r["r"] or 0 for r in want})


def _lookup(spark: SparkSession, values: dict[str, tuple], names: str) -> DataFrame:
    return spark.createDataFrame([(s, *v) for s, v in values.items()], f"source string, {names}")


def _live(target: dict[str, float], give: dict[str, int]) -> dict[str, float]:
    return {s: target[s] for s, n in give.items() if n > 0}


def _drawn(spark: SparkSession, d: str):
    sizes, held, target, give = _plan(spark, d)
    rule = _lookup(spark, {s: (n, give.get(s, 0) // n if n else 0, give.get(s, 0) % n if n else 0) for s, n in held.items()}, "held bigint, passes bigint, rest bigint")
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = sizes.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")).withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = totals.groupBy("source", "span").agg(F.sum("t").alias("t")).withColumn("spans_before", F.sum("t").over(Window.partitionBy("source").orderBy("span")) - F.col("t")).drop("t")
    within = totals.withColumn("before", F.sum("t").over(Window.partitionBy("source", "span").orderBy("bucket")) - F.col("t")).drop("t")
    before = within.join(spans, ["source", "span"]).select("source", "bucket", (F.col("before") + F.col("spans_before")).alias("before"))
    rows = (
        sizes.withColumn("end", F.sum("n_tokens").over(inner))
        .join(before, ["source", "bucket"])  # rows of a NULL source end here and come back below
        .join(F.broadcast(rule), "source", "left")  # at most SOURCES rows
        .withColumn("end", F.col("end") + F.col("before"))
        .withColumn("repeats", F.when(F.col("n_tokens") > 0, F.coalesce(F.col("passes") + (F.col("end") <= F.col("rest")).cast("int"), F.lit(0))).otherwise(F.lit(0)).cast("int"))
        .select("doc_id", "source", "n_tokens", "repeats", (F.col("end") - F.col("n_tokens")).alias("start"), "held")
    )
    none = sizes.where("source is null").select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("held"))
    return rows.unionByName(none), target, give


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every use of every text: repeats of the text, number of the use from 0, its place among the
    tokens of its source, the block it begins in and that block's slot.

    A text that isn't used has one row with repeats 0 and NULL in the other columns.  The order of the
    mixture is that of (slot, place).
    """
    rows, target, give = _drawn(spark, d)
    uses = F.when(F.col("repeats") > 0, F.sequence(F.lit(0), F.col("repeats") - 1))
    at = rows.select("doc_id", "source", "n_tokens", "repeats", "start", "held", F.explode_outer(uses).alias("use_no"))
    at = at.withColumn("place", F.col("start") + F.col("use_no") * F.col("held")).withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))
    out = ["doc_id", "source", "n_tokens", "repeats", "use_no", "place", "block"]
    if not give:
        return at.select(*out, F.lit(None).cast("long").alias("slot"))
    parts = whole_weights(_live(target, give))
    q = sum(parts.values())
    # a rescaled mixture ends in the slot of its last block, which may come before the period does
    needed = max((n // BLOCK + 1) * q // parts[s] + 1 for s, n in give.items() if s in parts)
    order = spark.createDataFrame([(s, k, t) for t, s, k, _, _ in pfair(parts, needed + q // min(parts.values()))], "source string, k int, offset int")
    at = at.join(F.broadcast(_lookup(spark, {s: (a,) for s, a in parts.items()}, "a int")), "source", "left")  # at most SOURCES rows
    at = at.withColumn("k", F.pmod("block", F.col("a").cast("long")).cast("int"))
    at = at.join(broadcast_if_small(order), ["source", "k"], "left")
    return at.select(*out, (F.floor(F.col("block") / F.col("a")) * F.lit(q) + F.col("offset")).cast("long").alias("slot"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share, tokens drawn and greatest repeats of every listed source."""
    rows, target, give = _drawn(spark, d)
    got = rows.where("repeats > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.count(F.lit(1)).alias("texts"))
    want = _lookup(spark, {s: (w,) for s, w in target.items()}, "target_share double")
    out = want.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = out.agg(F.sum("tokens").alias("total"))
    return out.join(F.broadcast(total)).select(  # one row
        "source", "target_share", "tokens", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.when(F.col("total") > 0, F.round(F.col("tokens") / F.col("total"), 6)).otherwise(F.lit(0.0)).alias("actual_share"),
    )


def p8_schedule(spark: SparkSession, d: str) -> DataFrame:
    """One period of the interleaving: slot, source, block, release and deadline."""
    _, _, target, give = _plan(spark, d)
    rows = pfair(whole_weights(_live(target, give))) if give else []
    return spark.createDataFrame(rows, "slot int, source string, block int, release int, deadline int")


SQL: dict[str, str] = {}
QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_schedule": p8_schedule}
