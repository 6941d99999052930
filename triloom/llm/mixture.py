"""Mixing of sources to target weights along a time-varying curriculum.

Each source has a weight schedule over the training time 0..1 whose integral is its target share. The schedule's integral
times the budget is the source's cumulative token demand; a document that begins after c tokens of its source stands at
the time when that demand reaches c. Documents are ordered within a source by a hash, and their offsets are prefix sums
in two levels: sums by (source, round, bucket), then within a bucket, so no task holds a whole source. Sorting by position
gives the sequence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triloom.llm.tokens import n_tokens
from triloom.session import col, cut

#: Documents in a bucket of the prefix sums, on average.
BUCKET_ROWS = 20_000
#: Sources a mixture may have: their schedules are worked out on the driver and broadcast.
MAX_SOURCES = 10_000


def schedules(weights: dict[str, int], drift: float) -> dict[str, float]:
    """The slope g of each source's weight p(1 + drift·g·(2t - 1)): at most 1 in size, and the weights sum to 1 at every t. Smaller targets come later."""
    names = sorted(weights, key=lambda s: (weights[s], s))
    total = sum(weights.values()) or 1
    mean = sum(i * weights[s] for i, s in enumerate(names)) / total
    raw = {s: mean - i for i, s in enumerate(names)}
    most = max(map(abs, raw.values()), default=0) or 1
    return {s: drift * r / most for s, r in raw.items()}


def position(share: Column, g: Column) -> Column:
    """The time at which the fraction ``share`` of a source's demand is reached: g·t² + (1 - g)·t = share, solved for t."""
    b = 1 - g
    return F.least(F.lit(1.0), 2 * share / (b + F.sqrt(F.greatest(b * b + 4 * g * share, F.lit(0.0)))))


def mix(docs: DataFrame, weights: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", drift: float = 0.5, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Place documents in a training sequence, and report the shares reached.

    ``weights`` has source, target_permille and max_repeats. Sources are compared after trimming spaces and ignoring
    case; documents of other sources, or of none, are left out. ``budget`` is the sequence's size in tokens, by default
    the tokens of all the named sources. A document is placed in round r = 0, 1, .. below max_repeats if its offset is
    within the source's demand. Null or empty texts count 0 tokens and are placed like others. Repeated rows are each
    placed. First result: doc_id, source, round, n_tokens, position; sort by (position, source, doc_id, round). Second
    result: for each source its tokens, demand, tokens placed, documents placed, target_permille, actual share in
    permille of all placed tokens, last position, and ``short`` if it can't fill its target. Null weights count as 0
    and null max_repeats as 1.
    """
    if not 0 <= drift <= 1:
        raise ValueError("drift must be within 0 and 1, else weights would be negative")
    wanted = weights.groupBy(F.lower(F.trim("source")).alias("key")).agg(F.min("source").alias("source"), F.max(F.coalesce("target_permille", F.lit(0))).cast("long").alias("permille"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("repeats")).where("key is not null")
    plan = wanted.limit(MAX_SOURCES + 1).collect()
    if len(plan) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    keys = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"), F.lower(F.trim(col(docs, source))).alias("key"))
    counted = cut(keys.where(F.col("key").isin([r.key for r in plan])).select("doc_id", "key", n_tokens(F.col("text")).alias("n_tokens")), "counted")
    sums = {r.key: (r.tokens, r.docs) for r in counted.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    total = budget if budget is not None else sum(t for t, _ in sums.values())
    g = schedules({r.key: r.permille for r in plan}, drift)
    rounds = {r.key: min(r.repeats, max(1, -(-r.permille * total // (1000 * max(1, sums.get(r.key, (0, 0))[0]))))) for r in plan}
    spark = docs.sparkSession
    table = spark.createDataFrame([(r.key, r.source, r.permille, r.repeats, rounds[r.key], float(g[r.key]), sums.get(r.key, (0, 0))[0]) for r in plan], "key string, source string, permille long, repeats long, rounds long, g double, tokens long")
    known = F.broadcast(table)  # at most MAX_SOURCES rows
    bits = max(0, math.ceil(math.log2(max(1, sum(d for _, d in sums.values()) / BUCKET_ROWS))))
    rows = counted.join(known.select("key", "rounds"), "key").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).alias("round")).drop("rounds").withColumn("h", F.xxhash64("doc_id", "round"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = rows.groupBy("key", "round", "bucket").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("key", "round", "bucket", (F.sum("size").over(Window.partitionBy("key").orderBy("round", "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("key", "round", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("upto", inside).join(before, ["key", "round", "bucket"]).join(known, "key")
    offset = F.col("base") + F.col("upto") - F.col("n_tokens")
    demand = F.col("permille") * F.lit(total)
    placed = placed.withColumn("offset", offset).where((F.col("offset") * 1000 < demand) | ((F.col("n_tokens") == 0) & (F.col("offset") * 1000 <= demand) & (demand > 0)))
    share = F.when(demand > 0, F.least(F.lit(1.0), (F.col("offset") + F.col("n_tokens") / 2) * 1000 / demand)).otherwise(0.0)
    sequence = placed.select("doc_id", "source", "round", "n_tokens", position(share, F.col("g")).alias("position"))
    got = sequence.groupBy("source").agg(F.sum("n_tokens").alias("placed_tokens"), F.count("*").alias("placed_docs"), F.max("position").alias("last_position"))
    report = known.join(got, "source", "left").select(
        "source", F.col("tokens"), (demand / 1000).alias("demand_tokens"), F.coalesce("placed_tokens", F.lit(0)).alias("placed_tokens"), F.coalesce("placed_docs", F.lit(0)).alias("placed_docs"), F.col("permille").alias("target_permille"), "last_position",
        (F.coalesce("placed_tokens", F.lit(0)) * 1000 < demand).alias("short"),
    )
    return sequence, report


def shares(report: DataFrame) -> DataFrame:
    """The report with each source's share, in permille, of all tokens placed."""
    all_tokens = F.sum("placed_tokens").over(Window.partitionBy())  # a row for each source, at most MAX_SOURCES
    return report.withColumn("actual_permille", F.when(all_tokens > 0, F.col("placed_tokens") * 1000 / all_tokens).otherwise(0.0))


def ordered(sequence: DataFrame) -> DataFrame:
    """The training sequence: range-partitioned and sorted by position."""
    return sequence.orderBy("position", "source", "doc_id", "round")
