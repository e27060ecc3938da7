"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, its expected number of copies. Rates stay as near as possible (in relative entropy) to one
copy each while every source's rates reach its target tokens. The dual of this convex problem has one multiplier per
source: a document's rate is the exponential of the multiplier times its length relative to the source's mean, capped
at the allowed repeats. Newton steps, safeguarded by a bracket, solve the dual; each is one aggregation over the
histogram of (source, tokens). Rates are rounded into copies so that running sums within a source stay exact to half a
copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokens import rank_within
from corpusmill.session import cut_lineage

#: Newton steps; a bracket of 2 BRACKET is halved to nothing within fewer, so more are never needed.
STEPS = 120
BRACKET = 1e5
TOLERANCE = 1e-6


def source_key(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, runs of spaces, hyphens and underscores as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s_-]+|[\s_-]+$", "")), r"[\s_-]+", "_")


def _rate(multiplier: Column, length: Column, cap: Column) -> Column:
    return F.least(cap, F.exp(F.least(F.lit(600.0), multiplier * length)))


def mix_sources(docs: DataFrame, item: str, source: str, tokens: str, weights: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Copies (item, source, tokens, copies) of every document and the report of sources.

    ``weights`` has source, target_share, max_repeats. ``docs`` must give the same rows when it is read twice. The
    report has, per listed source, target_share, documents, tokens, copies, mixed_tokens, actual_share, max_copies.
    Sources are compared in one spelling (``source_key``). Without ``total`` the corpus is as large as the caps allow
    for all sources that have tokens. Documents of a null or unlisted source, and documents without tokens, get zero
    copies and still appear. A listed source without documents is reported with zero tokens; the others share in
    proportion to their targets, so that actual shares are relative to what can be had. Weights that are null, not
    positive or repeated: null or non-positive ones are no target, repeated ones add up with the smallest cap. Other
    columns are ignored, whatever their names. Empty tables give an empty result or a report of zeros.
    """
    spark = docs.sparkSession
    goal = weights.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("cap"))
    goal = goal.filter("source is not null and share > 0 and cap > 0").groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))
    rows = docs.select(F.col(item).alias("item"), source_key(F.col(source)).alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"))
    cells = cut_lineage(rows.filter("tokens > 0").join(F.broadcast(goal), "source").groupBy("source", "tokens", "cap", "share").agg(F.count("*").alias("n")))
    # one row per listed source
    have = {r["source"]: r for r in cells.groupBy("source", "cap", "share").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tokens")).cast("double").alias("tokens")).collect()}
    shares = sum(r["share"] for r in have.values())
    most = min((r["cap"] * r["tokens"] * shares / r["share"] for r in have.values()), default=0.0)
    wanted = min(total, most) if total else most
    targets = {s: wanted * r["share"] / shares for s, r in have.items()}
    means = {s: r["tokens"] / r["n"] for s, r in have.items()}
    bracket = {s: [-BRACKET, BRACKET] for s in have}
    multiplier = {s: 0.0 for s in have}
    full = {s for s, r in have.items() if targets[s] >= r["cap"] * r["tokens"] * (1 - 1e-9)}
    multiplier |= {s: 1e9 for s in full}
    open_ = set(have) - full

    def rates(values: dict[str, float]) -> DataFrame:
        schema = "source string, multiplier double, mean double"
        dual = spark.createDataFrame([(s, float(v), float(means[s])) for s, v in values.items()], schema)
        joined = cells.join(F.broadcast(dual), "source")
        return joined.withColumn("x", F.col("tokens") / F.col("mean")).withColumn("rate", _rate(F.col("multiplier"), F.col("x"), F.col("cap").cast("double")))

    for _ in range(STEPS):
        if not open_:
            break
        weight = F.col("n") * F.col("tokens") * F.col("rate")
        slope = F.when(F.col("rate") < F.col("cap"), weight * F.col("x")).otherwise(0.0)
        sums = rates({s: multiplier[s] for s in open_}).groupBy("source").agg(F.sum(weight).alias("f"), F.sum(slope).alias("d")).collect()
        for r in sums:
            s, gap = r["source"], r["f"] - targets[r["source"]]
            if abs(gap) <= TOLERANCE * targets[s]:
                open_.discard(s)
                continue
            bracket[s][gap > 0] = multiplier[s]
            low, high = bracket[s]
            step = multiplier[s] - gap / r["d"] if r["d"] > 0 else math.nan
            multiplier[s] = step if low < step < high else (low + high) / 2
            if high - low < 1e-12:  # the rates jump over the target within one rounding of the multiplier
                open_.discard(s)
    if open_:
        raise RuntimeError(f"the mix did not settle for {', '.join(sorted(open_))}")
    solved = rates(multiplier)
    along = Window.partitionBy("source").orderBy("tokens")
    sums = F.sum(F.col("n") * F.col("rate")).over(along)
    planned = solved.withColumn("upto", F.floor(sums + 0.5)).withColumn("before", F.coalesce(F.lag("upto").over(along), F.lit(0)))
    planned = planned.select("source", "tokens", "n", F.least(F.col("upto") - F.col("before"), F.col("n") * F.col("cap")).cast("long").alias("planned"))
    planned = cut_lineage(planned.select("source", "tokens", F.expr("planned div n").alias("base"), F.expr("planned % n").alias("extra")))
    ranked = rank_within(rows.filter("tokens > 0 and source is not null"), ["source", "tokens"], [F.xxhash64("item"), F.col("item")])
    given = ranked.join(planned, ["source", "tokens"], "left")
    copies = F.coalesce(F.col("base") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0), F.lit(0)).cast("long").alias("copies")
    given = given.select("item", "source", "tokens", copies)
    rest = rows.filter("tokens <= 0 or source is null").select("item", "source", "tokens", F.lit(0).cast("long").alias("copies"))
    given = given.unionByName(rest)
    mixed = given.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("max_copies"))
    report = goal.join(mixed, "source", "left").na.fill(0, ["documents", "tokens", "copies", "mixed_tokens", "max_copies"])
    everything = report.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = report.crossJoin(F.broadcast(everything))  # a single row
    report = report.select("source", F.col("share").alias("target_share"), "documents", "tokens", "copies", "mixed_tokens", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("all_tokens")), F.lit(0.0)).alias("actual_share"), "max_copies")
    return given.select(F.col("item").alias(item), "source", "tokens", "copies"), report
