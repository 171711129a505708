"""Sources mixed to target weights, with a cap on repeats.

Capped water-filling: of a total, each source is given its target share; a source that
would have to be repeated more often than allowed is clamped at its cap, and what it can't give is spread
over the others in proportion to their weights, until all are feasible. Every document
of a source is then drawn the whole number of times, and a seeded fraction once more.

Defined results: a source is its trimmed lower-case name; documents of unlisted or null sources and
documents without tokens (null or blank texts) are not drawn; a listed source without
documents gets nothing and its weight is spread; null or negative shares and caps count as 0; targets
that repeat a source add up, with the greatest cap. Repeated rows count each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import Scratch

#: Parts into which each source is hashed; a fraction of it is drawn part by part.
PARTS = 4096


@dataclass(frozen=True)
class Allotment:
    source: str
    available: int
    share: float
    max_repeats: int
    tokens: float

    @property
    def epochs(self) -> float:
        return self.tokens / self.available if self.available else 0.0

    @property
    def clamped(self) -> bool:
        return self.tokens >= self.available * self.max_repeats


def water_fill(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> list[Allotment]:
    """How many tokens each source gives of ``total``; the sum is less only if all sources are at their caps."""
    caps = {s: available.get(s, 0) * max(0, int(n or 0)) for s, (_, n) in targets.items()}
    weights = {s: max(0.0, w or 0.0) for s, (w, _) in targets.items()}
    given = {s: 0.0 for s in targets}
    open_ = {s for s in targets if caps[s] > 0 and weights[s] > 0}
    left = float(total)
    while open_:
        scale = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * scale >= caps[s]}
        if not full:
            for s in open_:
                given[s] = weights[s] * scale
            break
        for s in full:
            given[s] = float(caps[s])
            left -= caps[s]
        open_ -= full
    return [Allotment(s, available.get(s, 0), weights[s], max(0, int(targets[s][1] or 0)), given[s]) for s in sorted(targets)]


def source_name(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


@dataclass(frozen=True)
class Mixture:
    """``drawn``: (doc_id, source, n_tokens, repeats); ``shares``: one row per target."""

    drawn: DataFrame
    shares: DataFrame


def mix(
    counts: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 17,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "n_tokens",
) -> Mixture:
    """Draw documents so that sources have their target shares of ``total_tokens`` (default: all
    tokens of the listed sources), as nearly as ``max_repeats`` allows.

    ``counts`` has one row per document with its size. Targets, one row per source, and one sum
    per listed source are all that reaches the driver. The fraction of a source
    is drawn by seeded hash parts: whole parts by their sums, and the one part in which
    the fraction ends document by document, so no source is ever sorted as a whole.
    """
    spark = counts.sparkSession
    named = targets.where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(
        F.sum(F.greatest("target_share", F.lit(0.0))).alias("share"), F.max("max_repeats").alias("cap")
    )
    wanted = {r["source"]: (r["share"] or 0.0, r["cap"] or 0) for r in named.collect()}
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(PARTS)).cast("int")
    docs, _ = Scratch(spark, "mixing").save(
        counts.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(size).cast("long").alias("n_tokens"))
        .where(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0))
        .withColumn("part", part)
    )
    sums = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(sums.values()) if total_tokens is None else total_tokens
    allotted = water_fill(sums, wanted, total)
    rows = [(a.source, a.share, a.max_repeats, a.available, a.epochs, a.clamped, int(a.epochs), (a.epochs - int(a.epochs)) * a.available) for a in allotted]
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long, epochs double, clamped boolean, whole int, rest double")

    # The part of each source in which its fraction ends, and what the parts before it hold: one row a source. Parts are at most PARTS rows a source.
    parts = docs.groupBy("source", "part").agg(F.sum("n_tokens").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parts.withColumn("_upto", F.sum("_sum").over(upto)).join(F.broadcast(plan.select("source", "rest")), "source").where(F.col("_upto") > F.col("rest"))
    ends = ends.groupBy("source").agg(F.min(F.struct("part", (F.col("_upto") - F.col("_sum")).alias("before"))).alias("_end"))
    placed = plan.select("source", "whole", "rest").join(ends, "source", "left").select("source", "whole", "rest", F.coalesce("_end.part", F.lit(PARTS)).alias("_edge"), F.col("_end.before").alias("_before"))
    joined = docs.join(F.broadcast(placed), "source")
    sure = joined.where(F.col("part") != F.col("_edge")).withColumn("repeats", F.col("whole") + F.when(F.col("part") < F.col("_edge"), 1).otherwise(0))
    order = Window.partitionBy("source", "part").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where(F.col("part") == F.col("_edge")).withColumn("_at", F.col("_before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    # A document belongs to the fraction if more of it lies within than beyond.
    edge = edge.withColumn("repeats", F.col("whole") + F.when(F.col("_at") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    columns = ["doc_id", "source", "n_tokens", "repeats"]
    drawn = sure.select(*columns).unionByName(edge.select(*columns)).where("repeats > 0")

    got = drawn.groupBy("source").agg(
        F.count(F.lit(1)).alias("drawn_documents"), F.sum("repeats").alias("drawn_copies"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats")
    )
    filled = plan.drop("whole", "rest").join(got, "source", "left").na.fill(0, ["drawn_documents", "drawn_copies", "drawn_tokens", "most_repeats"])
    everything = filled.agg(F.sum("drawn_tokens").alias("_total"))
    shares = filled.crossJoin(F.broadcast(everything)).withColumn("actual_share", F.when(F.col("_total") > 0, F.col("drawn_tokens") / F.col("_total")).otherwise(0.0)).drop("_total")
    return Mixture(drawn, shares)
