"""What is reachable from given nodes, for many start sets at once.

A frontier loop over edges, with what is already seen taken out at every step, as graphs are
cyclic. Start sets that share a graph walk it together: a node is met once, with a bit for each set that has come to it.
Only edges that lead on are walked: an edge whose target has no outgoing edge
ends a path, so such targets are added in one last hop. Each step is written to scratch; after some steps, while few nodes are new, a step
is of several hops, twice as many each time, so that long chains take few jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import Scratch
from tesserae.skew import HOT_ROWS, hot_keys, salted_join

#: Start sets that share one bit field.
BITS = 62
#: New nodes up to which a step may be of several hops, and the most hops of a step.
FEW, MOST_HOPS = 100_000, 4
#: Steps of one hop at first, as most graphs are shallow.
SINGLE = 4


def _hop(frontier: DataFrame, links: DataFrame, scope: str, n_links: int, hot: DataFrame | None, hot_rows: int) -> DataFrame:
    """The nodes one edge further, each once with all its bits. Edges of a node with very many are spread over several tasks."""
    at = frontier.select(scope, "word", F.col("node").alias("source"), "bits")
    ahead = salted_join(links, at, [scope, "source"], "inner", F.col("target"), hot_rows, n_links if hot is None else None, hot)
    return ahead.groupBy(scope, "word", F.col("target").alias("node")).agg(F.bit_or("bits").alias("bits"))


def _new(found: DataFrame, seen: DataFrame, scope: str) -> DataFrame:
    """What of ``found`` is not seen yet."""
    known = seen.groupBy(scope, "word", "node").agg(F.bit_or("bits").alias("_seen")).select(F.col(scope).alias("_s"), F.col("word").alias("_w"), F.col("node").alias("_n"), "_seen")
    match = F.col(scope).eqNullSafe(F.col("_s")) & (F.col("word") == F.col("_w")) & (F.col("node") == F.col("_n"))
    bits = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
    return found.join(known, match, "left").select(scope, "word", "node", bits.alias("bits")).where("bits <> 0")


def reachable(edges: DataFrame, seeds: DataFrame, label: str | None = None, labels: int = 1, scope: str = "scene_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(scope, label, node): the seeds and all nodes that edges lead to from them.

    ``seeds`` has scope, node and, where there are several start sets, a ``label`` from 0 up to ``labels`` - 1. Null nodes are none;
    edges without a source or target lead nowhere.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    plain = edges.select(scope, "source", "target").where(F.col("source") != F.col("target")).distinct()
    sources = plain.select(F.col(scope).alias("_s"), F.col("source").alias("_n"), F.lit(True).alias("_on")).distinct()
    on = plain.join(sources, F.col(scope).eqNullSafe(F.col("_s")) & (F.col("target") == F.col("_n")), "left")
    links, _ = scratch.save(on.select(scope, "source", "target", F.coalesce("_on", F.lit(False)).alias("on")))
    inner, links, n_links = links.where("on").drop("on"), links.drop("on"), links.count()
    hot = hot_keys(links, [scope, "source"], hot_rows) if n_links > hot_rows else None
    number = F.col(label) if label else F.lit(0)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (number % BITS).cast("int"))
    start = seeds.where(F.col("node").isNotNull()).groupBy(scope, F.floor(number / BITS).cast("int").alias("word"), "node").agg(F.bit_or(bit).alias("bits"))
    frontier, _ = scratch.save(start)
    seen, step, hops, new = frontier, 0, 1, frontier.count()
    while new:
        steps = [frontier]
        for _ in range(hops):
            steps.append(_hop(steps[-1], inner, scope, n_links, hot, hot_rows))
        found = steps[1]
        for more in steps[2:]:
            found = found.unionByName(more)
        if hops > 1:
            found = found.groupBy(scope, "word", "node").agg(F.bit_or("bits").alias("bits"))
        frontier, _ = scratch.save(_new(found, seen, scope))
        new = frontier.count()
        seen = seen.unionByName(frontier)
        step += 1
        hops = min(2 * hops, MOST_HOPS) if new <= FEW and step >= SINGLE else 1
    seen, _ = scratch.save(seen.groupBy(scope, "word", "node").agg(F.bit_or("bits").alias("bits")))
    last = _hop(seen, links, scope, n_links, hot, hot_rows)
    everything = seen.unionByName(last).groupBy(scope, "word", "node").agg(F.bit_or("bits").alias("bits"))
    if label is None:
        return everything.select(scope, "node")
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(min(BITS, labels) - 1)), lambda i: F.getbit("bits", i) == 1))
    return everything.select(scope, "word", "node", each.alias("_bit")).select(scope, (F.col("word") * BITS + F.col("_bit")).cast("int").alias(label), "node")


def reachable_assets(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, label: str | None = None, labels: int = 1) -> DataFrame:
    """(scene_id, label, path): the labels of asset nodes reachable from those seeds that are nodes."""
    known = nodes.select("scene_id", F.col("id").alias("node"))
    start = seeds.join(known, ["scene_id", "node"], "left_semi")
    found = reachable(edges, start, label, labels)
    assets = nodes.where("kind = 'asset'").select("scene_id", F.col("id").alias("node"), F.col("label").alias("path"))
    return found.join(assets, ["scene_id", "node"]).select("scene_id", *([label] if label else []), "path").distinct()
