"""Cross-reference edges: normalisation, strongest links, expansion, connected components and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ranking import place_in_parts
from corpusmill.session import cut_lineage

VOTES_ABOVE = 10
#: Vertices of a component are written out between rounds; so many rounds suffice for any graph that fits in a cluster.
MOST_ROUNDS = 60


def votes_above(votes: Column, least: int = VOTES_ABOVE) -> Column:
    """More votes than ``least``, null counting as none."""
    return F.coalesce(votes, F.lit(0)) > least


def strongest_links(edges: DataFrame, source: str, target: str, votes: str, limit: int | None = None) -> DataFrame:
    """(source, target, votes, place): each pair once with its most votes, ranked per source; the first ``limit``.

    Null votes stay null and rank as 0; ties are ordered by target. Pairs are merged before they are ranked. With a
    limit it is applied before the exchange; without one a source's pairs are ranked in parts of equal votes and equal
    beginnings of the target, so a source with a third of all edges is never sorted by one task.
    """
    best = edges.groupBy(source, target).agg(F.max(votes).alias(votes))
    counted = F.coalesce(votes, F.lit(0))
    if limit is not None:
        by = Window.partitionBy(source).orderBy(counted.desc(), F.col(target))
        return best.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit)
    return place_in_parts(best, [source], [(counted, True), (F.substring(target, 1, 6), False)], [F.col(target)])


def expand_links(primary: DataFrame, edges: DataFrame, within: str, item: str, source: str, target: str, votes: str, limit: int = 3) -> DataFrame:
    """(within, target, votes, place): for each group of primary items the best targets that aren't among them."""
    own = primary.select(within, F.col(item).alias(source)).distinct()
    strong = edges.filter(votes_above(F.col(votes))).groupBy(source, target).agg(F.max(votes).alias(votes))
    # of a source's targets, only so many can be among a group's best: others' places are taken by better ones or by the group's own items
    most = own.groupBy(within).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    first = Window.partitionBy(source).orderBy(F.col(votes).desc(), F.col(target))
    strong = strong.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit + most).drop("place")
    found = own.join(strong, source)
    best = found.groupBy(within, target).agg(F.max(votes).alias(votes))
    best = best.join(primary.select(within, F.col(item).alias(target)), [within, target], "left_anti")
    by = Window.partitionBy(within).orderBy(F.col(votes).desc(), F.col(target))
    return best.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit)


def _digest(links: DataFrame) -> tuple:
    """The number of links and two sums over hashes of them, equal for equal sets of links."""
    one, two = (F.sum(F.xxhash64(F.lit(salt), "a", "b").cast("decimal(38,0)")) for salt in (1, 2))
    return tuple(links.agg(F.count("*"), one, two).first())


def components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, root): the smallest node of each node's connected component.

    Large-star and small-star rounds (every node links its greater neighbours, then its smaller ones, to the least it
    knows) over distinct edges, each round written to the checkpoint folder; the rounds grow with the logarithm of the
    longest chain. Self loops make a node a component of its own; edges with a null end are ignored. A node with very
    many edges is never collected: its minimum is an aggregation with a map-side part, and the join that hands it on is
    split by the engine where it is skewed. The rounds end when the links' digest stays.
    """
    ends = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).dropna()
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = cut_lineage(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = _digest(links)
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        links = cut_lineage(small)
        now = _digest(links)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def roll_up(members: DataFrame, edges: DataFrame, source: str, votes: str, labels: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(root, size, vote_total, label, number): components of at least ``least`` nodes, largest first.

    ``labels`` has (node, label): the most frequent one is taken, of equals the first by name, else ``general``. An
    edge's votes count for the component of its source.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    sums = edges.select(F.col(source).alias("node"), F.col(votes).alias("votes")).join(members, "node").groupBy("root").agg(F.coalesce(F.sum("votes"), F.lit(0)).alias("vote_total"))
    out = sizes.join(sums, "root", "left").withColumn("vote_total", F.coalesce("vote_total", F.lit(0)))
    if labels is not None:
        out = out.join(most_frequent(members.join(labels, "node"), "root", "label"), "root", "left")
        out = out.withColumn("label", F.coalesce("label", F.lit("general")))
    else:
        out = out.withColumn("label", F.lit("general"))
    by = Window.orderBy(F.col("size").desc(), F.col("root"))  # components, not nodes
    return out.withColumn("number", F.row_number().over(by))


def most_frequent(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the most frequent non-null value of each group, of equals the smallest."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).count()
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("count"), value)).alias(value))


def cluster_boost(hits: DataFrame, members: str, votes: str, rank: str, within: str, most_members: int = 12, full: int = 250, most: int = 5) -> DataFrame:
    """(within, item, signal): for the first members of each found cluster the share of ``full`` votes, at most 1.

    A member of several clusters takes the highest signal; the first ``most`` members per question in cluster order stay.
    """
    spread = hits.select(within, rank, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(votes), F.lit(0)) / full)).alias("signal"), F.posexplode(F.slice(members, 1, most_members)).alias("at", "item"))
    best = spread.groupBy(within, "item").agg(F.max("signal").alias("signal"), F.min(F.struct(rank, "at")).alias("first_"))
    by = Window.partitionBy(within).orderBy("first_", "item")
    return best.withColumn("place_", F.row_number().over(by)).filter(F.col("place_") <= most).select(within, "item", "signal")
