"""Consolidating pairwise matches into groups: rake, compress, solve the core, restore.

Every round strips vertices of degree one onto their neighbour (rake) and removes an independent set of degree-two
vertices, joining their two neighbours by an edge (one step of list ranking on the chains).  Trees, chains and cycles
dissolve after a number of rounds that grows with the logarithm of their size.  What is left has minimum degree three;
it is solved by alternating large-star and small-star steps.  Removed vertices point to a vertex that outlived them, so
pointer doubling restores their labels in a logarithmic number of joins.

No link, component or vertex list reaches the driver; only counts do.  Every frame between rounds is a written table.

Edge cases: null or blank ids and self-pairs are left out (they link nothing); repeated and turned pairs count once; an
empty input gives an empty result; ids are compared as strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.session import scratch


def _adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges (a, b) as (v, u)."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))
    return edges.select(F.inline(ends))


def _ordered(x, y) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _removable(edges: DataFrame, turn: int) -> DataFrame:
    """(v, n1, n2): the leaves and the independent degree-two vertices of this round; n2 is null for a leaf."""
    low = (
        _adjacency(edges)
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("d"), F.min("u").alias("n1"), F.max("u").alias("n2"))
        .where("d <= 2")
    )
    rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))
    one = low.select(F.col("v").alias("n1"), F.col("d").alias("d1"))
    two = low.select(F.col("v").alias("n2"), F.col("d").alias("d2"))
    near = low.join(one, "n1", "left").join(two, "n2", "left")
    first = lambda d, n: F.col(d).isNull() | ((F.col(d) == 2) & (F.struct(rank("v"), "v") < F.struct(rank(n), n)))
    leaf = (F.col("d") == 1) & ~((F.coalesce("d1", F.lit(3)) == 1) & (F.col("v") < F.col("n1")))
    chain = (F.col("d") == 2) & first("d1", "n1") & first("d2", "n2")
    return near.where(leaf | chain).select("v", "n1", F.when(F.col("d") == 2, F.col("n2")).alias("n2"))


def _core_labels(edges: DataFrame, area) -> DataFrame:
    """(v, label) of the vertices of a graph by alternating large-star and small-star."""
    given, before = edges, None
    while True:
        near = _adjacency(edges)
        least = near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = near.where("u > v").join(least, "v").select(*_ordered(F.col("u"), F.col("m"))).where("a <> b").distinct()
        large = area.table(large, "large")
        low = large.select(F.col("b").alias("v"), F.col("a").alias("u"))
        least = low.groupBy("v").agg(F.min("u").alias("m"))
        small = low.join(least, "v").select(F.inline(F.array(F.struct(*_ordered(F.col("u"), F.col("m"))), F.struct(*_ordered(F.col("v"), F.col("m")))))).where("a <> b").distinct()
        small = area.table(small, "small")
        now = tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        area.drop(large, *([] if edges is given else [edges]))
        edges = small
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v"))
    return edges.select(F.col("b").alias("v"), F.col("a").alias("label")).unionByName(roots)


def connected_groups(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(record_id, group_id) of every id that is linked to another one; group_id is the smallest id of its component."""
    area = scratch(pairs.sparkSession)
    x, y = F.col(left).cast("string"), F.col(right).cast("string")
    links = pairs.select(*_ordered(x, y)).where((F.trim("a") != "") & (F.trim("b") != "") & (F.col("a") != F.col("b"))).distinct()
    first = edges = area.table(links, "edges")
    removed, count, turn = [], edges.count(), 0
    while count:
        turn += 1
        gone = area.table(_removable(edges, turn), "removed")
        lost = gone.count()
        if not lost:
            break
        removed.append(gone.select("v", F.col("n1").alias("p")))
        ids = gone.select("v")
        kept = edges.join(ids.withColumnRenamed("v", "a"), "a", "left_anti").join(ids.withColumnRenamed("v", "b"), "b", "left_anti")
        bridges = gone.where("n2 is not null").select(*_ordered(F.col("n1"), F.col("n2")))
        after = area.table(kept.select("a", "b").unionByName(bridges).distinct(), "edges")
        if edges is not first:
            area.drop(edges)
        edges, count = after, after.count()
    vertices = _adjacency(first).select("v").distinct()
    if removed:
        pointers = area.table(reduce(DataFrame.unionByName, removed), "pointers")
        depth = 1
        while depth < turn:  # a pointer leads to a later round, so `turn` steps reach the end
            over = pointers.select(F.col("v").alias("p"), F.col("p").alias("q"))
            after = area.table(pointers.join(over, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "pointers")
            area.drop(pointers)
            pointers, depth = after, depth * 2
        rooted = vertices.join(pointers, "v", "left").select("v", F.coalesce("p", "v").alias("root"))
    else:
        rooted = vertices.withColumn("root", F.col("v"))
    if count:
        core = area.table(_core_labels(edges, area), "core").select(F.col("v").alias("root"), "label")
        rooted = rooted.join(core, "root", "left").select("v", F.coalesce("label", "root").alias("root"))
    rooted = area.table(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("v").alias("group_id"))
    return rooted.join(names, "root").select(F.col("v").alias("record_id"), "group_id")
