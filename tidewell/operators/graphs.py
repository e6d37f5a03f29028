"""Graphs as edge tables: validation, peeling, components, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which end."""
    a = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").withColumn("end", F.lit("src"))
    b = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").withColumn("end", F.lit("dst"))
    return a.unionByName(b)


def peel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Depth of each node in topological order; null for nodes on or behind a cycle.

    Each round takes the nodes without open predecessors, until none is left; lineage is cut by checkpoints.
    """
    left, out, depth = edges.select("src", "dst"), None, 0
    open_ = nodes.select("node")
    while True:
        free = open_.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if not free.limit(1).count():
            break
        out = free if out is None else out.unionByName(free)
        if depth % 20 == 19:
            out = out.checkpoint()
        open_ = open_.join(free, "node", "left_anti").checkpoint()
        left = left.join(free.select(F.col("node").alias("src")), "src", "left_anti").checkpoint()
        depth += 1
    if out is None:
        return nodes.select("node", F.lit(None).cast("int").alias("depth"))
    return nodes.select("node").join(out, "node", "left")


def fan_in(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum of the values of each node's sources."""
    return edges.join(values.select(F.col("node").alias("src"), "value"), "src").groupBy("dst").agg(F.sum("value").alias("value"))


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each, by propagating minima with pointer jumps until nothing changes."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).checkpoint()
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        step = label.join(near, "node", "left").select("node", F.least("comp", F.coalesce("low", "comp")).alias("comp"), F.col("comp").alias("old"))
        jump = step.join(label.select(F.col("node").alias("comp"), F.col("comp").alias("over")), "comp", "left").select("node", F.least("comp", F.coalesce("over", "comp")).alias("comp"), "old").checkpoint()
        changed = jump.filter("comp <> old").limit(1).count()
        label = jump.select("node", "comp")
        if not changed:
            break
    return label


def history(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """Ancestors of each head by parent links, with their distance; one row per path.

    Each round doubles the distance covered: what a head has reached is joined with jumps of twice the
    length, so a history of a million links takes twenty rounds. Links that form a cycle are an error.
    """
    jump = commits.filter("parent is not null").select("node", F.col("parent").alias("to"))
    walk = heads.select(F.col("node").alias("head"), "node", F.lit(0).alias("distance"))
    turn, links = 0, jump.count()
    while True:
        new = walk.join(jump, "node").select("head", F.col("to").alias("node"), (F.col("distance") + F.lit(1 << turn)).cast("int").alias("distance")).checkpoint()
        if not new.limit(1).count():
            return walk
        if 1 << turn > links:  # each row of this round is that far from its head
            raise ValueError("a history longer than there are links, so they form a cycle")
        walk, turn = walk.unionByName(new), turn + 1
        jump = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.to").alias("to")).checkpoint()


def merged(graphs: list[DataFrame]) -> DataFrame:
    """One edge table: names prefixed by their graph's number, each Output feeding the next Input."""
    out = None
    for i, g in enumerate(graphs):
        p = lambda c: F.concat(F.lit(f"f{i}_"), F.col(c))
        part = g.filter((F.col("dst") != "Output") | F.lit(i == len(graphs) - 1)).select(p("src").alias("src"), p("dst").alias("dst"))
        if i + 1 < len(graphs):
            ends = g.filter("dst = 'Output'").select(p("src").alias("src"))
            begins = graphs[i + 1].filter("src = 'Input'").select(F.concat(F.lit(f"f{i + 1}_"), F.col("dst")).alias("dst"))
            part = part.unionByName(ends.crossJoin(begins))  # the ends of one graph and the begins of the next
        if i:
            part = part.filter(F.col("src") != f"f{i}_Input")
        out = part if out is None else out.unionByName(part)
    return out
