"""Network graph operators over edge tables (edge_id, u, v, length, ...)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for rows that cut a lineage: the session's, or that of spark.checkpoint.dir; a temporary one only where the master is local."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and reads them from there; sets a folder only where the session has none."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut_lineage, but as a Parquet table in that folder: smaller where there are many rows, and columns can be read alone."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _star(e: DataFrame, large: bool) -> DataFrame:
    """e: (a, b) with a < b. large: connects each node's larger neighbours to its least one; else the smaller ones."""
    down = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    around = down.unionByName(e.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else down
    low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = e.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u").select("v", "m")
    else:
        out = down.join(low, "u").select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m"))
    return out.filter("v <> m").select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node reachable, for every node of an edge between different nodes.

    Alternating large-star and small-star rounds: pre-aggregated minima and joins over the edge list, cut by a checkpoint, so a
    node of many edges is never gathered. Nulls and loops are ignored, repeated and reversed pairs count once.
    """
    e = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = mark(e)
    while was[0]:
        e = cut_lineage(_star(_star(e, True), False))
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed form of an undirected edge table: each edge from either end."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select("u", "v", *rest).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def reduce_parallel(edges: DataFrame, *order: str) -> DataFrame:
    """Of the edges between the same two nodes the first by order (the earlier row on ties); self-loops go."""
    pair = [F.least("u", "v"), F.greatest("u", "v")]
    w = Window.partitionBy(*pair).orderBy(*(order or ("length",)), "edge_id")
    return edges.filter("u <> v").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree), self-loops left out."""
    ends = edges.filter("u <> v").select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def dangling(edges: DataFrame) -> DataFrame:
    return degree(edges).filter("degree = 1").select("node")


def prune_spurs(edges: DataFrame, least: float, src: str | None = None) -> DataFrame:
    """Takes out edges shorter than least that end in a node of degree 1, until none is left."""
    left = cut_lineage(edges)
    n = left.count()
    while True:
        ends = dangling(left)
        short = (F.col("length") < least) & (F.lit(True) if src is None else F.col("src") == src)
        spur = left.filter(short).select("edge_id", F.explode(F.array("u", "v")).alias("node")).join(ends, "node", "left_semi").select("edge_id").distinct()
        left = cut_lineage(left.join(spur, "edge_id", "left_anti"))
        was, n = n, left.count()
        if n == was:
            return left


def cluster_endpoints(ends: DataFrame, reach: float) -> DataFrame:
    """Endpoints (id, x, y) within reach of each other, transitively, become one node: (id, node, node_x, node_y), at their mean. Those at one place are compared once."""
    from penumbra.operators.spatial import self_pairs

    places = ends.filter("x is not null and y is not null").groupBy("x", "y").agg(F.min("id").alias("place"))
    roots = connected_components(self_pairs(places.withColumnRenamed("place", "id"), "id", reach)).withColumnRenamed("node", "place")
    labelled = places.join(roots, "place", "left").select("x", "y", F.coalesce("root", "place").alias("root"))
    named = cut_lineage(ends.join(labelled, ["x", "y"], "left").withColumn("node", F.coalesce("root", "id")).select(*ends.columns, "node"))
    middle = named.groupBy("node").agg(F.avg("x").alias("node_x"), F.avg("y").alias("node_y"))
    return named.join(middle, "node").select("id", "node", "node_x", "node_y")


def main_component(edges: DataFrame, by: str = "length") -> int | None:
    """The root of the main component: of the greatest total length (by="length"), or of the most node pairs; ties to the least root."""
    labelled = edges.join(connected_components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnRenamed("node", "u"), "u")
    score = F.sum("length") if by == "length" else F.count_distinct("u", "v")
    top = labelled.groupBy("root").agg(score.alias("s")).orderBy(F.desc("s"), "root").first()
    return top and top["root"]


def prefix_sums(df: DataFrame, key: str, value: str, name: str = "before") -> DataFrame:
    """df and the sum of value over the rows of lesser keys (unique), by sums of key ranges, so that no task sorts all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))  # one row for each range
    base = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    w = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("__part", "__base")


def renumber(df: DataFrame, key: str) -> DataFrame:
    """(key, number): dense numbers from 0 in order of the key."""
    return prefix_sums(df.select(key).distinct().withColumn("__one", F.lit(1)), key, "__one", "number").drop("__one")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, first, n, neighbours): compressed adjacency, first being the sum of the sizes before; neighbours as sorted (v, edge_id)."""
    out = both_ways(edges).groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", "edge_id"))).alias("neighbours")).withColumn("n", F.size("neighbours"))
    return prefix_sums(out, "u", "n", "first").select(F.col("u").alias("node"), "first", "n", "neighbours")


def bridge_ends(links: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Accepts candidate links (link, a, b, priority, distance) between components, least (priority, distance, link) first.

    Rounds of mutual choice: each component proposes its best link to another one, the proposals are accepted and components
    merge, until no link joins two. This gives the minimum spanning forest of the candidates, as a one-pass union-find in that
    order does. links: node ids; edges: (u, v).
    """
    base = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    accepted = None
    for _ in range(rounds):
        joined = base if accepted is None else base.unionByName(accepted.select("a", "b"))
        roots = cut_lineage(connected_components(joined))
        ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = links.join(ra, "a", "left").join(rb, "b", "left").withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b")).filter("ra <> rb")
        best = live.select(F.explode(F.array("ra", "rb")).alias("root"), F.struct("priority", "distance", "link").alias("rank")).groupBy("root").agg(F.min("rank").alias("rank"))
        chosen = cut_lineage(links.join(best.select("rank.link").distinct(), "link", "left_semi"))
        if chosen.isEmpty():
            break
        accepted = chosen if accepted is None else cut_lineage(accepted.unionByName(chosen).distinct())
    return links.limit(0) if accepted is None else accepted


def contract_streets(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """(edge_id, street): edges of one street share the least edge_id of a chain through nodes of degree 2 that are not in keep (node)."""
    inner = degree(edges).filter("degree = 2").select("node").join(keep, "node", "left_anti")
    ends = edges.filter("u <> v").select("edge_id", F.explode(F.array("u", "v")).alias("node")).join(inner, "node", "left_semi")
    pairs = ends.groupBy("node").agg(F.min("edge_id").alias("a"), F.max("edge_id").alias("b"))
    roots = connected_components(pairs.select("a", "b")).withColumnRenamed("node", "edge_id")
    return edges.select("edge_id").join(roots, "edge_id", "left").select("edge_id", F.coalesce("root", "edge_id").alias("street"))
