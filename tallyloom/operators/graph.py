"""Relations between nodes as an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.staging import new_path, partitions


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def two_step_neighbours(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) over two edges, without loops back to src."""
    a, b = edges.select("src", F.col("dst").alias("mid")), edges.select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").filter("src <> dst").select("src", "dst").distinct()


def hops(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops): every node that the sources reach along the edges (src, dst), with the fewest edges from any of them; the sources
    themselves have 0. ``most`` stops after so many edges. Null ends are no nodes; cycles end where nothing new is found.

    Edges are dealt once by src, nodes by node, into as many buckets as there are shuffle partitions, so a round moves nothing but the ends of
    its own edges: each edge moves twice in all, whatever the number of rounds. A node's edges lie in one bucket and are read as a stream. Each round's nodes
    are a folder of their own, and all are read back as one table, so the plan does not grow with the rounds; the driver sees one yes or no a round."""
    spark, n = edges.sparkSession, partitions(edges)
    path = new_path(spark, "hops")
    links, nodes = (f"{name}_{path.split('/')[-2]}" for name in ("links", "nodes"))
    ends = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    new = sources.select(F.col(sources.columns[0]).alias("node")).filter("node IS NOT NULL").distinct()
    schema = new.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    try:
        ends.repartition(n, "src").write.bucketBy(n, "src").option("path", new_path(spark, "links")).saveAsTable(links)
        done = 0
        while True:
            new.withColumn("hops", F.lit(done)).write.partitionBy("hops").bucketBy(n, "node").option("path", path).mode("append").saveAsTable(nodes)
            seen = spark.table(nodes)
            frontier = seen.filter(F.col("hops") == done).select("node")
            if done == most or frontier.isEmpty():
                break
            new = _next_nodes(frontier, spark.table(links), seen.select("node"))
            done += 1
    finally:
        for table in (links, nodes):
            spark.sql(f"DROP TABLE IF EXISTS {table}")  # its files stay
    return spark.read.schema(f"{schema}, hops int").parquet(path)


def _next_nodes(frontier: DataFrame, links: DataFrame, seen: DataFrame) -> DataFrame:
    """The nodes one edge from ``frontier`` that are not ``seen``."""
    reached = links.join(frontier.hint("shuffle_hash"), F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
    return reached.join(seen, "node", "left_anti")
