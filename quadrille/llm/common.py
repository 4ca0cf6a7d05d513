"""Helpers shared by the corpus operators: checkpoints, batches, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted table of a few numbers each is broadcast (some MB).
FEW_ROWS = 50_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one where a local master names none (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quadrille-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """cut() for small tables of loops: also drops the size estimate, which a checkpoint keeps.

    Joins multiply estimates, so that those of a loop's tables would double their digits each round.
    """
    spark, written = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(written.javaRDD(), written.schema()), spark)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files and plans of finished steps, which it does as the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Removes a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(uri)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(texts: list, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts holding about `most` characters, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df for the smaller side of a join: broadcast if it has at most FEW_ROWS rows, as `rows` says."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than so many rows need."""
    return df.coalesce(max(1, -(-rows // FEW_ROWS) * 8)) if rows <= 20 * FEW_ROWS else df


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, class_id), class_id the smallest node.

    Labels move to smaller neighbours, then jump along their own labels, until none
    changes. A round is one aggregation with map-side combining and two equi-joins, whose
    skewed side (a centre with many links) the adaptive planner can split; labels of few
    nodes are broadcast. Only counts, and whether a label changed, reach the driver. Nodes
    without edges are not returned.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    # every node is its own neighbour, so that the aggregation sees its label too
    both = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (("u", "v"), ("v", "u"), ("u", "u"), ("v", "v"))])
    links = cut_round(ends.select(F.inline(both)).distinct())
    labels = cut_round(links.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node"))
    nodes = labels.count()
    labels, links = gathered(labels, nodes), gathered(links, 4 * nodes)
    while True:
        here = labels.withColumnRenamed("label", "own")
        near = links.join(bounded(here, nodes), links.v == here.node).groupBy("u").agg(F.min("own").alias("label"), F.max(F.when(F.col("u") == F.col("v"), F.col("own"))).alias("own"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = near.join(bounded(above, nodes), "label").select(F.col("u").alias("node"), F.col("jump").alias("label"), (F.col("jump") < F.col("own")).alias("moved"))
        labels = cut_round(gathered(moved, nodes))
        if not labels.agg(F.max("moved")).first()[0]:
            return labels.select("node", F.col("label").alias("class_id"))
        labels = labels.select("node", "label")


def merged(labels: DataFrame, links: DataFrame, nodes: int) -> DataFrame:
    """The labels (node, class_id), `nodes` in number, after links (a, b) have joined classes; a node without a label is its own class."""
    for end in ("a", "b"):
        own = bounded(labels.select(F.col("node").alias(end), F.col("class_id").alias("_own")), nodes)
        links = links.join(own, end, "left").withColumn(end, F.coalesce("_own", end)).drop("_own")
    moves = components(links)
    turned = bounded(moves.select(F.col("node").alias("class_id"), F.col("class_id").alias("_to")), moves.count())
    known = labels.join(turned, "class_id", "left").select("node", F.coalesce("_to", "class_id").alias("class_id"))
    return cut_round(known.unionByName(moves.join(bounded(labels.select("node"), nodes), "node", "left_anti")))
