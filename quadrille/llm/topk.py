"""Exact top-k by inner product through KD-trees, one for each shard of vectors.

A tree halves its vectors at the median of the widest axis; every node keeps the tight
bounding box of its vectors. For a query q the largest inner product inside a box is the
sum over axes of max(q_i * low_i, q_i * high_i), so leaves are visited best bound first
until the bound falls below the kth score so far.

Shards are cells of space: the same median splits over a bounded sample, with cells that hold
many rows cut further by a hash. The cells' tight boxes, a table of bounded size, are known
to all tasks. A query first visits a shard of the cell with its best bound; the kth score
found there is propagated, and only shards whose cell's bound reaches it get the query.
Vectors travel for those pairs alone, in blocks of bounded rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import cut

#: Rows of a shard, of a leaf, and queries of a block, on average.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 256, 512
#: Cells of space at most, and vectors of the sample that places their splits (on average).
MOST_CELLS, SAMPLE_ROWS = 1024, 20_000
#: Products below this are exact in floating point; others are computed in whole numbers.
EXACT = float(2**52)
LONG = 2**63 - 1


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(query, box): at least the largest inner product of the query with a point of the box, rounding included."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        slack = 1e-9 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).max(axis=0)) + 1e-9
        bound += slack[:, None]
    return np.where(np.isnan(bound), np.inf, bound)


class KDTree:
    """Median splits with tight boxes over integer-valued rows; ids break ties."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order, bounds = [], []
        self.children: list[tuple[int, int]] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []
        self.leaf: list[int] = []

        def grow(part: np.ndarray) -> int:
            node = len(self.nodes)
            low, high = rows[part].min(axis=0), rows[part].max(axis=0)
            self.nodes.append((low, high)), self.children.append((-1, -1)), self.leaf.append(-1)
            if len(part) > leaf_rows:
                axis = int(np.argmax(high - low))
                middle = len(part) // 2
                split = part[np.argpartition(rows[part, axis], middle)]
                self.children[node] = (grow(split[:middle]), grow(split[middle:]))
            else:
                self.leaf[node] = len(bounds)
                bounds.append((sum(map(len, order)), sum(map(len, order)) + len(part)))
                order.append(part)
            return node

        grow(np.arange(len(ids)))
        place = np.concatenate(order)
        self.ids, self.rows, self.bounds = ids[place], rows[place], bounds
        self.low, self.high = (np.stack(x) for x in zip(*self.nodes))
        del self.nodes

    def products(self, lo: int, hi: int, query: np.ndarray, exact: bool) -> np.ndarray:
        """Inner products with a leaf's rows: doubles that are exact, or else whole numbers cut to the range of a long."""
        if exact:
            return self.rows[lo:hi] @ query
        whole = [int(x) for x in query]
        found = (sum(a * int(b) for a, b in zip(whole, r)) for r in self.rows[lo:hi])
        return np.array([max(-LONG - 1, min(LONG, x)) for x in found], np.int64)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, scores, ids) of each query's best k rows with scores from floor on (a long; its least: all).

        Rows are best score first, then smaller id; a query's own id is left out. Scores are longs.
        """
        ceiling = upper_bounds(queries, self.low, self.high)
        widest = np.abs(queries).max(axis=1, initial=0) * max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)) * max(queries.shape[1], 1)
        for q in range(len(queries)):
            bound, kth, exact = ceiling[q], int(floor[q]), bool(widest[q] < EXACT)
            scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
            frontier = [(-bound[0], 0)]
            while frontier and -frontier[0][0] >= kth:
                node = heapq.heappop(frontier)[1]
                if self.leaf[node] < 0:
                    for child in self.children[node]:
                        if bound[child] >= kth:
                            heapq.heappush(frontier, (-bound[child], child))
                    continue
                lo, hi = self.bounds[self.leaf[node]]
                found = self.products(lo, hi, queries[q], exact)
                good = np.flatnonzero((found >= kth) & (self.ids[lo:hi] != query_ids[q]))
                if not len(good):
                    continue
                scores, ids = np.concatenate([scores, found[good].astype(np.int64)]), np.concatenate([ids, self.ids[lo:hi][good]])
                if len(scores) > k:
                    best = np.lexsort((ids, ~scores))[:k]
                    scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    kth = max(kth, int(scores.min()))
            best = np.lexsort((ids, ~scores))
            yield q, scores[best], ids[best]


def _padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def top_splits(rows: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axis, value and children of the nodes of median splits of a sample into at most `cells` cells.

    A child below zero is the cell ~child; a node's first child takes values up to its value.
    """
    axes, values, children = [], [], []
    count = 0

    def grow(part: np.ndarray, share: int) -> int:
        nonlocal count
        if len(part):
            low, high = rows[part].min(axis=0), rows[part].max(axis=0)
            axis = int(np.argmax(high - low))
        if share < 2 or len(part) < 2 or not high[axis] > low[axis]:
            count += 1
            return ~(count - 1)
        value = float(np.sort(rows[part, axis])[(len(part) - 1) // 2])
        if value == high[axis]:
            value = float(np.max(rows[part, axis][rows[part, axis] < value]))
        node = len(axes)
        axes.append(axis), values.append(value), children.append((0, 0))
        left = rows[part, axis] <= value
        children[node] = (grow(part[left], share // 2), grow(part[~left], share - share // 2))
        return node

    grow(np.arange(len(rows)), cells)
    return np.array(axes, np.int64), np.array(values), np.array(children, np.int64).reshape(-1, 2)


def cells_of(rows: np.ndarray, splits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The cell of each row."""
    axes, values, children = splits
    node = np.zeros(len(rows), np.int64) if len(axes) else np.full(len(rows), ~0)
    while len(open_ := np.flatnonzero(node >= 0)):
        at = node[open_]
        node[open_] = children[at, (rows[open_, axes[at]] > values[at]).astype(np.int64)]
    return ~node


def in_cells(vectors: DataFrame, splits: tuple, width: int) -> DataFrame:
    """(id, vector, cell) of (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells_of(_padded(batch.column(1).to_pylist(), width), splits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32())], names=["id", "vector", "cell"])

    return vectors.select("id", "vector").mapInArrow(run, "id long, vector array<double>, cell int")


def build_trees(vectors: DataFrame, width: int, leaf_rows: int) -> DataFrame:
    """(cell, shard, low, high, tree) of (id, vector, cell, shard), the tree as bytes."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = KDTree(part["id"].to_numpy(np.int64), _padded(list(part["vector"]), width), leaf_rows)
        return pd.DataFrame({"cell": [part["cell"].iloc[0]], "shard": [part["shard"].iloc[0]], "low": [tree.low[0].tolist()], "high": [tree.high[0].tolist()], "tree": [pickle.dumps(tree)]})

    return vectors.groupBy("cell", "shard").applyInPandas(build, "cell int, shard int, low array<double>, high array<double>, tree binary")


def search_blocks(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of (ids, vectors, floors, tree): the best k of each query and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree: KDTree = pickle.loads(row["tree"])
                queries, query_ids = _padded(row["vectors"], tree.rows.shape[1]), np.array(row["ids"], np.int64)
                floor = np.array([-LONG - 1 if x is None else x for x in row["floors"]], np.int64)
                out_q, out_v, out_s = [], [], []
                for q, scores, ids in tree.search(queries, query_ids, k, floor):
                    out_q += [int(query_ids[q])] * len(ids)
                    out_v += ids.tolist()
                    out_s += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.int64())], names=["query_id", "vec_id", "score"])

    return pairs.select("ids", "vectors", "floors", "tree").mapInArrow(run, "query_id long, vec_id long, score long")


def reached_cells(queries: DataFrame, boxes: tuple[np.ndarray, np.ndarray], width: int, best: bool) -> DataFrame:
    """(id, vector, floor, cells) of (id, vector, floor): the cells whose bound reaches the floor, or the best one alone."""
    held = queries.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = upper_bounds(_padded(batch.column(1).to_pylist(), width), *held.value)
            if best:
                cells = [[int(x)] for x in bound.argmax(axis=1)]
            else:
                # a floor is a long: the next double below it at most, so that no cell is lost
                floor = np.array([-np.inf if x is None else np.nextafter(float(x), -np.inf) for x in batch.column(2).to_pylist()])
                cells = [np.flatnonzero(b >= f).tolist() for b, f in zip(bound, floor)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=["id", "vector", "floor", "cells"])

    return queries.select("id", "vector", "floor").mapInArrow(run, "id long, vector array<double>, floor long, cells array<int>")


def in_blocks(rows: DataFrame, per_shard: DataFrame) -> DataFrame:
    """(cell, shard, ids, vectors, floors) of (id, vector, floor, cell, shard): blocks of BLOCK_ROWS queries on average."""
    sized = rows.join(per_shard, ["cell", "shard"])
    block = F.pmod(F.xxhash64(F.lit(1), "id"), F.ceil(F.col("asked") / F.lit(BLOCK_ROWS)))
    grouped = sized.groupBy("cell", "shard", block.alias("block")).agg(F.collect_list(F.struct("id", "vector", "floor")).alias("q"))
    return grouped.select("cell", "shard", F.col("q.id").alias("ids"), F.col("q.vector").alias("vectors"), F.col("q.floor").alias("floors"))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Adds rank: the best k rows of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products with other rows.

    Both inputs hold an id and a vector of whole numbers. Null ids and vectors that are
    null, empty, or hold null or non-finite components take no part; components that one
    of two vectors lacks count as zero; equal ids are one query's own; scores beyond a long are
    cut to its range; ties go to the smaller id. Rows repeated with one id compete as they
    are, and a query that comes again counts once. Empty inputs give an empty result. Other columns are not read.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & fine)

    data, asked = usable(vectors), cut(usable(queries).dropDuplicates(["id", "vector"]))
    size = data.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    # components beyond the widest vector would meet zeros
    width, wanted = size.width or 1, max(1, -(-size.n // shard_rows))
    share = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / max(size.n, 1)) * (1 << 30))
    sample = data.where(share).select("vector").toPandas()["vector"] if wanted > 1 else []
    splits = top_splits(_padded(list(sample), width), min(wanted, MOST_CELLS))
    celled = cut(in_cells(data, splits, width))
    fill = {r.cell: max(1, -(-r.n // shard_rows)) for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    shards = F.create_map(*[F.lit(x) for kv in fill.items() for x in kv]) if fill else F.create_map(F.lit(0), F.lit(1))
    trees = cut(build_trees(celled.withColumn("shard", F.pmod(F.xxhash64("id"), F.element_at(shards, F.col("cell"))).cast("int")), width, leaf_rows))
    ends = trees.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "x")).groupBy("cell", "axis").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).collect()
    low, high = np.zeros((len(splits[0]) + 1, width)), np.zeros((len(splits[0]) + 1, width))
    for r in ends:
        low[r.cell, r.axis], high[r.cell, r.axis] = r.low, r.high

    def visit(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("cell", "shard").agg(F.count("*").alias("asked"))
        return search_blocks(in_blocks(rows, counted).join(trees.select("cell", "shard", "tree"), ["cell", "shard"]), k)

    fits = asked.withColumn("vector", F.slice("vector", 1, width))
    home = reached_cells(fits.withColumn("floor", F.lit(None).cast("long")), (low, high), width, True)
    ways = F.element_at(shards, F.col("cell"))
    first = cut(home.withColumn("cell", F.element_at("cells", 1)).drop("cells").withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "id"), ways).cast("int")))
    near = cut(visit(first))
    kth = near.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("held"))
    floors = kth.select(F.col("query_id").alias("id"), F.when(F.col("held") >= k, F.col("kth")).alias("floor"))
    known = first.withColumnsRenamed({"cell": "_cell", "shard": "_shard"}).drop("floor").join(floors, "id", "left")
    rest = reached_cells(known, (low, high), width, False).withColumn("cell", F.explode("cells")).drop("cells")
    rest = rest.where(F.element_at(shards, F.col("cell")).isNotNull()).withColumn("shard", F.explode(F.sequence(F.lit(0), F.element_at(shards, F.col("cell")) - 1)))
    rest = cut(rest.join(first.select("id", "vector", "cell", "shard"), ["id", "vector", "cell", "shard"], "left_anti"))
    return best_of(near.unionByName(visit(rest)), k).select("query_id", "rank", "vec_id", "score")


def floored(df: DataFrame) -> DataFrame:
    """The embeddings with each component x replaced by floor(64 * x)."""
    scaled = F.transform("embedding", lambda x: F.lit(64.0) * x.cast("double"))
    # beyond 2^52 every double is whole; floor() would not fit a long there
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return df.select("vec_id", whole.alias("embedding"))


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = floored(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 20 = 0"), 20)


ORACLES = {
    "op2_exact_top_k": """
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::double) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select q.vec_id as query_id, r.vec_id, list_inner_product(q.v, r.v)::bigint as score
  from rows q join rows r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20"""
}
