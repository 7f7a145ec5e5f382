"""Approximate nearest neighbours by a forest of random-projection trees.

Fit: on a bounded, documented sample, each tree splits at the median of a projection on the
difference of two random sample vectors. The forest is broadcast; its size is bounded by the
sample. Index: every row goes to one leaf per tree. Search: one priority queue over all trees
pops the nodes whose side a query misses by the least, until enough leaves are found. Every
candidate of a searched leaf is reranked by its exact inner product.

How many leaves are enough is calibrated: queries from the sample are searched in the sample, where
the exact neighbours are known, and the number that reaches the wanted recall is taken. The nearest
rows of a larger table are nearer still, so its recall is not lower. A query also goes on until it has
seen more than k rows of the sample, or all of it, so no query is left with fewer than k rows.

Each row carries its leaf numbers. Blocks of queries meet blocks of rows, and a cell looks the
searched leaves up among its rows, so a row is written once however many trees there are.

Inner products become angles by one added component, sqrt(M^2 - |x|^2) for a row and 0 for a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.llm.common import partitions, ship
from needledrop.llm.topk import usable
from needledrop.sources.store import settled


_QUERIES = 64  # whose rough scores a cell holds at once


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: child < 0 is leaf -child - 1; roots are nodes 0 .. trees - 1."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    trees: int

    @property
    def width(self) -> int:
        return self.normals.shape[1]


def grow(sample: np.ndarray, trees: int, leaf_rows: int, seed: int) -> Forest:
    """Trees whose leaves hold at most ``leaf_rows`` of the sample, unless its rows are equal."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    normals, offsets, children = [np.zeros(width)] * trees, [0.0] * trees, [[0, 0] for _ in range(trees)]
    leaves = 0
    todo = [(t, np.arange(len(sample))) for t in reversed(range(trees))]
    while todo:
        node, rows = todo.pop()
        a, b = rng.choice(rows, 2) if len(rows) else (0, 0)
        normal = sample[a] - sample[b] if len(rows) else np.zeros(width)
        size = np.linalg.norm(normal)
        normals[node] = normal / size if size > 0 else rng.standard_normal(width) / max(1.0, width**0.5)
        side = sample[rows] @ normals[node]
        offsets[node] = float(np.median(side)) if len(rows) else 0.0
        for at, part in enumerate((rows[side <= offsets[node]], rows[side > offsets[node]])):
            if len(part) <= leaf_rows or len(part) == len(rows):
                children[node][at] = -leaves - 1
                leaves += 1
            else:
                children[node][at] = len(normals)
                normals.append(np.zeros(width))
                offsets.append(0.0)
                children.append([0, 0])
                todo.append((children[node][at], part))
    return Forest(np.array(normals), np.array(offsets), np.array(children), trees)


def leaves_of(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector in each tree."""
    out = np.empty((len(vectors), forest.trees), np.int64)
    for tree in range(forest.trees):
        node = np.full(len(vectors), tree)
        left = np.arange(len(vectors))
        while len(left):
            at = node[left]
            right = np.einsum("ij,ij->i", vectors[left], forest.normals[at]) > forest.offsets[at]
            node[left] = forest.children[at, right.astype(int)]
            left = left[node[left] >= 0]
        out[:, tree] = -node - 1
    return out


def margins(forest: Forest, queries: np.ndarray) -> np.ndarray:
    """The squared margins that each query (row) misses on its way to each leaf (column)."""
    sides = queries @ forest.normals.T - forest.offsets
    missed = np.zeros((len(queries), len(forest.normals)))
    out = np.empty((len(queries), int((forest.children < 0).sum())))
    level = np.arange(forest.trees)
    while len(level):
        for at in (0, 1):
            child = forest.children[level, at]
            wrong = (sides[:, level] > 0) != bool(at)
            total = missed[:, level] + np.where(wrong, sides[:, level] ** 2, 0.0)
            leaf = child < 0
            out[:, -child[leaf] - 1] = total[:, leaf]
            missed[:, child[~leaf]] = total[:, ~leaf]
        level = forest.children[level].ravel()
        level = level[level >= 0]
    return out


def calibrated(forest: Forest, asked: np.ndarray, sample: np.ndarray, own: np.ndarray, leaves: np.ndarray, k: int, recall: float) -> int:
    """The number of leaves after which ``asked`` queries have found the share ``recall`` of their k nearest sample rows.

    ``own`` is the place of each query in the sample, ``leaves`` the leaves of the sample rows.
    """
    if len(sample) < 2:
        return forest.trees
    found = []
    for some in np.array_split(np.arange(len(asked)), max(1, len(asked) // 32)):
        score = asked[some] @ sample.T
        score[np.arange(len(some)), own[some]] = -np.inf
        most = min(k, len(sample) - 1)
        nearest = np.argpartition(-score, most - 1, axis=1)[:, :most]
        order = np.argsort(margins(forest, asked[some]), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        reached = np.take_along_axis(place[:, None, :], leaves[nearest], axis=2).min(axis=2)
        found.append(reached.ravel())
    at = np.sort(np.concatenate(found))
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1


def search_leaves(forest: Forest, query: np.ndarray, enough: Callable[[list[int]], bool]) -> list[int]:
    """Leaves by a queue shared by the trees, ordered by the squared margins missed on the way, until ``enough``."""
    sides = forest.normals @ query - forest.offsets
    queue = [(0.0, tree) for tree in range(forest.trees)]
    heapq.heapify(queue)
    found: list[int] = []
    while queue:
        missed, node = heapq.heappop(queue)
        if node < 0:
            found.append(-node - 1)
            if enough(found):
                break
            continue
        side = sides[node]
        near = int(side > 0)
        heapq.heappush(queue, (missed, int(forest.children[node, near])))
        heapq.heappush(queue, (missed + side * side, int(forest.children[node, 1 - near])))
    return found


def _vectors(rows: pa.RecordBatch | pa.Table, name: str, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled with zeros."""
    col = rows.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.diff(np.asarray(col.offsets))
    out = np.zeros((len(sizes), width))
    flat = np.asarray(col.flatten(), dtype=np.float64)
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


def _candidates(order: np.ndarray, starts: np.ndarray, ends: np.ndarray, searched: np.ndarray, n: int) -> np.ndarray:
    """The rows in searched leaves, once each; ``order`` lists (row, tree) places by leaf."""
    first, size = starts[searched], ends[searched] - starts[searched]
    place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    seen = np.zeros(n, bool)
    seen[order[place]] = True
    return np.flatnonzero(seen)


def _rerank(k: int, width: int, trees: int, n_leaves: int):
    def cell(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = {"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)}
        if not queries.num_rows or not rows.num_rows:
            return pa.table(empty)
        ask, have = _vectors(queries, "v", width), _vectors(rows, "v", width)
        own, ids = np.asarray(queries.column("id")), np.asarray(rows.column("id"))
        leaf = np.frombuffer(b"".join(rows.column("leaves").to_pylist()), np.int32)
        order = np.argsort(leaf, kind="stable")
        at_leaf = np.arange(n_leaves)
        starts, ends = (np.searchsorted(leaf[order], at_leaf, side=x) for x in ("left", "right"))
        order //= trees
        # Sums in another order differ by less than this.
        slack = 1e-12 * (1.0 + np.abs(ask).sum(axis=1) * np.abs(have).max())
        out_q, out_i, out_s = ([e] for e in empty.values())
        for block in range(0, len(ask), _QUERIES):
            near = [
                _candidates(order, starts, ends, np.frombuffer(s, np.int32), len(have))
                for s in queries.column("leaves")[block : block + _QUERIES].to_pylist()
            ]
            # One product for the block where most rows are somebody's candidates, else one per query.
            dense = sum(map(len, near)) * 8 > len(have) * len(near)
            rough = have @ ask[block : block + _QUERIES].T if dense else None
            for j, at in enumerate(near):
                q = block + j
                at = at[ids[at] != own[q]]
                score = rough[at, j] if dense else have[at] @ ask[q]
                if len(at) > 2 * k:
                    # Rough scores choose whom to score exactly; equal rows may fill several places.
                    cut = np.partition(score, len(at) - k)[len(at) - k]
                    at = at[score >= cut - slack[q]]
                score = inner(have[at], ask[q])
                best = np.lexsort((ids[at], -score))[:k]
                out_q.append(np.full(len(best), own[q]))
                out_i.append(ids[at][best])
                out_s.append(score[best])
        return pa.table({c: np.concatenate(v) for c, v in zip(empty, (out_q, out_i, out_s))})

    return cell


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products added up in the order of the components, the same in every cell."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += rows[:, d] * query[d]
    return total


def neighbours(
    queries: DataFrame,
    rows: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector: str = "embedding",
    trees: int = 12,
    sample_rows: int = 16384,
    leaf_rows: int = 64,
    recall: float = 0.97,
    calibration_queries: int = 256,
    query_rows: int = 4096,
    block_rows: int = 65536,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found per query.

    ``sample_rows`` rows (smallest hashes of id and vector) fit the trees, and ``calibration_queries`` of them find how
    many leaves reach ``recall`` in the sample; every row is indexed. Each query has k rows, or all where there are
    fewer. A row with the query's own id is left out; ties go to the smaller id. Rows with a null id or a
    vector that is null, zero, or holds null, NaN or infinite components take no part. Equal (id, vector)
    rows count once. No rows give no result.
    """
    spark = rows.sparkSession
    ship(spark)

    def fit(df: DataFrame) -> DataFrame:
        ok = usable(vector) & F.exists(vector, lambda x: x != 0) & F.col(id_col).isNotNull()
        return df.where(ok).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).dropDuplicates(["id", "v"])

    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    have = settled(fit(rows), "forest-rows")
    asked = settled(fit(queries), "forest-queries")
    facts = have.agg(F.max(square).alias("norm2"), F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    ask_facts = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not facts["n"] or not ask_facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    limit, width = float(facts["norm2"]), max(int(facts["width"]), int(ask_facts["width"]))
    drawn = have.orderBy(F.xxhash64("id", "v", F.lit(seed)), "id").limit(sample_rows).toArrow()
    lifted = _lifted(drawn, width, limit)
    forest = grow(lifted, trees, leaf_rows, seed)
    n_leaves = int((forest.children < 0).sum())
    members, names = leaves_of(forest, lifted), np.asarray(drawn.column("id"))
    own = np.arange(min(calibration_queries, len(lifted)))
    plain = _vectors(drawn, "v", width + 1)
    wanted = calibrated(forest, plain[own], plain, own, members, k, recall)
    shared = spark.sparkContext.broadcast((forest, members, names))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaves_of(shared.value[0], _lifted(batch, width, limit)).astype(np.int32)
            leaves = pa.array([x.tobytes() for x in leaf], pa.binary())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": batch.column("v"), "leaves": leaves})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_of, leaves_by_row, ids = shared.value

        def rows_seen(found: list[int], own: int) -> bool:
            """Whether more than k rows of the sample, or all, lie in the leaves found; asked at doubling numbers."""
            size = len(found)
            if size < wanted or (size > wanted and size & (size - 1)):
                return False
            searched = np.zeros(n_leaves, bool)
            searched[found] = True
            seen = searched[leaves_by_row].any(axis=1)
            return bool(seen.all()) or int((seen & (ids != own)).sum()) > k

        for batch in batches:
            leaves = []
            for name, q in zip(batch.column("id").to_pylist(), _vectors(batch, "v", width + 1)):
                leaves.append(np.array(search_leaves(trees_of, q, lambda found: rows_seen(found, name)), np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": batch.column("v"), "leaves": pa.array(leaves, pa.binary())})

    kind = dict(have.dtypes)["v"]
    schema = f"id long, v {kind}, leaves binary"
    across, down = -(-int(facts["n"]) // block_rows), -(-int(ask_facts["n"]) // query_rows)
    # A row has one of `across` blocks and goes to every block of queries; a query the other way round.
    own_block = F.pmod(F.xxhash64("id", "v"), F.lit(across)).cast("int").alias("i")
    placed = have.mapInArrow(index, schema).select("*", own_block, F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("j"))
    ask_block = F.pmod(F.xxhash64("id", "v"), F.lit(down)).cast("int").alias("j")
    # Queries are few and narrow, and searching is the longest part of the work: deal them over all tasks.
    wide = asked.repartition(partitions(queries), "id").withColumn("v", F.col("v").cast(kind)).mapInArrow(ask, schema)
    wide = wide.select("*", ask_block, F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("i"))
    cells = wide.groupBy("i", "j").cogroup(placed.groupBy("i", "j"))
    found = cells.applyInArrow(_rerank(k, width, trees, n_leaves), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lifted(rows: pa.RecordBatch | pa.Table, width: int, limit: float) -> np.ndarray:
    v = _vectors(rows, "v", width)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, limit - (v * v).sum(axis=1)))])
