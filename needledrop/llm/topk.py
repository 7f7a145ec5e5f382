"""Exact top-k inner-product search over integer vectors by MaxScore.

A query is a list of terms (dimension, weight); a shard of candidates is a list of postings per
dimension. A term adds at most its bound to a score. In a shard, the terms are ordered by bound; the
longest tail whose bounds together cannot lift a candidate over the k-th best score is
non-essential. The postings of the essential terms are added up for every candidate of a block; the
others are probed, largest bound first, only for candidates that can still win. Shards are
independent and their lists are merged by a window over a query.

Queries and candidates meet in cells of bounded size (``common.grid``), so neither side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.llm.common import grid, ship

_PROBE = 8  # terms probed between two looks at who can still win
_BLOCK = 2048  # candidates added up at once
_EXACT = 2**53  # sums below this are exact in a double


def usable(vector: str) -> Column:
    """True for vectors that are not null and hold only finite components; the empty vector counts."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def quantised(vector: str, scale: int) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def _matrix(rows: pa.Table, name: str, width: int) -> np.ndarray:
    """Vectors as rows; a vector that is shorter has no postings in the dimensions it lacks."""
    col = rows.column(name).combine_chunks()
    ends = np.cumsum(np.diff(np.asarray(col.offsets, dtype=np.int64)))
    sizes = np.diff(ends, prepend=0)
    flat = np.asarray(col.flatten(), dtype=np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def _width(rows: pa.Table, name: str) -> int:
    sizes = np.diff(np.asarray(rows.column(name).combine_chunks().offsets))
    return int(sizes.max(initial=0))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def search_shard(
    query: np.ndarray, own: int, postings: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of one shard for one query; ``postings`` has a row per candidate."""
    bound = np.maximum(query * high, query * low)
    order = np.argsort(np.minimum(query * high, query * low) - bound, kind="stable")  # widest first
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # rest[i]: the most that terms i.. can add
    floor = np.append(np.cumsum(np.minimum(query * high, query * low)[order][::-1])[::-1], 0)
    weights = query[order]
    top, top_ids = np.empty(0, query.dtype), np.empty(0, np.int64)
    for at in range(0, len(ids), _BLOCK):
        block, names = postings[at : at + _BLOCK], ids[at : at + _BLOCK]
        least = top[-1] if len(top) == k else None
        # Essential terms: without them, no candidate reaches the k-th best score.
        spread = rest - floor
        essential = len(order) if least is None else int(np.argmax(spread + floor[0] < least)) if (spread + floor[0] < least).any() else len(order)
        partial = block[:, order[:essential]] @ weights[:essential]
        alive = np.flatnonzero(names != own)
        if least is not None:
            alive = alive[partial[alive] + rest[essential] >= least]
        for term in range(essential, len(order), _PROBE):
            if not len(alive):
                break
            some = order[term : term + _PROBE]
            partial[alive] += block[np.ix_(alive, some)] @ query[some]
            alive = alive[partial[alive] + rest[min(term + _PROBE, len(order))] >= least]
        top, top_ids = _best(np.append(top, partial[alive]), np.append(top_ids, names[alive]), k)
    return top, top_ids


def _cell(k: int):
    def cell(queries: pa.Table, shard: pa.Table) -> pa.Table:
        width = max(_width(queries, "terms"), _width(shard, "terms"))
        ask, postings = _matrix(queries, "terms", width), _matrix(shard, "terms", width)
        own, ids = np.asarray(queries.column("id")), np.asarray(shard.column("id"))
        if len(ids) and width * int(np.abs(ask).max(initial=0)) * int(np.abs(postings).max(initial=0)) < _EXACT:
            ask, postings = ask.astype(np.float64), postings.astype(np.float64)
        high = postings.max(axis=0, initial=0) if not len(ids) else postings.max(axis=0)
        low = postings.min(axis=0, initial=0) if not len(ids) else postings.min(axis=0)
        found = [search_shard(q, o, postings, ids, high, low, k) for q, o in zip(ask, own)]
        sizes = [len(i) for _, i in found]
        joined = lambda parts, kind: np.concatenate([*parts, np.empty(0)]).astype(kind)
        return pa.table(
            {
                "query_id": np.repeat(own, sizes).astype(np.int64),
                "vec_id": joined((i for _, i in found), np.int64),
                "score": joined((s for s, _ in found), np.int64) if ask.dtype != np.int64
                else np.concatenate([*(s for s, _ in found), np.empty(0, np.int64)]),
            }
        )

    return cell


def exact_top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    query_rows: int = 2048,
    shard_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest integer inner product per query.

    Components become floor(scale * x). A candidate with the query's own id is left out, ties go to
    the smaller id, fewer than k candidates give fewer rows. Rows with a null id or a vector that is
    null or holds null, NaN or infinite components take no part; a shorter vector counts as zero in
    the dimensions it lacks. Rows that repeat an id are separate candidates. Scores must fit a long.
    """
    ship(queries.sparkSession)

    def terms(df: DataFrame) -> DataFrame:
        fit = df.where(usable(vector) & F.col(id_col).isNotNull())
        return fit.select(F.lit(0).alias("shard"), F.col(id_col).cast("bigint").alias("id"), quantised(vector, scale).alias("terms"))

    found = grid(
        terms(queries), terms(candidates), ["shard"], "id", "id", query_rows, shard_rows,
        _cell(k), "query_id long, vec_id long, score long",
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
