"""Removal of long repeated word spans by De Bruijn compaction.

The graph: an edge is a window of ``window`` consecutive words, joined to the next one. Consecutive
windows that share a minimizer (their k-word piece of smallest hash) form a path piece, a run. Every
occurrence of a window lies in a run of the same minimizer, so runs are gathered by minimizer:

* A run that occurs again as a whole does not branch: all its windows repeat, and it stays compact.
* A minimizer with one run only is unique and leaves at once.
* Otherwise the path branches here: one run of each kind is opened at its source coordinates into its
  windows, which are counted; a window that is seen twice repeats.

Scans combine equal runs before they shuffle, so a passage that a third of all texts share sends a
row per task, and windows are counted by their hashes. Identity is 128 bits of independent hashes. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.llm.common import row_key, ship
from needledrop.llm.windows_core import Words, runs
from needledrop.sources.store import settled

_FLUSH = 1 << 19  # runs of one task that are combined at once


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _hashed(data: bytes) -> Words:
    return Words.of(np.frombuffer(data, np.uint8))


_RUN = "mini long, run long, key long, start int, size int, again boolean"


def _scan(window: int, k: int):
    """Runs of all texts. ``again`` marks one that this task has seen twice; a further occurrence is
    known to repeat, needs no partner, and gets a minimizer that spreads it (run null)."""

    def combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        mini, run, key, start, size = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((run, mini))
        m, r = mini[order], run[order]
        same = np.append(False, (m[1:] == m[:-1]) & (r[1:] == r[:-1]))
        again = same | np.append(same[1:], False)
        out_run = pa.array(r.view(np.int64), mask=same)
        spread = np.where(same, key[order] + start[order], m.view(np.int64))
        return pa.RecordBatch.from_pydict(
            {
                "mini": spread, "run": out_run, "key": key[order], "start": pa.array(start[order], pa.int32()),
                "size": pa.array(size[order], pa.int32()), "again": again,
            }
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                words = _hashed(_bytes(text.as_py()))
                start, size, place = runs(words, window, k)
                if not len(start):
                    continue
                mini, run = words.hashes(0, place, k), words.hashes(1, start, size + (window - 1))
                held.append((mini, run, np.full(len(start), key), start, size))
                n += len(start)
                if n >= _FLUSH:
                    yield combined(held)
                    held, n = [], 0
        if held:
            yield combined(held)

    return scan


def _gathered(found: DataFrame) -> DataFrame:
    """Of the runs of each minimizer: those that repeat, and one of each kind where a path branches."""
    group = W.partitionBy("mini")
    order = group.orderBy("run")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    run = F.col("run")
    seen = found.withColumns(
        {
            "_branches": F.min("run").over(whole) < F.max("run").over(whole),
            "_before": F.coalesce(F.lag("run").over(order) == run, F.lit(False)),
            "_after": F.coalesce(F.lead("run").over(order) == run, F.lit(False)),
        }
    )
    repeats = F.col("again") | run.isNull() | F.col("_before") | F.col("_after")
    opened = F.coalesce(F.col("_branches"), F.lit(False)) & run.isNotNull() & ~F.col("_before")
    return seen.where(repeats | opened).select(
        "key", F.struct("start", "size", repeats.alias("repeats"), F.when(opened, F.col("mini")).alias("mini")).alias("run")
    )


# One pass over the texts with their runs gives finished rows, opened runs, and texts that wait for them.
_OPENED = "key long, doc binary, done struct<kept:string,n_words:long,n_removed:long>, spans array<int>, blob binary, mini long, start int, sure boolean, windows array<long>"


_CLOSED = "doc binary, done struct<kept:string,n_words:long,n_removed:long>"


def _covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the words inside [start, end) spans."""
    edge = np.zeros(n + 1, np.int64)
    for start, end in spans:
        edge[start] += 1
        edge[end] -= 1
    return np.cumsum(edge[:-1]) > 0


def _finish(data: bytes, spans: list[tuple[int, int]], digest: bool) -> dict:
    words = data.split()
    gone = _covered(len(words), spans)
    kept = b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g])
    text = hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")
    return {"kept": text, "n_words": len(words), "n_removed": int(gone.sum())}


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Spans as a flat list of starts and ends without overlap."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _open(window: int, digest: bool):
    kind = _arrow_schema(_OPENED)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for key, doc, blob, found in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "blob", "runs"))):
                found = found or []
                data = unpack.decompress(blob)
                spans = [(r["start"], r["start"] + r["size"] + window - 1) for r in found if r["repeats"]]
                opened = [r for r in found if r["mini"] is not None]
                if opened:
                    words = _hashed(data)
                    for r in opened:
                        hashes = words.hashes(1, np.arange(r["start"], r["start"] + r["size"]), window)
                        out.append({"key": key, "mini": r["mini"], "start": r["start"], "sure": r["repeats"], "windows": hashes.view(np.int64)})
                if any(not r["repeats"] for r in opened):
                    out.append({"key": key, "doc": doc, "spans": _merged(spans), "blob": blob})
                else:
                    out.append({"key": key, "doc": doc, "done": _finish(data, spans, digest)})
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    return rows


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _counted(opened: DataFrame, window: int) -> DataFrame:
    """(key, spans): windows of the opened runs that are seen twice, as flat lists of starts and ends.

    A window of a run that repeats counts as two. The sums are combined before they shuffle, so a
    window or minimizer of very many texts is one row per task.
    """
    each = opened.select(
        "key", "mini", "sure", "start", F.posexplode("windows").alias("at", "window")
    )
    twice = F.sum(F.when(F.col("sure"), 2).otherwise(1)).alias("n")
    again = settled(each.groupBy("mini", "window").agg(twice).where("n > 1").select("mini", "window"), "repeated-windows")
    asked = each.where(~F.col("sure")).join(again, ["mini", "window"])
    begin = F.col("start") + F.col("at")
    return asked.groupBy("key").agg(F.collect_set(begin).alias("starts"))


def _close(window: int, digest: bool):
    kind = _arrow_schema(_CLOSED)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, blob, spans, starts in zip(*(batch.column(c).to_pylist() for c in ("doc", "blob", "spans", "starts"))):
                all_spans = list(zip(spans[::2], spans[1::2])) + [(s, s + window) for s in starts or []]
                out.append({"doc": doc, "done": _finish(unpack.decompress(blob), all_spans, digest)})
            yield pa.RecordBatch.from_pylist(out, kind)

    return rows


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = [pack.compress(_bytes(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_pydict(
            {"key": batch.column("key"), "doc": batch.column("doc"), "blob": pa.array(blobs, pa.binary())}
        )


def remove_repeats(docs: DataFrame, window: int = 35, k: int = 12, digest: bool = False) -> DataFrame:
    """(row, kept, n_words, n_removed): documents without the words of windows that occur again.

    ``row`` holds the input columns other than text; ``kept`` the words left, joined by one space, or
    their SHA-256 as lowercase hex with ``digest``. Words are runs of other than ASCII white space. Every
    occurrence of a repeated window is removed, the first included, in the same text or in another;
    windows are judged on the input. Null and empty texts have no word; texts shorter than a window lose
    none; a repeated row repeats all its windows. An empty table gives an empty result.
    """
    if not 0 < k <= window:
        raise ValueError("k must be between 1 and the window")
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string").alias("text")
    # Rows are named by their content: ids may be null or repeated, and equal rows fare alike.
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    named = docs.select(row.alias("row"), text).withColumn("key", row_key("row", "text"))
    found = named.select("key", "text").mapInArrow(_scan(window, k), _RUN)
    # Equal rows share a key and their runs: a set holds each once, and sets are combined before they shuffle.
    # Written, so that the join below can split a key that many rows share.
    runs_of = settled(_gathered(found).groupBy("key").agg(F.collect_set("run").alias("runs")), "runs-by-text")
    # The other columns travel as one JSON value: their names and types cannot clash with ours.
    doc = F.encode(F.to_json("row", {"ignoreNullFields": "false"}), "utf-8").alias("doc")
    packed = named.select("key", doc, "text").mapInArrow(_pack, "key long, doc binary, blob binary")
    opened = settled(packed.join(runs_of, "key", "left").mapInArrow(_open(window, digest), _OPENED), "opened-runs")
    done = opened.where("done IS NOT NULL").select("doc", "done")
    waiting = opened.where("blob IS NOT NULL").select("key", "doc", "blob", "spans")
    counted = _counted(opened.where("windows IS NOT NULL"), window)
    closed = waiting.join(counted, "key", "left").select("doc", "blob", "spans", "starts").mapInArrow(
        _close(window, digest), _CLOSED
    )
    schema = named.schema["row"].dataType
    return done.union(closed).select(F.from_json(F.decode("doc", "utf-8"), schema).alias("row"), "done.*")
