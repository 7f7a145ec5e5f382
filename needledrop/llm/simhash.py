"""Near-duplicate documents by SimHash, linked through the anchors of a covering code.

64 bits hold two halves of 31 bits. Two fingerprints that differ in at most three bits differ in at
most one bit of one half. Per half, the anchors are the codewords of the Hamming code of length 31: its
covering radius is 1, so every fingerprint has one home anchor. A fingerprint is replicated to every
anchor within covering radius plus one, at most 16 of them, so it meets every partner at that
partner's home. At an anchor, homes are compared with all rows on all 64 bits, and only the links of a
spanning forest leave.

Equal fingerprints are one node. Anchors with many rows are passed on to a grid of bounded cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import grid, partitions, ship
from needledrop.llm.components import components
from needledrop.sources.store import settled

SEED = 42
_HALF = 31  # length of the Hamming code with 5 check bits
_HALVES = (0, _HALF)  # first bits of the halves; bits 62 and 63 are only compared
_PIECE = 1 << 15  # shingles whose bits are counted at once
_PAIRS = 1 << 20  # pairs compared at once


def fingerprint64(text: str | None, words_each: int = 3) -> int:
    """SimHash of the shingles of a whole text, signed; zero when it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < words_each:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(words_each)))), len(words) - words_each + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        part = np.fromiter(hashes, dtype=np.uint64, count=min(_PIECE, n - at))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(words_each: int, carry: tuple[str, ...]):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint64(t.as_py(), words_each) for t in batch.column("text")]
            more = {c: batch.column(c) for c in carry}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "mark": pa.array(marks, pa.int64())} | more)

    return draw


def fingerprints(docs: DataFrame, words_each: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, mark): the signed 64-bit SimHash of every text, and the columns ``carry``."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kinds = dict(narrow.dtypes)
    schema = ", ".join(["doc_id long", "mark long", *(f"{c} {kinds[c]}" for c in carry)])
    return narrow.mapInArrow(_fingerprints(words_each, carry), schema)


def _syndrome(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for bit in range(_HALF):
        out ^= np.where((x >> np.uint64(bit)) & np.uint64(1), bit + 1, 0)
    return out


def _flip(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Flip bit ``place`` - 1; place 0 flips nothing."""
    return np.where(place > 0, x ^ (np.uint64(1) << np.maximum(place - 1, 0).astype(np.uint64)), x)


def anchors(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of all anchors within distance 2 in a half."""
    rows, names, homes = [], [], []
    mask = np.uint64((1 << _HALF) - 1)
    for side, start in enumerate(_HALVES):
        half = (marks.view(np.uint64) >> np.uint64(start)) & mask
        place = _syndrome(half)
        tag = np.uint64(side << _HALF)
        rows.append(np.arange(len(marks)))
        names.append(_flip(half, place) | tag)
        homes.append(np.ones(len(marks), bool))
        for a in range(1, _HALF + 1):
            # Bits a and b with a xor b = syndrome lead to a codeword; each pair once.
            b = a ^ place
            ok = np.flatnonzero((place > 0) & (a < b) & (b <= _HALF))
            rows.append(ok)
            names.append(_flip(_flip(half[ok], np.full(len(ok), a)), b[ok]) | tag)
            homes.append(np.zeros(len(ok), bool))
    return np.concatenate(rows), np.concatenate(names).view(np.int64), np.concatenate(homes)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.asarray(batch.column("mark"))
        row, anchor, home = anchors(marks)
        yield pa.RecordBatch.from_pydict({"anchor": anchor, "mark": marks[row], "home": home})


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every linked node that is not its component's smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def close_pairs(homes: np.ndarray, others: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that differ in at most ``most`` bits."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, _PAIRS // max(1, len(others)))
    for at in range(0, len(homes), step):
        some = homes[at : at + step]
        x, y = np.nonzero(np.bitwise_count(some[:, None].view(np.uint64) ^ others[None, :].view(np.uint64)) <= most)
        different = some[x] != others[y]
        a, b = forest(np.append(a, some[x[different]]), np.append(b, others[y[different]]))
    return a, b


def _small_cells(anchor: np.ndarray, mark: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links at many small anchors; rows are sorted by anchor."""
    starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    sizes = np.diff(np.append(starts, len(anchor)))
    cell = np.repeat(np.arange(len(starts)), sizes)
    ask = np.flatnonzero(home & (sizes[cell] > 1))
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(sizes[cell[ask]])
    at = 0
    while at < len(ask):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        some = ask[at:stop]
        n = sizes[cell[some]]
        x = np.repeat(some, n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[cell[some]], n)
        near = (np.bitwise_count(mark[x].view(np.uint64) ^ mark[y].view(np.uint64)) <= most) & (mark[x] != mark[y])
        a, b = forest(np.append(a, mark[x[near]]), np.append(b, mark[y[near]]))
        at = stop
    return a, b


def _meet(most: int, cell_rows: int):
    """Compare at each anchor; rows of a larger anchor pass through. Batches come sorted by anchor."""

    def out(a: np.ndarray, b: np.ndarray, anchor: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "anchor": anchor, "home": pa.array(home, pa.bool_())}
        )

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return out(a, b, pa.nulls(len(a), pa.int64()), np.zeros(len(a), bool))

    def passed(anchor: np.ndarray, mark: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        return out(mark, mark, pa.array(anchor, pa.int64()), home)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        large = None  # the anchor whose rows are being passed on
        for batch in batches:
            held = tuple(
                np.append(h, np.asarray(batch.column(c).to_numpy(zero_copy_only=False)).astype(h.dtype))
                for h, c in zip(held, ("anchor", "mark", "home"))
            )
            anchor = held[0]
            if not len(anchor):
                continue
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            sizes = np.diff(np.append(starts, len(anchor)))
            big = np.repeat((sizes > cell_rows) | (anchor[starts] == (large if large is not None else anchor[0] - 1)), sizes)
            if big.any():
                yield passed(*(h[big] for h in held))
            small = ~big
            small[cut:] = False
            if small.any():
                yield links(*_small_cells(*(h[small] for h in held), most))
            large = anchor[-1] if big[-1] else None
            held = tuple(h[cut:][~big[cut:]] for h in held)
        if len(held[0]):
            yield links(*_small_cells(*held, most))

    return meet


def links(marks: DataFrame, most: int = 3, cell_rows: int = 4096) -> DataFrame:
    """(a, b) between distinct fingerprints: a spanning forest of all pairs within ``most`` bits.

    ``marks`` has one row per fingerprint, in the column mark. ``most`` may be 0 to 3.
    """
    if not 0 <= most <= 3:
        raise ValueError("two halves of radius one cover distances up to 3")
    ship(marks.sparkSession)
    spread = marks.select("mark").mapInArrow(_spread, "anchor long, mark long, home boolean")
    dealt = spread.repartition(partitions(marks), "anchor").sortWithinPartitions("anchor")
    met = settled(dealt.mapInArrow(_meet(most, cell_rows), "a long, b long, anchor long, home boolean"), "anchor-links")
    small = met.where("anchor IS NULL").select("a", "b")
    rest = met.where("anchor IS NOT NULL").select("anchor", F.col("a").alias("mark"), "home")

    def cell(homes: pa.Table, others: pa.Table) -> pa.Table:
        a, b = close_pairs(np.asarray(homes.column("mark")), np.asarray(others.column("mark")), most)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    hot = grid(
        rest.where("home").select("anchor", "mark"), rest.select("anchor", "mark"), ["anchor"], "mark", "mark",
        cell_rows, cell_rows, cell, "a long, b long",
    )
    return small.union(hot)


def near_duplicates(
    docs: DataFrame, most: int = 3, cell_rows: int = 4096, words_each: int = 3, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, fingerprint, component_id, root) of every row of documents (doc_id, text), and the columns ``carry``.

    Fingerprints of shingles of ``words_each`` words link at ``most`` or fewer differing bits. Texts without a word,
    null ones included, have fingerprint zero and are linked like any other. ``component_id`` is the smallest
    doc_id in reach; null ids are never the smallest, so it is null where all ids are. ``root`` is a number of
    the component that is never null. Repeated rows are in one component. Other columns are ignored; an
    empty table gives an empty result.
    """
    marked = settled(fingerprints(docs, words_each, carry), "fingerprints")
    nodes = settled(marked.groupBy("mark").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    parts = components(links(nodes, most, cell_rows))
    rooted = nodes.join(parts.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    rooted = settled(rooted, "fingerprint-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = settled(rooted.join(named, "root").select("mark", "component_id", "root"), "fingerprint-components")
    return marked.join(labels, "mark").select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id", "root", *carry
    )
