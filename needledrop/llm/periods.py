"""Periodic runs of words: where a text repeats the same few words again and again.

The suffixes of a text's words are sorted by doubling, which also gives the longest common prefix (LCP) of
neighbours. Kruskal's rule then unites suffix classes by decreasing LCP: a class holds the ordered positions
of suffixes that agree on at least that many words, and the smaller of two classes goes into the larger.
Positions i < j that become neighbours in a class at LCP n agree on exactly n words, so the words from i on
have period j - i up to j + n, and j + n is where the period ends. If n is at least the distance, they seed a run.

All seeds of a run share its period and its end, and its first word is one of them: a position between
i and j in the class would give the run a smaller period. So a run is the smallest seed of each (period,
end), and no seed has a period that is not the smallest. LCPs below what the shortest run needs are left out.

A text is worked on by itself, in one task and without a shuffle; short texts are sorted together.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import ship

_AT_ONCE = 1 << 17  # words that are sorted at once; a longer text goes alone

Run = tuple[int, int, int]  # start, length, period


def shortest(period: int, least: int, times: int) -> int:
    """Words that a run of this period has at least."""
    return max(least, times * period)


def suffix_lcps(codes: np.ndarray, ends: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, lcp): neighbours in the order of suffixes that share at least ``floor`` words.

    ``codes`` are the words of several texts as numbers from 0, ``ends`` is where each text ends. Suffixes end
    with their text, and no two texts share a word, so only suffixes of one text have anything in common.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    _, rank = np.unique(text * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    counts = np.bincount(rank)
    first = np.cumsum(counts) - counts  # the place of a class is that of its first suffix
    rank, alive = first[rank], np.flatnonzero(counts[rank] > 1)
    ranks, width = [rank], 1  # by number of words compared: 1, 2, 4, ...
    while len(alive):
        ahead = alive + width
        inside = ahead < ends[text[alive]]
        # A text's end comes before every word; its suffixes have different lengths, so it never ties.
        after = np.where(inside, rank[np.minimum(ahead, n - 1)] + n, n - 1 - alive)
        order = np.lexsort((after, rank[alive]))
        at, group, after = alive[order], rank[alive][order], after[order]
        new_group = np.append(True, group[1:] != group[:-1])
        new = new_group | np.append(True, after[1:] != after[:-1])
        index = np.arange(len(at))
        place = group + index - index[new_group][np.cumsum(new_group) - 1]
        place = place[new][np.cumsum(new) - 1]
        rank = rank.copy()
        rank[at] = place
        ranks.append(rank)
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        alive = np.sort(at[np.repeat(size > 1, size)])
        width *= 2
    by_place = np.empty(n, np.int64)
    by_place[rank] = np.arange(n)
    a, b = by_place[:-1], by_place[1:]
    lcp = np.zeros(len(a), np.int64)
    # Neighbours that differ within the largest power of two below the floor need no counting.
    sure = max(0, min(floor.bit_length() - 1, len(ranks) - 1))
    same = ranks[sure][a] == ranks[sure][b]
    a, b, lcp = a[same], b[same], lcp[same]
    x, y = a.copy(), b.copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = (x < n) & (y < n)
        inside[inside] = ranks[level][x[inside]] == ranks[level][y[inside]]
        for moved in (x, y, lcp):
            moved[inside] += 1 << level
    enough = lcp >= floor
    return a[enough], b[enough], lcp[enough]


def kruskal_runs(a: list[int], b: list[int], lcp: list[int], least: int, times: int) -> dict[tuple[int, int], int]:
    """Starts by (period, end) of the runs, from neighbours sorted by decreasing LCP."""
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    starts: dict[tuple[int, int], int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def seed(i: int, j: int, shared: int) -> None:
        period = j - i
        if shared + period >= (least if times * period < least else times * period):
            key = (period, j + shared)
            if starts.get(key, i) >= i:
                starts[key] = i

    for i, j, shared in zip(a, b, lcp):
        one, other = find(i), find(j)
        large, small = members.pop(one, None) or [i], members.pop(other, None) or [j]
        if len(large) < len(small):
            large, small, one, other = small, large, other, one
        before = -1
        for x, following in zip(small, [*small[1:], None]):
            at = bisect(large, x)
            # Positions of the smaller class that lie between two of the larger are neighbours already.
            if at and large[at - 1] != before:
                seed(large[at - 1], x, shared)
            if at < len(large):
                if following is None or following > large[at]:
                    seed(x, large[at], shared)
                large.insert(at, x)
            else:
                large.append(x)
            before = x
        root[other] = one
        members[one] = large
    return starts


def find_runs(codes: np.ndarray, ends: np.ndarray, least: int = 6, times: int = 4) -> list[list[Run]]:
    """The runs of each text, by start and period; see ``periodic_runs``."""
    out: list[list[Run]] = [[] for _ in ends]
    if not len(codes):
        return out
    # A run of period p and length n has two suffixes p apart that share n - p words.
    floor = min(shortest(p, least, times) - p for p in range(1, least + 2))
    a, b, lcp = suffix_lcps(codes, ends, floor)
    order = np.argsort(-lcp, kind="stable")
    begin = np.append(0, ends)
    for (period, end), start in kruskal_runs(*(x[order].tolist() for x in (a, b, lcp)), least, times).items():
        text = int(np.searchsorted(ends, start, side="right"))
        out[text].append((int(start - begin[text]), int(end - start), int(period)))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each word stays when every run is cut down to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray:
    """Word numbers of a text of ``n`` words whose tail is planted to repeat, for one document in ten."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, at = h // 10, np.arange(n)
    if h % 10 or not n:
        return at
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.where(at >= a, a + (at - a) % period, at)


_SHAPE = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def _row(doc: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    best: tuple = (None,) * 4
    if runs:
        top = runs[0]
        for run in runs[1:]:
            # Exact length / period; runs are in the order of the ties.
            if run[1] * top[2] > top[1] * run[2]:
                top = run
        best = (*top, 1000 * top[1] // top[2])
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    left = words
    if runs:
        left = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return doc, len(runs), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()


def _find(change: Callable[[int | None, int], np.ndarray] | None, least: int, times: int, with_words: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SHAPE.split(", ")]

        def solve(docs: list, texts: list[list[bytes]], codes: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([len(c) for c in codes])
            found = find_runs(np.concatenate(codes), ends, least, times)
            rows = [_row(*r) for r in zip(docs, texts, found)]
            kinds = {n: pa.string() for n in names if n.endswith("sha256")}
            out = {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in zip(names, zip(*rows))}
            if with_words:
                run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                as_runs = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
                keep = [kept_words(len(w), r) for w, r in zip(texts, found)]
                left = [b" ".join(x for x, k in zip(w, keep) if k).decode("utf-8", "replace") for w, keep in zip(texts, keep)]
                out |= {"runs": pa.array(as_runs, pa.list_(run)), "collapsed": pa.array(left, pa.string())}
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            docs, texts, codes, held, known = [], [], [], 0, {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if change is not None and words:
                    words = [words[i] for i in change(doc, len(words)).tolist()]
                docs.append(doc)
                texts.append(words)
                codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                held += len(words)
                if held >= _AT_ONCE:
                    yield solve(docs, texts, codes)
                    docs, texts, codes, held, known = [], [], [], 0, {}
            if docs:
                yield solve(docs, texts, codes)

    return find


def periodic_runs(
    docs: DataFrame,
    least: int = 6,
    times: int = 4,
    change: Callable[[int | None, int], np.ndarray] | None = None,
    with_words: bool = True,
) -> DataFrame:
    """Per document: doc_id, n_runs, the run of greatest exponent, digests, and (with_words) runs and collapsed text.

    Words are what ASCII white space parts. A run is a stretch of words with smallest period q, of at least
    ``least`` words and ``times`` (2 or more) periods, that no neighbouring word extends. ``start`` (word number),
    ``length`` and ``period`` are of the run of greatest length / period, ties to the smaller start and then period,
    and ``exponent_milli`` is that ratio in thousandths; without a run all four are null. ``collapsed`` is the text
    without the words that lie in a run beyond its first period. ``change`` gives the word numbers to read
    instead of 0 .. n - 1 for an id and a number of words.

    Null, empty and blank texts have no words and no runs. Repeated rows each give a row; other columns are
    ignored; no documents give no rows.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * with_words
    return narrow.mapInArrow(_find(change, least, times, with_words), _SHAPE + more)
