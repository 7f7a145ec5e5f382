"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (with word ends, and the word itself), hashed
into buckets; a window of consecutive words is the mean of its words; a linear softmax turns it into
two logits. A document is as toxic as its worst window, so a single insult in a long text counts as much
as in a short one. Vectors and softmax are trained jointly in numpy by Adam, first on all words of a
document, then on its worst window. An unseen misspelling shares n-grams with words that were seen.
Every word counts as its overlapping pieces of twelve letters, so an insult inside glued words or prose without
spaces is a piece of its own; a word up to that length is one piece.

The model is linear above the buckets, so for scoring every bucket is one number. Fit: a bounded sample of
labelled rows on the driver. Score: one scan of all whole texts, no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import ship

_GRAMS = (3, 4, 5)
_NO_SIGN = re.compile(r"[\W_]+")
_REMEMBERED = 600_000  # words that one worker remembers
_PIECE, _STEP = 12, 6  # letters of a piece, and between the starts of two
_BLOCK = 4_096  # words that are hashed at one time
_FEW = 50_000  # words of texts that are scored at one time, or one text


@dataclass(frozen=True)
class ToxicityModel:
    vectors: np.ndarray  # bucket x dimension
    softmax: np.ndarray  # dimension x 2
    bias: np.ndarray
    window: int

    def folded(self) -> tuple[np.ndarray, float]:
        """Per bucket and in all: what they add to logit(toxic) - logit(clean)."""
        side = self.softmax[:, 1] - self.softmax[:, 0]
        return (self.vectors @ side).astype(np.float64), float(self.bias[1] - self.bias[0])


def whole_words(text: str | None) -> list[str]:
    return (text or "").lower().replace(",", " ").replace(".", " ").split()


def words_of(text: str | None) -> list[str]:
    """The words of a whole text as their pieces."""
    return [piece for w in whole_words(text) for piece in pieces_of(w)]


def pieces_of(word: str) -> list[str]:
    """Pieces of ``_PIECE`` letters, one every ``_STEP``; every n-gram of the word lies in one of them."""
    if len(word) <= _PIECE:
        return [word]
    letters = _NO_SIGN.sub("", word)
    if len(letters) <= _PIECE:
        return [word]
    return [letters[at : at + _PIECE] for at in range(0, len(letters) - _PIECE + _STEP, _STEP)]


def buckets_of(word: str, buckets: int) -> list[int]:
    """Hashed n-grams of a word, signs left out; nothing for a word of signs only."""
    letters = _NO_SIGN.sub("", word)
    if not letters:
        return []
    framed = f"<{letters}>"
    grams = {framed, *(framed[i : i + n] for n in _GRAMS for i in range(len(framed) - n + 1))}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in sorted(grams)]


_FRAMED = _PIECE + 2  # a piece and its ends
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _step(state: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """States of CRC-32 after one more character each, as its UTF-8 bytes."""

    def add(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return _CRC[(state ^ byte) & 0xFF] ^ (state >> 8)

    if chars.max(initial=0) < 0x80:
        return add(state, chars)
    size = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    state = add(state, np.choose(size - 1, (chars, 0xC0 | chars >> 6, 0xE0 | chars >> 12, 0xF0 | chars >> 18)))
    for more in (3, 2, 1):
        at = size > more
        state[at] = add(state[at], 0x80 | chars[at] >> 6 * (more - 1) & 0x3F)
    return state


def means_of(words: list[str], values: np.ndarray) -> np.ndarray:
    """Per word the mean of ``values`` at its ``buckets_of``, 0 without any; many words at a time."""
    out = np.zeros(len(words))
    letters = [w if w.isalnum() else _NO_SIGN.sub("", w) for w in words]
    ascii_, other = [], []
    for i, w in enumerate(letters):
        if 0 < len(w) <= _PIECE:
            (ascii_ if w.isascii() else other).append(i)
        elif w:
            out[i] = values[buckets_of(w, len(values))].mean()
    for some in (ascii_, other):
        for a in range(0, len(some), _BLOCK):
            of = some[a : a + _BLOCK]
            out[of] = _block_means([letters[i] for i in of], values)
    return out


def _block_means(letters: list[str], values: np.ndarray) -> np.ndarray:
    # One row a character, one column a word; no letter is the character 0.
    framed = "".join([f"<{w}>".ljust(_FRAMED, "\0") for w in letters]).encode("utf-32-le", "surrogatepass")
    chars = np.ascontiguousarray(np.frombuffer(framed, "<u4").reshape(-1, _FRAMED).T)
    size = (chars != 0).sum(axis=0)
    total, count = np.zeros(len(letters)), np.zeros(len(letters))
    state = np.full(chars.shape, 0xFFFFFFFF, np.uint32)
    for n in range(1, _FRAMED + 1):
        # The state of the n-gram at each start; beyond the n-grams only that of the whole word.
        starts = _FRAMED - n + 1 if n <= max(_GRAMS) else 1
        state = _step(state[:starts], chars[n - 1 : n - 1 + starts])
        if n in _GRAMS:
            there = np.arange(starts)[:, None] + n <= size
        elif n > max(_GRAMS):
            there = (size == n)[None, :]
        else:
            continue
        gram = ~state
        total += np.where(there, values[gram % len(values)], 0).sum(axis=0)
        count += there.sum(axis=0)
        if n == min(_GRAMS):
            apart = np.sort(np.where(there, gram.astype(np.int64), -1 - np.arange(starts)[:, None]), axis=0)
            twice = np.flatnonzero((apart[1:] == apart[:-1]).any(axis=0))
    out = total / count
    # A repeated n-gram counts once; where one repeats, its first three characters do.
    for i in twice:
        out[i] = values[buckets_of(letters[i], len(values))].mean()
    return out


def worst_windows(word_scores: np.ndarray, window: int) -> tuple[float, int]:
    """(mean, start) of the window of largest mean; a shorter text is one window, an empty one scores 0."""
    n = len(word_scores)
    if n <= window:
        return (float(word_scores.mean()) if n else 0.0), 0
    sums = np.concatenate([[0.0], np.cumsum(word_scores)])
    means = (sums[window:] - sums[:-window]) / window
    at = int(means.argmax())
    return float(means[at]), at


_WORDS = 20_000  # words whose n-grams are laid out at one time


class _Grams:
    """The n-gram buckets of all words, one word after the other; sums go through few words at a time."""

    def __init__(self, words: list[str], buckets: int) -> None:
        parts = [np.array(buckets_of(w, buckets), np.int32) for w in words]
        self.buckets = buckets
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.flat = np.concatenate([*parts, np.empty(0, np.int32)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _blocks(self, words: np.ndarray):
        for a in range(0, len(words), _WORDS):
            some = words[a : a + _WORDS]
            n = self.sizes[some]
            at = np.arange(n.sum()) + np.repeat(self.starts[some] - (np.cumsum(n) - n), n)
            yield slice(a, a + len(some)), np.repeat(np.arange(len(some)), n), self.flat[at], np.maximum(n, 1)

    def means(self, words: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Per word the mean of its buckets' values."""
        out = np.zeros(len(words))
        for place, of, bucket, n in self._blocks(words):
            out[place] = np.bincount(of, values[bucket], len(n)) / n
        return out

    def spread(self, words: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """Per bucket the sum of what each word's mean hands down to it."""
        out = np.zeros(self.buckets)
        for place, of, bucket, n in self._blocks(words):
            out += np.bincount(bucket, (slopes[place] / n)[of], self.buckets)
        return out


class _Adam:
    def __init__(self, *weights: np.ndarray, rate: float) -> None:
        self.weights, self.rate, self.step = weights, rate, 0
        self.first, self.second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def move(self, *slopes: np.ndarray) -> None:
        self.step += 1
        grow = self.rate * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for w, m, v, g in zip(self.weights, self.first, self.second, slopes):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= grow * m / (np.sqrt(v) + 1e-8)


def train(
    texts: list[str], labels: list[int], window: int = 3, buckets: int = 1 << 16, dimension: int = 8,
    warm: int = 10, rounds: int = 60, rate: float = 0.1, decay: float = 1e-6, seed: int = 5,
) -> ToxicityModel:
    """Train vectors and softmax together; ``labels`` are 0 or 1."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    grams = _Grams(list(vocabulary), buckets)
    every = np.arange(len(vocabulary))
    del vocabulary
    vectors = rng.normal(0, 0.1, (buckets, dimension)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (dimension, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if not len(docs) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(vectors * 0, softmax, np.array([0, 8.0 * (2 * share - 1)], np.float32), window)
    # Both classes weigh the same.
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
    adam = _Adam(vectors, softmax, bias, rate=rate)
    for turn in range(warm + rounds):
        if turn < warm:
            picked = docs
        else:
            score = grams.means(every, vectors @ (softmax[:, 1] - softmax[:, 0]))
            picked = []
            for d in docs:
                at = worst_windows(score[d], window)[1] if len(d) else 0
                picked.append(d[at : at + window])
        # Each document as weights on words, then on buckets.
        lengths = np.array([len(p) for p in picked])
        of = np.repeat(np.arange(len(picked)), lengths)
        word = np.concatenate([*picked, np.empty(0, np.int64)])
        used, slot = np.unique(word, return_inverse=True)
        word_vectors = np.stack([grams.means(used, vectors[:, d]) for d in range(dimension)], axis=1)
        share = 1.0 / np.maximum(lengths, 1)
        bag = np.stack([np.bincount(of, word_vectors[slot, d] * share[of], len(picked)) for d in range(dimension)], axis=1)
        logits = bag @ softmax + bias
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=1, keepdims=True)
        slope = chance.copy()
        slope[np.arange(len(y)), y] -= 1
        slope *= weight[:, None]
        to_bag = slope @ softmax.T
        to_vectors = decay * vectors
        for d in range(dimension):
            to_vectors[:, d] += grams.spread(used, np.bincount(slot, to_bag[of, d] * share[of], len(used)))
        adam.move(to_vectors, (bag.T @ slope + decay * softmax).astype(np.float32), slope.sum(axis=0).astype(np.float32))
    return ToxicityModel(vectors, softmax, bias, window)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 20_000, **how) -> ToxicityModel:
    """Train on at most ``per_class`` labelled rows of each class that are not held out.

    The ids of smallest hash are taken, and one text up to ``max_chars`` of each; longer texts are scored whole
    but not learned from. Null labels, ids and texts are left out; without both classes the model is constant.
    """
    learn = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic").distinct()
    order = F.xxhash64("doc_id", F.lit(17))
    some = [learn.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # at most 2 * per_class ids
    short = docs.where(F.length("text") <= max_chars).select("doc_id", F.col("text").cast("string").alias("text"))
    # One text of each id, however many rows have it.
    one = short.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.toPandas().sort_values(["doc_id", "toxic"])
    return train(list(rows["text"]), [int(t) for t in rows["toxic"]], **how)


class _WordScores:
    """The scores of every word's pieces; remembered up to a bound."""

    def __init__(self, scores: np.ndarray) -> None:
        self.scores = scores
        self.known: dict[str, bytes] = {}

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = {w for words in texts for w in words if w not in self.known}
        if len(self.known) + len(new) > _REMEMBERED:
            self.known.clear()
            new = set().union(*texts)
        pieces = [pieces_of(w) for w in new]
        raw = means_of([p for some in pieces for p in some], self.scores).tobytes()
        at = 0
        for word, some in zip(new, pieces):
            self.known[word] = raw[at : at + 8 * len(some)]
            at += 8 * len(some)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words))) for words in texts]

    def each(self, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
        few, n = [], 0
        for text in texts:
            few.append(whole_words(text))
            n += len(few[-1])
            if n >= _FEW:
                yield from self.of(few)
                few, n = [], 0
        yield from self.of(few)


def scored(docs: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score): the chance of label 1 for every whole text; empty and null texts have the bias alone.

    Columns named in ``carry`` come along.
    """
    ship(docs.sparkSession)
    scores, bias = model.folded()
    shared, window = docs.sparkSession.sparkContext.broadcast(scores), model.window

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _WordScores(shared.value)
        for batch in batches:
            texts = (text.as_py() for text in batch.column("text"))
            logits = [worst_windows(found, window)[0] + bias for found in memory.each(texts)]
            chance = 1 / (1 + np.exp(-np.clip(np.array(logits, float), -40, 40)))
            more = {c: batch.column(c) for c in carry}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(chance)} | more)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(score, ", ".join(["doc_id long", "score double", *(f"{c} {kinds[c]}" for c in carry)]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carry: tuple[str, ...] = (), **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents, with a model fitted on labels.

    Repeated rows give a row each; null ids are not held out; of other columns those in ``carry`` are
    added; an empty table gives an empty result.
    """
    rows = scored(docs, fit(docs, labels, **how), carry)
    return rows.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry
    )
