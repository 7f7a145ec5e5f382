"""SentencePiece encoding and decoding of giant documents by a max-plus scan over chunks.

A BPE encoding is the one chain of vocabulary pieces over a text in which every two neighbours are stable:
the library encodes their joined text as these two pieces. So it is a path, and paths compose. A text
is cut into chunks anywhere. The state at a cut is the piece that covers the character before it (where no
piece can reach across, there is one state). A chunk gives a transfer matrix over the max-plus
semiring: for each state at its left and right cut the number of tokens of the path between them, or
minus infinity if there is none. The product of matrices is associative; the scan over a document tells
each chunk its two states and its first token's number, and every chunk is then encoded by itself.

Chunks are rows that Spark deals out, so a giant document keeps many tasks busy. A document of one chunk
is the scan of one matrix. Paths are only searched between a cut and the nearest place where nothing reaches
across.

Inside a chunk, texts go through a second encoder of the same vocabulary with the library's result: it merges
bytes in the order of the pieces' scores. Texts with pieces whose order the scores leave open (runs of spaces)
go to the library. Tests compare both.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import partitions, ship, tokenizer_path
from needledrop.sources.store import settled

_SPACE = "▁"  # Fixed value: stands for a space inside pieces
State = tuple[int, int] | None  # a piece as (start, end) around a cut; None where nothing reaches across
_NO_PATH = -1
_FEW = 128  # texts that are encoded or decoded at one time


@cache
def processor(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))


class Vocabulary:
    def __init__(self, name: str) -> None:
        self.library = processor(name)
        n = self.library.get_piece_size()
        odd = [i for i in range(n) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)]
        self.pieces = {self.library.id_to_piece(i): i for i in set(range(n)) - set(odd)}
        self.longest = max(map(len, self.pieces))
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.stable: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        byte = {i: bytes([int(self.library.id_to_piece(i)[1:-1], 16)]) for i in odd if self.library.is_byte(i)}
        self._set_second({b: i for i, b in byte.items()})
        shown = [byte.get(i, b"") for i in range(n)]
        for piece, i in self.pieces.items():
            shown[i] = piece.replace(_SPACE, " ").encode("utf-8")
        self.bytes = pa.array(shown, pa.large_binary())

    def inside(self, text: str) -> list[int]:
        """Ids of normalised text that is not the start of a document; a line break joins with nothing."""
        return self.library.encode("\n" + text)[2:] if text else []

    def _set_second(self, byte: dict[bytes, int]) -> None:
        """The vocabulary as ranks of byte strings: first bytes, then characters and their beginnings, then pieces by score.

        A byte string that is no piece stands for the ids of its bytes, if the vocabulary has all bytes.
        """
        import tiktoken

        shown = {p: p.replace(_SPACE, " ").encode("utf-8") for p in self.pieces}
        score = {p: self.library.get_score(i) for p, i in self.pieces.items() if len(p) > 1}
        own = {b: self.pieces[p] for p, b in shown.items()}
        order = [bytes([b]) for b in range(256)]
        order += [b[:k] for p, b in shown.items() if len(p) == 1 for k in range(2, len(b) + 1)]
        order += [shown[p] for p in sorted(score, key=score.get, reverse=True)]
        order = list(dict.fromkeys(order))
        ids = [[own[b]] if b in own else [byte.get(b[k : k + 1], -1) for k in range(len(b))] for b in order]
        self.id_of = np.array([i[0] if len(i) == 1 else -1 for i in ids], np.int32)
        self.ids_of = pa.array(ids, pa.list_(pa.int32())) if len(byte) == 256 else None
        # Pieces of equal score, and those that the library does not give for their own text.
        often = Counter(score.values())
        alone = self.library.encode(["\n" + p for p in score])
        doubtful = {p for (p, s), found in zip(score.items(), alone) if often[s] > 1 or found[2:] != [self.pieces[p]]}
        least: list[str] = []
        for p in sorted(doubtful, key=len):
            if not any(q in p for q in least):
                least.append(p)
        self.doubtful = [p.replace(_SPACE, " ") for p in least]
        # Where no piece goes on after a word, words are merged one by one.
        by_word = all(a == _SPACE or b != _SPACE for a, b in self.joined)
        ranks = {b: rank for rank, b in enumerate(order)}
        pattern = " *[^ ]+| +" if by_word else "(?s:.+)"
        self.second = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def ids(self, text: str) -> np.ndarray:
        """``inside`` as an array; spaces may be shown or not."""
        text = text.replace(_SPACE, " ")
        if any(p in text for p in self.doubtful):
            return np.array(self.inside(text), np.int32)
        tokens = np.frombuffer(self.second.encode_to_tiktoken_buffer(text, set()), np.uint32)
        ids = self.id_of[tokens]
        if ids.min(initial=0) >= 0:
            return ids
        if self.ids_of is None:
            return np.array(self.inside(text), np.int32)
        return self.ids_of.take(pa.array(tokens)).flatten().to_numpy()

    def open_cut(self, text: str, at: int) -> bool:
        """True if no piece holds the characters before and after ``at``."""
        return not 0 < at < len(text) or text[at - 1 : at + 1] not in self.joined

    def is_token(self, piece: str) -> bool:
        if len(piece) == 1:
            return True  # bytes, if the vocabulary lacks it
        if piece not in self.pieces:
            return False
        found = self.own.get(piece)
        if found is None:
            found = self.own[piece] = self.inside(piece) == [self.pieces[piece]]
        return found

    def stays(self, left: str, right: str) -> bool:
        """True if the encoding of the joined text is the two pieces."""
        found = self.stable.get((left, right))
        if found is None:
            if len(self.stable) > 1_000_000:
                self.stable.clear()
            found = self.stable[left, right] = self.inside(left + right) == self.inside(left) + self.inside(right)
        return found

    def states(self, text: str, cut: int) -> list[State]:
        """All states that a cut can have."""
        if self.open_cut(text, cut):
            return [None]
        return [
            (s, e)
            for s in range(max(0, cut - self.longest), cut)
            for e in range(cut, min(len(text), s + self.longest) + 1)
            if self.is_token(text[s:e])
        ]

    def size(self, text: str, start: int, end: int) -> int:
        return len(self.inside(text[start:end]))

    def paths(self, text: str, left: list[State], start: int, right: list[State], end: int) -> list[list[int]]:
        """Tokens after each left state up to and with each right state; None stands at the cut itself."""
        begin = min([start, *(s[0] for s in left if s)])
        stop = max([end, *(s[1] for s in right if s)])
        # reach[position][piece start] = {left state: tokens so far}
        reach: dict[int, dict[int, dict[int, int]]] = {}
        for i, s in enumerate(left):
            place, own = (start, start) if s is None else (s[1], s[0])
            reach.setdefault(place, {}).setdefault(own, {})[i] = 0
        for e in range(begin + 1, stop + 1):
            for s in range(max(begin, e - self.longest), e):
                if s not in reach or not self.is_token(text[s:e]):
                    continue
                for p, counts in reach[s].items():
                    if p == s or self.stays(text[p:s], text[s:e]):
                        into = reach.setdefault(e, {}).setdefault(s, {})
                        for i, n in counts.items():
                            into[i] = n + self.size(text, s, e)
        out = [[_NO_PATH] * len(right) for _ in left]
        for j, s in enumerate(right):
            found = reach.get(end, {}).values() if s is None else [reach.get(s[1], {}).get(s[0], {})]
            for counts in found:
                for i, n in counts.items():
                    out[i][j] = max(out[i][j], n)
        return out

    def transfer(self, text: str, start: int, end: int) -> tuple[list[State], list[State], list[list[int]]]:
        """The matrix of the chunk text[start:end]; ``text`` reaches ``longest`` characters further."""
        left, right = self.states(text, start), self.states(text, end)
        first = start if left == [None] else next((i for i in range(max(start, *(s[1] for s in left)), end) if self.open_cut(text, i)), None)
        last = end if right == [None] else next((i for i in range(min(end, *(s[0] for s in right)), start, -1) if self.open_cut(text, i)), None)
        if first is None or last is None or first > last:
            return left, right, self.paths(text, left, start, right, end)
        head = [[0]] if left == [None] else self.paths(text, left, start, [None], first)
        tail = [[0] * 1] if right == [None] else self.paths(text, [None], last, right, end)
        return left, right, combine(combine(head, [[len(self.ids(text[first:last]))]]), tail)


@cache
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def combine(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """The max-plus product; associative. No path is -1."""
    return [
        [max((x + y[k] for x, y in zip(row, b) if x >= 0 and y[k] >= 0), default=_NO_PATH) for k in range(len(b[0]))] for row in a
    ]


def normalised(text: str | None) -> str:
    """The library's normalisation for this file: one space in front, spaces shown. Nothing for nothing."""
    return _SPACE + text.replace(" ", _SPACE) if text else ""


_CHUNKS = "doc_id long, row long, chunk int, chunks int, start long, inner int, size int, blob binary"


def _slice(name: str, chunk_chars: int):
    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, pack = vocabulary(name).longest, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                whole = normalised(text)
                n = max(1, -(-len(whole) // chunk_chars))
                for i in range(n):
                    at = i * chunk_chars
                    low, high = max(0, at - margin), min(len(whole), at + chunk_chars + margin)
                    blob = pack.compress(whole[low:high].encode("utf-8", "surrogatepass"))
                    size = min(chunk_chars, len(whole) - at)
                    out.append({"doc_id": doc, "row": row, "chunk": i, "chunks": n, "start": at, "inner": at - low, "size": size, "blob": blob})
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, chunk_schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, chunk_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    chunk_schema = to_arrow_schema(StructType.fromDDL(_CHUNKS))
    return slice_


def _open(blob: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass")


def _flat(states: list[State], base: int) -> list[int]:
    """States as offsets from the document's start; -1, -1 where nothing reaches across."""
    return [x for s in states for x in ((-1, -1) if s is None else (s[0] + base, s[1] + base))]


def _transfers(name: str):
    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(name)
        for batch in batches:
            cols: dict[str, list] = {"row": [], "chunk": [], "left": [], "right": [], "matrix": []}
            for row, i, start, inner, size, blob in zip(
                *(batch.column(c).to_pylist() for c in ("row", "chunk", "start", "inner", "size", "blob"))
            ):
                text = _open(blob)
                left, right, matrix = words.transfer(text, inner, inner + size)
                base = start - inner
                for c, v in zip(cols, (row, i, _flat(left, base), _flat(right, base), [n for line in matrix for n in line])):
                    cols[c].append(v)
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), longs, longs, longs)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(cols.items(), kinds)})

    return transfers


def scan(matrices: list[list[list[int]]]) -> list[tuple[int, int, int]]:
    """(left state, right state, tokens before) of every chunk, from prefix and suffix products.

    The document's ends have one state. A chunk's state is the one on a path from the start to the end.
    """
    before = [[[0]], *accumulate(matrices, combine)]
    after = [[[0]]]
    for m in reversed(matrices):
        after.append(combine(m, after[-1]))
    after.reverse()
    at = []
    for prefix, suffix in zip(before, after):
        on_path = [i for i, (x, y) in enumerate(zip(prefix[0], suffix)) if x >= 0 and y[0] >= 0]
        at.append((on_path[0], prefix[0][on_path[0]]))
    return [(a, b, n) for (a, n), (b, _) in zip(at, at[1:])]


_PLACED = "row long, chunk int, left array<long>, right array<long>, tokens_before long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {c.split()[0]: [] for c in _PLACED.split(", ")}
        for row, steps in zip(batch.column("row").to_pylist(), batch.column("steps").to_pylist()):
            shaped = [np.reshape(r["matrix"], (len(r["left"]) // 2, -1)).tolist() for r in steps]
            for r, (a, b, n) in zip(steps, scan(shaped)):
                for c, v in zip(cols, (row, r["chunk"], r["left"][2 * a : 2 * a + 2], r["right"][2 * b : 2 * b + 2], n)):
                    cols[c].append(v)
        longs = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int32(), longs, longs, pa.int64())
        yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(cols.items(), kinds)})


_TOKENS = "doc_id long, row long, chunk int, chunks int, tokens_before long, chars_before long, ids array<int>"


def _token_batch(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    ends = np.cumsum([0, *map(len, ids)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    return pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(zip(*rows), kinds)), lists], names=names)


def _backtrace(name: str):
    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(name)
        names = ("doc_id", "row", "chunk", "chunks", "tokens_before", "start", "inner", "size", "left", "right", "blob")
        for batch in batches:
            for at in range(0, batch.num_rows, _FEW):
                few = batch.slice(at, _FEW)
                out, found = [], []
                for doc, row, i, n, before, start, inner, size, left, right, blob in zip(*(few.column(c).to_pylist() for c in names)):
                    text, base = _open(blob), start - inner
                    # A piece across a cut belongs to the chunk on its left.
                    begin = inner if left[1] < 0 else left[1] - base
                    end = inner + size if right[1] < 0 else right[1] - base
                    lead = begin if left[1] < 0 else left[0] - base
                    found.append(words.ids(text[lead:end])[len(words.inside(text[lead:begin])) :])
                    # The space in front of a document is not decoded.
                    out.append((doc, row, i, n, before, max(0, begin + base - 1)))
                yield _token_batch(out, found)

    return backtrace


def _whole(name: str):
    """Documents of one chunk: both ends have one state and the library encodes all between them."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(name)
        for batch in batches:
            for at in range(0, batch.num_rows, _FEW):
                few = batch.slice(at, _FEW)
                keys = zip(few.column("doc_id").to_pylist(), few.column("row").to_pylist())
                found = [words.ids(normalised(t)) for t in few.column("text").to_pylist()]
                yield _token_batch([(doc, row, 0, 1, 0, 0) for doc, row in keys], found)

    return whole


def _rows(docs: DataFrame, chunk_chars: int, several: bool) -> DataFrame:
    """The documents of one chunk or of several, numbered from -1 down or from 0 up."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") >= chunk_chars, F.lit(False))
    number = F.monotonically_increasing_id()
    return rows.where(is_long if several else ~is_long).withColumn("row", number if several else -1 - number)


def encode_short(docs: DataFrame, model: str = "piece_bpe_32k.model", chunk_chars: int = 16384) -> DataFrame:
    """``encode`` for the documents of one chunk."""
    return _rows(docs, chunk_chars, False).mapInArrow(_whole(model), _TOKENS)


def _chunks(docs: DataFrame, model: str, chunk_chars: int) -> DataFrame:
    """The chunks of the documents of several, with their two states and the number of tokens before."""
    sliced = _rows(docs, chunk_chars, True).mapInArrow(_slice(model, chunk_chars), _CHUNKS)
    # Written with their row numbers, and dealt out by chunk, so that a giant document is many tasks' work.
    chunks = settled(sliced.repartition(partitions(docs), "row", "chunk"), "piece-chunks")
    matrices = chunks.mapInArrow(_transfers(model), "row long, chunk int, left array<long>, right array<long>, matrix array<long>")
    step = F.struct("chunk", "left", "right", "matrix")
    placed = matrices.groupBy("row").agg(F.array_sort(F.collect_list(step)).alias("steps")).mapInArrow(_scan, _PLACED)
    return chunks.join(placed, ["row", "chunk"])


def encode_long(docs: DataFrame, model: str = "piece_bpe_32k.model", chunk_chars: int = 16384) -> DataFrame:
    """``encode`` for the documents of several chunks."""
    return _chunks(docs, model, chunk_chars).mapInArrow(_backtrace(model), _TOKENS)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", chunk_chars: int = 16384) -> DataFrame:
    """(doc_id, row, chunk, chunks, tokens_before, chars_before, ids) for every chunk of every row of documents.

    The ids of a document's chunks in order are what the library gives for its whole text, without begin
    or end. ``row`` numbers the rows, so null and repeated ids are told apart. Null and empty texts are one
    chunk without ids. Other columns are ignored; an empty table gives an empty result.
    """
    return encode_short(docs, model, chunk_chars).unionByName(encode_long(docs, model, chunk_chars))


def mixed(places: np.ndarray, values: np.ndarray) -> int:
    """A signed 64-bit digest of values at their places; digests of parts combine by exclusive or."""
    x = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return int(np.bitwise_xor.reduce(x ^ (x >> np.uint64(31)), initial=np.uint64(0)).astype(np.int64))


def digests(docs: DataFrame, model: str = "piece_bpe_32k.model", chunk_chars: int = 16384) -> DataFrame:
    """(doc_id, n_chunks, n_tokens, ids_hash, decoded_chars, decoded_hash) of every row, encoded and decoded again.

    The hashes are ``mixed`` over ids and over code points; they combine by chunk, so no document is
    put together again for them.
    """
    kind = "doc_id long, row long, n_chunks int, n_tokens long, ids_hash long, decoded_chars long, decoded_hash long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {c.split()[0]: [] for c in kind.split(", ")}
            names = ("doc_id", "row", "chunks", "tokens_before", "chars_before")
            rows = zip(*(batch.column(c).to_pylist() for c in names), batch.column("ids"), batch.column("text"))
            for doc, row, n, tokens, chars, ids, text in rows:
                ids = np.asarray(ids.values)
                points = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), "<u4")
                found = (
                    doc, row, n, len(ids), mixed(np.arange(tokens, tokens + len(ids)), ids),
                    len(points), mixed(np.arange(chars, chars + len(points)), points),
                )
                for c, v in zip(cols, found):
                    cols[c].append(v)
            yield pa.RecordBatch.from_pydict(
                {c: pa.array(v, pa.int32() if c == "n_chunks" else pa.int64()) for c, v in cols.items()}
            )

    # Encoded, decoded and hashed by the same task, so that ids and texts do not go back to the JVM in between.
    whole_, backtrace, decoded = _whole(model), _backtrace(model), _decoded(model)
    short = _rows(docs, chunk_chars, False).mapInArrow(lambda batches: digest(decoded(whole_(batches))), kind)
    parts = _chunks(docs, model, chunk_chars).mapInArrow(lambda batches: digest(decoded(backtrace(batches))), kind)
    whole = parts.groupBy("doc_id", "row", "n_chunks").agg(
        F.sum("n_tokens").alias("n_tokens"), F.bit_xor("ids_hash").alias("ids_hash"),
        F.sum("decoded_chars").alias("decoded_chars"), F.bit_xor("decoded_hash").alias("decoded_hash"),
    )
    return short.unionByName(whole).drop("row")


def _decoded(name: str):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(name).bytes
        for batch in batches:
            for at in range(0, batch.num_rows, _FEW):
                few = batch.slice(at, _FEW)
                ids = few.column("ids")
                pieces = table.take(ids.flatten())
                ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0))])
                ends = np.frombuffer(pieces.buffers()[1], np.int64)[ends].tolist()
                data, texts = memoryview(pieces.buffers()[2] or b""), []
                for i, a, b in zip(few.column("chunk").to_pylist(), ends, ends[1:]):
                    text = str(data[a:b], "utf-8", "replace")
                    texts.append(text[1:] if i == 0 and text.startswith(" ") else text)
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array(texts, pa.string())], names=[*few.schema.names, "text"])

    return decoded


def decode(tokens: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Add ``text`` to the chunks of ``encode``: each decoded by itself, joined they are the document.

    The space in front of a document goes; ids of control pieces give nothing.
    """
    ship(tokens.sparkSession)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema) + ", text string"
    return tokens.mapInArrow(_decoded(model), kind)
