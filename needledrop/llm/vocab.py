"""Token ids and counts of whole texts, exactly as the library gives them.

The library's own encoder takes about a microsecond a byte. Texts of plain letters and signs go another way
with the same result: byte-level texts through a second encoder of the same vocabulary, and texts of a
tokenizer that drops white space word by word, where each worker remembers the words it has seen. That
memory is bounded and only saves work. All other texts go to the library.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

from needledrop.llm.common import tokenizer_path

_REMEMBERED = 600_000  # words that one worker remembers
_TYPES = {2: np.uint16, 4: np.uint32}


@cache
def library(name: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path(name))
    found.no_truncation()
    found.no_padding()
    return found


def plain_ids(name: str, text: str) -> list[int]:
    """What the library gives for a whole text; lone surrogates, which it cannot take, become U+FFFD."""
    if not text.isascii():
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return library(name).encode(text, add_special_tokens=False).ids


class _Remembered(dict):
    def __init__(self, look) -> None:
        super().__init__()
        self.look = look

    def __missing__(self, piece: str):
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[piece] = self.look(piece)
        return found


def id_type(name: str) -> type:
    return _TYPES[2 if library(name).get_vocab_size() <= 1 << 16 else 4]


# Texts of these characters: ASCII without the special tokens' brackets, and Latin letters that are lower-cased
# one by one and have no other canonical form.
_PLAIN = re.compile(r"[\n\r\t -;=?-{}~À-ÖØ-öø-ÿ]*")


# ---- tokenizers that drop white space and end words with a mark (word_bpe_49k.json) ----

_END = "</w>"
_MARK = b"\xff"  # stands for the end of a word; no text has this byte
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
# A comma or full stop beside another sign or before a letter; the underscore is a sign here, as in _PART.
_SIGNS = re.compile(r"[.,][^\s\w]|(?:[^\s\w]|_)[.,]|[.,]\w")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _word_encoder(name: str):
    """The vocabulary as ranks: an id is the rank of its merge, and a word's end is one more byte."""
    import tiktoken

    letters = _byte_letters()
    ranks = {}
    for token, rank in library(name).get_vocab(with_added_tokens=False).items():
        body = token.removesuffix(_END)
        if all(c in letters for c in body):
            ranks[bytes(letters[c] for c in body) + (_MARK if token.endswith(_END) else b"")] = rank
    ranks.setdefault(_MARK, max(ranks.values()) + 1)
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@cache
def _word_memory(name: str) -> _Remembered:
    kind, encode = id_type(name), _word_encoder(name)

    def look(piece: str) -> bytes:
        ids = [i for part in _PART.findall(piece) for i in encode(part.encode() + _MARK)]
        return np.array(ids, kind).tobytes()

    return _Remembered(look)


def word_ids(name: str, text: str) -> np.ndarray:
    """Ids of a text under a tokenizer that drops white space, lower-cases and ends words with a mark."""
    if _PLAIN.fullmatch(text) is None:
        return np.array(plain_ids(name, text), id_type(name))
    text = text.lower()
    if _SIGNS.search(text) is None:
        text = text.replace(",", " ,").replace(".", " .")
    return np.frombuffer(b"".join(map(_word_memory(name).__getitem__, text.split())), id_type(name))


# ---- byte-level tokenizers (byte_bpe_50k.json) ----

@cache
def _byte_encoder(ranks_name: str):
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(ranks_name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_count(name: str, ranks_name: str, text: str) -> int:
    """Number of tokens under a byte-level tokenizer whose vocabulary ``ranks_name`` has as ranks."""
    if _PLAIN.fullmatch(text) is None:
        return len(plain_ids(name, text))
    return len(_byte_encoder(ranks_name).encode_ordinary(text))
