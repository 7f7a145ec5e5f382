"""CRC-32C of many byte strings at once, in numpy.

The checksum without its start value is linear: zeros in front change nothing, and what follows a block
acts on the block's checksum as a 32 by 32 bit matrix. So all strings are cut into blocks of one size, the
blocks go through the table side by side, and neighbouring blocks are combined in pairs.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# Fixed values of the checksum and of its mask in record files.
_POLYNOMIAL = 0x82F63B78
_ROTATE, _ADD = 15, 0xA282EAD8

_BLOCK = 512  # bytes


@cache
def _bytewise() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


@cache
def _two_bytes() -> np.ndarray:
    """The state after two bytes, by the low half of the state before."""
    one, low = _bytewise(), np.arange(1 << 16, dtype=np.uint32)
    first = one[low & 0xFF] ^ (low >> 8)
    return one[first & 0xFF] ^ (first >> 8)


@cache
def _zeros(power: int) -> np.ndarray:
    """What 2**power zero bytes do to a state: four tables by byte of the state."""
    state = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power == 0:
        images = _bytewise()[state & 0xFF] ^ (state >> 8)
    else:
        images = _through(power - 1, _through(power - 1, state))
    byte = np.arange(256)
    tables = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        tables[bit // 8] ^= np.where(byte >> bit % 8 & 1, images[bit], 0).astype(np.uint32)
    return tables


def _through(power: int, state: np.ndarray) -> np.ndarray:
    t = _zeros(power)
    return t[0][state & 0xFF] ^ t[1][state >> 8 & 0xFF] ^ t[2][state >> 16 & 0xFF] ^ t[3][state >> 24]


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of ``data[start : start + size]``; ``data`` are bytes as uint8."""
    starts, sizes = np.asarray(starts, np.int64), np.asarray(sizes, np.int64)
    if not len(starts):
        return np.empty(0, np.uint32)
    width = min(_BLOCK, 1 << int(max(1, sizes.max() - 1)).bit_length())
    counts = np.maximum(1, -(-sizes // width))
    ends = np.cumsum(counts)
    # Every string ends with its last block; the first one is filled up with zeros in front.
    blocks = np.zeros((int(ends[-1]), width), np.uint8)
    flat = blocks.reshape(-1)
    for start, size, end in zip(starts.tolist(), sizes.tolist(), (ends * width).tolist()):
        flat[end - size : end] = data[start : start + size]
    columns = np.ascontiguousarray(blocks.view("<u2").T)
    state, table = np.zeros(len(blocks), np.uint32), _two_bytes()
    for column in columns:
        state = table[(state & 0xFFFF) ^ column] ^ (state >> 16)
    power = width.bit_length() - 1
    while counts.max() > 1:
        # Block i of c, counted from the end, joins with block i + 1 into block i // 2.
        from_end = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(len(state))
        odd = from_end % 2 == 1
        owner = np.repeat(np.arange(len(counts)), counts)
        state[odd] = _through(power, state[odd])
        counts = (counts + 1) // 2
        joined = np.zeros(int(counts.sum()), np.uint32)
        place = np.cumsum(counts)[owner] - 1 - from_end // 2
        joined[place[odd]] = state[odd]
        joined[place[~odd]] ^= state[~odd]
        state, power = joined, power + 1
    begun = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for bit in range(int(sizes.max()).bit_length()):
        on = sizes >> bit & 1 == 1
        begun[on] = _through(bit, begun[on])
    return state ^ begun ^ np.uint32(0xFFFFFFFF)


def masked(checksums: np.ndarray) -> np.ndarray:
    """Checksums as they are stored, so that a checksum of data that holds checksums stays sound."""
    turned = checksums >> np.uint32(_ROTATE) | checksums << np.uint32(32 - _ROTATE)
    return turned + np.uint32(_ADD)
