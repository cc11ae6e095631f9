"""BLAKE3 in plain Python (the published specification), for short inputs."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_MIXES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_CHUNK, _BLOCK, _M32 = 1024, 64, 0xFFFFFFFF


def _turn(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & _M32


def _compress(chain, block: bytes, counter: int, length: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(_BLOCK, b"\0")))
    v = [*chain, *_IV[:4], counter & _M32, counter >> 32, length, flags]
    for _ in range(7):
        for i, (a, b, c, d) in enumerate(_MIXES):
            for word, (turn_d, turn_b) in zip(m[2 * i : 2 * i + 2], ((16, 12), (8, 7))):
                v[a] = (v[a] + v[b] + word) & _M32
                v[d] = _turn(v[d] ^ v[a], turn_d)
                v[c] = (v[c] + v[d]) & _M32
                v[b] = _turn(v[b] ^ v[c], turn_b)
        m = [m[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _node(data: bytes, number: int, root: int) -> list[int]:
    """The chaining value of a subtree that starts at chunk ``number``."""
    if len(data) <= _CHUNK:
        chain, blocks = list(_IV), [data[i : i + _BLOCK] for i in range(0, len(data), _BLOCK)] or [b""]
        for i, block in enumerate(blocks):
            last = i == len(blocks) - 1
            flags = (_CHUNK_START if not i else 0) | (_CHUNK_END | root if last else 0)
            chain = _compress(chain, block, number, len(block), flags)
        return chain
    left = _CHUNK << ((len(data) - 1) // _CHUNK).bit_length() - 1
    pair = _node(data[:left], number, 0) + _node(data[left:], number + left // _CHUNK, 0)
    return _compress(_IV, struct.pack("<16I", *pair), 0, _BLOCK, _PARENT | root)


def blake3(data: bytes) -> bytes:
    """The 32-byte digest."""
    return struct.pack("<8I", *_node(data, 0, _ROOT))


def blake3_words(inputs: list[bytes]) -> np.ndarray:
    """The first 8 digest bytes of each input as little-endian unsigned 64-bit;
    inputs of one block (64 bytes) are hashed together, longer ones singly."""
    out = np.zeros(len(inputs), np.uint64)
    short = [i for i, x in enumerate(inputs) if len(x) <= _BLOCK]
    for i in set(range(len(inputs))) - set(short):
        (out[i],) = struct.unpack("<Q", blake3(inputs[i])[:8])
    if not short:
        return out
    blocks = np.frombuffer(b"".join(inputs[i].ljust(_BLOCK, b"\0") for i in short), "<u4").reshape(-1, 16)
    m = [blocks[:, i].copy() for i in range(16)]
    n = len(short)
    fixed = [*_IV, *_IV[:4], 0, 0, 0, _CHUNK_START | _CHUNK_END | _ROOT]
    v = [np.full(n, x, np.uint32) for x in fixed]
    v[14] = np.array([len(inputs[i]) for i in short], np.uint32)

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x >> np.uint32(by)) | (x << np.uint32(32 - by))

    for _ in range(7):
        for i, (a, b, c, d) in enumerate(_MIXES):
            for word, (turn_d, turn_b) in zip(m[2 * i : 2 * i + 2], ((16, 12), (8, 7))):
                v[a] = v[a] + v[b] + word
                v[d] = turn(v[d] ^ v[a], turn_d)
                v[c] = v[c] + v[d]
                v[b] = turn(v[b] ^ v[c], turn_b)
        m = [m[i] for i in _ORDER]
    low, high = (v[0] ^ v[8]).astype(np.uint64), (v[1] ^ v[9]).astype(np.uint64)
    out[short] = low | (high << np.uint64(32))
    return out
