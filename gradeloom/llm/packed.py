"""A file of token ids, each in the least bits that its vocabulary needs, with random access.

    magic "GLPK", bits, ids in a block (uint32 each), number of ids, blocks, documents (uint64 each)
    block offsets in bytes from the first block (uint64, one more than blocks)
    document ids (int64), whether each is null (uint8), first id of each document (uint64, one more)
    blocks: ids of `bits` bits each, lowest bit first, filled up to a whole byte

All numbers are little-endian. Whole blocks are unpacked by numpy; any stretch of ids is read
from the blocks that hold it.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, HEADER = b"GLPK", struct.Struct("<4sIIQQQ")
BLOCK_IDS = 1 << 16
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def width(vocabulary: int) -> int:
    """The least bits for ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    each = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(each, bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in _WHOLE:
        return np.frombuffer(data, dtype=_WHOLE[bits], count=n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros((n, 32), dtype=np.uint8)
    out[:, :bits] = each
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Gathers documents of one file. Full blocks are packed as they come."""

    def __init__(self, bits: int):
        self.bits = bits
        self.blocks: list[bytes] = []
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.docs: list[int | None] = []
        self.starts = [0]

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32)
        at = 0
        while len(ids) - at >= BLOCK_IDS or (last and at < len(ids)):
            self.blocks.append(pack(ids[at : at + BLOCK_IDS], self.bits))
            at += BLOCK_IDS
        self.rest = [ids[at:]]
        self.waiting = max(0, len(ids) - at)

    def finish(self) -> bytes:
        self._flush(True)
        n = len(self.docs)
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.blocks])]).astype("<u8")
        ids = np.array([0 if d is None else d for d in self.docs], dtype="<i8")
        null = np.array([d is None for d in self.docs], dtype=np.uint8)
        head = HEADER.pack(MAGIC, self.bits, BLOCK_IDS, self.starts[-1], len(self.blocks), n)
        return b"".join([head, offsets.tobytes(), ids.tobytes(), null.tobytes(), np.array(self.starts, dtype="<u8").tobytes(), *self.blocks])


class Reader:
    """Random access to a file's bytes (of a file, a buffer or a memory map)."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block_ids, self.n_ids, blocks, self.n_docs = HEADER.unpack_from(self.data, 0)
        if magic != MAGIC:
            raise ValueError("no packed file")
        at = HEADER.size

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.offsets = array("<u8", blocks + 1)
        ids, null = array("<i8", self.n_docs), array("u1", self.n_docs)
        self.docs = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        self.starts = array("<u8", self.n_docs + 1)
        self.first = at
        self.last: tuple[int, np.ndarray] | None = None

    def block(self, b: int) -> np.ndarray:
        if self.last is None or self.last[0] != b:
            self.last = b, self._unpacked(b)
        return self.last[1]

    def _unpacked(self, b: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - b * self.block_ids)
        return unpack(self.data[self.first + int(self.offsets[b]) : self.first + int(self.offsets[b + 1])], self.bits, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file."""
        if start >= stop:
            return np.empty(0, "<u4")
        first = start // self.block_ids
        parts = [self.block(b) for b in range(first, (stop - 1) // self.block_ids + 1)]
        joined = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return joined[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))
