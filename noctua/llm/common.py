"""Helpers that the corpus operators share: reading tables, cutting lineage, and splitting texts into hashed words.

Words are handled as 64-bit hashes in NumPy arrays, a megabyte of text at a time, so that a task's memory does not depend
on its number of rows.  A single very long text is one chunk of its own, of which a task holds about twelve bytes a byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.session import shared_dir, written  # noqa: F401

#: Text and rows of a slice, which bound what a task holds at once.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a token between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word of ASCII digits, ASCII letters and any characters beyond ASCII.
WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = WORDY[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []
#: Codes of which one step of hashing makes running sums.
BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """For each name one that df has no column of, in any case of letters; for columns that come and go inside an operator."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The doc_id, and for rows without one a hash of the text from 2^62 up, so that different texts are told apart."""
    hashed = F.xxhash64(F.col(text).cast("string")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col(doc_id).cast("long"), hashed)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER_CODE = BYTE_CODE[_LOWER]


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for two blocks; made once a process."""
    if not _POWERS:
        with np.errstate(over="ignore"):
            for base in (_BASE, _INVERSE):
                table = np.full(2 * BLOCK + 1, base, np.uint64)
                table[0] = 1
                _POWERS.append(np.multiply.accumulate(table))
    return _POWERS[0], _POWERS[1]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each slice codes[start:end] (or table[codes[start:end]]); equal slices hash alike.  starts rise.

    Running sums go over blocks of a fixed size, so that memory beyond the arguments does not follow their length; a
    slice that leaves its block goes on from block to block."""
    up, down = _powers()
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, lo + BLOCK)))
        top = min(int(ends[at:to].max()), lo + 2 * BLOCK)
        sums = _sums(codes[lo:top], table, up)
        s = starts[at:to] - lo
        out[at:to] = (sums[np.minimum(ends[at:to], top) - lo] - sums[s]) * down[s]
        for i in at + np.flatnonzero(ends[at:to] > top):
            for more in range(top, int(ends[i]), BLOCK):
                rest = _sums(codes[more : min(more + BLOCK, int(ends[i]))], table, up)[-1:]
                out[i : i + 1] += rest * np.uint64(pow(int(_BASE), more - int(starts[i]), 1 << 64))
        at = to
    return mix(out + (ends - starts).astype(np.uint64))


def _sums(codes: np.ndarray, table: np.ndarray | None, up: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes if table is None else table[codes]) * up[: len(codes)], out=sums[1:])
    return sums


class Words:
    """The hashed words of some texts.

    hash: of each word; first: index of each text's first word, with the total at the end; start, end: byte positions
    in data; data: the texts' bytes, one after the other."""

    def __init__(self, texts: pa.Array, kind: np.ndarray = SPACED, lower: str = "ascii"):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower == "unicode":
            texts = pc.utf8_lower(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = data
        starts, ends = [], []
        for lo in range(0, len(data), BLOCK):  # flags of a byte each, for a block and a byte on either side
            hi = min(lo + BLOCK, len(data))
            inside = np.zeros(hi - lo + 2, bool)
            a, b = max(lo - 1, 0), min(hi + 1, len(data))
            inside[a - lo + 1 : b - lo + 1] = kind[data[a:b]]
            edge = np.zeros(hi - lo + 1, bool)
            own = self.offsets[np.searchsorted(self.offsets, lo) : np.searchsorted(self.offsets, hi, side="right")]
            edge[own - lo] = True
            here = inside[1:-1]
            starts.append(lo + np.flatnonzero(here & (~inside[:-2] | edge[:-1])))
            ends.append(lo + 1 + np.flatnonzero(here & (~inside[2:] | edge[1:])))
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.hash = run_hashes(self.data, self.start, self.end, _LOWER_CODE if lower else BYTE_CODE)
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.first) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word indices) at which n words of one text begin, and the hashes of those n words."""
        room = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hash))
        at = np.flatnonzero(room >= n)
        return at, run_hashes(self.hash, at, at + n)


def word_hash(word: str) -> int:
    """The hash that Words gives to this (lower-case) word."""
    code = BYTE_CODE[np.frombuffer(word.encode(), np.uint8)]
    return int(run_hashes(code, np.array([0]), np.array([len(code)]))[0])


#: How to let go of what the last operator of this worker keeps for its next task.
_KEPT: list[Callable[[], None]] = []


def _let_go() -> None:
    """Give free memory back to the system, since a worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS, forget: Callable[[], None] | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows` rows and `size` bytes of text, or of one row.

    forget: frees what the caller keeps in the worker; it is called when another operator comes."""
    if _KEPT and _KEPT[0] != forget:
        _KEPT.pop()()
        _let_go()
    if forget and not _KEPT:
        _KEPT.append(forget)
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(total, base + size, side="right"))))
            yield batch.slice(at, to - at)
            at = to
    batch = None
    _let_go()


class Lookup:
    """Finds which of many 64-bit hashes stand in a small sorted set, by a bitmap first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.bits = min(26, max(12, (8 * len(self.keys)).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that are in the set, and their places in keys."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - self.bits)])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        good = self.keys[place] == hashes[at]
        return at[good], place[good]
