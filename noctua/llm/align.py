"""Alignment of two tokenizers over the same bytes, and how many documents link each pair of their ids.

A text is cut before spaces that follow no white space: neither tokenizer joins bytes over such a place, so each piece is
encoded and aligned once in a worker and then known by its hash.  A first pass gathers the distinct pairs with partial
counts; a minimal perfect hash gives each pair a slot; dense count vectors are summed in tasks, then by block; a second pass
aligns the documents again and looks their pairs up, each verified by the key of its slot.

The pairs are bounded by the two vocabularies, not by the corpus, and are split by the first id into parts of about PART pairs;
what is broadcast is one part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.common import BYTE_CODE, CHUNK_BYTES, chunks, fresh_names, mix, run_hashes
from noctua.session import written

#: Pairs of a part, keys of a small hash bucket, buckets of a building task, slots of a block of counts.
PART, KEYS, TASK, BLOCK = 1 << 23, 3, 1 << 14, 1 << 16
#: Bytes that a worker keeps of aligned pieces; pairs that a task sums before it hands them on.
KEPT_BYTES, HELD = 160 << 20, 1 << 21
#: Bytes of pieces that are given to a tokenizer as one text.
JOINED = 1 << 15
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


# --- the tokenizers ------------------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


def _laid_out(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' bytes one after the other, where each starts, and their lengths."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


class ByteLevel:
    """Ids of a byte-level file of the tokenizers library; special tokens in texts are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.cuts = True
        self.flat, self.starts, self.lengths = _laid_out(self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Ids of a sentencepiece model that puts a space before a text; a text's own first space is left to it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        #: Without pieces that hold a space after something else, merges never reach over a space.
        self.cuts = not any(re.search("[^▁]▁", n) for n in names)
        self.flat, self.starts, self.lengths = _laid_out(self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


@cache
def _tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


# --- pieces and their alignment ------------------------------------------------------------------------------------------------


def _blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space."""
    b1, b2, b3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    blank = _SPACE[b1] | ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)) | ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))
    return blank | ((b3 == 0xE2) & (((b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))) | ((b2 == 0x81) & (b1 == 0x9F))))


def cut_texts(texts: pa.Array, cuts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, each after a space, and where their pieces start; first piece of each text, with the end.

    A piece starts with each text and at each space whose character before is not white space; a space that ends a text
    stays with what is before it, since no tokenizer can be asked for it alone."""
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    spaced = pc.binary_join_element_wise(empty, texts.cast(pa.large_string()), space)
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at = np.flatnonzero(data == 32)
    inner = at[at > 0] if cuts else at[:0]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inner = inner[~(_blank_before(data, inner) | edge[inner + 1])]
    edge[inner] = True
    starts = np.flatnonzero(edge[:-1])
    return data, starts, np.searchsorted(starts, offsets)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x, sorted, and how often each stands there."""
    x = np.sort(x)
    lead = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[lead], np.diff(np.append(lead, len(x)))


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of n each, one after the other."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


def _encoded(kind: ByteLevel | Pieces, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the texts whose tokens have the texts' bytes, one after the other; the number of ids of each text; which texts these are."""
    found = kind.encode([t.decode() for t in texts])
    n = np.array([len(x) for x in found], np.int64)
    ids = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
    text = np.repeat(np.arange(len(texts)), n)
    size = np.array([len(t) for t in texts], np.int64)
    good = np.bincount(text, weights=kind.lengths[ids], minlength=len(texts)).astype(np.int64) == size
    ids, text = ids[good[text]], text[good[text]]
    whole = np.frombuffer(b"".join([t for t, g in zip(texts, good.tolist(), strict=True) if g]), np.uint8)
    differs = whole != kind.flat[_ranges(kind.starts[ids], kind.lengths[ids])]
    good[np.repeat(np.flatnonzero(good), size[good])[differs]] = False
    return ids[good[text]], np.where(good, n, 0), good


class Tokens:
    """Ids of some pieces by one tokenizer: ids, and count of each piece; good: the tokens' bytes are the piece's.

    Pieces that end in no white space can stand one after the other in one text, whose places to cut are theirs; a text whose
    bytes differ is taken again piece by piece."""

    def __init__(self, kind: ByteLevel | Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        raw, n = data.tobytes(), len(starts)
        pieces = [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        alone = _blank_before(data, ends) if kind.cuts else np.ones(n, bool)
        rest = np.flatnonzero(~alone)
        groups = np.split(rest, np.flatnonzero(np.diff(np.cumsum((ends - starts)[rest]) // JOINED)) + 1) if len(rest) else []
        ids, _, fine = _encoded(kind, [b"".join([pieces[k] for k in g.tolist()]) for g in groups])
        joined = np.concatenate([g for g, ok in zip(groups, fine.tolist(), strict=True) if ok] or [rest[:0]])
        single = np.concatenate([np.flatnonzero(alone), *[g for g, ok in zip(groups, fine.tolist(), strict=True) if not ok]])
        # ids of joined texts go to their pieces by where they end
        piece = joined[np.searchsorted(np.cumsum((ends - starts)[joined]), np.cumsum(kind.lengths[ids]))]
        more, counts, good = _encoded(kind, [pieces[k] for k in single.tolist()])
        piece = np.append(piece, np.repeat(single, counts))
        order = np.argsort(piece, kind="stable")
        self.ids = np.append(ids, more)[order]
        self.count = np.bincount(piece, minlength=n)
        self.good = np.zeros(n, bool)
        self.good[joined] = True
        self.good[single[good]] = True


class Aligned:
    """Aligned pieces of a worker, by number: n (n_a, n_b, n_groups, n_links), text (of the groups, each with ; after it), bad
    (where the bytes differ), and codes a * size_b + b with the times each is linked, from first[i] on."""

    def __init__(self, a: str, b: str):
        self.a, self.b = _tokenizers(a, b)
        self.size_b = len(self.b.bytes)
        self.age = 0
        self.clear()

    def clear(self) -> None:
        self.age += 1
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text: list[bytes] = []
        self.bad = np.zeros(0, bool)
        self.n = np.zeros((0, 4), np.int64)
        self.codes, self.times, self.first = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.kept = 0

    def find(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The numbers of the pieces that start there; new ones are aligned."""
        if self.kept > KEPT_BYTES:
            self.clear()
        ends = np.append(starts[1:], len(data))
        hashes = run_hashes(data, starts, ends, BYTE_CODE)
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        known = np.full(len(unique), -1)
        there = np.flatnonzero(place < len(self.hashes))
        there = there[self.hashes[place[there]] == unique[there]]
        known[there] = self.numbers[place[there]]
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = len(self.text) + np.arange(len(new))
            size = np.cumsum(ends[at[new]] - starts[at[new]])
            for run in np.split(new, np.flatnonzero(np.diff(size // CHUNK_BYTES)) + 1):
                self._add(data, starts[at[run]], ends[at[run]])
            every = np.append(self.hashes, unique[new])
            order = np.argsort(every, kind="stable")
            self.hashes, self.numbers = every[order], np.append(self.numbers, known[new])[order]
        return known[back]

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n = len(starts)
        a, b = (Tokens(kind, data, starts, ends) for kind in (self.a, self.b))
        good = a.good & b.good
        for t in (a, b):
            t.ids = t.ids[np.repeat(good, t.count)]
            t.count = np.where(good, t.count, 0)
        end_a, end_b = np.cumsum(self.a.lengths[a.ids]), np.cumsum(self.b.lengths[b.ids])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        from_a, from_b = (np.searchsorted(g, np.arange(len(common) + 1)) for g in (group_a, group_b))
        owner = np.repeat(np.arange(n), a.count)[from_a[:-1]]
        each_a, each_b = np.diff(from_a), np.diff(from_b)
        n_groups = np.bincount(owner, minlength=n)
        n_links = np.bincount(owner, weights=each_a * each_b, minlength=n).astype(np.int64)
        owners, codes, times = self._links(a.ids, b.ids, from_a, from_b, owner)
        self.codes = np.concatenate([self.codes, codes.astype(np.uint32)])
        self.times = np.concatenate([self.times, times.astype(np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(owners, minlength=n))])
        self.n = np.concatenate([self.n, np.stack([a.count, b.count, n_groups, n_links], 1)])
        self.bad = np.concatenate([self.bad, ~good])
        self.text += _written_groups(a.ids, b.ids, group_a, group_b, from_a, from_b, owner, n)
        self.kept += 8 * len(codes) + 140 * n + sum(map(len, self.text[-n:]))

    def _links(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces, codes and times of the links, by piece: all of a group one by one, of a very large one by distinct ids."""
        each_a, each_b = np.diff(from_a), np.diff(from_b)
        large = each_a * each_b > 1 << 12
        group = np.repeat(np.arange(len(each_a)), each_a)
        left = np.flatnonzero(~large[group])
        group = group[left]
        codes = np.repeat(a[left] * self.size_b, each_b[group]) + b[_ranges(from_b[group], each_b[group])]
        key, times = _distinct(np.repeat(owner[group] << 32, each_b[group]) | codes)
        owners, codes = key >> 32, key & 0xFFFFFFFF
        for g in np.flatnonzero(large):
            (ua, ca), (ub, cb) = (_distinct(x[f[g] : f[g + 1]]) for x, f in ((a, from_a), (b, from_b)))
            codes = np.append(codes, (ua[:, None] * self.size_b + ub).ravel())
            times = np.append(times, (ca[:, None] * cb).ravel())
            owners = np.append(owners, np.full(len(ua) * len(ub), owner[g]))
        if large.any():
            order = np.argsort(owners, kind="stable")
            owners, codes, times = owners[order], codes[order], times[order]
        return owners, codes, times


def _written_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """For each of n pieces its groups as `a1,a2|b1;`: every id's digits and what stands after it, laid out in one array."""
    ids = np.concatenate([a, b])
    group = np.concatenate([group_a, group_b])
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[from_a[1:] - 1] = ord("|")
    mark[len(a) + from_b[1:] - 1] = ord(";")
    order = np.argsort(group, kind="stable")
    ids, group, mark = ids[order], group[order], mark[order]
    wide = max(1, len(str(int(ids.max(initial=0)))))
    digits = ids[:, None] // 10 ** np.arange(wide - 1, -1, -1)
    shown = digits > 0
    shown[:, -1] = True
    letters = np.concatenate([(digits % 10 + ord("0")).astype(np.uint8), mark[:, None]], 1)
    shown = np.concatenate([shown, np.ones((len(ids), 1), bool)], 1)
    text = letters[shown].tobytes()
    ends = np.append(0, np.cumsum(np.bincount(owner[group], weights=shown.sum(1), minlength=n).astype(np.int64))).tolist()
    return [text[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


class Slice:
    """A slice of texts: piece numbers, the document of each piece, and which documents have tokens."""

    def __init__(self, known: Aligned, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, starts, self.first = cut_texts(texts, known.a.cuts and known.b.cuts)
        self.piece = known.find(data, starts)
        full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        self.good = full & (self.sums(known.bad[self.piece]) == 0)
        self.document = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's pieces."""
        total = np.append(0, np.cumsum(values))
        return total[self.first[1:]] - total[self.first[:-1]]


_WORKER: dict[tuple[str, str], Aligned] = {}


def _aligned(a: str, b: str) -> Aligned:
    if (a, b) not in _WORKER:
        _WORKER.clear()
        _WORKER[a, b] = Aligned(a, b)
    return _WORKER[a, b]


def _forget() -> None:
    _WORKER.clear()
    _tokenizers.cache_clear()


# --- first pass: the pairs of documents ---------------------------------------------------------------------------------------


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    lead = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[lead], np.add.reduceat(n, lead) if len(lead) else n


def _gather(a: str, b: str, text: str) -> Callable:
    """Pairs of a task's documents with their numbers of documents, summed as far as HELD pairs reach."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, held = _aligned(a, b), [], 0
        for batch in chunks(batches, text, forget=_forget):
            s = Slice(known, batch.column(text))
            own = s.good[s.document]
            pairs, _ = _distinct(s.document[own] << 32 | s.piece[own])
            piece = pairs & 0xFFFFFFFF
            n = known.first[piece + 1] - known.first[piece]
            code = known.codes[_ranges(known.first[piece], n)].astype(np.int64)
            once, _ = _distinct(np.repeat(pairs >> 32, n) << 32 | code)
            codes, times = _distinct(once & 0xFFFFFFFF)
            parts.append((codes, times))
            held += len(codes)
            if held > HELD:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if 2 * held > HELD:
                    yield _pair_rows(parts.pop())
                    held = 0
        if parts:
            yield _pair_rows(_merged(parts))

    return step


def _pair_rows(pairs: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in pairs], ["code", "n"])


# --- the minimal perfect hash and its counts ------------------------------------------------------------------------------------


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(codes) % np.uint64(buckets)).astype(np.int64)


def _place(codes: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (mix(codes ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))) % sizes.astype(np.uint64)).astype(np.int64)


def find_seeds(codes: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the smallest seed that places its keys one to a slot, and its number of keys."""
    order = np.argsort(bucket, kind="stable")
    codes, bucket = codes[order], bucket[order]
    sizes = np.bincount(bucket, minlength=buckets)
    seeds = np.zeros(buckets, np.uint32)
    left = np.flatnonzero(sizes > 1)
    seed = 0
    while len(left):
        many = max(1, min(4096, (1 << 18) // max(1, int(sizes[left].sum()))))  # seeds at once
        own = np.isin(bucket, left)
        c, k = codes[own], np.searchsorted(left, bucket[own])
        first = np.searchsorted(k, np.arange(len(left)))
        tries = seed + np.arange(many, dtype=np.uint64)[:, None]
        slots = _place(c[None, :], tries, sizes[left][k][None, :])
        hit = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), slots.astype(np.uint64)), first, axis=1)
        full = hit == (np.left_shift(np.uint64(1), sizes[left].astype(np.uint64)) - np.uint64(1))[None, :]
        done = full.any(0)
        seeds[left[done]] = seed + full.argmax(0)[done]
        left = left[~done]
        seed += many
    return seeds, sizes


class PairHash:
    """Slots of known keys, without gaps or collisions; any other key gets some slot too, so keys are to be verified."""

    def __init__(self, seeds: np.ndarray, sizes: np.ndarray):
        self.seeds, self.sizes = seeds, sizes.astype(np.uint8)
        self.starts = np.append(0, np.cumsum(sizes, dtype=np.int64))

    def slots(self, codes: np.ndarray) -> np.ndarray:
        k = bucket_of(codes, len(self.seeds))
        return self.starts[k] + _place(codes, self.seeds[k], np.maximum(self.sizes[k], 1))


def build_hash(keys: DataFrame, n: int) -> PairHash:
    """The hash of the n distinct codes of keys; seeds are sought in tasks of TASK buckets of about KEYS keys."""
    buckets = max(1, -(-n // KEYS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = bucket_of(batch.column("code").to_numpy().astype(np.uint64), buckets)
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(k), pa.array(k // TASK)], ["code", "bucket", "task"])

    def seek(group: pa.Table) -> pa.Table:
        task = group.column("task")[0].as_py()
        own = min(TASK, buckets - task * TASK)
        seeds, sizes = find_seeds(group.column("code").to_numpy().astype(np.uint64), group.column("bucket").to_numpy() - task * TASK, own)
        return pa.table({"task": pa.array([task]), "seeds": pa.array([seeds.tobytes()], pa.binary()), "sizes": pa.array([sizes.astype(np.uint8).tobytes()], pa.binary())})

    rows = keys.select("code").mapInArrow(deal, "code long, bucket long, task long").groupBy("task").applyInArrow(seek, "task long, seeds binary, sizes binary")
    seeds, sizes = np.zeros(buckets, np.uint32), np.zeros(buckets, np.uint8)
    for row in rows.collect():  # five bytes a bucket, of PART / KEYS buckets at most
        at = slice(row.task * TASK, row.task * TASK + TASK)
        seeds[at], sizes[at] = np.frombuffer(row.seeds, np.uint32), np.frombuffer(row.sizes, np.uint8)
    return PairHash(seeds, sizes)


class Counts:
    """A part's pairs by slot: keys, counts, and whether a count is the highest of its first id."""

    def __init__(self, of: PairHash, keys: np.ndarray, counts: np.ndarray, size_b: int):
        self.of, self.keys, self.counts = of, keys, counts
        first = (keys // np.uint64(size_b)).astype(np.int64)
        highest = np.zeros(int(first.max(initial=0)) + 1, np.int64)
        np.maximum.at(highest, first, counts)
        self.best = counts == highest[first]

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and best flags; 0 for codes of other parts."""
        if not len(self.keys) or not len(codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        slot = np.minimum(self.of.slots(codes), len(self.keys) - 1)
        mine = self.keys[slot] == codes
        return np.where(mine, self.counts[slot], 0), mine & self.best[slot]


def dense_counts(pairs: DataFrame, keys: DataFrame, size_b: int) -> Counts:
    """Counts of the distinct codes of keys from pairs (code, n), partial counts: dense vectors of a task, cut in blocks of
    BLOCK slots, then one sum for each block."""
    n = keys.count()
    of = build_hash(keys, n)
    shared = pairs.sparkSession.sparkContext.broadcast(of)

    def blocks(keys: np.ndarray, counts: np.ndarray, numbers: list[int]) -> pa.Table:
        parts = [slice(k * BLOCK, (k + 1) * BLOCK) for k in numbers]
        return pa.table({"block": pa.array(numbers, pa.int64()), "keys": pa.array([keys[p].tobytes() for p in parts], pa.binary()), "counts": pa.array([counts[p].tobytes() for p in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = np.zeros(0, np.int64)
        for batch in batches:
            if not len(counts):  # only where there are rows
                keys, counts = np.zeros(n, np.uint64), np.zeros(n, np.int64)
            code = batch.column("code").to_numpy().astype(np.uint64)
            slot = shared.value.slots(code)
            keys[slot] = code
            np.add.at(counts, slot, batch.column("n").to_numpy())
        full = np.add.reduceat(counts, np.arange(0, n, BLOCK)) if len(counts) else counts
        for k in np.flatnonzero(full):
            yield from blocks(keys, counts, [int(k)]).to_batches()

    def total(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        size = min(BLOCK, n - block * BLOCK)
        keys, counts = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        for k, c in zip(group.column("keys"), group.column("counts"), strict=True):
            own, more = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)
            if ((own != keys) & (more > 0) & (counts > 0)).any():
                raise ValueError("two pairs share a slot")
            np.maximum(keys, own, out=keys)
            counts += more
        return pa.table({"block": pa.array([block]), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    rows = pairs.mapInArrow(add, "block long, keys binary, counts binary").groupBy("block").applyInArrow(total, "block long, keys binary, counts binary")
    keys_, counts = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for row in rows.toLocalIterator():  # a part, PART pairs at most but for one first id's
        at = slice(row.block * BLOCK, (row.block + 1) * BLOCK)
        keys_[at], counts[at] = np.frombuffer(row.keys, np.uint64), np.frombuffer(row.counts, np.int64)
    shared.unpersist()
    return Counts(of, keys_, counts, size_b)


# --- second pass ------------------------------------------------------------------------------------------------------------------


def _look_up(a: str, b: str, text: str, counts, first: bool) -> Callable:
    """Adds the part's n_best and count_sum; the first part also gives what needs no counts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done, age = _aligned(a, b), 0, 0
        best = summed = np.zeros(0, np.int64)
        for batch in chunks(batches, text, forget=_forget):
            s = Slice(known, batch.column(text))
            if age != known.age:  # the pieces were let go meanwhile
                done, best, summed, age = 0, best[:0], summed[:0], known.age
            if done < len(known.text):
                at = known.first[done]
                n, top = counts.value.look_up(known.codes[at:].astype(np.uint64))
                new = known.first[done:] - at
                sums = [np.append(0, np.cumsum(v * known.times[at:])) for v in (top, n)]
                best, summed = (np.concatenate([old, x[new[1:]] - x[new[:-1]]]) for old, x in zip((best, summed), sums, strict=True))
                done = len(known.text)
            columns = {name: batch.column(name) for name in batch.schema.names}
            if first:
                for name, values in zip(COLUMNS, known.n[s.piece].T, strict=False):
                    columns[name] = pa.array(np.where(s.good, s.sums(values), 0))
                columns["n_best"] = columns["count_sum"] = pa.array(np.zeros(len(s.good), np.int64))
                words = s.piece.tolist()
                columns["groups_sha256"] = pa.array([hashlib.sha256(b"".join([known.text[i] for i in words[p:q]])[:-1]).hexdigest() if ok else "" for p, q, ok in zip(s.first[:-1], s.first[1:], s.good.tolist(), strict=True)])
            for name, values in (("n_best", best), ("count_sum", summed)):
                columns[name] = pa.array(columns[name].to_numpy() + np.where(s.good, s.sums(values[s.piece]), 0))
            yield pa.RecordBatch.from_pydict(columns)

    return step


def align_tokenizers(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """docs with n_a, n_b (tokens of the byte-level file a and the sentencepiece model b), n_groups (stretches between byte
    places where tokens of both end), n_links (pairs of an a and a b token that share a group), n_best (links whose pair is
    in as many documents as any pair of their a id), count_sum (documents of each link's pair, summed) and groups_sha256
    (of `a1,a2|b1;a3|b2,b3`).

    A text is taken after one space.  A null or empty one, and one whose tokens' bytes differ from it, has no tokens: zeros and
    ''.  Each row is a document, so repeated rows count again.  Other columns stay; new ones replace those of the same name.  An
    empty table gives an empty one."""
    spark = docs.sparkSession
    inside, = fresh_names(docs, "text")
    base = docs.drop(*[c for c in docs.columns if c in COLUMNS and c != text]).withColumn(inside, F.col(text).cast("string"))
    pairs = written(base.select(inside).mapInArrow(_gather(a, b, inside), "code long, n long"), "pairs")
    keys = written(pairs.select("code").distinct(), "pair-keys")
    size_b = len(_tokenizers(a, b)[1].bytes)
    parts = max(1, -(-keys.count() // PART))
    first = F.floor(F.col("code") / size_b)
    found = base
    for i in range(parts):
        mine = first % parts == i
        counts = spark.sparkContext.broadcast(dense_counts(pairs.where(mine), keys.where(mine), size_b))
        kinds = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
        new = "" if i else ", " + ", ".join(f"{c} {'string' if c.endswith('256') else 'long'}" for c in COLUMNS)
        found = found.mapInArrow(_look_up(a, b, inside, counts, not i), kinds + new)
    return found.drop(inside)
