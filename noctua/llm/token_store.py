"""Token ids in files of canonical length-limited Huffman code, read back by table-driven decoding.

A file set is a folder of Parquet part files whose rows are blocks of whole documents, in ascending doc_id order, and a
codebook.  Each block decodes on its own; inside it, a mark every MARK ids gives the bit where decoding can start, so
all stretches between marks are decoded side by side.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.llm.common import chunks, mix, run_hashes, shared_dir, written

MARK = 128
LONGEST = 18
BLOCK_IDS = 1 << 16
#: How the pieces of a word-level BPE are found; Tokenizer finds the same ones.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The byte-level alphabet: bytes that Latin-1 does not show, in order, are the characters from 256 up.
VISIBLE = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
BLOCK = "file int, block int, before long, n_ids long, doc_ids array<long>, sizes array<int>, bits binary, marks binary"


# --- the code ---------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bit lengths (uint8; 0 for ids that do not occur) of an optimal prefix code of at most `longest` bits, by
    package-merge: each level merges the symbols with pairs of the level before, and a symbol's length is the number of
    levels in which it is among those taken."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    longest = max(longest, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(float)
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate((weight, packages))
        at = np.argsort(both, kind="stable")
        levels.append(at < len(weight))
        merged = both[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, length = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        length[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = length
    return out


class Code:
    """The canonical code of some lengths: codes in order of length, then id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = int(self.lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        step = np.left_shift(1, self.width - self.lengths[order])
        begin = np.cumsum(step) - step
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = begin >> (self.width - self.lengths[order])
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.symbol[: step.sum()] = np.repeat(order, step)
        self.size = np.ones(1 << self.width, np.int64)
        self.size[: step.sum()] = np.repeat(self.lengths[order], step)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids' bits, and the bit at which every MARK-th id begins."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        start = end - size
        if not len(ids):
            return b"", start
        window = self.codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
        word = start >> 5
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out = np.zeros(int(end[-1] + 31 >> 5) + 1, np.uint64)
        out[word[first]] += np.add.reduceat(window >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], start[::MARK]

    def encode_each(self, ids: np.ndarray, cut: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """What encode gives for each ids[cut[i] : cut[i + 1]], none of them empty, at once."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        first = end[cut[:-1]] - size[cut[:-1]]
        bits = end[cut[1:] - 1] - first
        words = np.concatenate(([0], np.cumsum(bits + 31 >> 5)))
        shift = np.repeat(32 * words[:-1] - first, np.diff(cut))
        start = end - size + shift
        window = self.codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
        word = start >> 5
        at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out = np.zeros(int(words[-1]) + 1, np.uint64)
        out[word[at]] += np.add.reduceat(window >> np.uint64(32), at)
        out[word[at] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), at)
        data = out.astype(">u4").tobytes()
        return [(data[4 * w : 4 * w + (b + 7 >> 3)], start[i:j:MARK] - 32 * w) for w, b, i, j in zip(words.tolist(), bits.tolist(), cut.tolist(), cut[1:].tolist(), strict=False)]

    def decode(self, bits: list[bytes], marks: list[np.ndarray], counts: list[int]) -> np.ndarray:
        """The ids of several blocks, one after the other; all stretches between marks advance together."""
        base = np.cumsum([0] + [len(b) for b in bits])
        data = np.frombuffer(b"".join(bits) + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = np.concatenate([m + 8 * b for m, b in zip(marks, base, strict=False)] + [np.zeros(0, np.int64)]).astype(np.int64)
        n = np.concatenate([np.minimum(MARK, c - MARK * np.arange(len(m))) for m, c in zip(marks, counts, strict=True)] + [np.zeros(0, np.int64)]).astype(np.int64)
        out = np.zeros((len(at), MARK), np.uint32)
        shift, mask = 32 - self.width, np.uint32((1 << self.width) - 1)
        order = np.argsort(-n, kind="stable")
        at, live = at[order], n[order]
        for i in range(MARK):
            m = int(np.searchsorted(-live, -i, side="left"))
            if not m:
                break
            peek = (window[at[:m] >> 3] >> (shift - (at[:m] & 7)).astype(np.uint32)) & mask
            out[order[:m], i] = self.symbol[peek]
            at[:m] += self.size[peek]
        return out[np.arange(MARK) < n[:, None]]


# --- tokens -----------------------------------------------------------------------------------------------------------


SPACE, PIECE, SINGLE, LETTER, ODD = range(5)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point.  ODD ones are left to the library: those without a class that libraries
    of different Unicode versions agree on, and those whose lower case is not one character."""
    kind, lower = np.full(0x110000, ODD, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        cat = unicodedata.category(c)
        low = c.lower()
        if len(low) == 1 and cat[0] != "C":
            kind[i] = LETTER if cat[0] == "L" else SINGLE if cat[0] == "N" else SPACE if cat[0] == "Z" else PIECE
            lower[i] = ord(low)
    kind[[9, 10, 11, 12, 13]] = SPACE
    return kind, lower


class Tokenizer:
    """Ids of whole texts from a tokenizer file of the tokenizers library.

    For a BPE whose pieces are runs of letters, single numbers or runs of other marks, and end in an end-of-word mark,
    pieces are encoded by the library and remembered by their hashes in a table, where a piece gives way to another of
    its slot, and all do after `keep` pieces; a text with characters that this might treat differently, with special
    tokens, or not in NFC, goes to the library whole."""

    def __init__(self, path: str, keep: int = 400_000, table_bits: int = 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library, self.keep, self.bits = Library.from_file(path), keep, table_bits
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        mark = spec["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_piece = bool(mark) and (steps[0].get("pattern") or {}).get("Regex") == PIECES and steps[1:] == [BYTES] and (spec.get("normalizer") or {}).get("type") == "Sequence"
        if self.by_piece:
            self.kind, self.lower = _characters()
            self.code = mix(np.arange(1, len(self.kind) + 1, dtype=np.uint64))
        self.clear()

    def clear(self) -> None:
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.slot_key, self.slot_place = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of more pieces, which the library's model takes as visible characters, one for each byte."""
        model = self.library.model
        each = [[t.id for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(VISIBLE))] for p in pieces]
        more = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + more))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(each), np.uint32, int(more[-1]))))

    def _pieces(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece; codes are lower case."""
        kind = self.kind[codes]
        new = np.ones(len(codes), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == SINGLE)
        new[offsets[:-1][offsets[:-1] < len(codes)]] = True
        mark = np.flatnonzero(new & (codes == 39))
        if len(mark):  # 's 't 're 've 'm 'll 'd where a piece begins
            stop = offsets[np.searchsorted(offsets, mark, side="right")]
            one, two = np.zeros(len(mark), np.uint32), np.zeros(len(mark), np.uint32)
            ok1, ok2 = mark + 1 < stop, mark + 2 < stop
            one[ok1], two[ok2] = codes[mark[ok1] + 1], codes[mark[ok2] + 2]
            pair = ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))
            n = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where(pair, 2, 0))
            mark, n, stop = mark[n > 0], n[n > 0], stop[n > 0]
            new[mark + 1] = False
            after = mark + 1 + n
            after = after[after < stop]
            new[after[self.kind[codes[after]] == LETTER]] = True
        new &= kind != SPACE
        cut = np.flatnonzero(new | (kind == SPACE))
        end = np.append(cut[1:], len(codes))
        good = new[cut]
        return cut[good], end[good]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null: none."""
        whole = lambda t: np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
        if not self.by_piece:
            return [whole(t or "") for t in texts]
        if len(self.bounds) > self.keep:
            self.clear()
        codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        alone = [bool(len(c)) and ("<|" in t or (self.kind[c] == ODD).any() or not t.isascii() and not unicodedata.is_normalized("NFC", t)) for t, c in zip(texts, codes, strict=True)]
        plain = [c if not a else c[:0] for c, a in zip(codes, alone, strict=True)]
        offsets = np.concatenate(([0], np.cumsum([len(c) for c in plain]))).astype(np.int64)
        code = self.lower[np.concatenate(plain)] if len(plain) else np.zeros(0, np.uint32)
        del codes, plain
        begin, end = self._pieces(code, offsets)
        h = run_hashes(code, begin, end, self.code)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        place = np.where(self.slot_key[slot] == h, self.slot_place[slot], -1).astype(np.int64)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            keys, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = len(self.bounds) - 1 + np.arange(len(keys))
            text = code.tobytes().decode("utf-32-le")
            self._learn([text[i:j] for i, j in zip(begin[miss[first]].tolist(), end[miss[first]].tolist(), strict=True)])
            place[miss] = at[back]
            where = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
            self.slot_place[where] = at  # of keys with one slot the last stays, here and there
            self.slot_key[where] = keys
        start = self.bounds[place]
        n = self.bounds[place + 1] - start
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(start - total[:-1], n) + np.arange(total[-1])]
        cut = total[np.searchsorted(begin, offsets)]
        return [whole(t) if a else ids[x:y] for t, a, x, y in zip(texts, alone, cut, cut[1:], strict=False)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


# --- writing and reading ----------------------------------------------------------------------------------------------


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end: int, spool: Code) -> Iterator[pa.RecordBatch]:
    """Each document's ids in the spool code, and at the end of the task one row with its counts of ids."""
    tok = tokenizer(path)
    counts = np.zeros(max(tok.size, end + 1), np.int64)
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["doc_id", "n", "bits", "marks", "counts"]
    for batch in chunks(batches, forget=tokenizer.cache_clear):
        ids = [np.append(x, np.uint32(end)) for x in tok.encode(batch.column("text").to_pylist())]
        counts += np.bincount(np.concatenate(ids), minlength=len(counts))
        coded = spool.encode_each(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))
        columns = [batch.column("doc_id"), [len(x) for x in ids], [c[0] for c in coded], [c[1].astype(np.int32).tobytes() for c in coded], [None] * len(ids)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((None, 0, None, None, counts.tobytes()), kinds, strict=True)], names)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for blob in batch.column("counts").to_pylist():
            more = np.frombuffer(blob, np.int64)
            total = np.pad(total, (0, max(0, len(more) - len(total))))
            total[: len(more)] += more
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def _pack(batches: Iterator[pa.RecordBatch], spool: Code, code: Code, block_ids: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents from one range of doc_ids, in order."""
    file, block, before = TaskContext.get().partitionId(), 0, 0
    docs: list[tuple] = []

    def close():
        nonlocal block, before, docs
        ids = spool.decode([d[2] for d in docs], [np.frombuffer(d[3], np.int32) for d in docs], [d[1] for d in docs])
        bits, marks = code.encode(ids)
        row = (file, block, before, len(ids), [d[0] for d in docs], [d[1] for d in docs], bits, marks.astype(np.int64).tobytes())
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        block, before, docs = block + 1, before + len(ids), []
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["file", "block", "before", "n_ids", "doc_ids", "sizes", "bits", "marks"])

    held = 0
    for batch in batches:
        for doc in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "bits", "marks")), strict=True):
            docs.append(doc)
            held += doc[1]
            if held >= block_ids:
                yield close()
                held = 0
    if docs:
        yield close()


def _unpack(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[pa.RecordBatch]:
    """doc_id, start and ids of every document."""
    for batch in batches:
        for r in batch.to_pylist():
            ids = code.decode([r["bits"]], [np.frombuffer(r["marks"], np.int64)], [r["n_ids"]])
            cut = np.concatenate(([0], np.cumsum(r["sizes"]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(cut[:-1] + np.int64(r["start"] + r["before"])), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(cut, pa.array(ids.astype(np.int32)))],
                ["doc_id", "start", "n_tokens", "ids"],
            )


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end: int = 1, file_ids: int = 1 << 23, block_ids: int = BLOCK_IDS, spool_docs: int = 512) -> str:
    """Encode every whole text (null: empty), append `end`, and write the ids under `path` in ascending doc_id order
    (nulls first; rows that share a doc_id in order of their number of ids and a hash of these).  Rows of one
    doc_id, or without one, are dealt over files like others.

    Texts are tokenized once.  Ids wait in a spool in a provisional code, made from `spool_docs` documents with every id
    counted once more, which keeps the spool and its one shuffle as small as the result; the final code comes from
    the exact counts of all ids, of which there are no more than the vocabulary has."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tok = tokenizer(tokenizer_path)
    guess = np.ones(max(tok.size, end + 1), np.int64)
    for row in source.limit(spool_docs).select(F.substring("text", 1, 1 << 14)).collect():
        np.add.at(guess, tok.encode([row[0]])[0], 1000)
    guess[end] += 1000 * spool_docs
    tok.clear()
    spool = spark.sparkContext.broadcast(Code(code_lengths(guess)))
    tokens = written(source.mapInArrow(lambda b: _tokenize(b, tokenizer_path, end, spool.value), "doc_id long, n int, bits binary, marks binary, counts binary"), "tokens")
    counts = tokens.where("counts is not null").select("counts").mapInArrow(_sum_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(max(tok.size, end + 1), np.int64)
    total[counts.id.to_numpy(np.int64)] = counts.n.to_numpy(np.int64)
    lengths = code_lengths(total)
    code = spark.sparkContext.broadcast(Code(lengths))
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.parquet(f"{path}/codebook")
    files = max(1, -(-int(total.sum()) // file_ids))
    keyed = tokens.where("counts is null").drop("counts").withColumns({"tie": F.xxhash64("bits"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(files, "doc_id", "n", "tie", "row").sortWithinPartitions("doc_id", "n", "tie").drop("tie", "row")
    ordered.mapInArrow(lambda b: _pack(b, spool.value, code.value, block_ids), BLOCK).write.parquet(f"{path}/blocks")
    ends = spark.read.schema(BLOCK).parquet(f"{path}/blocks").groupBy("file").agg(F.sum("n_ids").alias("n"))  # a row per file
    ends.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start")).write.parquet(f"{path}/files")
    return path


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with the number of ids in all files before theirs."""
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").join(spark.read.schema("file int, start long").parquet(f"{path}/files"), "file")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document of a file set."""
    code = spark.sparkContext.broadcast(Code(np.frombuffer(spark.read.parquet(f"{path}/codebook").first()[0], np.uint8)))
    return _placed(spark, path).mapInArrow(lambda b: _unpack(b, code.value), "doc_id long, start long, n_tokens long, ids array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_tokens, with a CRC-32 of the ids as little-endian 32-bit integers instead of the ids."""
    code = spark.sparkContext.broadcast(Code(np.frombuffer(spark.read.parquet(f"{path}/codebook").first()[0], np.uint8)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _unpack(batches, code.value):
            cut, ids = b.column("ids").offsets.to_numpy(), b.column("ids").values.to_numpy().astype("<u4").tobytes()
            crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
