"""Benchmark decontamination: pigeonhole edit matching of test items inside documents.

An item of m words may differ from a passage by k = floor(rate * m) word insertions, deletions and replacements.  It is
split into k + 1 runs of words; k edits leave at least one run whole, so every leak holds an exact run.  Runs are found
by rolling hashes, and the words around each are verified by Myers' bit-parallel edit distance over words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.common import WORDY, Lookup, Words, chunks, fresh_names, row_key, run_hashes, written

SCHEMA = "doc_id long, item_id long, distance int, budget int, first_word long, end_word long, item_words int"


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> list[int]:
    """Edit distance of the pattern to the best text slice that ends at each text position (anchored: to the whole text
    up to there), one bit per pattern word."""
    m, where = len(pattern), defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for w in text:
        eq = where.get(w, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hn = minus | (full & ~(d0 | plus)), plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | anchored) & full
        plus, minus = ((hn << 1) & full) | (full & ~(d0 | hp)), hp & d0
        out.append(score)
    return out


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """(distance, start, end) of the text slice nearest to the pattern; ties to the earliest end, then the longest."""
    scores = myers(pattern, text)
    distance = min(scores, default=len(pattern))
    if distance >= len(pattern):
        return len(pattern), 0, 0
    end = scores.index(distance) + 1
    back = myers(pattern[::-1], text[:end][::-1], anchored=True)
    return distance, end - max(i + 1 for i, s in enumerate(back) if s == distance), end


def _pieces(items: list[tuple[int, str]], rate: float, min_words: int) -> tuple[list, dict[int, dict]]:
    """The items' words and budgets, and for each piece length the hashes with (item, offset) of their pieces."""
    kept, pieces = [], defaultdict(lambda: defaultdict(list))
    if not items:
        return kept, pieces
    words = Words(pa.array([t for _, t in items], pa.string()), WORDY, "unicode")
    for i, (item_id, _) in enumerate(items):
        h = words.hash[words.first[i] : words.first[i + 1]]
        if len(h) < min_words:
            continue
        k = int(rate * len(h))
        cuts = np.linspace(0, len(h), k + 2).astype(int)
        for a, b in zip(cuts, cuts[1:], strict=False):
            pieces[int(b - a)][int(run_hashes(h, np.array([a]), np.array([b]))[0])].append((len(kept), int(a)))
        kept.append((item_id, h.tolist(), k))
    return kept, pieces


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], rate: float, min_words: int) -> Iterator[pa.RecordBatch]:
    kept, pieces = _pieces(items, rate, min_words)
    finders = {n: (Lookup(np.fromiter(p, np.uint64)), p) for n, p in pieces.items()}
    for batch in chunks(batches):
        words, found = Words(batch.column("text"), WORDY, "unicode"), defaultdict(list)
        for n, (lookup, owners) in finders.items():
            at, h = words.grams(n)
            hit, place = lookup.find(h)
            for pos, key in zip(at[hit].tolist(), lookup.keys[place].tolist(), strict=True):
                for item, offset in owners[key]:
                    found[item, pos].append(offset)
        doc_of, spans = words.text_of_word(), defaultdict(list)
        for (item, pos), offsets in found.items():
            doc = int(doc_of[pos])
            lo, hi, m, k = words.first[doc], words.first[doc + 1], len(kept[item][1]), kept[item][2]
            spans[doc, item] += [(max(lo, pos - o - k), min(hi, pos - o + m + k)) for o in offsets]
        rows, ids = [], batch.column("doc_id").to_pylist()
        for (doc, item), windows in spans.items():
            item_id, pattern, budget = kept[item]
            best, (lo, hi) = None, (-1, -1)
            merged: list[tuple[int, int]] = []
            for lo, hi in sorted(windows):  # overlapping windows become one, so a repeated passage is read once
                if merged and lo <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
                else:
                    merged.append((lo, hi))
            for lo, hi in merged:
                d, a, b = best_match(pattern, words.hash[lo:hi].tolist())
                if d <= budget and (best is None or d < best[0]):
                    best = (d, int(lo + a - words.first[doc]), int(lo + b - words.first[doc]))
            if best:
                rows.append((ids[doc], item_id, best[0], budget, best[1], best[2], len(pattern)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            names = ("doc_id", "item_id", "distance", "budget", "first_word", "end_word", "item_words")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, min_words: int = 5, block_words: int = 1 << 20) -> DataFrame:
    """Every (document, item) where the document holds the item within its error budget: the best passage's distance,
    budget and word range (words are runs of letters and digits, lower-cased, counted from 0).

    Items of fewer than `min_words` words are no evidence of a leak and match nothing, as do null texts.  A repeated
    document or item row gives its own rows.  Items go out in blocks of about `block_words` words, one pass over the
    documents for each: a block's matches are written before the next block is read, so driver and tasks hold one block
    at a time, however many items there are.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    blocks = -(-int(words) // block_words)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for b in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
        part = docs.mapInArrow(lambda batches, block=block: _search(batches, block, rate, min_words), SCHEMA)
        found.append(written(part, "leaks-of-a-block") if blocks > 1 else part)
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark item.  Of the rows without a doc_id,
    those go whose text leaks.

    The leaking keys are written first; they are few next to the documents."""
    key, leak = fresh_names(docs, "key", "leak")
    keyed = docs.withColumn(key, row_key())
    leaks = written(find_leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return keyed.join(leaks, F.col(key) == F.col(leak), "left_anti").drop(key)
