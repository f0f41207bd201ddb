"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and distance-weighted
votes that are calibrated on examples outside the index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.common import WORDY, Lookup, Words, chunks, written

BLOCK = 64
#: Answers that a worker remembers.
KNOWN = 1 << 14


class BlockMaxIndex:
    """Unit vectors over few terms, in blocks of BLOCK examples with each term's largest weight in the block.

    vectors: (terms, weights) of each example; tops: for each block and term the largest weight; postings: the weights
    by block and term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, ids: list[int], labels: list[int]):
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0].tolist(), ids[i]))  # like examples share blocks
        self.ids, self.labels = np.array([ids[i] for i in order], np.int64), np.array([labels[i] for i in order], float)
        self.blocks = -(-len(order) // BLOCK)
        self.tops = np.zeros((n_terms, self.blocks))
        lists: dict[tuple[int, int], tuple[list, list]] = {}
        for place, i in enumerate(order):
            for t, w in zip(*vectors[i], strict=True):
                at, ws = lists.setdefault((int(t), place // BLOCK), ([], []))
                at.append(place % BLOCK)
                ws.append(w)
                self.tops[t, place // BLOCK] = max(self.tops[t, place // BLOCK], w)
        self.postings = {k: (np.array(a), np.array(w)) for k, (a, w) in lists.items()}

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0; ties to the earlier place.  Blocks are
        read from the highest bound down, until the next bound is below the k-th best."""
        bound = weights @ self.tops[terms]
        got_at, got_s, floor = [], [], 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] < floor - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights, strict=True):
                if (p := self.postings.get((t, int(b)))) is not None:
                    score[p[0]] += w * p[1]
            good = np.flatnonzero((score > 0) & (score >= floor - 1e-12))
            got_at.append(good + b * BLOCK)
            got_s.append(score[good])
            if but is not None:
                keep = self.ids[got_at[-1]] != but
                got_at[-1], got_s[-1] = got_at[-1][keep], got_s[-1][keep]
            flat = np.concatenate(got_s)
            if len(flat) >= k:
                floor = np.partition(flat, -k)[-k]
        if not got_at:
            return np.zeros(0, np.int64), np.zeros(0)
        at, s = np.concatenate(got_at), np.concatenate(got_s)
        best = np.lexsort((at, -np.round(s, 12)))[:k]
        return at[best], s[best]


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising curve through (x, y): adjacent violators are pooled, each pool is level from its first x to its
    last and smoothed by half a row of each label; between pools the curve is straight."""
    pools: list[list[float]] = []
    for v, label in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        pools.append([v, v, label, 1])
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]):
            _, hi, a, n = pools.pop()
            pools[-1][1:] = [hi, pools[-1][2] + a, pools[-1][3] + n]
    value = [(a + 0.5) / (n + 1) for _, _, a, n in pools]
    return np.array([e for p in pools for e in p[:2]]), np.array([v for v in value for _ in range(2)])


class Model:
    """Terms with their IDF, the index, and the calibration of its votes."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, rows: list[tuple[int, int, np.ndarray, np.ndarray]], k: int):
        """rows: (doc_id, label, places of its terms, their counts), in the order in which they are used."""
        self.lookup, self.idf, self.k = Lookup(terms), idf, k
        labels = np.array([r[1] for r in rows], float)
        self.prior = float(labels.mean()) if len(rows) else 0.0
        some = [r for r in rows if len(r[2])]
        none = np.array([r[1] for r in rows if not len(r[2])], float)
        self.silent = float((none.sum() + self.prior) / (len(none) + 1))
        # every third labelled row calibrates, the others are examples; all rows are both if they are few
        held, tried = ([r for i, r in enumerate(some) if i % 3], some[::3]) if len(some) >= 64 else (some, some)
        self.index = BlockMaxIndex([self.vector(r[2], r[3]) for r in held], len(self.idf), [r[0] for r in held], [r[1] for r in held])
        votes = np.array([self.vote(*self.vector(r[2], r[3]), but=r[0])[0] for r in tried])
        self.steps, self.values = _isotonic(votes, np.array([r[1] for r in tried], float))
        self.known: dict[bytes, tuple[float, list[int]]] = {}

    def vector(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[places]
        return places, w / max(np.sqrt((w * w).sum()), 1e-300)

    def vote(self, terms, weights, but=None) -> tuple[float, np.ndarray]:
        at, s = self.index.nearest(terms, weights, self.k, but)
        w = 1 / (1e-3 + np.sqrt(np.maximum(0, 2 - 2 * s)))  # of the distance between unit vectors
        return (float(w @ self.index.labels[at]) + 0.1 * self.prior) / (float(w.sum()) + 0.1), at

    def score(self, places: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        if not len(places) or not len(self.steps):
            return self.silent, []
        key = places.tobytes() + counts.tobytes()
        if key not in self.known:  # texts with few of the terms are often alike
            if len(self.known) >= KNOWN:
                self.known.clear()
            v, at = self.vote(*self.vector(places, counts))
            self.known[key] = float(np.interp(v, self.steps, self.values)), self.index.ids[at[:3]].tolist()
        return self.known[key]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words = Words(batch.column("text"), WORDY, "unicode")
        doc = words.text_of_word()
        order = np.lexsort((words.hash, doc))
        doc, h = doc[order], words.hash[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate((first, [len(doc)]))).astype(np.int32)
        cut = np.searchsorted(doc[first], np.arange(len(words) + 1)).astype(np.int32)
        terms = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(count)], ["term", "count"]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), terms], ["doc_id", "toxic", "terms"])


def _holders(batches: Iterator[pa.RecordBatch], lookup: Lookup) -> Iterator[pa.RecordBatch]:
    """The task's number of texts that hold each term; place -1: of all texts."""
    total, n = np.zeros(len(lookup.keys), np.int64), 0
    for batch in chunks(batches):
        words = Words(batch.column("text"), WORDY, "unicode")
        at, place = lookup.find(words.hash)
        pairs = np.unique(words.text_of_word()[at] * max(len(total), 1) + place)
        total += np.bincount(pairs % max(len(total), 1), minlength=len(total))
        n += len(words)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.append(n, total))], ["place", "n"])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words = Words(batch.column("text"), WORDY, "unicode")
        at, place = model.lookup.find(words.hash)
        pairs, counts = np.unique(words.text_of_word()[at] * len(model.idf) + place, return_counts=True) if len(at) else (np.zeros(0, np.int64),) * 2
        cut = np.searchsorted(pairs, np.arange(len(words) + 1) * max(len(model.idf), 1))
        scores, near = [], []
        for i in range(len(words)):
            mine = slice(cut[i], cut[i + 1])
            s, ids = model.score(pairs[mine] % len(model.idf), counts[mine]) if cut[i] < cut[i + 1] else (model.silent, [])
            scores.append(s)
            near.append(ids)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = 12_000, max_terms: int = 2_048, k: int = 15, chi2: float = 25.0) -> Model:
    """Learn from labelled documents: docs (doc_id, text), labels (doc_id, label 0 or 1; null and others are ignored, a
    doc_id that is labelled both ways counts as 1).

    Fitting uses a sample of at most `max_labelled` labelled ids, those first in order of a hash of doc_id; of the texts of one
    id the one with the smallest hash counts.  The terms are
    the words, at most `max_terms`, whose document counts under the two labels differ by a chi-squared of `chi2` or
    more (about 1 in 2 million by chance); cosine is exact over them, with tf 1 + ln(count) and idf of all docs.  Two thirds
    of the sample go into the index and one third calibrates, so what is collected and broadcast is bounded; a sample of fewer
    than 64 texts that hold a term does both with all of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = source.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text")
    one = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("m")).select("doc_id", "toxic", "m.text")
    rows = written(one.mapInArrow(_terms, "doc_id long, toxic int, terms array<struct<term:long,count:int>>"), "toxic-terms")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    a, df = F.col("a").cast("double"), F.col("df").cast("double")
    gap = a * F.lit(float(n)) - df * F.lit(float(pos))
    stat = F.lit(float(n)) * gap * gap / (df * (F.lit(float(n)) - df) * F.lit(float(pos)) * F.lit(float(n - pos)))
    counted = rows.select("toxic", F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.sum("toxic").alias("a"), F.count("*").alias("df"))
    picked = counted.where((df >= 3) & (df < n)).withColumn("stat", stat).where(F.col("stat") >= chi2) if 0 < pos < n else counted.where("false").withColumn("stat", F.lit(0.0))
    best = picked.orderBy(F.desc("stat"), "term").limit(max_terms).toPandas()
    terms = best.term.to_numpy(np.int64).view(np.uint64)
    lookup = Lookup(terms)
    counts = {r.place: r.n for r in source.select("text").mapInArrow(lambda b: _holders(b, lookup), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + counts.get(-1, 0)) / (1 + np.array([counts.get(i, 0) for i in range(len(terms))], float))) + 1
    chosen = F.filter("terms", lambda t: t["term"].isin(best.term.tolist())) if len(best) else F.filter("terms", lambda t: F.lit(False))
    got = []
    for doc_id, toxic, own in rows.select("doc_id", "toxic", chosen).orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").toLocalIterator():
        h = np.array([t[0] for t in own], np.int64).view(np.uint64)
        _, place = lookup.find(h)
        at = np.argsort(place)
        got.append((doc_id, toxic, place[at], np.array([t[1] for t in own], float)[at]))
    return Model(terms, idf, got, k)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs: doc_id, score (0 to 1), evidence (doc_ids of the three nearest labelled examples).

    Null and empty texts, and texts with none of the model's terms, get the share of the label among such training
    documents and no evidence.  Without training rows every score is 0.  Repeated rows are scored alike.  Texts are
    scored where they are read; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _score(b, sent.value), "doc_id long, score double, evidence array<long>")


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without rows that score `least` or more; a row without a doc_id goes only by its own score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            renamed = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], ["doc_id", "text"])
            score = np.concatenate([b.column("score").to_numpy() for b in _score(iter([renamed]), sent.value)])
            yield batch.filter(pa.array(score < least))

    return docs.mapInArrow(keep, docs.schema)
