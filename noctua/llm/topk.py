"""Exact top-k inner products by norm buckets: vectors are grouped by length, and each bucket is pruned by the cosine
that a vector of it would need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctua.llm.common import written

SCHEMA = "query_id long, mark long, vec_id long, score long"
#: Queries that are answered at once.
QUERIES = 1024


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), -1)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where every partial sum is an exact float."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ v.T.astype(float)).astype(np.int64) if most < 2**53 else q @ v.T


def _bucket(qid, q, q_len, floor, vid, v, v_len, coordinates):
    """Candidates (query row, vector row, score) of one bucket that may be among the best k, by local pruning.

    floor: for each query a score that its k-th best reaches at least.  A vector p scores |q||p|cos, so it needs
    cos >= floor / (|q| max|p|) = t in this bucket: t > 1 drops the bucket; a high t allows, for each coordinate f of
    the unit vectors, only values within q_f t +- sqrt((1 - t^2)(1 - q_f^2)); a low t prunes by length alone."""
    longest = v_len.max(initial=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(q_len * longest > 0, floor / np.maximum(q_len * longest, 1e-300), np.where(floor > 0, np.inf, -np.inf))
    alive = np.flatnonzero(need <= 1 + 1e-9)
    tight = alive[need[alive] >= 0.9]
    loose = alive[need[alive] < 0.9]
    out = []
    unit_v = v / np.maximum(v_len, 1e-300)[:, None]
    for i in tight:  # coordinate pruning
        t, u = min(need[i], 1.0), q[i] / max(q_len[i], 1e-300)
        ok = np.ones(len(v), bool)
        for f in np.argsort(-np.abs(u))[:coordinates]:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-9
            low = u[f] * t - spread
            high = u[f] * t + spread if u[f] < t else 1 + 1e-9
            low = low if -u[f] < t else -1 - 1e-9
            ok &= (unit_v[:, f] >= low) & (unit_v[:, f] <= high)
        at = np.flatnonzero(ok)
        if len(at):
            s = _products(q[i : i + 1], v[at])[0]
            good = s >= floor[i]
            out.append((np.full(good.sum(), i), at[good], s[good]))
    if len(loose):  # length pruning: rows are sorted by length, so what may qualify is a head of the bucket
        reach = np.min(np.where(q_len[loose] > 0, floor[loose] / np.maximum(q_len[loose], 1e-300), np.where(floor[loose] > 0, np.inf, -np.inf)))
        head = int(np.searchsorted(-v_len, -reach + 1e-9, side="right")) if np.isfinite(reach) and reach > 0 else len(v)
        if head:
            s = _products(q[loose], v[:head])
            r, c = np.nonzero(s >= floor[loose][:, None])
            out.append((loose[r], c, s[r, c]))
    if not out:
        return [np.zeros(0, np.int64)] * 3
    r, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
    other = qid[r] != vid[c]
    return r[other], c[other], s[other]


def _best(qid, vid, score, k):
    """The best k rows of each query: score descending, then vec_id."""
    order = np.lexsort((vid, -score, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    first = np.searchsorted(qid, qid, side="left")
    keep = np.arange(len(qid)) - first < k
    return qid[keep], vid[keep], score[keep]


def _answers(queries: pd.DataFrame, vectors: tuple, k: int, bucket: int, coordinates: int) -> pd.DataFrame:
    """The best k candidates of each query among one slice's vectors of its number of components, bucket by bucket from
    the longest vectors down."""
    vid, v, v_len = vectors
    qid, q, floor = queries.vec_id.to_numpy(np.int64), _matrix(queries.v), queries.floor.to_numpy(float).copy()
    q_len = np.sqrt((q.astype(float) ** 2).sum(1))
    got = (np.zeros(0, np.int64),) * 3
    for at in range(0, len(vid), bucket):
        rows = slice(at, at + bucket)
        r, c, s = _bucket(qid, q, q_len, floor, vid[rows], v[rows], v_len[rows], coordinates)
        got = _best(*(np.concatenate(x) for x in zip(got, (r, vid[rows][c], s), strict=True)), k)
        which, counts = np.unique(got[0], return_counts=True)
        full = counts >= k  # a query with k results needs no lower score from here on
        floor[which[full]] = np.maximum(floor[which[full]], got[2][np.cumsum(counts)[full] - 1])
    return pd.DataFrame({"query_id": qid[got[0]], "mark": queries.mark.to_numpy(np.int64)[got[0]], "vec_id": got[1], "score": got[2]})


def _scan(frames: Iterator[pd.DataFrame], k: int, bucket: int, coordinates: int) -> Iterator[pd.DataFrame]:
    """Slice after slice: first its vectors, which are held, then the queries that come to it, a few at a time."""
    last, held, ready, waiting = None, [], {}, []

    def answer() -> Iterator[pd.DataFrame]:
        if held:
            for d, own in pd.concat(held).groupby("dims"):
                v = _matrix(own.v)
                v_len = np.sqrt((v.astype(float) ** 2).sum(1))
                order = np.argsort(-v_len, kind="stable")
                ready[d] = own.vec_id.to_numpy(np.int64)[order], v[order], v_len[order]
            held.clear()
        for d, own in pd.concat(waiting).groupby("dims"):
            if d in ready:
                for at in range(0, len(own), QUERIES):
                    yield _answers(own.iloc[at : at + QUERIES], ready[d], k, bucket, coordinates)
        waiting.clear()

    for pdf in frames:
        for (place, kind), own in pdf.groupby(["slice", "kind"], sort=True):
            if place != last:
                if waiting:
                    yield from answer()
                last, ready = place, {}
                held.clear()
            (waiting if kind else held).append(own)
            if kind and sum(map(len, waiting)) >= QUERIES:
                yield from answer()
    if waiting:
        yield from answer()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, seeds: int = 1024, slice_rows: int = 1 << 16, bucket: int = 1024, coordinates: int = 5) -> DataFrame:
    """For each query the k vectors with the highest integer inner product: query_id, rank, vec_id, score; ties to the
    smaller vec_id.  vectors and queries: vec_id long, v array<long>; a query's own vec_id is no candidate, null ids
    and null vectors take no part, and vectors of another number of components are not compared.  A query row that is
    given twice is answered once; rows of one id with different vectors are queries of their own, each ranked from 1.

    The `seeds` longest vectors give each query a score that its k-th best reaches at least.  Vectors are range-partitioned by
    length into slices of at most about `slice_rows`.  A query goes to the slices whose longest vector can reach its
    score; a task holds one slice, prunes its buckets of `bucket` vectors by local cosine thresholds, and sends on at
    most k rows a query.  Queries pass through no driver; what is broadcast is the seeds and a row for each slice.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = lambda df: df.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v"), F.size("v").alias("dims"), norm.alias("norm"))
    spark, rows = vectors.sparkSession, whole(vectors)
    n = rows.count()
    slices = max(-(-n // slice_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1024)), 1)
    table = written(rows.repartitionByRange(slices, F.desc("norm"), "vec_id").withColumn("slice", F.spark_partition_id()), "topk-vectors")
    head = table.orderBy(F.desc("norm"), "vec_id").limit(seeds).select("vec_id", "v", "dims").toPandas()
    sent = spark.sparkContext.broadcast({int(d): (own.vec_id.to_numpy(np.int64), _matrix(own.v)) for d, own in head.groupby("dims")})

    def floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["floor"] = -np.inf
            for d, own in pdf.groupby("dims"):
                vid, v = sent.value.get(int(d), (np.zeros(0, np.int64), None))
                for at in range(0, len(own) if len(vid) > k else 0, QUERIES):
                    part = own.iloc[at : at + QUERIES]
                    s = _products(_matrix(part.v), v).astype(float)
                    s[part.vec_id.to_numpy()[:, None] == vid[None, :]] = -np.inf
                    pdf.loc[part.index, "floor"] = np.partition(s, -k, axis=1)[:, -k]
            yield pdf

    asked = whole(queries).dropDuplicates(["vec_id", "v"]).withColumn("mark", F.xxhash64("v")).mapInPandas(floors, "vec_id long, v array<long>, dims int, norm double, mark long, floor double")
    tops = table.groupBy("slice").agg(F.max("norm").alias("top")).agg(F.collect_list(F.struct("slice", "top")).alias("tops"))  # one row
    reach = F.filter("tops", lambda t: (F.col("floor") <= 0) | (F.sqrt(F.col("norm")) * F.sqrt(t["top"]) * (1 + 1e-9) >= F.col("floor")))
    visits = asked.crossJoin(F.broadcast(tops)).withColumn("slice", F.explode(F.transform(reach, lambda t: t["slice"])))
    columns = ["slice", "kind", "vec_id", "v", "dims", "norm", "mark", "floor"]
    both = table.withColumns({"kind": F.lit(0), "mark": F.lit(0).cast("long"), "floor": F.lit(0.0)}).select(columns).union(visits.withColumn("kind", F.lit(1)).select(columns))
    dealt = both.repartition(slices, "slice").sortWithinPartitions("slice", "kind").drop("norm")
    found = dealt.mapInPandas(lambda frames: _scan(frames, k, bucket, coordinates), SCHEMA)
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
