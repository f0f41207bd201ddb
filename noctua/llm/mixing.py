"""Mixing sources to target weights: equal-token blocks are apportioned by highest quotients, then chosen by a seed."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.llm.common import fresh_names, written


#: Numbers of equal rows that are dealt at once.
RUN = 1 << 14


def water_fill(size: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """Shares of sum(size) in proportion to weight, none above most * size; what is cut goes to the others by weight."""
    target, open_, left = np.zeros(len(size)), size > 0, float(size.sum())
    while open_.any():
        share = np.where(open_, left * weight / weight[open_].sum(), 0)
        over = open_ & (share > most * size)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over] = most * size[over]
        left -= float((most * size[over]).sum())
        open_ &= ~over
    return target


def apportion(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: seats go one by one to the highest votes / (2 * held + 1); no party beyond its `most`; ties to the
    earlier party.  Parties start from the seats that the method gives them under a divisor too large for all the
    seats, so only the last few seats are dealt singly."""
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    held = np.zeros(len(votes), np.int64)
    if not len(votes) or votes.sum() <= 0:
        return held
    divisor = votes.sum() / max(seats, 1)
    for _ in range(60):
        held = np.minimum(np.floor(votes / divisor + 0.5).astype(np.int64), most)
        if held.sum() <= seats:
            break
        divisor *= 1 + max(1e-9, (held.sum() - seats) / max(seats, 1) / 2)
    heap = [(-v / (2 * h + 1), i) for i, (v, h, m) in enumerate(zip(votes, held, most, strict=True)) if v > 0 and h < m]
    heapq.heapify(heap)
    for _ in range(seats - int(held.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    return held


def apportion_words(votes: np.ndarray, words: int, most: np.ndarray, block: int) -> np.ndarray:
    """Numbers of words in proportion to votes, none above its `most`: whole blocks by Sainte-Laguë, as far as they stay within
    a party's share, then by the same quotients single words for what each share still lacks."""
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    total = votes.sum()
    if not words or total <= 0:
        return np.zeros(len(votes), np.int64)
    share = np.minimum(votes * (words / total), most)
    got = block * apportion(votes, words // block, np.floor(share / block + 1e-9).astype(np.int64))
    got += apportion(np.maximum(share - got, 0), words - int(got.sum()), most - got)
    return got + apportion(np.maximum(most - got, 0), words - int(got.sum()), most - got)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns of a row (maps, which have no hash, apart) that places it in the mix's order."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, block: int = 64, shard_words: int = 1 << 18, shard_docs: int = 1 << 13, seed: int = 0) -> DataFrame:
    """What a mix takes of each document: doc_id, source, size, row and nth (which name it), source_size, target,
    taken, and its pieces (array of {copy, from, to}: word ranges of the document taken in each pass over the source).

    Sources in order of code point, null last, weigh `weights` in turn and share the words of the whole table; a target
    stops at `most` times its source, and the excess goes to the others.  Whole blocks of `block` words are apportioned
    to sources and then to the source's shards by Sainte-Laguë, and what a share lacks after them in single words, so a source
    gives its target to a word or two however small it is.  A shard gives all its words once for every full pass that its quota
    holds and the rest in blocks by seeded rank, the last of them in part, so no document is taken more than `most` times.  The plan depends on rows and seed only, not on partitions; a row is known by
    all its columns, and the n-th of equal rows by its number.
    Documents without words take part with size 0 and taken 0; an empty table gives an empty plan.

    The number of shards grows with words and rows of the source, which bounds what a task holds, a hot source included.
    One task sees a row per source, and a row for each of about sqrt(shards) groups or shards.
    """
    # equal rows are one row with a count until they are dealt to shards, each by its number
    keyed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(docs, seed).alias("row"))
    counted = keyed.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))  # so no array grows with n
    rows = runs.select("doc_id", "source", "size", "row", F.explode(F.sequence(F.col("run") * RUN + 1, F.least("n", (F.col("run") + 1) * RUN))).alias("nth"))
    rows = written(rows.withColumn("draw", F.xxhash64("row", "nth")), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(pdf)), key=lambda i: (pdf.source[i] is None, pdf.source[i] or ""))
        pdf = pdf.iloc[order].reset_index(drop=True)
        size = pdf.source_size.to_numpy(float)
        pdf["target"] = water_fill(size, np.resize(np.asarray(weights, float), len(pdf)), most)
        pdf["quota"] = apportion_words(pdf.target, int(round(pdf.target.sum())), most * pdf.source_size.to_numpy(np.int64), block)
        pdf["shards"] = np.maximum(1, np.ceil(np.maximum(size / shard_words, pdf.n / shard_docs))).astype(np.int64)
        return pdf[["source", "source_size", "target", "quota", "shards"]]

    sources = written(totals.groupBy().applyInPandas(targets, "source string, source_size long, target double, quota long, shards long"), "mix-sources")
    placed = rows.join(sources.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).select(
        "doc_id", "source", "size", "row", "nth", "draw", "source_size", "target", "quota", F.pmod(F.xxhash64(F.lit("shard"), "draw"), F.col("shards")).alias("shard"),
        F.ceil(F.sqrt("shards")).alias("groups"),
    )

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("party").reset_index(drop=True)
        pdf["share"] = apportion_words(pdf.words, int(pdf.quota[0]), most * pdf.words.to_numpy(np.int64), block)
        return pdf[["source", "party", "share"]]

    # a source's quota goes to about sqrt(shards) groups of shards, and each group's to its shards
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("groups").alias("groups"))
    shards = shards.withColumn("group", F.pmod("shard", F.col("groups")))
    above = shards.groupBy("source", "group").agg(F.sum("words").alias("words"), F.first("quota").alias("quota"))
    above = above.withColumnRenamed("group", "party").groupBy("source").applyInPandas(shares, "source string, party long, share long")
    above = above.select(F.col("source").alias("_s"), F.col("party").alias("_g"), "share")
    inside = shards.drop("quota").join(above, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_g") == F.col("group")))
    inside = inside.select("source", "group", F.col("shard").alias("party"), "words", F.col("share").alias("quota"))
    quotas = inside.groupBy("source", "group").applyInPandas(shares, "source string, party long, share long").select(F.col("source").alias("_s"), F.col("party").alias("_h"), "share")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "row", "nth"], kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy(np.int64)
        end = np.cumsum(size)
        n, whole = int(-(-end[-1] // block)), int(end[-1])
        quota, name = int(pdf.share[0]), f"{seed}/{pdf.source[0]}/{pdf.shard[0]}"
        passes = min(quota // whole, most) if n else 0
        rest = min(quota - passes * whole, whole) if n and passes < most else 0
        edges = np.minimum(np.arange(n + 1) * block, whole)
        order = np.random.default_rng(zlib.crc32(name.encode())).permutation(n)
        reach = np.cumsum(np.diff(edges)[order])
        full = int(np.searchsorted(reach, rest, side="right"))  # blocks taken whole; of the next one what the quota still holds
        chosen = np.sort(order[: full + 1] if full < n and rest > (reach[full - 1] if full else 0) else order[:full])
        run_from, run_to = edges[chosen], edges[chosen + 1].copy()
        if len(chosen) > full:
            run_to[chosen == order[full]] = edges[order[full]] + rest - (int(reach[full - 1]) if full else 0)
        joined = np.flatnonzero(run_from[1:] == run_to[:-1])
        run_from, run_to = np.delete(run_from, joined + 1), np.delete(run_to, joined)
        taken, pieces = [], []
        lo = np.searchsorted(run_to, end - size, side="right")
        hi = np.searchsorted(run_from, end, side="left")
        for i in range(len(pdf)):
            a, b = end[i] - size[i], end[i]
            got = [(c, 0, int(size[i])) for c in range(passes)] if size[i] else []
            got += [(passes, int(max(run_from[j], a) - a), int(min(run_to[j], b) - a)) for j in range(lo[i], hi[i]) if size[i]]
            taken.append(sum(t - f for _, f, t in got))
            pieces.append([{"copy": c, "from": f, "to": t} for c, f, t in got])
        return pdf.assign(taken=taken, pieces=pieces)[["doc_id", "source", "size", "row", "nth", "source_size", "target", "taken", "pieces"]]

    dealt = placed.join(quotas, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_h") == F.col("shard"))).drop("_s", "_h")
    return dealt.groupBy("source", "shard").applyInPandas(take, "doc_id long, source string, size long, row long, nth long, source_size long, target double, taken long, pieces array<struct<copy:int,from:long,to:long>>")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each document and pass that takes any of it.

    A row that is taken in part keeps the taken words with what stands between them in the text; n_chars, where there
    is such a column, is set to the new length.  Documents of which nothing is taken are left out."""
    row, nth, plan_row, plan_nth, pieces, turn, count, new = fresh_names(docs, "row", "nth", "plan", "at", "pieces", "pass", "words", "new")
    plan = mix_plan(docs, **options).where("taken > 0").select(F.col("row").alias(plan_row), F.col("nth").alias(plan_nth), F.col("pieces").alias(pieces))
    rows = docs.withColumn(row, _draw(docs, options.get("seed", 0)))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0))))  # of equal rows
    got = rows.join(plan, (F.col(row) == F.col(plan_row)) & (F.col(nth) == F.col(plan_nth)))
    got = got.withColumn(turn, F.explode(F.array_distinct(F.transform(pieces, lambda p: p["copy"]))))
    mine = F.filter(pieces, lambda p: p["copy"] == F.col(turn))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    part = F.array_join(F.transform(mine, lambda p: F.array_join(F.slice(words, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")), "")), "")
    whole = (F.size(mine) == 1) & (F.element_at(mine, 1)["from"] == 0) & (F.element_at(mine, 1)["to"] == F.col(count))
    got = got.withColumn(count, F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))).withColumn(new, F.when(whole, F.col("text")).otherwise(part))
    changed = {"text": F.col(new), "n_chars": F.length(new).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return got.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
