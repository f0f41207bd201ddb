"""Near-duplicate detection with DartMinHash signatures of weighted word shingles, banded joins and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.common import WORDY, Words, chunks, fresh_names, mix, run_hashes, written

#: Lowest rank cell is [0, FLOOR), each next one as wide as all before it.
FLOOR = 0.125
#: Documents that are signed at once (each throws about 900 darts), and elements whose darts are thrown at once.
SIGN_ROWS, STEP = 512, 1 << 16
#: Most bits of the bitmap of texts to be shingled; beyond an eighth of as many texts it lets more others through.
MAP_BITS = 27
#: Members and shingles of a block of group members, two of which one task holds.
BLOCK_MEMBERS, BLOCK_ELEMENTS = 512, 1 << 18


def _poisson_table(area: float) -> np.ndarray:
    n = int(area + 12 * np.sqrt(area) + 24)
    log_p = -area + np.arange(n) * np.log(area) - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n)))))
    return np.cumsum(np.exp(log_p))


_TABLES: dict[float, np.ndarray] = {}


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


def _throw(best: np.ndarray, d: np.ndarray, e: np.ndarray, w: np.ndarray, r: np.ndarray, k: int, seed: int) -> None:
    """Throw the darts of elements e of documents d up to weights w and ranks r; best keeps the earliest of each slot."""
    low_w, width, nu = 0.0, 1.0, 0
    while len(d):
        low_r, height, rho = 0.0, FLOOR, 0
        dd, ee, ww, rr = d, e, w, r
        while len(dd):
            area = width * height
            cell = mix(ee + np.uint64(((seed * 64 + nu) * 64 + rho + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            if area not in _TABLES:
                _TABLES[area] = _poisson_table(area)
            count = np.searchsorted(_TABLES[area], _uniform(cell), side="right")
            has = np.flatnonzero(count)
            n = count[has]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            src = np.repeat(has, n)
            dart = mix(cell[src] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            at_r = low_r + height * _uniform(mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            at_w = low_w + width * _uniform(dart)
            ok = (at_w < ww[src]) & (at_r < rr[src])
            dart, at_r, owner = dart[ok], at_r[ok], dd[src[ok]]
            slot = (mix(dart + np.uint64(7)) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
            # rank in the high half (in single precision, whose bits order like the numbers), dart in the low half
            packed = (at_r.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
            np.minimum.at(best, owner * k + slot.astype(np.int64), packed)
            low_r, height, rho = low_r + height, (height if rho == 0 else height * 2), rho + 1
            further = rr > low_r
            dd, ee, ww, rr = dd[further], ee[further], ww[further], rr[further]
        low_w, width, nu = low_w + width, (width if nu == 0 else width * 2), nu + 1
        more = w > low_w
        d, e, w, r = d[more], e[more], w[more], r[more]


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int, seed: int = 0) -> np.ndarray:
    """Signatures (n_docs x k) of weighted sets given as (doc, element hash, weight) rows; two sets agree in a
    coordinate with the probability of their weighted Jaccard similarity.

    Each element has a random set of darts in the plane (weight, rank), one per unit of area, the same in every
    document.  A document keeps the darts below its weight, up to a rank where it expects k (ln k + 2) of them; a dart
    falls to one coordinate by its hash, where the earliest one stands.  Darts are made cell by cell, cells being
    dyadic in weight and rank, so an element costs a few hashes whatever its weight; a document that leaves a coordinate
    empty throws again up to twice the rank.  Documents without elements have all-ones rows."""
    out = np.full((n_docs, k), np.uint64(0xFFFFFFFFFFFFFFFF))
    total = np.bincount(doc, weight, n_docs)
    todo = total > 0
    throw = k * (np.log(k) + 2)
    while todo.any():
        reach = np.where(todo, throw / np.maximum(total, 1e-12), 0)
        mine = todo[doc]
        d, e, w = doc[mine], element[mine], weight[mine]
        r = reach[d]
        best = np.full(n_docs * k, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(d), STEP):
            _throw(best, d[at : at + STEP], e[at : at + STEP], w[at : at + STEP], r[at : at + STEP], k, seed)
        best = best.reshape(n_docs, k)
        full = todo & (best != np.uint64(0xFFFFFFFFFFFFFFFF)).all(1)
        out[full] = best[full]
        todo &= ~full
        throw *= 2
    return out


def _shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of each n words in a row, by document and shingle; a text of fewer words is one shingle."""
    at, h = words.grams(n)
    doc = words.text_of_word()[at] if len(at) else np.zeros(0, np.int64)
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    doc, h = np.concatenate((doc, short)), np.concatenate((h, run_hashes(words.hash, words.first[short], words.first[short + 1])))
    order = np.lexsort((h, doc))
    return doc[order], h[order]


def _firsts(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(doc) else np.zeros(0, np.int64)


def _nodes(words: Words) -> np.ndarray:
    """The hash of each text's words, its name among texts."""
    return run_hashes(words.hash, words.first[:-1], words.first[1:]).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, rows=SIGN_ROWS):
        words = Words(batch.column("text"), WORDY, "unicode")
        doc, h = _shingles(words, n)
        first = _firsts(doc, h)
        weight = np.diff(np.append(first, len(doc))).astype(float)
        sig = dart_signatures(doc[first], h[first], weight, len(words), bands * rows)
        at = np.arange(len(sig)) * rows
        keys = np.stack([run_hashes(mix(sig[:, b * rows : (b + 1) * rows]).ravel() + np.uint64(b), at, at + rows) for b in range(bands)], 1)
        some = words.first[1:] > words.first[:-1]
        cut = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(_nodes(words)), pa.ListArray.from_arrays(cut, pa.array(keys[some].ravel().view(np.int64)))],
            ["doc_id", "text_hash", "node", "bands"],
        )


def _elements(batches: Iterator[pa.RecordBatch], n: int, wanted: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Shingles of the texts whose bit is set, one text once a task; the c-th copy of a shingle is an element of its own,
    so that sets of elements have the weighted Jaccard similarity of the shingles."""
    given: set[int] = set()

    def fresh() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("text_hash").to_numpy()
            at = h & ((1 << bits) - 1)
            asked = np.flatnonzero(wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            _, first = np.unique(h[asked], return_index=True)
            here = [i for i in np.sort(asked[first]).tolist() if int(h[i]) not in given]
            given.update(h[here].tolist())
            yield batch.take(pa.array(here, pa.int64()))

    for batch in chunks(fresh()):
        words = Words(batch.column("text"), WORDY, "unicode")
        doc, h = _shingles(words, n)
        first = _firsts(doc, h)
        copy = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        h = np.where(copy > 0, mix(h + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
        cut = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(_nodes(words)), pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64)))], ["node", "elements"])


def _common(elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of elements in common of each two of n sets, given as (element, owner) rows; an element that stands in one
    set only counts nowhere."""
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], elements[1:] != elements[:-1])))
    df = np.diff(np.append(first, len(elements)))
    out = np.zeros((n, n), np.float32)
    usual = np.flatnonzero(df > max(1, n // 16))
    step = max(1, (1 << 20) // n)
    for at in range(0, len(usual), step):  # elements of many sets as columns
        u = usual[at : at + step]
        k = df[u]
        dense = np.zeros((n, len(u)), np.float32)
        column = np.repeat(np.arange(len(u)), k)
        dense[owner[np.repeat(first[u], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)], column] = 1
        out += dense @ dense.T
    rare = np.flatnonzero((df > 1) & (df <= max(1, n // 16)))
    ends = np.cumsum(df[rare] ** 2)
    at = 0
    while at < len(rare):  # elements of few sets as pairs
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 19), side="right")))
        u = rare[at:to]
        k = df[u]
        nth = np.arange((k * k).sum()) - np.repeat(np.cumsum(k * k) - k * k, k * k)
        k, base = np.repeat(k, k * k), np.repeat(first[u], k * k)
        out += np.bincount(owner[base + nth // k] * n + owner[base + nth % k], minlength=n * n).reshape(n, n)
        at = to
    return out


def _linked(node: np.ndarray, named: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join all that is linked among members of different classes of one or two blocks."""
    if len(np.unique(named)) < 2:
        return []
    size = np.array([len(x) for x in sets])
    same = _common(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets)).astype(float)
    linked = (same / (size[:, None] + size[None, :] - same) >= similarity) & (named[:, None] != named[None, :])
    out, fresh = [], linked.any(1)
    while fresh.any():  # a spanning forest
        stack = [int(np.argmax(fresh))]
        fresh[stack[0]] = False
        while stack:
            a = stack.pop()
            to = np.flatnonzero(linked[a] & fresh)
            fresh[to] = False
            stack += to.tolist()
            out += [(int(node[a]), b) for b in node[to].tolist()]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of the members of each two blocks; rows come in the order of host, lo, hi."""
    last, held = None, []

    def give():
        node, named, sets = zip(*held, strict=True)
        links = _linked(np.array(node), np.array(named), list(sets), similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        elements = batch.column("elements")
        cut, flat = elements.offsets.to_numpy(), elements.values.to_numpy()
        rows = zip(*(batch.column(c).to_pylist() for c in ("host", "lo", "hi", "node", "class")), strict=True)
        for i, (*group, node, named) in enumerate(rows):
            if group != last:
                if held:
                    yield give()
                last, held = group, []
            held.append((node, named, flat[cut[i] : cut[i + 1]].copy()))
    if held:
        yield give()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, root (the smallest node of its component).

    Each round, every node points to the neighbour (or itself) that comes first in the round's random order; edges and
    node names are rewritten along the pointers, and edges inside a node vanish.  Rounds grow with the logarithm of a
    component's size, and each is written out, so no round is computed twice."""
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    names = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node"))
    seed = 0
    while not edges.isEmpty():
        seed += 1  # the first rounds share an order, by which pivots tend to come first
        order = lambda c, s=max(0, seed - 2): F.struct(F.xxhash64(*([F.lit(s)] if s else []), c).alias("o"), F.col(c).alias("v"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        to = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("old"), F.least(order("a"), "m")["v"].alias("new"))
        to = written(to, "pointers")
        names = names.join(to, names["at"] == to["old"], "left").select("node", F.coalesce("new", "at").alias("at"))
        left = edges.join(to, edges["a"] == to["old"]).select(F.col("new").alias("a"), "b")
        edges = written(left.join(to, left["b"] == to["old"]).select("a", F.col("new").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    names = written(names, "nodes")  # one join for each round
    return names.join(names.groupBy("at").agg(F.min("node").alias("root")), "at").select("node", "root")


def _bitmap(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of these 64-bit hashes by their low bits, of at most 2 ** MAP_BITS bits, and its number of bits."""
    bits = min(MAP_BITS, max(16, (8 * hashes.count()).bit_length()))
    low = hashes.select(F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)).alias("bit"))
    cells = low.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8), bits


def _classes(docs: DataFrame, shingle: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), class and the smallest doc_id of the class, for each row of docs."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    signed = written(source.mapInArrow(lambda b: _sign(b, shingle, bands, rows), "doc_id long, text_hash long, node long, bands array<long>"), "signed")
    copies = written(signed.groupBy("node").agg(F.min("doc_id").alias("id"), F.min("text_hash").alias("text_hash"), F.any_value("bands").alias("bands")), "copies")
    banded = copies.select("node", F.explode("bands").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(banded.join(full, "key").select("key", "node", "n"), "buckets")

    # the member that meets most others over all its buckets, an original rather than one of its copies, is their home
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    heavy = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("node").alias("o"), "node")).alias("p"))
    homes = written(shared.join(heavy, "key").groupBy("node").agg(F.max("p")["node"].alias("home")), "homes")

    wanted, bits = _bitmap(copies.join(homes, "node", "left_semi").select("text_hash"))
    sent = spark.sparkContext.broadcast(wanted)
    sets = source.select("text_hash", "text").mapInArrow(lambda b: _elements(b, shingle, sent.value, bits), "node long, elements array<long>")
    sets = written(sets.join(homes, "node", "left_semi").dropDuplicates(["node"]), "shingles")

    # each text first meets its home
    same = F.size(F.array_intersect("ea", "eb"))
    pairs = homes.where("node <> home").join(sets.select("node", F.col("elements").alias("ea")), "node")
    pairs = pairs.join(sets.select(F.col("node").alias("home"), F.col("elements").alias("eb")), "home")
    links = written(pairs.where(same / (F.size("ea") + F.size("eb") - same) >= similarity).select(F.col("node").alias("a"), F.col("home").alias("b")), "links")
    roots = written(components(links), "classes")

    # texts of different classes that share a bucket meet in a group: those with the bucket's usual home at that home,
    # where the others of the bucket come for a visit; and these others among themselves
    named = homes.join(roots, "node", "left").select("node", "home", F.coalesce("root", "node").alias("class"))
    named = written(named.join(sets.select("node", F.size("elements").alias("size")), "node"), "named")
    at = shared.select("key", "node").join(named, "node")
    mixed = at.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("key")
    at = written(at.join(mixed, "key"), "mixed")
    usual = at.groupBy("key", "home").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", F.xxhash64("home").alias("o"), "home"))["home"].alias("main"))
    at = written(at.join(usual, "key"), "mixed")
    hosts = at.select(F.col("main").alias("home")).distinct()
    away = at.where("home <> main")
    member = named.join(hosts, "home", "left_semi").select(F.col("home").alias("host"), "node", "class", "size")
    member = member.union(away.select("main", "node", "class", "size")).union(away.select("key", "node", "class", "size")).distinct()
    # the members of a group's largest class meet the others only, which meet each other too, in blocks
    by = member.groupBy("host", "class").agg(F.count("*").alias("m"), F.sum("size").alias("size"))
    most = by.groupBy("host").agg(F.count("*").alias("classes"), F.max(F.struct("m", "size", "class")).alias("most"), F.sum("m").alias("m"), F.sum("size").alias("size")).where("classes > 1")
    blocks = lambda m, size: F.greatest(F.ceil(m / BLOCK_MEMBERS), F.ceil(size / BLOCK_ELEMENTS)).cast("int")
    most = most.select("host", F.col("most.class").alias("largest"), blocks(F.col("most.m"), F.col("most.size")).alias("homes"), blocks(F.col("m") - F.col("most.m"), F.col("size") - F.col("most.size")).alias("others"))
    at_home, spread = F.col("class") == F.col("largest"), F.xxhash64("node")
    met = member.join(most, "host").withColumn("block", F.when(at_home, F.col("others") + F.pmod(spread, "homes")).otherwise(F.pmod(spread, "others")).cast("int"))
    met = met.select("host", "node", "class", "block", F.when(at_home, F.col("others") - 1).otherwise(F.col("others") + F.col("homes") - 1).alias("last"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), "last"))).select("host", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "node", "class")
    met = met.join(sets, "node").repartition("host", "lo", "hi").sortWithinPartitions("host", "lo", "hi")
    links = links.union(written(met.mapInArrow(lambda b: _blocks(b, similarity), "a long, b long"), "links"))

    named = copies.select("node", "id").join(written(components(links), "classes"), "node", "left").select("node", "id", F.coalesce("root", "node").alias("class"))
    least = named.groupBy("class").agg(F.min("id").alias("class_id"))
    return signed.select("doc_id", "text_hash", "node").join(named.join(least, "class").select("node", "class", "class_id"), "node").drop("node")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 26, rows: int = 5) -> DataFrame:
    """For each row of docs: doc_id, class_id, the smallest doc_id of its class (null if no row of it has one).

    Documents with the same words (runs of letters and digits, lower-cased) in the same order are copies.  Two different
    texts are linked if the weighted Jaccard similarity of their `shingle`-word shingles, weighted by count, is at least
    `similarity`, and classes are the connected components.  Texts without words are copies of each other.  Rows are
    told apart by their words alone, so rows that share a doc_id, or have none, are compared like all others.  Texts are
    named by a 64-bit hash of their words, of which two among n are the same by chance with a probability of n^2 / 2^65.

    Copies are folded first, so one text is signed and compared once however often it stands.  Band keys of `rows`
    coordinates meet in `bands` buckets (a pair at 0.8 is missed by all bands with probability 3e-5; this is the only
    miss).  Each text is compared with its home, which is the same over all its buckets, so n near copies of one text cost n
    comparisons.  Then all texts of different classes that share a bucket meet, once for all their buckets: a row for each
    text at its home and two at most for each bucket in which most others have another home.  Groups are compared in blocks
    of bounded size, the members of a group's largest class with the others only.  What stays is one row for each block
    that a text not linked to its home has to meet, since nothing else proves that it has no link.
    Verification is exact, on the shingles of texts that share a bucket; a bitmap keeps other texts from being shingled again.
    """
    return _classes(docs, shingle, similarity, bands, rows).select("doc_id", "class_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 26, rows: int = 5) -> DataFrame:
    """docs with one row of each class: that with the smallest doc_id, rows without one last, then by a hash of the text.
    Of rows that are equal in both, any one stays."""
    classes = _classes(docs, shingle, similarity, bands, rows)
    keys = fresh_names(docs, "null", "id", "hash")
    best = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias(keys[0]), F.coalesce("doc_id", F.lit(0)).alias(keys[1]), F.col("text_hash").alias(keys[2]))).alias("k"))
    kept = written(best.select("k.*"), "kept")
    keyed = docs.withColumns(dict(zip(keys, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.col("text").cast("string"))), strict=True)))
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
