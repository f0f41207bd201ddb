"""Language-model scores from a hierarchical Pitman-Yor model whose seatings are sampled by Gibbs.

Each word is the context of the tokens that follow it and has a restaurant, whose customers are those tokens in training
texts.  A table there sends one customer to its parent, the root restaurant, which all contexts share and whose base is
uniform over the known words and one unknown.

Words are 48-bit hashes.  One shuffle brings (context, word, document, times) to parts by context, in packed blobs; a part
counts its pairs, seats them, and later looks up its documents' tokens.  What parts have to tell each other goes by words:
the contexts of a word over all parts are its customers at the root, and the root's seating comes back to the parts.

A context with more tokens than a part should hold is still one restaurant: its words are counted over all documents
first, a part of its own seats these counts, and pieces of its tokens get the probabilities that this part finds.
Random numbers are hashes of what they are drawn for, so it makes no difference where a restaurant is seated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.llm.common import Words, chunks, mix, word_hash, written

MASK = np.uint64((1 << 48) - 1)
END = np.uint64(word_hash(" ")) & MASK  # no token holds a space
#: Most customers of a dish for which the sums over seatings are exact; beyond, an expansion of theirs serves.
EXACT = 256
#: Dishes of one restaurant are resampled in so many turns a sweep.
TURNS = 8
#: Text of one flush of pairs, in slices of a megabyte; words of one flush of the vocabulary.
FLUSH, VOCABULARY = 8, 2_000_000


# --- tokens and blobs --------------------------------------------------------------------------------------------------


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes with an end after each text, and each text's first index."""
    words = Words(texts)
    n = len(words)
    out = np.empty(len(words.hash) + n, np.uint64)
    first = words.first + np.arange(n + 1)
    last = first[1:] - 1
    out[last] = END
    rest = np.ones(len(out), bool)
    rest[last] = False
    out[rest] = words.hash & MASK
    return out, first


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; the first, sorted and of 64 bits, as differences; bytes of like weight side by side."""
    n = len(arrays[0])
    gaps = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T.tobytes() for a in (gaps, *arrays[1:])]
    return zstandard.compress(n.to_bytes(8, "little") + b"".join(planes), 1)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in (np.uint64, *kinds):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _cuts(sorted48: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that occur among sorted 48-bit hashes, and where each begins, with the end."""
    part = (sorted48 >> np.uint64(48 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return part[first], np.append(first, len(part))


def _summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return [key[first], *(np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in values)]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts."""

    def give():
        word, n = _summed(np.concatenate(words), np.concatenate(counts))
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    words, counts = [], []
    for batch in chunks(batches):
        w, n = np.unique(_tokens(batch.column("text"))[0], return_counts=True)
        words.append(w)
        counts.append(n)
        if sum(map(len, words)) > VOCABULARY:
            yield give()
            words, counts = [], []
    if words:
        yield give()


ALL = np.uint64(0)


def _find(among: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that are among some sorted ones, and their places there."""
    at = np.minimum(np.searchsorted(among, words), len(among) - 1)
    found = np.flatnonzero(among[at] == words)
    return found, at[found]


def _first_pieces(bits: int, salts: np.ndarray) -> np.ndarray:
    """Part numbers of each hot context's first piece, and the end: after 2 ** bits parts and one for each hot context."""
    return (1 << bits) + len(salts) + np.concatenate(([0], np.cumsum(salts))).astype(np.int64)


def _piece_of_word(hot: np.ndarray, words: np.ndarray) -> np.ndarray:
    """ALL for words that are as frequent as hot contexts, of which every piece holds some; else a number to deal by."""
    out = mix(words) | np.uint64(1)
    out[_find(hot, words)[0]] = ALL
    return out


def _dishes(batches: Iterator[pa.RecordBatch], bits: int, hot: np.ndarray, salts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words that follow hot contexts and how often they do in training texts, in blobs dealt over the numbers of
    the context's pieces by word."""
    pieces = _first_pieces(bits, salts)

    def give():
        group, w, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((w, group))
        group, w, n = group[order], w[order], n[order]
        cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        blobs = [_pack(*(x.astype(k) for x, k in zip(_summed(w[a:b], n[a:b]), (np.uint64, np.uint32), strict=True))) for a, b in zip(cut, np.append(cut[1:], len(w)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(group[cut]), pa.array(blobs, pa.binary())], ["part", "blob"])

    held: list[tuple] = []
    for batch in chunks(batches):
        token, first = _tokens(batch.column("text"))
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[first[:-1]] = END
        at, which = _find(hot, before)
        trained = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(first))
        held.append((pieces[which] + (mix(token[at]) % salts[which].astype(np.uint64)).astype(np.int64), token[at], trained[at].astype(np.int64)))
        if len(held) == 4 * FLUSH:
            if sum(len(x[0]) for x in held):
                yield give()
            held = []
    if sum(len(x[0]) for x in held):
        yield give()


def _whole_context(bits: int, hot: np.ndarray, salts: np.ndarray):
    pieces = _first_pieces(bits, salts)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        """Words of a hot context with their counts over all documents, as pairs of this context's own part; a word that
        no training text has there is one of a held-out document."""
        i = int(np.searchsorted(pieces, key[0].as_py(), side="right")) - 1
        w, n = _summed(*(np.concatenate(x) for x in zip(*(_unpack(b, np.uint32) for b in table["blob"].to_pylist()), strict=True)))
        blob = _pack(np.full(len(w), hot[i]), w, (n == 0).astype(np.uint32), np.maximum(n, 1).astype(np.uint32))
        return pa.table([pa.array([(1 << bits) + i], pa.int64()), pa.array([key[0].as_py()], pa.int64()), pa.array([blob], pa.binary()), pa.nulls(1, pa.binary())], names=["part", "base", "blob", "own"])

    return count


PAIRS = "part long, base long, blob binary, own binary"


def _pairs(batches: Iterator[pa.RecordBatch], bits: int, hot: np.ndarray, salts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each few slices of texts, a blob for each part (context, word, 2 * document + held out, times) and one of the
    documents' own rows, under a group of its own.

    A document is known by its flush and its number there; a flush by its task and the rows before it in the task, which
    a rerun of the task repeats.  Tokens of a hot context go to its pieces, which are parts beyond the others: by their
    word, and those of a word that is as frequent itself by their document."""
    pieces = _first_pieces(bits, salts)
    base = TaskContext.get().partitionId() << 36
    held: list[tuple] = []

    def give():
        nonlocal base, held
        u, w, doc, own = (np.concatenate(x, -1) for x in zip(*held, strict=True))
        order = np.lexsort((doc, w, u))
        u, w, doc = u[order], w[order], doc[order]
        new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]))))
        times = np.diff(np.append(new, len(u))).astype(np.uint32)
        u, w, doc = u[new], w[new], doc[new]
        parts, cut = _cuts(u, bits)
        blobs = [_pack(*(x[a:b] for x in (u, w, doc, times))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        k, n = len(parts), own.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*parts.tolist(), -1 - base], pa.int64()), pa.array([base] * (k + 1), pa.int64()), pa.array([*blobs, None], pa.binary()), pa.array([None] * k + [zstandard.compress(own.tobytes(), 1)], pa.binary())],
            ["part", "base", "blob", "own"],
        )
        base, held = base + n, []

    n = 0
    for batch in chunks(batches):
        token, first = _tokens(batch.column("text"))
        size = np.diff(first)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[first[:-1]] = END
        if len(hot):
            split, which = _find(hot, before)
            salt = mix(np.repeat(batch.column("salt").to_numpy(), size)[split].view(np.uint64))
            spread = np.where(_piece_of_word(hot, token[split]) == ALL, salt, mix(token[split])) % salts[which].astype(np.uint64)
            before[split] = (pieces[which].astype(np.uint64) + spread) << np.uint64(48 - bits)
        kept = batch.column("held_out").to_numpy(zero_copy_only=False)
        doc = np.repeat((n + np.arange(len(size))) * 2 + kept, size).astype(np.uint32)
        ids = batch.column("doc_id")
        own = np.stack([ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), kept, size]).astype(np.int64)  # doc_id, whether there is one
        held.append((before, token, doc, own))
        n += len(size)
        if len(held) == FLUSH:
            yield from give()
            n = 0
    if held:
        yield from give()


# --- seating -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def log_seatings(discount: float, most: int = EXACT) -> np.ndarray:
    """[c, t]: log of the generalized Stirling number, the weight of all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            out[c, t] = np.logaddexp(out[c - 1, t - 1], out[c - 1, t] + np.log(np.maximum(c - 1 - discount * t, 0)))
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8."""
    y = x + 8
    shift = sum(np.log(x + i) for i in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_seatings_of_many(c: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    """The same for many customers, but for a term that depends on c alone: the coefficient of z^c in
    (1 - (1 - z)^d)^t / (d^t t!), for few tables by the expansion of the power, whose terms then fall fast, and beyond
    by its saddle point, with what it lacks where the two meet, which fades as 1 / t."""
    t, edge = tables, np.maximum(0.7 * c**d, 1)
    few = t <= edge
    out = np.empty(t.shape)
    out[few] = _expansion(c[few], t[few], d)
    c, t, edge = c[~few], t[~few], edge[~few]
    out[~few] = _saddle(c, t, d) + (_expansion(c, edge, d) - _saddle(c, edge, d)) * edge / t
    return out - _log_gamma(tables + 1.0) - tables * np.log(d)


def _expansion(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    total, log_choose = np.zeros(t.shape), np.zeros(t.shape)
    one = _log_gamma(c - d)
    for k in range(1, min(40, int(t.max(initial=0))) + 1):
        log_choose = log_choose + np.log(np.maximum(t - k + 1, 1e-300) / k)
        sign = (-1) ** (k + 1) * np.sin(np.pi * d * k)
        inside = (c > d * k) & (t >= k)
        size = log_choose + _log_gamma(np.array(1 + d * k)) + _log_gamma(np.where(inside, c - d * k, 1.0)) - one
        total += np.where(inside, sign * np.exp(np.minimum(size, 600)), 0)
    return np.log(np.maximum(total, 1e-300) / np.pi) + one - _log_gamma(c + 1)


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    ratio = np.maximum(c / t, 1 + 1e-9)
    lo, hi = np.full(ratio.shape, -200.0), np.full(ratio.shape, -1e-12)  # log(1 - z)
    for _ in range(50):
        mid = (lo + hi) / 2
        above = -np.expm1(mid) * d * np.exp((d - 1) * mid) > ratio * -np.expm1(d * mid)
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    s = (lo + hi) / 2
    x, f, z = np.exp(s), -np.expm1(d * s), -np.expm1(s)
    slope = d * np.exp((d - 1) * s) / f
    bend = slope + z * slope * (1 - d) / x - z * slope * slope
    return t * np.log(f) - c * np.log(z) - 0.5 * np.log(2 * np.pi * t * z * bend)


def uniform(key: np.ndarray, n: int) -> np.ndarray:
    """The n-th random number of each key, in [0, 1)."""
    return (mix(key + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) * 2.0**-53


def _choice(logits: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A column of each row, by weights of exp(logits)."""
    total = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), 1)
    return (total <= u[:, None] * total[:, -1:]).sum(1)


def draw_tables(key: np.ndarray, n: int, c: np.ndarray, t: np.ndarray, others: np.ndarray, log_p: np.ndarray, d: float, theta: float) -> np.ndarray:
    """New numbers of tables of dishes with c customers, now at t, in restaurants with `others` tables besides, where the
    parent gives the dish a probability of exp(log_p).

    Up to EXACT customers the number is drawn from its whole conditional, the sums over seatings times the new tables'
    weights, by the n-th random numbers of the dishes' keys.  Beyond, it is drawn by the same weights from a window of values that holds the present one at a random
    place, which leaves the conditional as it is; the window is about ten deviations wide."""
    out = np.ones(len(c), np.int64)
    exact = log_seatings(round(d, 4))
    low = 1
    for most in (2, 4, 8, 16, 32, 64, 128, EXACT):
        group = np.flatnonzero((c > low) & (c <= most))
        low = most
        step = max(1, (1 << 19) // most)
        for at in range(0, len(group), step):
            g = group[at : at + step]
            k = np.arange(1, most + 1)
            logits = exact[c[g], 1 : most + 1] + log_p[g, None] * k + np.cumsum(np.log(theta + d * (others[g, None] + k - 1)), 1)
            out[g] = 1 + _choice(logits, uniform(key[g], 2 * n))
    many, width = np.flatnonzero(c > EXACT), 49
    for at in range(0, len(many), 4096):
        g = many[at : at + 4096]
        stride = np.maximum(1, np.round(0.2 * np.sqrt(c[g] ** d))).astype(np.int64)
        k = t[g, None] + stride[:, None] * (np.arange(width) - np.floor(width * uniform(key[g], 2 * n + 1)).astype(np.int64)[:, None])
        fits = (k >= 1) & (k <= c[g, None])
        k = np.where(fits, k, 1)
        logits = log_seatings_of_many(np.broadcast_to(c[g, None], k.shape).astype(float), k.astype(float), d) + k * (log_p[g, None] + np.log(d))
        logits = np.where(fits, logits + _log_gamma(theta / d + others[g, None] + k), -np.inf)
        out[g] = k[np.arange(len(g)), _choice(logits, uniform(key[g], 2 * n))]
    return out


class Seating:
    """Restaurants given as (restaurant, customers) of each dish, at first with customers ** discount tables.

    key: a number of each dish that its random numbers come from, with the seed."""

    def __init__(self, restaurant: np.ndarray, customers: np.ndarray, d: float, theta: float, seed: int, key: np.ndarray | None = None):
        self.u, self.c, self.d, self.theta = restaurant, customers, d, theta
        self.key = mix((np.arange(len(customers), dtype=np.uint64) if key is None else key) + mix(np.array([seed], np.uint64)))
        self.sweeps = 0
        self.t = np.clip(np.round(customers.astype(float) ** d), customers > 0, customers).astype(np.int64)
        self.tables = np.bincount(restaurant, self.t, restaurant.max(initial=-1) + 1)
        many = np.flatnonzero(customers > 1)
        many = many[np.argsort(restaurant[many], kind="stable")]
        nth = np.arange(len(many)) - np.searchsorted(restaurant[many], restaurant[many])
        self.turns = [many[nth % TURNS == i] for i in range(TURNS)]

    def sweep(self, p: np.ndarray) -> None:
        """Resample each dish once; restaurants of at most TURNS such dishes do so one dish after the other."""
        for own in self.turns:
            if len(own):
                others = self.tables[self.u[own]] - self.t[own]
                new = draw_tables(self.key[own], self.sweeps, self.c[own], self.t[own], others, np.log(p[own]), self.d, self.theta)
                self.tables += np.bincount(self.u[own], new - self.t[own], len(self.tables))
                self.t[own] = new
        self.sweeps += 1


def discount(c: np.ndarray) -> float:
    return discount_of(int((c == 1).sum()), int((c == 2).sum()))


def discount_of(one: float, two: float) -> float:
    return float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))


def _rows(table: pa.Table) -> list[tuple]:
    """The flush, contexts, words, documents and times of each blob."""
    return [(b, *_unpack(x, np.uint64, np.uint32, np.uint32)) for b, x in sorted(zip(table["base"].to_pylist(), table["blob"].to_pylist(), strict=True))]


class Part:
    """The pairs of a part: their training counts, and the rows of its documents."""

    def __init__(self, table: pa.Table, theta: float, seed: int, words_only: bool = False, d: float | None = None):
        rows = _rows(table)
        u, w, doc, times = (np.concatenate(x) for x in list(zip(*rows, strict=True))[1:])
        key = mix(u ^ mix(w))
        order = np.argsort(key)
        key = key[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(first) - 1
        at, key = order[first], key[first]
        del order, first
        self.count = np.bincount(place, np.where(doc & 1, 0, times), len(at)).astype(np.int64)
        self.words, self.w = np.unique(w[at], return_inverse=True)
        contexts, self.u = np.unique(u[at], return_inverse=True)
        self.customers = np.bincount(self.u, self.count, len(contexts))
        self.tokens = np.bincount(self.w, self.count, len(self.words)).astype(np.int64)
        if words_only:
            return
        self.bases, self.first = [r[0] for r in rows], np.cumsum([0, *(len(r[1]) for r in rows[:-1])])
        self.doc, self.times, self.place = doc >> 1, times, place
        self.d, self.theta = discount(self.count) if d is None else d, theta
        self.seating = Seating(self.u, self.count, self.d, theta, seed, key)

    def predict(self, root: np.ndarray, burn: int, samples: int) -> np.ndarray:
        """The probability of each pair, averaged over samples of the seating under the words' root probabilities."""
        p, out, total = root[self.w], 0, self.theta + self.customers
        for i in range(burn + samples):
            self.seating.sweep(p)
            if i >= burn:
                s = self.seating
                out = out + (self.count - self.d * s.t + (self.theta + self.d * s.tables)[self.u] * p) / total[self.u] / samples
        return out


WORDS = "word_part long, part long, blob binary, pairs_once double, pairs_twice double"
TOTALS = ("customers", "tables", "once", "twice", "pairs_once", "pairs_twice")
ROOTS = "part long, word_part long, blob binary, " + ", ".join(f"{c} double" for c in TOTALS)


def _send_words(theta: float, sweeps: int, seed: int, bits: int, pieces: int = 1 << 62):
    """Sends a word's contexts and training tokens in a part; no seating, discount or root is needed for them."""

    def send(key: tuple, table: pa.Table) -> pa.Table:
        names = ["word_part", "part", "blob", "pairs_once", "pairs_twice"]
        if not 0 <= key[0].as_py() < pieces:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64())], names=names)
        part = Part(table, theta, seed, words_only=True)
        sent = np.bincount(part.w, part.count > 0, len(part.words)).astype(np.uint32)
        parts, cut = _cuts(part.words, bits)
        blobs = [_pack(part.words[a:b], sent[a:b], part.tokens[a:b].astype(np.uint32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        once = [[float((part.count == k).sum())] + [0.0] * (len(parts) - 1) for k in (1, 2)]
        return pa.table([pa.array(parts), pa.array([key[0].as_py()] * len(parts), pa.int64()), pa.array(blobs, pa.binary()), *map(pa.array, once)], names=names)

    return send


def _seat_root(theta: float, vocabulary: int, burn: int, samples: int, seed: int):
    def seat(key: tuple, table: pa.Table) -> pa.Table:
        """The root's seating of a word part, for each part that asked: customers, mean tables, training tokens."""
        rows = sorted(zip(table["part"].to_pylist(), table["blob"].to_pylist(), strict=True))
        asked = [_unpack(b, np.uint32, np.uint32) for _, b in rows]
        words, c, tokens = _summed(*(np.concatenate(x) for x in zip(*asked, strict=True)))
        d = discount(c)
        # one restaurant for all words: its tables elsewhere are as many a known word as here
        known = max(int((c > 0).sum()), 1)
        scale = max(vocabulary / known, 1.0)
        s = Seating(np.zeros(len(c), np.int64), c, d, theta, seed, words)
        mean = np.zeros(len(c))
        for i in range(burn + samples):
            total = s.t.sum() * scale
            many = np.flatnonzero(c > 1)
            s.t[many] = draw_tables(s.key[many], i, c[many], s.t[many], total - s.t[many], np.full(len(many), -np.log(vocabulary + 1.0)), d, theta)
            if i >= burn:
                mean += s.t / samples
        sums = [float(x) for x in (c.sum(), mean.sum(), (c == 1).sum(), (c == 2).sum(), *(sum(table[k].to_pylist()) for k in TOTALS[4:]))]
        blobs = []
        for w, _, _ in asked:
            at = np.searchsorted(words, w)
            blobs.append(_pack(w, c[at].astype(np.uint32), mean[at].astype(np.float32), tokens[at].astype(np.uint64)))
        n = len(rows)
        first = [[x] + [0.0] * (n - 1) for x in sums]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([key[0].as_py()] * n, pa.int64()), pa.array(blobs, pa.binary()), *map(pa.array, first)], names=["part", "word_part", "blob", *TOTALS])

    return seat


SUMS = "base long, part long, blob binary, own binary"
_SUMS = pa.schema([("base", pa.int64()), ("part", pa.int64()), ("blob", pa.binary()), ("own", pa.binary())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def root_probability(customers: np.ndarray, tables: np.ndarray, totals: dict, vocabulary: int, theta: float) -> np.ndarray:
    """The root's probability of words with these customers and tables; an unknown word has neither.  Over the known
    words and one unknown these sum to 1."""
    d = discount_of(totals["once"], totals["twice"])
    return (customers - d * tables + (theta + d * totals["tables"]) / (vocabulary + 1)) / (theta + totals["customers"])


def _probabilities(left: pa.Table, right: pa.Table, theta: float, vocabulary: int, burn: int, samples: int, seed: int) -> tuple[Part, np.ndarray, np.ndarray]:
    """A part, the log10 of the model's probability of each of its pairs, and the training tokens of the pair's word."""
    totals = {k: right[f"all_{k}"][0].as_py() for k in TOTALS}
    part = Part(left, theta, seed, d=discount_of(totals["pairs_once"], totals["pairs_twice"]))
    rows = sorted(zip(right["word_part"].to_pylist(), right["blob"].to_pylist(), strict=True))
    words, c, t, n = (np.concatenate(x) for x in zip(*(_unpack(b, np.uint32, np.float32, np.uint64) for _, b in rows), strict=True))
    if len(words) != len(part.words):
        raise ValueError("the root answers for other words than the part asked about")
    root = root_probability(c.astype(float), t.astype(float), totals, vocabulary, theta)
    return part, np.log10(part.predict(root, burn, samples)), n[part.w]


def _score_context(theta: float, vocabulary: int, burn: int, samples: int, seed: int, bits: int, hot: np.ndarray, salts: np.ndarray):
    pieces = _first_pieces(bits, salts)

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """For each piece of a hot context its words with their training tokens and probabilities after the context."""
        names = ["part", "blob"]
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=names)
        part, log_p, n = _probabilities(left, right, theta, vocabulary, burn, samples, seed)
        order = np.argsort(part.w)
        words, log_p, n = part.words[part.w[order]], log_p[order], n[order]
        i = key[0].as_py() - (1 << bits)
        everywhere = _piece_of_word(hot, words) == ALL
        spread = (mix(words) % np.uint64(salts[i])).astype(np.int64)
        blobs = [_pack(words[own], n[own], log_p[own]) for own in ((spread == j) | everywhere for j in range(salts[i]))]
        return pa.table([pa.array(np.arange(pieces[i], pieces[i + 1])), pa.array(blobs, pa.binary())], names=names)

    return score


def _given(key: tuple, bases: list, cut: np.ndarray, doc: np.ndarray, times: np.ndarray, at: np.ndarray, n: np.ndarray, log_p: np.ndarray, smooth: int) -> pa.Table:
    """Sums over the documents of each flush, of pairs whose figures stand at `at`."""
    base = np.log10((n.astype(float) + 1) / smooth)
    values, blobs = (times * (n[at] > 0), times * base[at], times * log_p[at]), []
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        docs, place = np.unique(doc[i:j], return_inverse=True)
        known, low, high = (np.bincount(place, x[i:j], len(docs)) for x in values)
        blobs.append(_pack(docs.astype(np.uint64), known.astype(np.uint32), low, high))
    k = len(blobs)
    return pa.table([pa.array(bases, pa.int64()), pa.array([key[0].as_py()] * k, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(k, pa.binary())], schema=_SUMS)


def _score_part(theta: float, tokens: int, vocabulary: int, burn: int, samples: int, seed: int, own: int):
    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """What a part's pairs give to the documents of each flush, in a blob; documents' own rows pass."""
        if not left.num_rows or key[0].as_py() < 0:
            return left.select(["base", "part", "blob", "own"]).cast(_SUMS)
        if key[0].as_py() >= own:  # counts of a hot context, and pieces
            return _SUMS.empty_table()
        part, log_p, n = _probabilities(left, right, theta, vocabulary, burn, samples, seed)
        return _given(key, part.bases, np.append(part.first, len(part.doc)), part.doc, part.times, part.place, n, log_p, tokens + vocabulary + 1)

    return score


def _score_piece(tokens: int, vocabulary: int, pieces: int):
    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The same of a hot context's piece, whose words' figures come from the context's own part."""
        if not left.num_rows or key[0].as_py() < pieces:
            return _SUMS.empty_table()
        words, n, log_p = _unpack(right["blob"][0].as_py(), np.uint64, np.float64)
        rows = _rows(left)
        w, doc, times = (np.concatenate(x) for x in list(zip(*rows, strict=True))[2:])
        at = np.minimum(np.searchsorted(words, w), len(words) - 1)
        if not (words[at] == w).all():
            raise ValueError("a hot context's part has not got all words of its pieces")
        return _given(key, [r[0] for r in rows], np.cumsum([0, *(len(r[1]) for r in rows)]), doc >> 1, times, at, n, log_p, tokens + vocabulary + 1)

    return score


def _total(table: pa.Table) -> pa.Table:
    """The documents of one flush with the sums over all parts, in the order of parts."""
    rows = sorted(zip(table["part"].to_pylist(), table["blob"].to_pylist(), table["own"].to_pylist(), strict=True), key=lambda r: r[0])
    doc_id, valid, held, size = np.frombuffer(zstandard.decompress(rows[0][2]), np.int64).reshape(4, -1)
    sums = np.zeros((3, len(size)))
    for _, blob, _ in rows[1:]:
        at, *got = _unpack(blob, np.uint32, np.float64, np.float64)
        sums[:, at.astype(np.int64)] += np.stack(got)
    return pa.table([pa.array(doc_id, mask=valid == 0), pa.array(held > 0), pa.array(size), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score_texts(docs: DataFrame, part_tokens: int = 1 << 21, burn: int = 3, samples: int = 4, theta: float = 1.0, seed: int = 0) -> DataFrame:
    """For each row of docs (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score.  The model learns from rows that are not held out (a null counts as not held out).

    Tokens are what stands between ASCII white space, A-Z lower-cased, then one end; a null text is empty, so every text
    has a token.  base_score: sum of log10((c + 1) / (N + V + 1)); score: sum of log10 of the model's probability.
    Without training rows N, V and counts are 0 and both scores are those of a uniform choice of the one unknown.
    Repeated rows count and are scored each.

    A token's context is the word before it (the end, for a first word).  Parts hold about `part_tokens` tokens.  Tokens
    of a context with more than half of that are dealt over pieces, by word or (for words as frequent) by a hash of
    doc_id (of the text where there is none), but their counts are summed first and seated as one restaurant, in a task
    that holds the context's distinct words.  Such contexts are at most 2 tokens / part_tokens, 16 bytes each to every task.

    Each context sends the root one customer for each of its words, as in Kneser and Ney's counts, and the root's
    tables are sampled word part by word part.  Under this root each part burns in and averages `samples` predictives; a
    sweep draws the number of tables of each dish from its conditional, given the other tables of its restaurant and the
    root.  One discount, from all pairs that occur once and twice, serves all restaurants but the root.  Customers and
    tables of one restaurant in one predictive are of one sample, and the root's totals are the sums of its words', so
    probabilities after any context sum to 1 over the known words and one unknown.  `part_tokens` changes scores
    only by the discount and the tables of the root, which a word part finds from its own words, a sample by their hash.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.xxhash64(F.col("doc_id").cast("long"))).alias("salt"),
    )
    words = docs.where(~F.col("held_out")).select("text").mapInArrow(_vocabulary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "lm-words")
    tokens, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = part_tokens // 2
    hot = sorted((int(np.int64(r.word).view(np.uint64)), -(-r.n // (part_tokens // 2))) for r in words.where(F.col("n") > least).collect())
    split, salts = np.array([h for h, _ in hot], np.uint64), np.array([s for _, s in hot], np.int64)
    bits = max(2, int(np.ceil(np.log2(max(1, tokens / part_tokens)))))

    own, pieces = 1 << bits, int(_first_pieces(bits, salts)[0])

    pairs = docs.mapInArrow(lambda b: _pairs(b, bits, split, salts), PAIRS)
    if hot:
        dishes = docs.mapInArrow(lambda b: _dishes(b, bits, split, salts), "part long, blob binary")
        contexts = written(dishes.groupBy("part").applyInArrow(_whole_context(bits, split, salts), PAIRS), "lm-contexts")
        pairs = pairs.union(contexts)
    asked = pairs.groupBy("part").applyInArrow(_send_words(theta, burn, seed, bits, pieces), WORDS)
    roots = asked.groupBy("word_part").applyInArrow(_seat_root(theta, vocabulary, burn, samples, seed + 1), ROOTS).repartition("part")
    totals = roots.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"all_{c}") for c in TOTALS])
    answers = roots.select("part", "word_part", "blob").join(F.broadcast(totals))
    sums = pairs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_score_part(theta, tokens, vocabulary, burn, samples, seed + 2, own), SUMS)
    if hot:  # the whole of pairs and answers again, whose exchanges are shared, so that neither is made or moved twice
        found = contexts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_score_context(theta, vocabulary, burn, samples, seed + 2, bits, split, salts), "part long, blob binary")
        sums = sums.union(pairs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_score_piece(tokens, vocabulary, pieces), SUMS))
    whole = sums.groupBy("base").applyInArrow(_total, SCORES)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
