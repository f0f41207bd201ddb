"""Each corpus operator against a brute-force form, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noctua.llm import common, decontaminate, licenses, lm, minhash, mixing, secrets, token_store, topk, toxicity, url_filter
from noctua.llm.queries import QUERIES, URL_RULES, tokenizer_file

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- common ---------------------------------------------------------------------------------------------------------------


def test_words_are_those_of_a_regular_expression(odd_rows):
    rows = [t for _, t, _ in odd_rows]
    for kind, pattern in ((common.SPACED, SPACED), (common.WORDY, WORDS)):
        w = common.Words(pa.array(rows, pa.string()), kind)
        for i, t in enumerate(rows):
            want = pattern.findall((t or "").translate(LOWER))
            got = w.hash[w.first[i] : w.first[i + 1]]
            assert len(got) == len(want)
            assert [int(h) for h in got[:50]] == [common.word_hash(x) for x in want[:50]]


# --- 1 --------------------------------------------------------------------------------------------------------------------


def _distance(a, b):
    """Edit distance of a to the best slice of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_agrees_with_the_table_of_distances():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 80)).tolist(), rng.integers(0, 4, rng.integers(1, 90)).tolist()
        d, start, end = decontaminate.best_match(a, b)
        assert d == _distance(a, b)
        if d < len(a):
            assert _distance(b[start:end], a) <= d and decontaminate.myers(a, b[start:end], anchored=True)[-1] == d


def test_leaks_are_those_of_comparing_every_pair(spark, documents):
    docs = documents.limit(60)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, bench).collect()}
    words = lambda t: WORDS.findall((t or "").lower())
    want = {}
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    for doc_id, t in texts(docs):
        w = words(t)
        grams = set(w)
        for item_id, p in items:
            k = int(0.2 * len(p))
            if len(p) >= 5 and len(set(p) - grams) <= k and (d := _distance(p, w)) <= k:
                want[doc_id, item_id] = d
    assert got == want


def test_edited_passages_are_found_and_blocks_change_nothing(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    w = item.split()
    cases = [(1, item), (2, " ".join(w[:3] + ["new"] + w[3:8] + w[9:])), (3, " ".join(reversed(w))), (4, "Alpha, BETA! " + " ".join(w[2:])), (5, " ".join(w[:7]))]
    docs = spark.createDataFrame([(i, f"some words before {t} and after") for i, t in cases], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, "too short"), (3, None)], "item_id long, text string")
    for size in (1 << 20, 10):
        got = sorted((r.doc_id, r.item_id, r.distance, r.first_word) for r in decontaminate.find_leaks(docs, bench, block_words=size).collect())
        assert got == [(1, 1, 0, 3)] * 2 + [(2, 1, 2, 3)] * 2 + [(4, 1, 0, 3)] * 2
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [3, 5]
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.without_leaks(odd, bench).columns == odd.columns and decontaminate.without_leaks(odd, bench).count() == odd.count()
    assert decontaminate.find_leaks(odd, bench.where("false")).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"seeds": 30, "slice_rows": 40, "bucket": 16}])
def test_top_k_is_that_of_all_products(spark, options):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-20, 20, (80, 6)), np.tile([[9, 9, 9, 9, 9, 9]], (40, 1)), rng.integers(-200, 200, (10, 6)), np.zeros((3, 6), int)])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (None, [1, 2, 3, 4, 5, 6]), (501, [1, 2])]
    d = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(d, d.where("vec_id % 20 = 0"), 20, **options).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    want = []
    for q in range(0, len(v), 20):
        order = sorted(((-int(v[q] @ v[i]), i) for i in range(len(v)) if i != q))[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(order, 1)]
    assert got == want
    assert topk.top_k(d.where("false"), d.where("false")).count() == 0
    two = spark.createDataFrame([(0, v[0].tolist()), (0, v[0].tolist()), (0, (-v[0]).tolist())], "vec_id long, v array<long>")
    got = Counter((r["rank"], r.score) for r in topk.top_k(d, two, 3, **options).collect())
    best = lambda q: sorted((-int(q @ v[i]), i) for i in range(1, len(v)))[:3]
    assert got == Counter((n, -s) for q in (v[0], -v[0]) for n, (s, _) in enumerate(best(q), 1))


# --- 3 --------------------------------------------------------------------------------------------------------------------


def test_apportionment_is_that_of_single_seats():
    rng = np.random.default_rng(2)
    for _ in range(60):
        votes, most = rng.integers(0, 50, 7).astype(float), rng.integers(0, 30, 7)
        seats = int(rng.integers(0, 80))
        held = [0] * 7
        for _ in range(seats):
            free = [(-(votes[i] / (2 * held[i] + 1)), i) for i in range(7) if votes[i] > 0 and held[i] < most[i]]
            if not free:
                break
            held[min(free)[1]] += 1
        assert mixing.apportion(votes, seats, most).tolist() == held


def test_water_fill():
    assert mixing.water_fill(np.array([100, 100]), np.array([1.0, 2.0]), 3).tolist() == pytest.approx([200 / 3, 400 / 3])
    assert mixing.water_fill(np.array([90, 10]), np.array([1.0, 2.0]), 3).tolist() == pytest.approx([70, 30])


def test_mix_meets_its_targets(spark, documents):
    rows = mixing.mix_plan(documents).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts(documents))
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert sum(g[0].target for g in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    for g in by.values():
        assert sum(r["size"] for r in g) == g[0].source_size and g[0].target <= 3 * g[0].source_size + 1e-6
        assert abs(sum(r.taken for r in g) - g[0].target) <= 2
        assert all(r.taken <= 3 * r["size"] and r.taken == sum(p.to - p["from"] for p in r.pieces) for r in g)
    again = mixing.mix_plan(documents.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_small_sources_meet_their_targets_to_a_word(spark):
    tiny = [(i, "one two three four five " * 4, f"s{i:03}") for i in range(400)]
    plan = mixing.mix_plan(spark.createDataFrame(tiny, "doc_id long, text string, source string")).collect()
    assert sum(r.taken for r in plan) == 8000 and all(abs(r.taken - r.target) <= 1 and r.taken > 0 for r in plan)
    uneven = [(1, "a b c d e", "small"), *((i, "w " * 100, "large") for i in range(2, 122))]
    plan = mixing.mix_plan(spark.createDataFrame(uneven, "doc_id long, text string, source string"), weights=(1, 1)).collect()
    taken = {s: sum(r.taken for r in plan if r.source == s) for s in ("small", "large")}
    assert taken == {"small": 15, "large": 11_990}


def test_words_are_apportioned_in_whole_blocks_first():
    rng = np.random.default_rng(3)
    for _ in range(50):
        votes, words = rng.integers(0, 400, 6), int(rng.integers(0, 2000))
        most = 3 * votes
        got = mixing.apportion_words(votes, words, most, 64)
        assert got.sum() == min(words, most.sum()) and (got <= most).all()
        if words <= votes.sum() and votes.sum():
            assert np.abs(got - votes * words / votes.sum()).max() <= 2


def test_names_of_the_mix_are_the_tables_own(spark):
    names = ["_row", "_nth", "_plan", "_at", "_pieces", "_pass", "_words", "_new"]
    d = spark.createDataFrame([(i, "a b c " * 9, "s", *names) for i in range(5)], f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names)}")
    got = mixing.mixed(d)
    assert got.columns == d.columns and all(r[n] == n for r in got.collect() for n in names)


def test_mix_of_odd_rows_and_small_shards(spark, odd, nothing):
    plan = mixing.mix_plan(odd, shard_words=5000).collect()
    assert len(plan) == odd.count()
    want = Counter((i, len(SPACED.findall(t or ""))) for i, t in texts(odd))
    assert Counter((r.doc_id, r["size"]) for r in plan) == want
    got = mixing.mixed(odd, shard_words=5000)
    assert got.columns == odd.columns
    out = got.collect()
    taken = sum(r.taken for r in plan)
    assert sum(len(SPACED.findall(r.text)) for r in out) == taken and all(r.n_chars == len(r.text) for r in out)
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------------


def _shingles(t, n=5):
    w = WORDS.findall((t or "").lower())
    return Counter([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [()])


def _classes(rows):
    sets = [(i, _shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            both = sum((s & u).values())
            if both / (sum(s.values()) + sum(u.values()) - both) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**63, 400).astype(np.uint64)
    w = np.stack([rng.integers(1, 6, 400), rng.integers(1, 6, 400)]).astype(float)
    w[1, :200] = w[0, :200]
    sig = minhash.dart_signatures(np.repeat([0, 1], 400), np.tile(h, 2), w.ravel(), 2, 4000)
    true = np.minimum(*w).sum() / np.maximum(*w).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_near_duplicate_classes(spark, documents):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents).collect()}
    assert got == _classes(texts(documents))


def test_near_duplicates_of_a_large_group_and_odd_rows(spark, odd, odd_rows, nothing):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"n{i}"
        rows.append((1000 + i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in minhash.near_duplicates(d).collect()} == {1000}
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(odd).collect())
    want = _classes([(i, t) for i, t, _ in odd_rows])
    prose_class = want[4]
    assert {k: v for k, v in got.items() if k[0] is not None} == {(i, want[i]): n for i, n in Counter(i for i, _, _ in odd_rows if i is not None).items()}
    assert {k: v for k, v in got.items() if k[0] is None} == {(None, prose_class): 1, (None, None): 1}
    kept = minhash.without_near_duplicates(odd)
    # the two different texts of document 10 both stay
    assert kept.columns == odd.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i in set(want.values())] + [(False, 10), (True, 0)])
    assert minhash.near_duplicates(nothing).count() == 0


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in minhash.components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_duplicates_of_copies_of_copies_with_mixed_edits(spark, monkeypatch):
    rng = np.random.default_rng(11)
    made = []
    for g in range(10):  # 81 shingles, 101 (0.802 to these), and a family of 102 and more (0.794 to them), which the pivot is of
        w = [f"g{g}w{i}" for i in range(106)]
        made += [w[:85], w[:105], w, *([*w, f"u{g}n{k}"] for k in range(8))]
    for _ in range(60):  # edits of all strengths
        w = list(made[int(rng.integers(0, len(made)))])
        for at in rng.integers(0, len(w), int(rng.integers(1, 9))):
            w[at] = f"n{rng.integers(0, 10**6)}"
        made.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    want = _classes(rows)
    assert 10 < len(set(want.values())) < len(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(d).collect()} == want
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 8)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(d).collect()} == want


def test_rows_without_an_id_are_told_apart(spark):
    one, two, leak = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    d = spark.createDataFrame([(None, one), (None, two), (None, one), (None, one + " more"), (None, leak), (1, two)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in minhash.without_near_duplicates(d).collect()]
    assert len(kept) == 3 and (1, two) in kept and (None, leak) in kept and ((None, one) in kept) != ((None, one + " more") in kept)
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(d).collect())
    assert got == {(None, None): 4, (None, 1): 1, (1, 1): 1}
    clean = decontaminate.without_leaks(d, spark.createDataFrame([(7, leak)], "item_id long, text string"))
    assert clean.columns == d.columns and sorted(r.text for r in clean.collect()) == sorted([one, two, one, one + " more", two])


def test_numbers_of_common_elements():
    rng = np.random.default_rng(5)
    for n, most in ((1, 50), (3, 40), (80, 60), (80, 3000)):
        sets = [np.unique(rng.integers(0, most, 40)).astype(np.int64) for _ in range(n)]
        got = minhash._common(np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets]), n)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(i))


# --- 5 --------------------------------------------------------------------------------------------------------------------


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    x = rng.random((300, 12)) * (rng.random((300, 12)) < 0.3)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    vectors = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in x]
    index = toxicity.BlockMaxIndex(vectors, 12, list(range(300)), [0] * 300)
    for q in x[:60]:
        t = np.flatnonzero(q)
        at, s = index.nearest(t, q[t], 7)
        want = np.sort(x @ q)[::-1][:7]
        assert s == pytest.approx(want[want > 0][: len(s)]) and len(s) == min(7, int((x @ q > 0).sum()))


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert len(got) > 500 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.95
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85


def test_toxicity_of_odd_rows(spark, odd, nothing):
    bad = [(100 + i, f"you are a worthless idiot number{i} today" if i % 2 else f"have a pleasant quiet day number{i} friend") for i in range(80)]
    docs = spark.createDataFrame(bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in bad] + [(100, None), (None, 1), (5000, 1), (101, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    new = spark.createDataFrame([(1, "What a WORTHLESS idiot"), (2, "pleasant day, friend"), (3, None)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score_toxicity(new, model).collect()}
    assert s[1] > 0.5 > s[2]
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and toxicity.without_toxic(nothing, model).count() == 0
    empty = toxicity.fit(nothing, labels.where("false"))
    assert {r.score for r in toxicity.score_toxicity(odd, empty).collect()} == {0.0}


# --- 6 --------------------------------------------------------------------------------------------------------------------


def _base(rows, held):
    tok = lambda t: [*SPACED.findall((t or "").translate(LOWER)), None]
    c = Counter(w for (i, t), h in zip(rows, held, strict=True) if not h for w in tok(t))
    n, v = sum(c.values()), len(c)
    return Counter((i, h, len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 4)) for (i, t), h in zip(rows, held, strict=True))


def test_language_model_base_and_gain(spark, documents):
    got = QUERIES["op6_language_model"](spark, DATA).collect()
    rows = texts(documents)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == _base(rows, held)
    new = [r for r in got if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


@pytest.mark.parametrize("part_tokens", [1 << 21, 40])
def test_language_model_is_a_distribution(monkeypatch, part_tokens):
    """Over all known words and the unknown the model's probabilities after any context sum to 1, whole or split."""
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    rng = np.random.default_rng(6)
    words = ["a", "b", "c", "d", "e", "f", "zzz"]
    train = [" ".join(rng.choice(words[:6], 12, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])) for _ in range(60)]
    asked = [f"{c} {w}".strip() for c in ("", *words) for w in ("", *words)]
    rows = [(i, t, i >= len(train)) for i, t in enumerate([*train, *asked])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([7] * len(rows), pa.int64())], ["doc_id", "text", "held_out", "salt"]
    )
    hot = np.array([lm.word_hash("a")], np.uint64) & lm.MASK if part_tokens < 100 else np.zeros(0, np.uint64)
    pairs = pa.Table.from_batches(lm._pairs(iter([batch]), 2, hot, np.array([3] * len(hot)))).to_pylist()
    tables = {p: pa.Table.from_pylist([r for r in pairs if r["part"] == p], pairs_schema()) for p in {r["part"] for r in pairs}}
    own = {p: t for p, t in tables.items() if p >= 0}
    sent = [r for p, t in own.items() for r in lm._send_words(1.0, 2, 0, 2)((pa.scalar(p),), t).to_pylist()]
    tokens, v = sum(len(t.split()) + 1 for t in train), 7
    roots = []
    for q in {r["word_part"] for r in sent}:
        roots += lm._seat_root(1.0, v, 2, 3, 0)((pa.scalar(q),), pa.Table.from_pylist([r for r in sent if r["word_part"] == q])).to_pylist()
    totals = {k: sum(r[k] for r in roots) for k in ("customers", "tables", "once", "twice")}
    ends, seen = {int(lm.word_hash(w) & int(lm.MASK)) for w in words} | {int(lm.END)}, 0
    for p, t in own.items():
        part = lm.Part(t, 1.0, 0)
        got = [lm._unpack(r["blob"], np.uint32, np.float32, np.uint64) for r in sorted((r for r in roots if r["part"] == p), key=lambda r: r["word_part"])]
        w, c, tab, n = (np.concatenate(x) for x in zip(*got, strict=True))
        assert (w == part.words).all() and n.sum() <= tokens
        root = lm.root_probability(c.astype(float), tab.astype(float), totals, v, 1.0)
        probability = part.predict(root, 2, 3)
        for u in range(len(part.customers)):
            own_words = {int(x) for x in part.words[part.w[part.u == u]]}
            if own_words == ends:  # a context that was asked with every word
                seen += 1
                assert probability[part.u == u].sum() == pytest.approx(1, abs=1e-6)
    assert seen >= 6


def pairs_schema():
    return pa.schema([("part", pa.int64()), ("base", pa.int64()), ("blob", pa.binary()), ("own", pa.binary())])


def test_tables_are_those_of_customers_that_move_singly():
    """Mean tables of each dish against a sampler that seats one customer after the other, at real tables."""
    c, p, d, theta = np.array([14, 5, 2, 1]), np.array([0.3, 0.05, 0.6, 0.05]), 0.6, 1.0
    s = lm.Seating(np.zeros(4, np.int64), c, d, theta, 1)
    got, rounds = np.zeros(4), 20_000
    for _ in range(rounds):
        s.sweep(p)
        got += s.t / rounds
        assert s.tables[0] == s.t.sum()
    rng = np.random.default_rng(2)
    seats, want, rounds = [[int(x)] for x in c], np.zeros(4), 8_000
    for _ in range(rounds):
        for k in range(4):
            for _ in range(c[k]):
                own = seats[k]
                i = int(rng.choice(len(own), p=np.array(own) / sum(own)))  # a random customer's table
                own[i] -= 1
                if not own[i]:
                    own.pop(i)
                t = sum(map(len, seats))
                weight = np.array([n - d for n in own] + [(theta + d * t) * p[k]])
                j = int(rng.choice(len(weight), p=weight / weight.sum()))
                own.append(1) if j == len(own) else own.__setitem__(j, own[j] + 1)
        want += np.array([len(x) for x in seats]) / rounds
    assert got == pytest.approx(want, abs=0.08)


@pytest.mark.parametrize("d", [0.3, 0.6, 0.9])
def test_weights_of_seatings_of_many(d):
    exact, c = lm.log_seatings(d, 400), 400
    t = np.arange(1, 300)
    many = lm.log_seatings_of_many(np.full(len(t), float(c)), t.astype(float), d)
    assert np.diff(many) == pytest.approx(np.diff(exact[c, t]), abs=0.02)


def test_language_model_of_odd_rows(spark, odd_rows, nothing):
    rows = [(i, t) for i, t, _ in odd_rows]
    held = [i == 5 for i, _ in rows]
    d = spark.createDataFrame([(*r, h) for r, h in zip(rows, held, strict=True)], "doc_id long, text string, held_out boolean")
    got = lm.score_texts(d).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == _base(rows, held)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert {r.base_score for r in lm.score_texts(d.withColumn("held_out", F.lit(True))).collect()} == {0.0}
    assert lm.score_texts(nothing.select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0


def test_a_hot_context_is_one_restaurant(spark, documents):
    """Scores are the same whether frequent contexts stay in their parts or are dealt over pieces."""
    d = documents.select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out")).limit(300)
    more = spark.createDataFrame([(10_000 + i, " ".join(f"the w{i * j % 97}" for j in range(1, 120)), i % 5 == 0) for i in range(200)], d.schema)
    d = d.union(more)
    whole = {r.doc_id: r for r in lm.score_texts(d).collect()}
    tokens = next(iter(whole.values())).train_tokens
    for part_tokens in (tokens // 4 + 1, tokens // 9):  # as many parts as above; more parts, of whose words the root's discount is
        got = {r.doc_id: r for r in lm.score_texts(d, part_tokens=part_tokens).collect()}
        assert got.keys() == whole.keys()
        for i, r in got.items():
            assert r[:5] == whole[i][:5] and r.base_score == pytest.approx(whole[i].base_score)
            assert r.score == pytest.approx(whole[i].score, rel=1e-9 if part_tokens > tokens // 4 else 5e-3)


def test_weights_of_small_seatings():
    """Three customers: one table in (1 - d)(2 - d) ways, two in 3 (1 - d), three in one."""
    got = np.exp(lm.log_seatings(0.5)[3, 1:4])
    assert got == pytest.approx([0.5 * 1.5, 3 * 0.5, 1])


# --- 7 --------------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def _secret_base(t):
    t = t or ""
    got = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    got += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    got += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(got)]


def test_secret_spans(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = Counter()
    for i, t in texts(docs):
        b = _secret_base(t)
        n = Counter(x.split(":")[0] for x in b)
        rows[i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(b).encode()).hexdigest()] += 1
    got = secrets.find_secrets(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == rows
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0


def test_weak_parts_are_reported_only_together(spark, nothing):
    key, weak = "AKIA" + "ABCDEFGHIJ234567", "aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW"
    cases = [
        (1, f"user: alice\n{weak}\nhttps://db.example.com:5432/x", {"weak_id", "weak_secret", "endpoint"}),
        (2, weak, set()), (3, f"user: alice {'x ' * 300} {weak}", set()), (4, f"user: alice\n\n{weak}", set()),
        (5, f"{key} then {weak}", {"access", "weak_secret"}), (6, "user: alice at https://a.example.com", set()), (7, "é" * 10 + "secret = 'abcdef12' user=bob", {"assign", "weak_id"}), (7, "token:abc token=secret: abcdefgh", {"assign"}),
    ]
    d = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")
    got = secrets.find_secrets(d.union(d)).collect()
    kinds = Counter((r.doc_id, frozenset(s.split(":")[0] for s in r.spans.split(",") if s)) for r in got)
    assert kinds == Counter({k: 2 * n for k, n in Counter((i, frozenset(k)) for i, _, k in cases).items()})
    seven = next(r for r in got if r.doc_id == 7 and r.n_linked)
    assert seven.spans.startswith("assign:10:28,weak_id:")
    assert secrets.find_secrets(nothing).count() == 0


def _linked(text, reach):
    """All weak spans that stand near their complements, by comparing every pair of parts."""
    found = [(m.start(), k, m.end()) for k, p in enumerate((secrets.WEAK_ID, secrets.WEAK_SECRET, secrets.ENDPOINT), 3) for m in re.finditer(p, text)]
    for s in _secret_base(text):
        kind, start, end = s.split(":")
        found.append((int(start), secrets.KINDS.index(kind), int(end)))
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    role = lambda k: "id" if k in (1, 3) else "secret" if k in (0, 2, 4) else "endpoint"
    scope = lambda at: sum(b < at for b in breaks)
    out = set()
    for start, kind, end in found:
        near = {role(k) for a, k, b in found if a <= end + reach and b >= start - reach and scope(a) == scope(start)} - {role(kind)}
        wanted = {"id": {"secret"}, "secret": {"id"}, "endpoint": {"id", "secret"}}[role(kind)]
        if kind >= 3 and wanted <= near:
            out.add((start, kind, end))
    return out


def test_links_are_those_of_comparing_all_parts(spark):
    rng = np.random.default_rng(12)
    pieces = ["user: alice", "client_id=app77", "host = db.local", "https://a.example.com:80/x", "aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW", "AKIA" + "ABCDEFGHIJ234567", "password = hunter22", "0123456789abcdef01234567", "\n\n", "\n \t\n", "some words here", "é" * 40, "x" * 90, "more, and more"]
    rows = [(i, " ".join(pieces[j] for j in rng.integers(0, len(pieces), rng.integers(1, 40)))) for i in range(150)]
    rows.append((150, " ".join(["user: bob and aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW at https://x.example.com"] * 300)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for reach in (200, 60):
        got = {r.doc_id: {(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)} for r in secrets.find_secrets(d, reach).collect()}
        links = 0
        for i, text in rows:
            want = _linked(text, reach)
            assert {s for s in got[i] if s[1] >= 3} == want, (i, reach)
            links += len(want)
        assert links > 500


# --- 8 --------------------------------------------------------------------------------------------------------------------


def test_license_places(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = Counter()
    for i, t in texts(docs):
        w = WORDS.findall((t or "").translate(LOWER))
        at, names = [], set()
        for p, label in licenses.PHRASES.items():
            p = p.split()
            hits = [j for j in range(len(w)) if w[j] == p[0] and w[j : j + len(p)] == p]
            at += hits
            names |= {label} if hits else set()
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))] += 1
    got = licenses.scan_licenses(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_passages_with_changed_words(spark, nothing):
    w = licenses.TEMPLATES["bsd"][0].split()
    changed = " ".join(w[:8] + ["really"] + w[8:15] + w[16:])
    rows = [(1, "x y z " + " ".join(w)), (2, changed), (3, " ".join(w[:6])), (4, " ".join(w) + " gap" * 50 + " " + " ".join(w)), (5, None)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["bsd", "bsd", "", "bsd", ""]
    assert got[1].score == 1.0 and got[1].found[0].first_word == 3 and 0.5 < got[2].score < 1 and 0 < got[3].score < 0.6
    assert len(got[4].found) == 2 and got[5].score == 0 and licenses.scan_licenses(nothing).count() == 0


def _passages(words, k=5, slack=3, least=0.6):
    """found and the best cover, by comparing every place of the document with every place of every template."""
    found, best = [], 0.0
    for label, texts_ in licenses.TEMPLATES.items():
        for text in texts_:
            t = WORDS.findall(text.translate(LOWER))
            hits = [(i, j) for i in range(len(words) - k + 1) for j in range(len(t) - k + 1) if words[i] == t[j] and words[i : i + k] == t[j : j + k]]
            runs: list[list] = []
            for off in sorted({i - j for i, j in hits}):
                if runs and off - runs[-1][-1] <= slack:
                    runs[-1].append(off)
                else:
                    runs.append([off])
            for run in runs:
                mine = [(i, j) for i, j in hits if i - j in run]
                cover = len({j + n for _, j in mine for n in range(k)}) / len(t)
                lo, hi = min(i for i, _ in mine), max(i for i, _ in mine) + k
                best = max(best, cover)
                if cover >= least and hi - lo <= 2 * len(t):
                    found.append((label, lo, hi, round(cover, 9)))
    return sorted(found), best


def test_license_passages_are_those_of_all_diagonals(spark):
    rng = np.random.default_rng(8)
    parts = [WORDS.findall(t.translate(LOWER)) for ts in licenses.TEMPLATES.values() for t in ts]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.integers(1, 4)):
            t = list(parts[rng.integers(len(parts))])
            for _ in range(rng.integers(0, 6)):  # edits: a word changed, left out, put in, or the passage cut
                at = int(rng.integers(len(t)))
                t = [t[:at] + ["changed"] + t[at + 1 :], t[:at] + t[at + 1 :], t[:at] + ["inserted"] * 2 + t[at:], t[at // 3 :]][rng.integers(4)] or ["none"]
            words += ["filler"] * int(rng.integers(0, 9)) + t
        rows.append((i, " ".join(words)))
    total = 0
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = rows[r.doc_id][1].split()
        found, best = _passages(words)
        assert sorted((f.label, f.first_word, f.end_word, round(f.cover, 9)) for f in r.found) == found
        assert r.n_base > 0 and r.score == 1.0 or abs(r.score - best) < 1e-9
        total += len(found)
    assert total > 80


# --- 9 --------------------------------------------------------------------------------------------------------------------


def test_url_verdicts_of_all_rules(spark):
    urls = [
        "http://example.com/en/a", "http://www.example.com/en/", "HTTP://WWW.EXAMPLE.COM/EN/", "https://a.b.example.com/en/x?y#z", "ftp://notexample.com/en/", "http://x.com", "http://x.com/", "http://net/es/", "http://a.net/fr/q", "http://a.net/frx/",
        "http://example.com?/en/", "no scheme/com/", "", None, "://com/", "http://.com/", "http://example.com/en/a",
    ]
    rows = [(i, u, "old") for i, u in enumerate(urls)]
    d = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.url_verdicts(d, spark.createDataFrame(URL_RULES, url_filter.RULES)).collect()}
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0].translate(LOWER)
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert url_filter.url_verdicts(d.where("false"), spark.createDataFrame(URL_RULES, url_filter.RULES)).count() == 0
    none = url_filter.url_verdicts(d, spark.createDataFrame([("com", None, "block")], url_filter.RULES))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_url_paths_match_inside_a_segment(spark):
    d = spark.createDataFrame([(1, "http://a.com/english"), (2, "http://a.com/e")], "page_id long, url string")
    got = url_filter.url_verdicts(d, spark.createDataFrame([("a.com", "/en", "block"), ("a.com", "/en", "allow")], url_filter.RULES))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow"}


# --- 10 -------------------------------------------------------------------------------------------------------------------


def test_code_is_optimal_and_round_trips():
    rng = np.random.default_rng(6)
    counts = np.bincount(rng.zipf(1.3, 20000) % 3000, minlength=3500)
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        best += s
        heapq.heappush(heap, s)
    assert int((token_store.code_lengths(counts, 40).astype(int) * counts).sum()) == best
    n = token_store.code_lengths(counts, 12)
    assert n.max() <= 12 and (2.0 ** -n[n > 0].astype(float)).sum() <= 1 + 1e-12
    for lengths in (n, token_store.code_lengths(np.array([0, 5])), token_store.code_lengths(np.array([3, 5]))):
        code = token_store.Code(lengths)
        used = np.flatnonzero(lengths)
        blocks = [rng.choice(used, k) for k in (0, 1, 127, 128, 129, 5000)]
        coded = [code.encode(b) for b in blocks]
        back = code.decode([c[0] for c in coded], [c[1] for c in coded], [len(b) for b in blocks])
        assert back.tolist() == np.concatenate(blocks).tolist()


def test_tokenizer_gives_the_library_s_ids():
    import random

    t = token_store.Tokenizer(tokenizer_file())
    random.seed(7)
    letters = list("abS's tTreVEllD'1²Ⅷ.,-<|>ßÀéΣİ\t\n\x1c漢字́ ")
    cases = ["".join(random.choice(letters) for _ in range(random.randint(0, 25))) for _ in range(3000)] + [chr(c) + "a" for c in range(1, 0x3000)] + ["", None]
    got = t.encode(cases)
    want = [e.ids for e in t.library.encode_batch([c or "" for c in cases], add_special_tokens=False)]
    assert [g.tolist() for g in got] == want


def test_a_tokenizer_keeps_little_for_a_piece():
    """Pieces beyond what it keeps, in a table with fewer slots, and how much it holds for each."""
    import tracemalloc

    words = [f"{a}{b}{c}é" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"]
    small = token_store.Tokenizer(tokenizer_file(), keep=300, table_bits=5)
    some = [" ".join(words[i : i + 60]) for i in range(0, 1200, 20)]
    want = [e.ids for e in small.library.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for at in range(0, len(some), 4) for x in small.encode(some[at : at + 4])] == want
    t = token_store.Tokenizer(tokenizer_file())
    t.encode(["a"])
    tracemalloc.start()
    t.encode([" ".join(words)])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 50 * len(words)


def test_documents_are_coded_at_once_as_one_by_one():
    rng = np.random.default_rng(3)
    code = token_store.Code(token_store.code_lengths(rng.integers(1, 5000, 700)))
    docs = [rng.integers(0, 700, n) for n in (1, 2, 127, 128, 129, 1, 5000, 1)]
    got = code.encode_each(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    for d, (bits, marks) in zip(docs, got, strict=True):
        one = code.encode(d)
        assert bits == one[0] and marks.tolist() == one[1].tolist()


def _stored(spark, df, **options):
    path = token_store.write_tokens(df, token_store.fresh_path(spark), tokenizer_file(), **options)
    return token_store.read_tokens(spark, path).collect(), token_store.token_digests(spark, path).collect()


@pytest.mark.parametrize("options", [{}, {"file_ids": 5000, "block_ids": 700}])
def test_token_files_round_trip(spark, odd, documents, options):
    d = odd.select("doc_id", "text").union(documents.select("doc_id", "text").limit(40))
    library = token_store.Tokenizer(tokenizer_file()).library
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in texts(d))
    got, digests = _stored(spark, d, **options)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    by_start = sorted(got, key=lambda r: r.start)
    at, last = 0, -1
    for r in by_start:
        assert r.start == at and r.n_tokens == len(r.ids) and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    crc = {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in digests} == crc


def test_token_files_of_nothing(spark, nothing):
    assert _stored(spark, nothing) == ([], [])


def test_votes_are_those_of_all_examples():
    """A score against cosines with every example, weighted by distance, without the index."""
    rng = np.random.default_rng(8)
    terms = np.sort(rng.integers(1, 2**62, 20).astype(np.uint64))
    idf = rng.random(20) + 0.5
    rows = []
    for i in range(300):
        at = np.flatnonzero(rng.random(20) < 0.2)
        rows.append((i, int(rng.random() < (0.8 if 3 in at else 0.1)), at, rng.integers(1, 4, len(at)).astype(float)))
    model = toxicity.Model(terms, idf, rows, 7)
    some = [r for r in rows if len(r[2])]
    held = [r for i, r in enumerate(some) if i % 3]

    def dense(at, n):
        v = np.zeros(20)
        v[at] = (1 + np.log(n)) * idf[at]
        return v / np.linalg.norm(v)

    x, y = np.array([dense(r[2], r[3]) for r in held]), np.array([r[1] for r in held], float)
    prior = np.mean([r[1] for r in rows])
    for _, _, at, n in some[:60]:
        s = x @ dense(at, n)
        best = np.sort(s)[::-1][:7]
        clear = best[best > 0]
        if len(np.unique(np.round(s[s >= clear[-1] - 1e-9], 9))) != (s >= clear[-1] - 1e-9).sum():
            continue  # ties among the nearest may be any of them
        order = np.argsort(-s)[: len(clear)]
        w = 1 / (1e-3 + np.sqrt(np.maximum(0, 2 - 2 * s[order])))
        want = (w @ y[order] + 0.1 * prior) / (w.sum() + 0.1)
        assert model.vote(*model.vector(at, n))[0] == pytest.approx(want)
        assert model.score(at, n)[0] == model.score(at, n)[0] == pytest.approx(float(np.interp(want, model.steps, model.values)))


def test_equal_text_in_two_sources_and_repeated_rows_are_mixed_apart(spark):
    rows = [(1, "a b c d " * 60, "s1"), (1, "a b c d " * 60, "s2")] + [(2, "e f g h " * 50, "s3")] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(d).collect()
    assert len(plan) == len(rows) and len({(r.row, r.nth) for r in plan}) == len(rows)
    out = Counter()
    for r in mixing.mixed(d).collect():
        out[r.source] += len(SPACED.findall(r.text))
    assert out == Counter({s: sum(r.taken for r in plan if r.source == s) for s in ("s1", "s2", "s3")})


def test_quotas_of_shards_add_up(spark, documents):
    """Every source's blocks are dealt to its shards without rest, in the shares of their words."""
    small = {"shard_words": 2000, "shard_docs": 20}
    rows = mixing.mix_plan(documents, **small).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for g in by.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= 2
        assert all(r.taken <= 3 * r["size"] for r in g)
