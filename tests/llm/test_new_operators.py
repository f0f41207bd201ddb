"""Alignment of tokenizers, dropping of shared lines and the prefix trie, against plain programs over the same rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from noctua.llm import align, decontaminate, line_dedup, minhash, prefix_trie, queries, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
FILES = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")


# --- 12: lines -------------------------------------------------------------------------------------------------------------------

STRIP = " \t\n\x0b\x0c\r"


def line_key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(STRIP))


def lines_by_hand(rows, least_chars=40, least_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least_chars:
                holders[line_key(line)].add(i)
    top = {k: max((i for i in v if i is not None)) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in top or top[line_key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(4)
    common = ["Ärger mit der langen Zeile, die in vielen Texten steht", "THE SAME LONG LINE in upper and lower case letters", "x" * 40, "y" * 39]
    rows = [(i, "\n".join(rng.choice([*common, "  " + common[1].lower() + "\t\r", f"own {i}", "", " "]) for _ in range(rng.randrange(9)))) for i in range(40)]
    long = "\n".join([common[0]] * 3 + [f"a line of a very long text, number {i} of many more" for i in range(30_000)] + [common[2]])
    return [*rows, (41, None), (42, ""), (43, "\n\n"), (44, long), (45, long), (None, common[0]), (None, "\n".join(common)), (7, common[2]), (7, common[2])]


def test_lines_as_by_hand(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == lines_by_hand(rows)
    got = line_dedup.dedup_lines(docs, 2, 3).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == lines_by_hand(rows, 2, 3)


def test_lines_keep_columns_and_take_odd_tables(spark, odd, nothing):
    got = line_dedup.dedup_lines(odd.withColumnsRenamed({"key": "_own", "row": "kept_text", "bit": "_kept", "part": "_id"}))
    assert got.count() == odd.count() and {"_own", "_kept", "_id"} <= set(got.columns)
    assert {r["_own"] for r in got.select("_own").collect()} == {"k"}
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_lines_use_no_python(spark, documents):
    plan = line_dedup.dedup_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- 13: the trie ------------------------------------------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    built = {c: (lambda h: own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:])(zlib.crc32(str(c).encode()) % 6) for c, v in own.items()}
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest())
        for k, m in members.items()
    )


def trie_rows():
    rng = random.Random(2)
    said = ["", "hi", "how are you", "ünï", "漢字"]
    rows = [(c, t, rng.choice(["user", None, "bot"]), rng.choice(said)) for c in [*range(-3, 60), *range(100, 130), 250, 301, 5_000_000_000_000_000_001] for t in range(rng.randrange(8))]
    hot = [(c, t, "user", "the same") for c in range(1000, 1400) for t in range(7)]
    ties = [(400, None, "a", "b"), (400, None, "a", "b"), (400, 1, None, None), (400, 1, "z", "z"), (None, 1, "a", "b"), (401, 3, "a", None)]
    return [*rows, *hot, *ties, *((500, t, "r", f"{t % 3}") for t in range(50)), *((501, t, "r", f"{t % 3}") for t in range(30))]


@pytest.mark.parametrize("limits", [{}, {"most": 1, "most_turns": 1}, {"span": 3, "most": 2, "most_turns": 5}, {"span": 1}, {"span": 4}])
def test_trie_as_by_hand(spark, limits):
    rows = trie_rows()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = sorted(map(tuple, prefix_trie.prefix_trie(turns, **limits).collect()))
    assert got == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    turns = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(turns).count() == 0


# --- 11: alignment -----------------------------------------------------------------------------------------------------------------


def align_by_hand(texts):
    a, b = align._tokenizers(*FILES)
    groups = []
    for text in texts:
        whole = " " + (text or "")
        x, y = a.tokenizer.encode(whole, add_special_tokens=False).ids, b.model.encode(text or "")
        if not text or b"".join(a.bytes[i] for i in x) != whole.encode() or b"".join(b.bytes[i] for i in y) != whole.encode():
            groups.append([])
            continue
        ends = [np.cumsum([len(t.bytes[i]) for i in ids]).tolist() for t, ids in ((a, x), (b, y))]
        both = sorted(set(ends[0]) & set(ends[1]))
        got, last = [], 0
        for end in both:
            got.append([[i for i, e in zip(ids, es, strict=True) if last < e <= end] for ids, es in zip((x, y), ends, strict=True)])
            last = end
        groups.append(got)
    count = Counter(p for gs in groups for p in {(i, j) for x, y in gs for i in x for j in y})
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for gs in groups:
        links = [(i, j) for x, y in gs for i in x for j in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if gs else ""))
    return out


def odd_texts():
    rng = random.Random(8)
    letters = "ab  \n\t.é漢▁ 　​'<|>0７ﬁ́\r😀"
    mixed = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [None, "", " ", "  ", " a", "a ", "<|endoftext|> <s> </s> <0x41> <unk>", "\x00 \x1c x", "a" * 5000, " " * 3000, "漢字" * 400, "the cat's  dog\n\n sat  on   it", *mixed, mixed[0], mixed[0]]


def test_alignment_as_by_hand(spark, documents):
    texts = odd_texts() + [r.text for r in documents.select("text").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = align.align_tokenizers(docs, *FILES).orderBy("i").select(*align.COLUMNS).collect()
    for text, row, want in zip(texts, got, align_by_hand(texts), strict=True):
        assert tuple(row) == want, text


def test_alignment_in_parts_and_with_a_small_memory(spark, documents, monkeypatch):
    docs = spark.createDataFrame(documents.limit(80).collect(), documents.schema)
    want = align.align_tokenizers(docs, *FILES).orderBy("doc_id").select(*align.COLUMNS).collect()
    monkeypatch.setattr(align, "PART", 5000)
    assert align.align_tokenizers(docs, *FILES).orderBy("doc_id").select(*align.COLUMNS).collect() == want


def test_pieces_encode_as_whole_texts():
    known = align.Aligned(*FILES)
    for text in odd_texts():
        if text:
            s = align.Slice(known, pa.array([text]))
            whole = " " + text
            assert known.n[s.piece, 0].sum() == len(known.a.tokenizer.encode(whole, add_special_tokens=False).ids) or not s.good[0]
    known.kept = align.KEPT_BYTES + 1
    assert align.Slice(known, pa.array(["anew"])).good[0] and len(known.text) == 1


def test_odd_tables_of_alignment(spark, odd, nothing):
    got = align.align_tokenizers(odd.withColumnsRenamed({"key": "n_a", "row": "_text"}), *FILES)
    assert got.count() == odd.count() and {"_text"} <= set(got.columns)
    assert align.align_tokenizers(nothing, *FILES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3000, 40_000])
def test_perfect_hash(spark, n):
    codes = np.unique(np.random.default_rng(n).integers(0, 1 << 31, n)).astype(np.int64)
    of = align.build_hash(spark.createDataFrame([(int(c),) for c in codes], "code long"), len(codes))
    assert sorted(of.slots(codes.astype(np.uint64)).tolist()) == list(range(len(codes)))


# --- names and repeats in the pipeline's operators ---------------------------------------------------------------------------------


def test_operators_keep_columns_that_are_named_like_their_own(spark):
    names = ["_key", "_leak", "_null", "_id", "_hash", "_salt", "_copy", "_won", "_url", "_verdict"]
    kinds = f"doc_id long, text string, url string, {', '.join(f'{n} string' for n in names)}"
    rows = [(i, f"text number {i} of some more words here", f"https://a.com/{i}", *names) for i in range(6)]
    d = spark.createDataFrame(rows, kinds)
    bench = spark.createDataFrame([(1, "text number 3 of some more words here")], "item_id long, text string")
    rules = spark.createDataFrame([("com", "/", "block")], url_filter.RULES)
    for got, n in ((decontaminate.without_leaks(d, bench, rate=0.0), 5), (minhash.without_near_duplicates(d), 6)):
        assert got.columns == d.columns and got.count() == n and all(r[c] == c for r in got.collect() for c in names)
    got = url_filter.url_verdicts(d, rules).collect()
    assert all(r[c] == c for r in got for c in names) and {r.verdict for r in got} == {"block"}


def test_texts_of_one_labelled_id_count_in_any_order(spark):
    rows = [(i, f"you are a worthless idiot {i % 7}" if side else f"have a pleasant quiet day {i % 7}") for i in range(20) for side in (0, 1)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(20)], "doc_id long, toxic int")
    fits = [toxicity.fit(spark.createDataFrame(r, "doc_id long, text string").coalesce(1), labels) for r in (rows, rows[::-1])]
    asked = spark.createDataFrame([(1, "pleasant day"), (2, "worthless idiot"), (3, "")], "doc_id long, text string")
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(asked, m).collect()) for m in fits)
    assert one == two


def test_pipeline_of_no_documents(spark):
    import corpus_pipeline

    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").where("false")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == columns and docs.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == 0
