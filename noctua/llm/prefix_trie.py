"""A trie of conversations by turns, built as burst tries.

Conversations are sequences of turn ids (hashes of 128 bits of role and text).  Equal sequences are folded first.  A shard
holds containers: the suffixes below one trie head.  A container of too many suffixes or turns bursts: its head goes on
through all turns that its suffixes share, and they are dealt to containers below it by their next turn id.  What remains is
sorted and swept into nodes, a container at a time.  Figures of subtrees go from containers to all heads above them by one sum.

A conversation is cut into segments of `span` turns, each a suffix below the prefix that leads to it, so no row grows with a
conversation; segments are built from the deepest up, in as many steps as the longest conversation has segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctua.operators.stats import numbered
from noctua.session import written

#: Ids of conversations that one row of the digests' input holds at most, as a power of two.
RUN_BITS = 12
NODE = "b1 long, b2 long, h1 long, h2 long, top boolean, depth int, conv long, parent long, n long, kids long, leaves long, saved long, e1 long, e2 long"


def two_hashes(*cols: Column | str) -> tuple[Column, Column]:
    return F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv, p, id, size: the turns of every conversation by place, from 1.  size: code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    ids = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", ids.alias("id"), F.char_length(text).cast("long").alias("size"))
    return numbered(rows, ["conv"], ["turn", "id"], "p").select("conv", F.col("p").cast("long").alias("p"), "id", "size")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """conv, d, id, size: every conversation as the first h turns of conversation conv - conv % block, then its own turns
    after its first h, with h = crc32 of conv's decimal form, modulo `most`; and for each one a row of d = 0."""
    rows = turn_rows(turns)
    base = F.col("conv") - F.col("conv") % block
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    heads = rows.where((F.col("conv") % block == 0) & (F.col("p") < most)).select(F.col("conv").alias("base"), "p", "id", "size")
    has = heads.groupBy("base").agg(F.max("p").alias("has"))
    each = rows.groupBy("conv").agg(F.lit(0).cast("long").alias("d"))
    lent = each.select("conv", base.alias("base"), h.alias("h")).join(heads, "base").where(F.col("p") <= F.col("h")).select("conv", F.col("p").alias("d"), "id", "size")
    own = rows.withColumns({"base": base, "h": h}).where(F.col("p") > F.col("h")).join(has, "base", "left")
    own = own.select("conv", (F.col("p") - F.col("h") + F.least(F.col("h"), F.coalesce("has", F.lit(0)))).alias("d"), "id", "size")
    none = each.select("conv", "d", F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("size"))
    return lent.unionByName(own).unionByName(none)


def segments(rows: DataFrame, span: int) -> DataFrame:
    """conv, k, h1, h2 (the prefix before the segment), s1, s2 (with it), on (whether turns follow), ids, sizes."""
    k = F.floor((F.greatest(F.col("d"), F.lit(1)) - 1) / span).cast("long")
    turn = F.when(F.col("d") > 0, F.struct("d", "id", "size"))
    a, b = (F.coalesce(F.bit_xor(F.when(F.col("d") > 0, x)), F.lit(0).cast("long")) for x in two_hashes("d", "id"))
    cut = rows.groupBy("conv", k.alias("k")).agg(F.sort_array(F.collect_list(turn)).alias("t"), a.alias("a"), b.alias("b"))
    w = Window.partitionBy("conv").orderBy("k")
    s1, s2 = F.bit_xor("a").over(w), F.bit_xor("b").over(w)
    on = F.col("k") < F.max("k").over(Window.partitionBy("conv"))
    cut = cut.select("conv", "k", s1.bitwiseXOR(F.col("a")).alias("h1"), s2.bitwiseXOR(F.col("b")).alias("h2"), s1.alias("s1"), s2.alias("s2"), on.alias("on"), F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: x["size"]).alias("sizes"))
    return written(cut, "trie-segments")


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes (NODE) of the containers whose suffixes come sorted; a container's nodes are in memory together."""
    box, rows = None, []
    for pdf in frames:
        for row in pdf.itertuples(index=False):
            if (row.b1, row.b2) != box:
                if rows:
                    yield _container(rows)
                box, rows = (row.b1, row.b2), []
            rows.append(row)
    if rows:
        yield _container(rows)


def _container(rows: list) -> pd.DataFrame:
    head = rows[0]
    depth, up, size = [head.at], [-1], [head.sizes[head.at - 1] if head.at else 0]
    ends: list[int] = []
    line, before = [0], head.ids  # nodes of the last suffix, from the head on
    for row in rows:
        ids, at = row.ids, head.at
        most = min(len(ids), len(before), head.at + len(line) - 1)
        while at < most and ids[at] == before[at]:
            at += 1
        del line[at - head.at + 1 :]
        for d in range(at, len(ids)):
            up.append(line[-1])
            line.append(len(depth))
            depth.append(d + 1)
            size.append(row.sizes[d])
        ends.append(line[-1])
        before = ids
    m = len(depth)
    n, kids, leaves, saved, conv = [0] * m, [0] * m, [0] * m, [0] * m, [1 << 63] * m
    e1, e2 = [None] * m, [None] * m
    for row, i in zip(rows, ends, strict=True):
        n[i] += row.n
        conv[i] = min(conv[i], row.conv)
        kids[i] += row.kids
        leaves[i] += row.leaves
        saved[i] += row.saved
        if not row.on:
            e1[i], e2[i] = row.s1, row.s2
    for i in range(m - 1, -1, -1):  # children come after their parents
        leaves[i] = leaves[i] if kids[i] else 1
        saved[i] += (n[i] - 1) * size[i]
        p = up[i]
        if p >= 0:
            n[p] += n[i]
            conv[p] = min(conv[p], conv[i])
            kids[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    parent = [int(head.up) if head.up else None] + [conv[p] for p in up[1:]]
    top = [True] + [False] * (m - 1)
    whole = lambda x: pd.array(x, dtype="Int64")
    return pd.DataFrame({"b1": head.b1, "b2": head.b2, "h1": head.h1, "h2": head.h2, "top": top, "depth": depth, "conv": conv, "parent": whole(parent), "n": n, "kids": kids, "leaves": leaves, "saved": saved, "e1": whole(e1), "e2": whole(e2)})


def _burst(rows: DataFrame, most: int, most_turns: int) -> tuple[DataFrame, list[DataFrame]]:
    """The suffixes in containers that are small enough, and the heads that burst, a table for each round."""
    resting, heads = [], []
    while True:
        sizes = rows.groupBy("b1", "b2").agg(F.count("*").alias("_m"), F.sum(F.size("ids") - F.col("at")).alias("_t"), F.min("ids").alias("_lo"), F.max("ids").alias("_hi"))
        large = written(sizes.where(((F.col("_m") > most) | (F.col("_t") > most_turns)) & (F.col("_lo") != F.col("_hi"))).select("b1", "b2", "_lo", "_hi"), "trie-large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*resting, rows]), heads
        resting.append(rows.join(large, ["b1", "b2"], "left_anti"))
        differ = F.array_position(F.zip_with("_lo", "_hi", lambda a, b: ~a.eqNullSafe(b)), True)
        shared = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("_lo"), F.size("_hi"))).cast("int")
        inside = rows.join(large.select("b1", "b2", shared.alias("_d")), ["b1", "b2"])
        following = F.when(F.size("ids") > F.col("_d"), F.get("ids", F.col("_d")))
        ended = F.when(following.isNull() & ~F.col("on"), F.struct("s1", "s2"))
        head = inside.groupBy("b1", "b2").agg(
            *[F.any_value(c).alias(c) for c in ("h1", "h2", "at", "up", "path")], F.any_value("_d").alias("d"), F.any_value(F.slice("sizes", 1, F.greatest(F.col("_d"), F.lit(0)))).alias("sizes"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max(ended).alias("end"),
        )
        head = written(head, "trie-heads")
        heads.append(head)
        went = inside.join(head.select("b1", "b2", F.col("conv").alias("_up")), ["b1", "b2"])
        one, two = two_hashes("b1", "b2", following)
        low = F.col("_d") + 1
        # a suffix that ends at the head is part of it; all others go below
        went = went.where(F.size("ids") > F.col("_d")).withColumns({"path": F.concat("path", F.array(F.struct("b1", "b2"))), "at": low, "up": F.col("_up").cast("string"), "_1": one, "_2": two})
        rows = written(went.withColumns({"b1": F.col("_1"), "b2": F.col("_2")}).drop("_1", "_2", "_up", "_d"), "trie-suffixes")


def forest(rows: DataFrame, most: int = 4096, most_turns: int = 1 << 18) -> DataFrame:
    """Nodes (NODE without b1, b2) below each head h1, h2 of the suffixes: h1, h2, s1, s2, on, ids, sizes, n, conv (the smallest),
    and kids, leaves, saved of what follows the suffix.  depth counts from the head, which is the node of depth 0."""
    no_path = F.array().cast("array<struct<b1:long,b2:long>>")
    rows = rows.withColumns({"b1": F.col("h1"), "b2": F.col("h2"), "at": F.lit(0), "up": F.lit(None).cast("string"), "path": no_path})
    rows, heads = _burst(rows, most, most_turns)
    columns = ["b1", "b2", "h1", "h2", "s1", "s2", "on", "at", "up", "ids", "sizes", "n", "conv", "kids", "leaves", "saved"]
    nodes = written(rows.select(*columns).repartition("b1", "b2").sortWithinPartitions("b1", "b2", "ids").mapInPandas(sweep, NODE), "trie-nodes")
    if not heads:
        return nodes.drop("b1", "b2")
    above = reduce(DataFrame.unionByName, heads)
    paths = rows.groupBy("b1", "b2").agg(F.any_value("path").alias("path"))
    run = F.aggregate(F.slice("sizes", F.greatest(F.col("at"), F.lit(1)), F.col("d")), F.lit(0).cast("long"), lambda s, x: s + x)
    parts = nodes.where("top").join(paths, ["b1", "b2"]).select("path", "leaves", "saved")
    parts = parts.unionByName(above.select("path", F.lit(0).cast("long").alias("leaves"), ((F.col("n") - 1) * run).alias("saved")))
    parts = parts.select(F.posexplode("path").alias("i", "b"), "leaves", "saved", (F.size("path") - 1).alias("last"))
    below = parts.groupBy("b.b1", "b.b2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"), F.count_if(F.col("i") == F.col("last")).alias("kids"))
    line = above.join(below, ["b1", "b2"]).withColumn("depth", F.explode(F.sequence("at", "d")))
    size = F.when(F.col("depth") > 0, F.get("sizes", F.col("depth") - 1)).otherwise(0)
    saved = F.col("below") + F.sum((F.col("n") - 1) * size).over(Window.partitionBy("b1", "b2").orderBy(F.desc("depth")))
    end = F.col("depth") == F.col("d")
    line = line.select(
        "h1", "h2", (F.col("depth") == F.col("at")).alias("top"), "depth", "conv", F.when(F.col("depth") == F.col("at"), F.col("up").cast("long")).otherwise(F.col("conv")).alias("parent"), "n",
        F.when(end, F.col("kids")).otherwise(1).alias("kids"), "leaves", saved.alias("saved"), F.when(end, F.col("end.s1")).alias("e1"), F.when(end, F.col("end.s2")).alias("e2"),
    )
    return nodes.drop("b1", "b2").unionByName(line)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's ids, which come in runs by rising number; one key's digest is in memory."""
    key, digest = None, None
    for pdf in frames:
        out = []
        for a, b, run in zip(pdf["s1"], pdf["s2"], pdf["run"], strict=True):
            if (a, b) != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256(run.encode())
            else:
                digest.update(b"," + run.encode())
        yield pd.DataFrame(out, columns=["e1", "e2", "ends_sha256"])
    if key:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["e1", "e2", "ends_sha256"])


def prefix_trie(turns: DataFrame, span: int = 8192, most: int = 4096, most_turns: int = 1 << 18) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, turn, role, text.  Turns are ordered by turn, null first, and where turns are alike by a hash of role
    and text; a null role or text is an empty one; repeated rows are turns of their own; rows without a conv_id belong to no conversation; other columns
    do not matter.  A conversation is rebuilt as in `rebuilt`, and may end up without turns, at the root.  No conversations,
    no nodes."""
    cut = segments(rebuilt(turns), span)
    keys = ["k", "h1", "h2", "s1", "s2", "on"]
    folded = cut.groupBy(*keys).agg(F.any_value("ids").alias("ids"), F.any_value("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv").alias("conv"))
    folded = written(folded, "trie-folded")
    deepest = folded.agg(F.max("k")).first()[0] or 0
    found, below = [], None
    for k in range(deepest, -1, -1):
        rows = folded.where(F.col("k") == k)
        nothing = F.lit(0).cast("long")
        if below is None:
            rows = rows.withColumns({c: nothing for c in ("kids", "leaves", "saved")})
        else:
            rows = rows.join(below, ["s1", "s2", "on"], "left").withColumns({c: F.coalesce(c, nothing) for c in ("kids", "leaves", "saved")})
        nodes = forest(rows.drop("k"), most, most_turns)
        if k:
            heads = folded.where(F.col("k") == k - 1).groupBy(F.col("s1").alias("h1"), F.col("s2").alias("h2")).agg(F.min("conv").alias("_first"))
            first = F.when(F.col("depth") == 1, F.col("_first")).otherwise(F.col("parent"))
            nodes = nodes.join(heads, ["h1", "h2"], "left").withColumn("parent", first).drop("_first")
            tops = nodes.where("depth = 0").select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.lit(True).alias("on"), "kids", "leaves", "saved")
            below = written(tops, "trie-below")
        found.append((nodes.where("depth > 0") if k else nodes).withColumn("depth", F.col("depth") + k * span))
    nodes = reduce(DataFrame.unionByName, found)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    runs = cut.where("not on").groupBy("s1", "s2", F.shiftright("conv", RUN_BITS).alias("at")).agg(ids.alias("run"))
    ends = runs.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "at").mapInPandas(_digests, "e1 long, e2 long, ends_sha256 string")
    out = nodes.join(ends, ["e1", "e2"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
