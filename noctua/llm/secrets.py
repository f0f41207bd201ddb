"""Secret scanning with multipart credential linking, in DataFrame functions only.

Strong spans are reported as they stand.  Weak parts (identifiers, random-looking strings, endpoints) are reported only
where complementary parts stand near each other in one scope, found by an interval join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctua.llm.common import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: names given to a principal, long mixed strings, and places to connect to.
WEAK_ID = r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|app_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{28,}={0,2}"
ENDPOINT = r"""(?i)\b[a-z][a-z0-9+]{1,11}://[A-Za-z0-9.-]+(?::[0-9]+)?|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}"""
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as {start, end, value}, in code points: what stands between the matches, and
    the matches, are as long as the text together, so running sums of their lengths give the places."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("value"))
    walk = F.aggregate(
        both, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("got")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
            F.concat(a["got"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("start"), (a["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("got"),
        ),
    )["got"]
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(SPAN))


def _tag(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """For each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Strong spans: assignments with a value of 6 or more characters, access ids of 20 or more, hex runs of 24 or more.
    Weak spans are added when linked: an identifier with a secret, a secret with an identifier, and an endpoint with
    both, at most `reach` characters apart and with no blank line between them; strong access ids count as identifiers,
    strong assignments and hex runs as secrets.  A null text is an empty one; repeated rows give repeated results.
    Spans count code points, end exclusive, and are written kind:start:end by start, kind and end.

    Parts meet by document and by stretch of `reach` characters, so a document with very many parts is split into many
    keys, each of which holds no more parts than fit in its stretch.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    length = lambda s: s["end"] - s["start"]
    base = docs.select("doc_id", F.xxhash64("doc_id", text).alias("_key"), text.alias("_text")).select(
        "doc_id", "_key", "_text",
        F.filter(spans(F.col("_text"), ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6).alias("assign"),
        F.filter(spans(F.col("_text"), ACCESS), lambda s: length(s) >= 20).alias("access"),
        spans(F.col("_text"), HEX).alias("hex"), spans(F.col("_text"), WEAK_ID).alias("weak_id"),
        spans(F.col("_text"), WEAK_SECRET).alias("weak_secret"), spans(F.col("_text"), ENDPOINT).alias("endpoint"),
    )
    strong = F.concat(*[_tag(F.col(k), k) for k in KINDS[:3]])
    secret, who = F.size("assign") + F.size("hex") + F.size("weak_secret") > 0, F.size("access") + F.size("weak_id") > 0
    every = F.concat(*[_tag(F.col(k), k) for k in KINDS])
    breaks = spans(F.col("_text"), r"\n[\x20\t\r]*\n")
    table = written(
        base.select(
            "doc_id", "_key", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], strong.alias("strong"),
            F.when(secret & who, every).alias("parts"), F.when(secret & who, F.transform(breaks, lambda b: b["start"])).alias("breaks"),
        ), "secrets",
    )
    parts = table.where("parts is not null").dropDuplicates(["_key"]).select("_key", "breaks", F.explode("parts").alias("p")).select(
        "_key", "p.*", F.size(F.filter("breaks", lambda b: b < F.col("p.start"))).alias("scope")
    )
    role = F.when(F.col("kind").isin(1, 3), "id").when(F.col("kind").isin(0, 2, 4), "secret").otherwise("endpoint")
    parts = parts.withColumn("role", role)
    left = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))))
    near = F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))
    right = parts.select("_key", "scope", F.col("role").alias("other"), F.col("start").alias("from"), F.col("end").alias("to"), F.explode(near).alias("cell"))
    met = (
        left.join(right, ["_key", "scope", "cell"])
        .where((F.col("role") != F.col("other")) & (F.col("from") <= F.col("end") + reach) & (F.col("to") >= F.col("start") - reach))
        .groupBy("_key", "start", "kind", "end", "role").agg(F.max((F.col("other") == "id").cast("int")).alias("has_id"), F.max((F.col("other") == "secret").cast("int")).alias("has_secret"))
        .where("kind >= 3 and ((role = 'id' and has_secret = 1) or (role = 'secret' and has_id = 1) or (role = 'endpoint' and has_id = 1 and has_secret = 1))")
        .groupBy("_key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = table.drop("parts", "breaks").join(met, "_key", "left").withColumn("linked", F.coalesce("linked", none))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("strong")), 256).alias("base_sha256"),
        _joined(F.concat("strong", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"),
    )
