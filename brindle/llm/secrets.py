"""Secret scan with multipart credential linking, in SQL functions alone.

Base matches come from three patterns.  Weak parts (short or undeclared values,
account identifiers, endpoints) mean nothing alone; they are linked by an interval
join inside a document: every weak candidate looks for a part of a complementary role
that meets its own span widened by ``scope`` code points on either side.  Positions are
cut in buckets no wider than the scope.  Parts are first reduced to the interval that
they span in each bucket, so the join is an equality on (document, role, bucket) with an
overlap test, makes at most one row for each bucket of a candidate, and never lists
the pairs of a scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# Kind, pattern, group whose length counts, its least length.  The hex
# pattern asks for 16 characters at once, which finds the same maximal runs.
BASE = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
]
#: Weak parts: role, pattern, group whose span is the part (the whole match's span is reported).
WEAK = [
    ("id", r"""(?<![A-Za-z0-9])(?:(?i:client_?id|access_?key(?:_?id)?|user(?:name)?|account|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+""", 0, 0),
    ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[a-z+/_=-]*+[A-Z0-9])(?=[A-Z0-9+/_=-]*+[a-z])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+", 0, 0),
    ("endpoint", r"""(?<![A-Za-z0-9])(?:(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]{2,20}))://[^\s"'<>]++""", 0, 0),
]
#: Order of kinds at equal starts.
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret"]
_SPAN = "struct<start:int,k:int,end:int>"


def _scan(values: Column) -> Column:
    """Exclusive prefix sums of a short array."""
    empty = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
    return F.aggregate(values, empty, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]


def _prefix_sums(values: Column, block: int = 128) -> Column:
    """Exclusive prefix sums in two levels, so that many matches do not cost their square."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    bases = _scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, y: x + y)))
    pairs = F.arrays_zip(blocks.alias("b"), bases.alias("s"))
    return F.flatten(F.transform(pairs, lambda p: F.transform(_scan(p["b"]), lambda v: v + p["s"])))


def _spans(text: Column, pattern: str, group: int, least: int, k: int, below: int = 1 << 30) -> Column:
    """Leftmost non-overlapping matches as spans in code points; those outside ``least <= length < below`` are dropped afterwards."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    def place(arrays: Column) -> Column:
        w, g, v = arrays["w"], arrays["g"], arrays["v"]
        lengths = F.zip_with(F.slice(g, 1, F.size(w)), w, lambda gap, m: F.length(gap) + F.length(m))
        before = _prefix_sums(lengths)
        rows = F.arrays_zip(before.alias("b"), g.alias("g"), w.alias("w"), v.alias("v"))
        kept = F.filter(rows, lambda r: r["w"].isNotNull() & (F.length(r["v"]) >= least) & (F.length(r["v"]) < below))
        return F.transform(kept, lambda r: F.struct((r["b"] + F.length(r["g"])).alias("start"), F.lit(k).alias("k"), (r["b"] + F.length(r["g"]) + F.length(r["w"])).alias("end")))

    # Held in a one-element array, so that each regular expression runs once a text.
    held = F.transform(F.array(F.struct(whole.alias("w"), gaps.alias("g"), value.alias("v"))), place)[0]
    return F.when(text.rlike(pattern), held).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, scope: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base matches and linked weak candidates of every text.

    Returns one row per input row: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_linked.  A weak part is reported if a complement is at most ``scope`` code
    points away; parts may overlap (gap 0).  A null text counts as empty, with no spans.  Repeated rows get
    equal results; a null id is carried along.  An empty table gives no rows; columns
    besides the two named are not read.
    """
    text = F.col("text")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = base.select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        F.length("text").alias("n"),
        *[_spans(text, p, g, least, k).alias(kind) for k, (kind, p, g, least) in enumerate(BASE)],
        *[_spans(text, p, g, least, k).alias(f"weak_{role}") for k, (role, p, g, least) in enumerate(WEAK)],
        _spans(text, *BASE[0][1:3], 1, 1, BASE[0][3]).alias("short"),
    )
    # Assigned values too short for the base are weak secrets; the pattern is the base's, so the two never overlap.
    found = found.withColumn("weak_secret", F.concat("weak_secret", "short")).drop("short")
    found = stage(found, "secrets-found")
    linked = _link(found, scope)
    on = found["doc_id"].eqNullSafe(linked["l_doc_id"]) & (found["h"] == linked["l_h"]) & (found["n"] == linked["l_n"])
    both = found.join(linked, on, "left").withColumn("base", F.concat("assign", "access", "hex"))
    every = F.concat("base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>")))
    return both.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(every).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_linked"),
    )


def _link(found: DataFrame, scope: int) -> DataFrame:
    """Weak candidates that have a complement within ``scope``, gathered per text."""
    roles = {"id": F.concat("access", "weak_id"), "secret": F.concat("assign", "hex", "weak_secret"), "endpoint": F.col("weak_endpoint")}

    def tagged(role: str) -> Column:
        return F.transform(roles[role], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(role).alias("role"), F.array_contains(F.col(f"weak_{role}"), s).alias("weak")))

    several = sum((F.size(r) > 0).cast("int") for r in roles.values()) > 1
    some_weak = F.size("weak_id") + F.size("weak_secret") > 0
    key = ["doc_id", "h", "n"]
    parts = found.where(several & some_weak).select(*key, F.explode(F.concat(*map(tagged, roles))).alias("p")).select(*key, "p.*")
    # A bucket is no wider than the scope, so a widened span ends in another bucket than it
    # begins in.  Then the interval that all parts of a bucket span together meets the
    # widened span if and only if one of the parts does.
    width = max(1, scope)

    def buckets(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))

    # An identifier or an endpoint complements a secret, a secret an identifier.
    serves = F.when(F.col("role") == "secret", "id").otherwise("secret")
    offers = parts.select(*[F.col(c).alias(f"o_{c}") for c in key], serves.alias("serves"), "start", "end", buckets(F.col("start"), F.col("end")).alias("o_bucket"))
    offers = offers.groupBy(*[f"o_{c}" for c in key], "serves", "o_bucket").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = parts.where(F.col("weak") & (F.col("role") != "endpoint")).select(*key, "role", "start", "end").distinct()
    wide = weak.withColumn("bucket", buckets(F.col("start") - scope, F.col("end") + scope))
    same = wide["doc_id"].eqNullSafe(offers["o_doc_id"]) & (wide["h"] == offers["o_h"]) & (wide["n"] == offers["o_n"])
    meets = same & (wide["role"] == offers["serves"]) & (wide["bucket"] == offers["o_bucket"]) & (F.col("first") <= F.col("end") + scope) & (F.col("last") >= F.col("start") - scope)
    hits = wide.join(offers.hint("merge"), meets, "left_semi").select(*key, "role", "start", "end").distinct()
    span = F.struct(F.col("start"), F.when(F.col("role") == "id", 3).otherwise(4).alias("k"), F.col("end"))
    out = hits.groupBy(*key).agg(F.collect_list(span).cast(f"array<{_SPAN}>").alias("more"))
    return out.select(*[F.col(c).alias(f"l_{c}") for c in key], "more")
