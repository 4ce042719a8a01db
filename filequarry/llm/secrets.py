"""Secret scans by linking the parts of a credential, in DataFrame functions only.

Three kinds are reported wherever they stand (assign, access, hex). Three weak kinds are everyday text by themselves:
``login`` (a named user or client), ``key40`` (forty characters of base-64 that hold a digit and letters of both cases)
and ``endpoint`` (a URL with a scheme that takes credentials). An interval join within scopes, stretches of SCOPE
characters, reports these only beside what completes them: a login beside a secret, a key40 beside an identifier or
endpoint, an endpoint beside both an identifier and a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_id, text_key, written

#: Patterns, in the order in which kinds of one start are listed; group 2 or the match must have the least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = "(?i)(?:password|passwd|secret|token|api_?key)"
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "login": r"""(?i)\b(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "key40": r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "endpoint": r"(?i)\b(?:https?|jdbc:[a-z]+|rediss?|amqps?|mongodb(?:\+srv)?|postgres(?:ql)?|mysql|s3)://[^\x20\x09-\x0D\"'<>]+",
}
BASE = ("assign", "access", "hex")
#: Parts this many characters apart at most belong to one credential.
SCOPE = 256
LEAST_ASSIGNED = 8


def _scan(kind: str, text: Column) -> Column:
    """Per match: the lengths of the text before it since the last match, of the match, and of its group 2 (in code points)."""
    pattern = F.lit(KINDS[kind])
    hit = F.rlike(text, F.lit(ASSIGN_HINT) if kind == "assign" else pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, KINDS[kind], -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(2 if kind == "assign" else 0)), F.length).alias("own"),
    )
    return F.when(hit, F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), x["own"].alias("own"))))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def secret_spans(docs: DataFrame) -> DataFrame:
    """(id, text_key, kind, start, end, base) of all spans found in ``docs(doc_id, text)``, in code points, end exclusive.

    Repeated rows, of the same doc_id and text, are scanned once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(row_id().alias("id"), text_key(F.col("text")).alias("text_key"), *[_scan(k, text).alias(k) for k in KINDS])
    lists = [F.when(F.size(k) > 1, F.col(k)) for k in KINDS]  # a text without a match is one part
    found = found.where(F.coalesce(*lists).isNotNull()).select("id", "text_key", *[x.alias(k) for k, x in zip(KINDS, lists, strict=True)])
    found = written(found.dropDuplicates(["id", "text_key"]), "matches")
    runs = F.explode(F.array_compact(F.array(*KINDS)))
    rows = found.select("id", "text_key", runs.alias("run")).select("id", "text_key", F.posexplode("run").alias("at", "m"))
    rows = rows.select("id", "text_key", "at", "m.kind", "m.gap", "m.size", "m.own")
    ended = F.expr("sum(gap + coalesce(size, 0)) over (partition by id, text_key, kind order by at)")
    rows = rows.withColumn("end", ended).where("size is not null").withColumn("start", F.col("end") - F.col("size"))
    good = (F.col("kind") != "assign") | (F.col("own") >= LEAST_ASSIGNED)
    spans = written(rows.where(good).select("id", "text_key", "kind", "start", "end", F.col("kind").isin(*BASE).alias("base")), "spans")
    return spans.where("base").union(_linked(spans))


def _linked(spans: DataFrame) -> DataFrame:
    """The weak spans beside their complements. A block of the join holds what reaches into SCOPE characters of one text."""
    weak = spans.where("not base").withColumn("block", F.explode(F.expr(f"sequence(greatest(start - {SCOPE}, 0) div {SCOPE}, (end + {SCOPE}) div {SCOPE})")))
    sides = spans.select("id", "text_key", "kind", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.expr(f"sequence(start div {SCOPE}, end div {SCOPE})")).alias("block"))

    def beside(left: DataFrame, *kinds: str) -> DataFrame:
        right = sides.where(F.col("kind").isin(*kinds)).drop("kind")
        near = (F.col("e") >= F.col("start") - SCOPE) & (F.col("s") <= F.col("end") + SCOPE) & ((F.col("e") <= F.col("start")) | (F.col("s") >= F.col("end")))
        on = (F.col("x.id") == F.col("y.id")) & (F.col("x.text_key") == F.col("y.text_key")) & (F.col("x.block") == F.col("y.block"))
        hit = left.alias("x").join(right.alias("y"), on & near, "left_semi")
        return hit.select("id", "text_key", "kind", "start", "end", "base").distinct()

    def blocks(kind: str) -> DataFrame:
        return weak.where(F.col("kind") == kind)

    identified = beside(blocks("endpoint"), "access", "login")
    keyed = beside(blocks("endpoint"), "assign", "hex", "key40")
    return (
        beside(blocks("login"), "assign", "hex", "key40")
        .union(beside(blocks("key40"), "access", "login", "endpoint"))
        .union(identified.intersect(keyed))
    )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, spans as an array of (start, order, end, kind, base).

    Spans are in order of start, then of kind. Null and empty texts have none. Rows with a null doc_id are scanned like
    others; repeated rows each get the same spans; other columns are not read; an empty table gives an empty result.
    """
    spans = secret_spans(docs)
    item = F.struct("start", _order(F.col("kind")).alias("order"), "end", "kind", "base")
    by_text = spans.groupBy("id", "text_key").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    rows = docs.select("doc_id", row_id().alias("id"), text_key(F.col("text")).alias("text_key"))
    none = F.array().cast(by_text.schema["spans"].dataType)
    return rows.join(by_text, ["id", "text_key"], "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
