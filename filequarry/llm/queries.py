"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classlm, decontaminate, gif, licenses, linededup, packing, quality, secrets, simhash, toxicity
from .common import table


def byte_bpe() -> str:
    """The content of the tokenizer file that the contracts name."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), byte_bpe())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.lm_scores(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("coverage", 6).alias("coverage"), "words", "start", "end")


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "end", "edits", "shared")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["s"], r["e"])), ",")
    return out.select("doc_id", F.size("runs").alias("n_runs"), told.alias("runs"), F.length("text").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "severity", "grade", "p_toxic", "toxic")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_simhash": op2_simhash,
        "op3_lm": op3_lm,
        "op4_licenses": op4_licenses,
        "op5_gif": op5_gif,
        "op6_decontaminate": op6_decontaminate,
        "op7_secrets": op7_secrets,
        "op8_quality": op8_quality,
        "op9_linededup": op9_linededup,
        "op10_toxicity": op10_toxicity,
    }


def secrets_sql() -> str:
    """DuckDB SQL for op7_secrets: matches by splitting at them, places by running sums, links by EXISTS."""
    q = lambda x: x.replace("'", "''")
    # (?i) would also fold letters beyond ASCII there
    case = lambda x: re.sub(r"\\x..|\\.|\[[^]]*\]|[A-Za-z]", lambda m: f"[{m[0].lower()}{m[0].upper()}]" if m[0].isalpha() else m[0], x[4:]) if x.startswith("(?i)") else x
    # this dialect has no look-around: the runs that key40 may be are taken whole and then judged
    patterns = secrets.KINDS | {"key40": "[A-Za-z0-9+/=]+"}
    tests = {
        "assign": f"length(own) >= {secrets.LEAST_ASSIGNED}",
        "key40": "regexp_full_match(own, '[A-Za-z0-9+/]{40}') and regexp_matches(own, '[0-9]') and regexp_matches(own, '[a-z]') and regexp_matches(own, '[A-Z]')",
    }
    scans = " union all ".join(
        f"select doc_id, '{k}' as kind, {n} as o, string_split_regex(t, '{q(case(p))}') as gaps, regexp_extract_all(t, '{q(case(p))}', 0) as hits, regexp_extract_all(t, '{q(case(p))}', {2 if k == 'assign' else 0}) as owns from d"
        for n, (k, p) in enumerate(patterns.items(), 1)
    )
    good = " and ".join(f"(kind <> '{k}' or ({t}))" for k, t in tests.items())
    near = f'y.doc_id = x.doc_id and y."end" >= x.start - {secrets.SCOPE} and y.start <= x."end" + {secrets.SCOPE} and (y."end" <= x.start or y.start >= x."end")'
    beside = lambda *kinds: f"exists (select 1 from s y where {near} and y.kind in ({', '.join(map(repr, kinds))}))"
    told = "coalesce(string_agg(kind || ':' || start || ':' || \"end\", ',' order by start, o){}, '')"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
scans as ({scans}),
rows as (select doc_id, kind, o, unnest(range(1, len(hits) + 1)) as i, gaps, hits, owns from scans where len(hits) > 0),
cut as (select doc_id, kind, o, i, length(gaps[i]) as gap, length(hits[i]) as size, owns[i] as own from rows),
placed as (select *, sum(gap + size) over (partition by doc_id, kind order by i) as stop from cut),
s as (select doc_id, kind, o, cast(stop - size as bigint) as start, cast(stop as bigint) as "end", o <= {len(secrets.BASE)} as base from placed where {good}),
kept as (select * from s x where base
  or (kind = 'login' and {beside("assign", "hex", "key40")})
  or (kind = 'key40' and {beside("access", "login", "endpoint")})
  or (kind = 'endpoint' and {beside("access", "login")} and {beside("assign", "hex", "key40")}))
select d.doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secrets.BASE)},
  sha256({told.format(" filter (base)")}) as base_sha256, {told.format("")} as spans
from d left join kept using (doc_id) group by d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op7_secrets": secrets_sql()}
