"""Registered queries of the document operators and, where SQL can say it, the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.llm import sql_forms
from terrashift.llm.common import table
from terrashift.llm.decontaminate import leaks
from terrashift.llm.exact_dedup import exact_groups
from terrashift.llm.language_id import identified
from terrashift.llm.mixing import mix_plan
from terrashift.llm.near_dedup import near_groups
from terrashift.llm.pii import personal_data
from terrashift.llm.quality import judged
from terrashift.llm.resample import resampled
from terrashift.llm.substring_dedup import without_repeats
from terrashift.llm.token_store import TokenSpec, token_digest
from terrashift.llm.toxicity import scored
from terrashift.llm.url_filter import judge
from terrashift.llm.variants import spelling_variants
from terrashift.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


@_query("op1_pii")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@_query(
    "op2_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest=True)


@_query("op3_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, docs, table(spark, sf_dir, "labels"))


@_query("op4_tokens")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), TokenSpec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


def _sql_level(i: int, source: str, parent: str) -> str:
    """CTEs of one level of the tree: wildcards, then groups of similar siblings; gives ``t{i + 1}`` with column ``m{i}``."""
    same = "abs(b / k - pb / pk) <= 1.96::DOUBLE * sqrt(((b + pb) / (k + pk)) * (1 - (b + pb) / (k + pk)) * (1 / k + 1 / pk))"
    return f"""
    o{i} AS (SELECT {parent}, s{i}, SUM(n) AS n, SUM(k) AS k FROM {source} GROUP BY ALL),
    x{i} AS (SELECT * EXCLUDE (n, k), CASE WHEN k = 0 AND n * 50 < SUM(n) OVER (PARTITION BY {parent}) THEN '{{*}}' ELSE s{i} END AS v{i} FROM o{i}),
    y{i} AS (SELECT z.*, v{i} FROM {source} z JOIN x{i} USING ({parent}, s{i})),
    b{i} AS (SELECT {parent}, v{i} AS v, SUM(k) AS k, SUM(b) AS b FROM y{i} GROUP BY ALL),
    p{i} AS (SELECT {parent}, k AS k0, b AS b0, COUNT(*) AS c, SUM(k)::DOUBLE AS k, SUM(b)::DOUBLE AS b, min(v) AS f FROM b{i} WHERE k > 0 GROUP BY ALL),
    l{i} AS (SELECT *, lag(k) OVER w AS pk, lag(b) OVER w AS pb FROM p{i} WINDOW w AS (PARTITION BY {parent} ORDER BY b0 / k0, k0, b0)),
    g{i} AS (SELECT *, SUM(CASE WHEN pk IS NOT NULL AND {same} THEN 0 ELSE 1 END) OVER (PARTITION BY {parent} ORDER BY b0 / k0, k0, b0 ROWS UNBOUNDED PRECEDING) AS grp FROM l{i}),
    h{i} AS (SELECT {parent}, k0, b0, CASE WHEN SUM(c) OVER (PARTITION BY {parent}, grp) > 1 THEN '*' || min(f) OVER (PARTITION BY {parent}, grp) END AS m FROM g{i}),
    m{i} AS (SELECT b{i}.* EXCLUDE (k, b), coalesce(m, v) AS m{i} FROM b{i} LEFT JOIN h{i} ON {" AND ".join(f"b{i}.{c} = h{i}.{c}" for c in parent.split(", "))} AND b{i}.k = h{i}.k0 AND b{i}.b = h{i}.b0),
    t{i + 1} AS (SELECT y{i}.*, m{i}.m{i} FROM y{i} JOIN m{i} ON {" AND ".join(f"y{i}.{c} = m{i}.{c}" for c in parent.split(", "))} AND y{i}.v{i} = m{i}.v)"""


@_query(
    "op5_url_filter",
    f"""
    WITH u AS (
      SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    r AS (
      SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
          WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
          WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
          WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
          WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
        [CASE WHEN regexp_matches(x, '[0-9]') THEN '{{n}}' ELSE x END for x in string_split(path, '/') if x <> ''] AS seg FROM u),
    g AS (
      SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given,
        coalesce(seg[1], '') AS s0, coalesce(seg[2], '') AS s1, CASE WHEN len(seg) > 2 THEN '/..' ELSE '' END AS deep FROM r),
    t AS (SELECT host, s0, s1, deep, COUNT(*) AS n, COUNT(given) AS k, COUNT(*) FILTER (given = 'block') AS b FROM g GROUP BY ALL),{_sql_level(0, "t", "host")},{_sql_level(1, "t1", "host, m0")},
    p AS (
      SELECT host, m0, m1, deep, SUM(k) AS k, coalesce((SUM(b) + 2 * (SELECT SUM(b) / SUM(k) FROM t)) / (SUM(k) + 2), 0) AS purity FROM t2 GROUP BY ALL)
    SELECT g.page_id, g.host, g.path, g.rule, coalesce(g.given, CASE WHEN p.k > 0 AND p.purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict,
      g.host || '/' || p.m0 || '/' || p.m1 || p.deep AS template, round(p.purity, 9) AS purity
    FROM g JOIN t2 USING (host, s0, s1, deep) JOIN p ON p.host = t2.host AND p.m0 = t2.m0 AND p.m1 = t2.m1 AND p.deep = t2.deep
    """,
)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumn("purity", F.round("purity", 9))


@_query("op6_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op7_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


@_query("op8_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op9_mix")
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


@_query("op10_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


@_query("op11_substrings", sql_forms.SUBSTRINGS)
def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), texts=False)


@_query("op12_resample", sql_forms.RESAMPLE)
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op13_variants", sql_forms.VARIANTS)
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
