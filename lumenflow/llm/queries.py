"""Registry of the training-data queries and of the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import decontaminate, divergence, exact_dedup, language, mixing, near_dedup, pii, quality, secret_scan, suffix_dedup, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_register("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).drop("source")


@_register(
    "op10_decontamination",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dn AS (SELECT r, doc_id, w, coalesce(len(w), 0) AS n FROM d),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, len(w) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(n, 10) AS k, array_to_string(w[i : i + least(n, 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, n, unnest(generate_series(1, greatest(1, n - 9))) AS i FROM bn)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT r, w, k, unnest(generate_series(1, n - k + 1)) AS i FROM dn, ks WHERE n >= k)),
h AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hits AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT dn.doc_id, CAST(dn.n AS BIGINT) AS n_words, CAST(coalesce(hits.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(hits.n_hit, 0) > 0 AS contaminated
FROM dn LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
""",
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), _docs(spark, sf_dir, "benchmark")).drop("h")


@_register(
    "op8_near_dedup",
    r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT row, doc_id, array_to_string(w[i : i + 1], ' ') AS g
      FROM (SELECT row, doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
inter AS (SELECT a.row AS x, b.row AS y, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT DISTINCT a, b FROM inter JOIN n x ON x.row = inter.x JOIN n y ON y.row = inter.y WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT id, min(root) AS component FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.component, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(c.component, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (row) LEFT JOIN c ON c.id = d.doc_id
""",
)
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir), shingle=2).drop("class_id")


@_register(
    "op9_topk",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
)
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_docs(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_register("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_docs(spark, sf_dir))


def _fold(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


@_register("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    field = language.train(docs, _fold(3) != 1)
    return language.identify(docs, field).select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "known")


@_register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = toxicity.train(docs, _docs(spark, sf_dir, "labels"), _fold(4) != 2)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality.classify(docs, quality.train(docs))


@_register(
    "op6_suffix_dedup",
    """
WITH rows AS (SELECT doc_id, md5(coalesce(text, '')) AS k, coalesce(hex(encode(text)), '') AS x, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
h AS (SELECT DISTINCT * FROM rows),
w AS (SELECT doc_id, k, s, md5_number(substr(x, 2 * s + 1, 200)) AS m
      FROM (SELECT doc_id, k, x, unnest(range(0, n - 99)) AS s FROM h WHERE n >= 100 AND doc_id IS NOT NULL)),
d AS (SELECT doc_id, k, s FROM (SELECT doc_id, k, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, k, s) AS r FROM w) WHERE r > 1),
b AS (SELECT doc_id, k, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id, k ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM d),
g AS (SELECT doc_id, k, s, sum(new) OVER (PARTITION BY doc_id, k ORDER BY s) AS g FROM b),
i AS (SELECT doc_id, k, g, min(s) AS a, max(s) + 100 AS z FROM g GROUP BY 1, 2, 3),
j AS (SELECT doc_id, k, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id, k ORDER BY a), 0) AS p FROM i),
t AS (SELECT doc_id, k, sum(z - a) AS n_removed, count(*) AS n_spans,
             string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept
      FROM j JOIN h USING (doc_id, k) GROUP BY 1, 2)
SELECT r.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM rows r LEFT JOIN t USING (doc_id, k)
""",
)
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_docs(spark, sf_dir)).drop("kept")


@_register("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(_docs(spark, sf_dir))


@_register(
    "op11_exact_dedup",
    r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t
""",
)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.unhex(exact_dedup.digest(F.col("text"))).alias("digest")
    rows = exact_dedup.classes(_docs(spark, sf_dir), [F.col("doc_id"), digest])
    return rows.select("row_.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("row_.digest")).alias("text_sha256"))


@_register(
    "op12_source_divergence",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS m FROM x GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY 1, 2, 3),
k AS (SELECT g.lang, g.source, v.term, v.m, coalesce(c.n, 0) AS n
      FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
z AS (SELECT *, CAST(sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source) AS HUGEINT) AS own,
             CAST(sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang, source) AS HUGEINT) AS whole FROM k),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // own AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (m + 1)) // whole AS q FROM z),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir))
