"""The jobs as registered queries: each runs twice into a folder of its own, and gives all that is there after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import band_tuning, scan_evaluation
from jobs._common import config_of
from lumenflow.checkpoints import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_band_tuning(spark: SparkSession, sf: str) -> DataFrame:
    out, config = _folder(spark, "band_tuning"), config_of("band_tuning")
    for _ in range(2):
        rows = band_tuning.run(spark, f"{sf}/documents.parquet", f"{sf}/labels.parquet", out, config)
    return rows


def job2_scan_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    out, config = _folder(spark, "scan_evaluation"), config_of("scan_evaluation")
    for _ in range(2):
        rows = scan_evaluation.run(spark, f"{sf}/lineitem.parquet", f"{out}/output", f"{out}/checkpoint", config)
    return rows


QUERIES.update({"job1_band_tuning": job1_band_tuning, "job2_scan_evaluation": job2_scan_evaluation})

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE_SQL["job1_band_tuning"] = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS sample, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, lang, sample, len({_WORDS}) AS words, 1000 * len(list_distinct({_WORDS})) // greatest(1, len({_WORDS})) AS "distinct",
             1000 * len(regexp_extract_all(t, '[0-9]')) // greatest(1, length(t)) AS digits FROM d),
v AS (SELECT doc_id, lang, sample, 'words' AS measure, CAST(words AS BIGINT) AS value FROM m UNION ALL SELECT doc_id, lang, sample, 'distinct', "distinct" FROM m
      UNION ALL SELECT doc_id, lang, sample, 'digits', digits FROM m),
c AS (SELECT measure, sample, value, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS g FROM v JOIN labels USING (doc_id) GROUP BY 1, 2, 3),
p AS (SELECT measure, value, sum(g) AS g FROM c GROUP BY 1, 2 HAVING sum(g) > 0),
q AS (SELECT measure, value, sum(g) OVER (PARTITION BY measure ORDER BY value) AS upto, sum(g) OVER (PARTITION BY measure) AS tot FROM p),
b AS (SELECT measure, min(value) FILTER (WHERE upto * 100 >= tot) AS low, min(value) FILTER (WHERE upto * 100 >= tot * 99) AS high,
             min(value) FILTER (WHERE upto * 100 >= tot * 5) AS lo0, min(value) FILTER (WHERE upto * 100 >= tot * 95) AS hi0 FROM q GROUP BY 1),
w AS (SELECT *, greatest(1, (high - low + 64) // 64) AS width FROM b),
h AS (SELECT c.measure, sample, (value - low) // width AS bin, sum(n) AS n, sum(g) AS g FROM c JOIN w USING (measure) WHERE value BETWEEN low AND high GROUP BY 1, 2, 3),
t AS (SELECT measure, sample, CAST(sum(n) AS BIGINT) AS n, CAST(sum(g) AS BIGINT) AS truth FROM c GROUP BY 1, 2),
e AS (SELECT t.measure, t.sample, edge, any_value(t.truth) AS truth, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS cn, CAST(coalesce(sum(h.g), 0) AS BIGINT) AS cg
      FROM t CROSS JOIN range(65) r(edge) LEFT JOIN h ON h.measure = t.measure AND h.sample = t.sample AND h.bin < edge GROUP BY 1, 2, 3),
s AS (SELECT x.measure, x.edge AS lo, y.edge AS hi, sum(2000000000 * (y.cg - x.cg) // greatest(1, y.cn - x.cn + x.truth)) AS score
      FROM e x JOIN e y ON x.measure = y.measure AND x.sample = y.sample AND y.edge > x.edge GROUP BY 1, 2, 3),
k AS (SELECT measure, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY score DESC, lo, hi) AS r FROM s WHERE lo % 4 = 0 AND hi % 4 = 0) WHERE r = 1),
f AS (SELECT measure, lo, hi FROM (SELECT s.*, row_number() OVER (PARTITION BY s.measure ORDER BY score DESC, s.lo, s.hi) AS r FROM s JOIN k USING (measure)
      WHERE abs(s.lo - k.lo) <= 4 AND abs(s.hi - k.hi) <= 4) WHERE r = 1),
u AS (SELECT measure, lo0, hi0, CAST(low + lo * width AS BIGINT) AS lo, CAST(low + hi * width - 1 AS BIGINT) AS hi FROM f JOIN w USING (measure)),
y AS (SELECT c.measure, c.sample, CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(g) AS BIGINT) AS truth, u.lo, u.hi,
             coalesce(sum(g) FILTER (WHERE value BETWEEN lo0 AND hi0), 0) AS g0, coalesce(sum(n) FILTER (WHERE value BETWEEN lo0 AND hi0), 0) AS n0,
             coalesce(sum(g) FILTER (WHERE value BETWEEN u.lo AND u.hi), 0) AS g1, coalesce(sum(n) FILTER (WHERE value BETWEEN u.lo AND u.hi), 0) AS n1
      FROM c LEFT JOIN u USING (measure) GROUP BY c.measure, c.sample, u.lo, u.hi)
SELECT measure, sample, "rows", truth, lo, hi, CAST(2000000000 * g0 // greatest(1, n0 + truth) AS BIGINT) AS dice_before,
       CAST(2000000000 * g1 // greatest(1, n1 + truth) AS BIGINT) AS dice_after, 'sample' AS part, NULL AS lang, NULL AS doc_id, NULL AS value, NULL AS chosen FROM y
UNION ALL SELECT v.measure, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'document', lang, doc_id, value, coalesce(value BETWEEN lo AND hi, false) FROM v LEFT JOIN u USING (measure)
"""

ORACLE_SQL["job2_scan_evaluation"] = """
WITH v AS (SELECT concat(l_returnflag, l_linestatus) AS sample, CAST(round(l_discount * 100) AS BIGINT) AS level, l_quantity > 25 AS gt FROM lineitem),
c AS (SELECT sample, level, count(*) AS n, count(*) FILTER (WHERE gt) AS g FROM v GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER lo AS upto, sum(n) OVER own AS tot, sum(n) OVER hi AS n1, sum(g) OVER hi AS g1, sum(g) OVER own AS pos FROM c
      WINDOW own AS (PARTITION BY sample), lo AS (PARTITION BY sample ORDER BY level ROWS UNBOUNDED PRECEDING),
             hi AS (PARTITION BY sample ORDER BY level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, 2000000000 * g1 // greatest(1, n1 + pos) AS dice, (upto - n + (n + 1) / 2.0) * g AS ranks FROM w),
s AS (SELECT sample, sum(n) AS n, sum(g) AS truth, min(level) AS low, max(level) AS high, min(level) FILTER (WHERE upto * 100 >= tot * 10) AS p10,
             min(level) FILTER (WHERE upto * 100 >= tot * 50) AS median, min(level) FILTER (WHERE upto * 100 >= tot * 90) AS p90,
             first(level ORDER BY dice DESC, level) AS threshold, max(dice) AS dice, sum(ranks) AS ranks FROM d GROUP BY 1)
SELECT CAST(n AS BIGINT) AS n, CAST(truth AS BIGINT) AS truth, low, high, p10, median, p90,
       CAST(floor((ranks - truth * (truth + 1) / 2.0) / nullif(truth * (n - truth), 0) * 1000000) AS BIGINT) AS auc,
       CASE WHEN truth > 0 THEN threshold END AS threshold, CASE WHEN truth > 0 THEN CAST(dice AS BIGINT) END AS dice,
       CASE WHEN truth = 0 THEN 'no truth' WHEN truth = n THEN 'truth only' ELSE 'ok' END AS status, sample FROM s
"""
