"""Queries on tabular signals: threshold search, overlap, ranking and path measures over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.operators import metrics, paths, search, voxel
from lumenflow.plans.catalog import query
from lumenflow.session import table


def _band_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as voxels: intensity l_partkey mod 97, truth a band of it with a quantity over 5, samples by return flag."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sample"), F.pmod("l_partkey", F.lit(97)).cast("int").alias("hu"),
        (F.pmod("l_partkey", F.lit(97)).between(20, 60) & (F.col("l_quantity") > 5)).alias("gt"),
    )


_BAND_CTE = """
v AS (SELECT l_returnflag AS sample, CAST(l_partkey % 97 AS INT) AS hu, (l_partkey % 97 BETWEEN 20 AND 60 AND l_quantity > 5) AS gt FROM lineitem),
h AS (SELECT sample, least(CAST(floor(hu / (97.0 / 60)) AS INT), 59) AS bin, count(*) AS n, count(*) FILTER (WHERE gt) AS g FROM v GROUP BY 1, 2),
t AS (SELECT sample, count(*) FILTER (WHERE gt) AS truth FROM v GROUP BY 1),
e AS (SELECT sample, edge FROM t, range(61) r(edge)),
c AS (SELECT e.sample, e.edge, coalesce(sum(h.n), 0) AS cn, coalesce(sum(h.g), 0) AS cg FROM e LEFT JOIN h ON h.sample = e.sample AND h.bin < e.edge GROUP BY 1, 2),
d AS (SELECT a.edge AS lo, b.edge AS hi, avg(2.0 * CAST(b.cg - a.cg AS DOUBLE) / (CAST(b.cn - a.cn + t.truth AS DOUBLE) + 1e-8)) AS mean_dice
      FROM c a JOIN c b ON a.sample = b.sample AND b.edge > a.edge JOIN t ON t.sample = a.sample GROUP BY 1, 2)
"""


@query("band_threshold_search", f"WITH {_BAND_CTE} SELECT CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, round(mean_dice, 6) AS mean_dice FROM d ORDER BY mean_dice DESC, lo, hi LIMIT 1")
def band_threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    scores = search.band_search(spark, _band_rows(spark, sf), ["sample"], "hu", "gt", 0, 97, 60)
    return search.best(scores, "mean_dice", "lo", "hi").select("lo", "hi", F.round("mean_dice", 6).alias("mean_dice"))


@query("band_scores_all", f"WITH {_BAND_CTE} SELECT CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, round(mean_dice, 6) AS mean_dice FROM d")
def band_scores_all(spark: SparkSession, sf: str) -> DataFrame:
    return search.band_search(spark, _band_rows(spark, sf), ["sample"], "hu", "gt", 0, 97, 60).withColumn("mean_dice", F.round("mean_dice", 6))


@query(
    "band_sensitivity",
    f"WITH {_BAND_CTE} SELECT 'lo' AS side, CAST(lo AS INT) AS edge, round(mean_dice, 6) AS mean_dice FROM d WHERE hi = 36 UNION ALL SELECT 'hi', CAST(hi AS INT), round(mean_dice, 6) FROM d WHERE lo = 11",
)
def band_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """One end of the band moves, the other stays."""
    v = _band_rows(spark, sf)
    hist = search.histogram(v, ["sample"], "hu", 0, 97, 60, "gt")
    cum = search.dense_cumulative(spark, hist, ["sample"], 60)
    total = v.groupBy("sample").agg(F.sum(F.col("gt").cast("int")).cast("long").alias("truth"))
    lows = spark.range(36).select(F.col("id").cast("int").alias("lo"), F.lit(36).alias("hi"))
    highs = spark.range(12, 61).select(F.lit(11).alias("lo"), F.col("id").cast("int").alias("hi"))
    low = search.band_scores(cum, total, ["sample"], lows).select(F.lit("lo").alias("side"), F.col("lo").alias("edge"), "mean_dice")
    high = search.band_scores(cum, total, ["sample"], highs).select(F.lit("hi").alias("side"), F.col("hi").alias("edge"), "mean_dice")
    return low.unionByName(high).withColumn("mean_dice", F.round("mean_dice", 6))


@query("histogram_cumsum", f"WITH {_BAND_CTE} SELECT sample, CAST(bin AS INT) AS bin, CAST(sum(n) OVER w AS BIGINT) AS cn, CAST(sum(g) OVER w AS BIGINT) AS cg FROM h WINDOW w AS (PARTITION BY sample ORDER BY bin ROWS UNBOUNDED PRECEDING)")
def histogram_cumsum(spark: SparkSession, sf: str) -> DataFrame:
    return search.cumulative(search.histogram(_band_rows(spark, sf), ["sample"], "hu", 0, 97, 60, "gt"), ["sample"], ["n", "g"])


_SWEEP = """
WITH v AS (SELECT l_returnflag AS sample, CAST(round(l_discount * 100) AS INT) AS level, l_quantity > 25 AS gt FROM lineitem),
t AS (SELECT sample, count(*) FILTER (WHERE gt) AS t FROM v GROUP BY 1),
d AS (SELECT t.sample, s.threshold, 2.0 * count(*) FILTER (WHERE v.gt AND v.level >= s.threshold) / (count(*) FILTER (WHERE v.level >= s.threshold) + any_value(t.t) + 1e-8) AS dice
      FROM t JOIN v USING (sample), range(1, 10) s(threshold) GROUP BY 1, 2)
"""


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sample"), F.round(F.col("l_discount") * 100).cast("int").alias("v"), (F.col("l_quantity") > 25).alias("gt")
    )
    return search.threshold_sweep(v, ["sample"], F.col("v"), "gt", list(range(1, 10)))


@query("threshold_sweep_dice", _SWEEP + "SELECT sample, CAST(threshold AS INT) AS threshold, round(dice, 6) AS dice FROM d")
def threshold_sweep_dice(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf).withColumn("dice", F.round("dice", 6))


@query("threshold_best", _SWEEP + "SELECT CAST(threshold AS INT) AS threshold, round(avg(dice), 6) AS mean_dice FROM d GROUP BY 1 ORDER BY mean_dice DESC, threshold LIMIT 1")
def threshold_best(spark: SparkSession, sf: str) -> DataFrame:
    mean = _sweep(spark, sf).groupBy("threshold").agg(F.round(F.avg("dice"), 6).alias("mean_dice"))
    return search.best(mean, "mean_dice", "threshold")


@query("hard_dice_by_group", "SELECT l_returnflag, l_linestatus, round(2.0 * count(*) FILTER (WHERE l_quantity > 20 AND l_tax > 0.03) / (count(*) FILTER (WHERE l_quantity > 20) + count(*) FILTER (WHERE l_tax > 0.03) + 1e-8), 6) AS dice FROM lineitem GROUP BY 1, 2")
def hard_dice_by_group(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem")
    return metrics.hard_dice(v, ["l_returnflag", "l_linestatus"], F.col("l_quantity") > 20, F.col("l_tax") > 0.03).withColumn("dice", F.round("dice", 6))


@query("soft_dice_by_group", "SELECT l_returnflag, l_linestatus, round((2 * sum(l_discount * 10 * CAST(l_quantity > 20 AS DOUBLE)) + 1e-5) / (sum(l_discount * 10) + count(*) FILTER (WHERE l_quantity > 20) + 1e-5), 6) AS soft_dice FROM lineitem GROUP BY 1, 2")
def soft_dice_by_group(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem")
    return metrics.soft_dice(v, ["l_returnflag", "l_linestatus"], F.col("l_discount") * 10, F.col("l_quantity") > 20).withColumn("soft_dice", F.round("soft_dice", 6))


@query(
    "auc_rank",
    """WITH v AS (SELECT d.lang, d.n_chars, l.quality FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM v)
SELECT lang, round((sum(CASE WHEN quality = 1 THEN r ELSE 0 END) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM r GROUP BY lang""",
)
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return metrics.auc(v, ["lang"], "n_chars", "quality").select("lang", F.round("auc", 6).alias("auc"))


@query("minmax_normalise", "SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE value END, 6) AS norm FROM events WINDOW w AS (PARTITION BY user_id)")
def minmax_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return voxel.minmax(table(spark, sf, "events"), ["user_id"], "value").select("event_id", F.round("norm", 6).alias("norm"))


@query("percentile_bounds", "SELECT event_type, round(quantile_cont(value, 0.02), 6) AS p02, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.98), 6) AS p98 FROM events GROUP BY 1")
def percentile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    p = metrics.percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p02": 0.02, "p50": 0.5, "p98": 0.98})
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p02", "p50", "p98")])


@query("sample_summary", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS low, max(l_quantity) AS high, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def sample_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.summary(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return s.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high", F.round("total", 2).alias("total"))


@query("argmax_total_order", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def argmax_total_order(spark: SparkSession, sf: str) -> DataFrame:
    """Best row of each group, the first index of equal ones: an aggregate over a struct instead of a sort."""
    v = table(spark, sf, "customer")
    top = F.max_by(F.struct("c_custkey", "c_acctbal"), F.struct("c_acctbal", -F.col("c_custkey")))
    return v.groupBy("c_nationkey").agg(top.alias("t")).select("c_nationkey", "t.*")


@query("unique_labels", "SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem")
def unique_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag").distinct()


@query("volume_by_label", "SELECT l_returnflag AS label, count(*) * 0.5 / 1000 AS cm3 FROM lineitem GROUP BY 1")
def volume_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Voxel counts as volumes, at 0.5 mm3 a voxel."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg((F.count("*") * F.lit(0.5) / 1000).alias("cm3"))


@query(
    "path_length",
    """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
s AS (SELECT user_id, pos, sqrt(1 + power(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos), 2)) AS d FROM p)
SELECT user_id, count(*) AS points, round(greatest(coalesce(sum(d), 0), 1e-3), 6) AS length FROM s GROUP BY 1""",
)
def path_length(spark: SparkSession, sf: str) -> DataFrame:
    p = _paths(spark, sf)
    return paths.lengths(p, ["user_id"], "pos", ["pos", "value"]).select("user_id", "points", F.round("length", 6).alias("length"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "value", F.row_number().over(w).alias("pos"))


@query(
    "path_interpolate",
    """WITH p AS (SELECT user_id, event_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER w AS a,
last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(a + (b - a) * pos / greatest(1, n - 1) + 1e-9, 6) AS pressure FROM p""",
)
def path_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf, "events").select("user_id", "event_id", "value", (F.row_number().over(w) - 1).alias("pos"))
    ends = p.groupBy("user_id").agg(F.min_by("value", "pos").alias("p_a"), F.max_by("value", "pos").alias("p_b"), F.count("*").alias("n"))
    return paths.interpolate(p.join(ends, "user_id"), "pos", "n", "p_a", "p_b").select("event_id", F.round(F.col("value_at") + 1e-9, 6).alias("pressure"))


@query("csr_pointers", "WITH l AS (SELECT user_id, count(*) AS len FROM events GROUP BY 1) SELECT user_id, len, CAST(sum(len) OVER (ORDER BY user_id) - len AS BIGINT) AS start FROM l")
def csr_pointers(spark: SparkSession, sf: str) -> DataFrame:
    return paths.pointers(table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("len")), "user_id", "len")


@query(
    "step_straightness",
    """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
d AS (SELECT user_id, pos, 1.0 AS dx, value - lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS dy FROM p),
u AS (SELECT user_id, pos, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM d WHERE dy IS NOT NULL),
c AS (SELECT user_id, ux * lag(ux) OVER w + uy * lag(uy) OVER w AS c FROM u WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, round(coalesce(avg(c), 1), 6) AS straightness FROM c GROUP BY 1""",
)
def step_straightness(spark: SparkSession, sf: str) -> DataFrame:
    s = paths.straightness(_paths(spark, sf), ["user_id"], "pos", ["pos", "value"])
    return s.select("user_id", F.round("straightness", 6).alias("straightness"))


@query(
    "cohort_summary",
    """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'MEAN' ELSE l_returnflag END AS id, round(avg(l_quantity), 6) AS dsc,
count(*) FILTER (WHERE l_tax >= 0.06) AS n_auto, count(*) FILTER (WHERE l_tax >= 0.03 AND l_tax < 0.06) AS n_review, count(*) FILTER (WHERE l_tax < 0.03) AS n_reject
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""",
)
def cohort_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").withColumn("action", voxel.tri_state(F.col("l_tax"), 0.06, 0.03))
    n = lambda a: F.count_if(F.col("action") == a)
    out = v.groupingSets([["l_returnflag"], []], "l_returnflag").agg(
        F.grouping("l_returnflag").alias("g"), F.round(F.avg("l_quantity"), 6).alias("dsc"), n("accepted").alias("n_auto"), n("flagged").alias("n_review"),
        n("rejected").alias("n_reject"),
    )
    return out.select(F.when(F.col("g") == 1, "MEAN").otherwise(F.col("l_returnflag")).alias("id"), "dsc", "n_auto", "n_review", "n_reject")


@query("confidence_tri_state", "SELECT CASE WHEN l_discount >= 0.07 THEN 'accepted' WHEN l_discount >= 0.03 THEN 'flagged' ELSE 'rejected' END AS action, count(*) AS n FROM lineitem GROUP BY 1")
def confidence_tri_state(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(voxel.tri_state(F.col("l_discount"), 0.07, 0.03).alias("action")).agg(F.count("*").alias("n"))


@query("manifest_skip_done", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def manifest_skip_done(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs whose output isn't there yet."""
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@query("top_ranked", "SELECT CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rank, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_ranked(spark: SparkSession, sf: str) -> DataFrame:
    top = table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)
    # 25 rows: the rank needs no further shuffle of the table
    return top.select(F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"), "c_custkey", "c_acctbal")


@query("loss_dice_bce", "SELECT l_returnflag, round(0.7 * (1 - (2 * sum(p * y) + 1e-5) / (sum(p) + sum(y) + 1e-5)) + 0.3 * avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS loss FROM (SELECT l_returnflag, l_discount * 10 AS p, greatest(least(l_discount * 10, 1 - 1e-7), 1e-7) AS q, CAST(l_quantity > 25 AS DOUBLE) AS y FROM lineitem) GROUP BY 1")
def loss_dice_bce(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("p"), (F.col("l_quantity") > 25).alias("y"))
    return metrics.dice_bce_loss(v, ["l_returnflag"], "p", "y").select("l_returnflag", F.round("loss", 6).alias("loss"))


@query("soft_gate", "SELECT event_id, round(1 / (1 + exp(-10 * (value - 50) / 100.0)), 6) AS gate FROM events")
def soft_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(metrics.soft_gate(F.col("value"), 50, 0.1), 6).alias("gate"))


@query(
    "flow_accumulate",
    """WITH leaf AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS flow FROM customer),
n AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, CAST(coalesce((SELECT sum(flow) FROM leaf WHERE parent = 'n' || n_nationkey), 0) AS BIGINT) AS flow FROM nation),
r AS (SELECT 'r' || r_regionkey AS id, 'root' AS parent, CAST(coalesce((SELECT sum(flow) FROM n WHERE parent = 'r' || r_regionkey), 0) AS BIGINT) AS flow FROM region)
SELECT id, flow FROM leaf UNION ALL SELECT id, flow FROM n UNION ALL SELECT id, flow FROM r UNION ALL SELECT 'root', CAST(sum(flow) AS BIGINT) FROM r""",
)
def flow_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    from lumenflow.operators import graph

    t = lambda n: table(spark, sf, n)
    own = t("orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg(F.count("*").alias("own"))
    tree = (
        t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
        .union(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
        .union(t("region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root")))
        .union(spark.createDataFrame([("root", None)], "id string, parent string"))
    )
    return graph.accumulate(tree, own).select("id", F.col("total").alias("flow"))
