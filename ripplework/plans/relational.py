"""Queries on numeric tables and event series: statistics, windows, reshaping, checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplework.functions import vector as V
from ripplework.operators import core as O
from ripplework.operators import sketches
from ripplework.plans.registry import query
from ripplework.session import PLACE, materialize, placed, table

_L = "(SELECT l_orderkey AS pair, l_linenumber AS layer, sum(l_extendedprice) / 1000 AS e, sum(l_quantity * (1 - l_discount)) - 25 AS a FROM lineitem GROUP BY 1, 2)"


def pair_layers(spark, d):
    """Pair x layer values with unique keys: exact e and approximate a."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("layer"))
    return x.agg((F.sum("l_extendedprice") / 1000).alias("e"), (F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))) - 25).alias("a"))


@query(f"SELECT layer, count(*) AS n, round(corr(e, a), 6) AS pearson, round(avg(CASE WHEN abs(a) > 0 AND abs(e) > 0 THEN (sign(e) = sign(a))::INT END), 6) AS signs, round(sum(e * a) / nullif(sum(a * a), 0), 6) AS slope, round(avg(abs(e - a)), 6) AS mae, round(max(abs(e - a)), 6) AS max_abs FROM {_L} GROUP BY layer")
def layer_metrics(spark, d):
    """A19, A21, X01, X04-X06."""
    e, a = F.col("e"), F.col("a")
    return pair_layers(spark, d).groupBy("layer").agg(F.count("*").alias("n"), F.round(O.safe_corr(e, a), 6).alias("pearson"), F.round(O.sign_agreement(e, a), 6).alias("signs"), F.round(O.origin_slope(a, e), 6).alias("slope"), F.round(F.avg(F.abs(e - a)), 6).alias("mae"), F.round(F.max(F.abs(e - a)), 6).alias("max_abs"))


_RANKS = f"(SELECT layer, rank() OVER (PARTITION BY layer ORDER BY e) + (count(*) OVER (PARTITION BY layer, e) - 1) / 2.0 AS x, rank() OVER (PARTITION BY layer ORDER BY a) + (count(*) OVER (PARTITION BY layer, a) - 1) / 2.0 AS y FROM (SELECT pair, layer, round(e, 3) AS e, round(a, 3) AS a FROM {_L}))"


@query(f"SELECT layer, round(corr(x, y), 6) AS spearman FROM {_RANKS} GROUP BY layer")
def spearman_layers(spark, d):
    """X02, W02."""
    x = materialize(pair_layers(spark, d).select("layer", F.round("e", 3).alias("e"), F.round("a", 3).alias("a")), "layers")
    r = O.with_average_rank(O.with_average_rank(x, "e", ("layer",), "x"), "a", ("layer",), "y")
    return r.groupBy("layer").agg(F.round(O.safe_corr(F.col("x"), F.col("y")), 6).alias("spearman"))


@query()
def correlation_pvalues(spark, d):
    """X03."""
    x = pair_layers(spark, d).groupBy("layer").agg(O.safe_corr(F.col("e"), F.col("a")).alias("r"), F.count("*").alias("n"))
    return O.t_test_p(x, "r", "n")


@query(f"SELECT pair, {', '.join(f'round(sum(e) FILTER (layer = {i}), 6) AS l{i}' for i in range(1, 8))} FROM {_L} GROUP BY pair")
def pivot_layers(spark, d):
    """P07-P09, G05."""
    p = pair_layers(spark, d).groupBy("pair").pivot("layer", list(range(1, 8))).agg(F.round(F.first("e"), 6))
    return p.select("pair", *[F.col(str(i)).alias(f"l{i}") for i in range(1, 8)])


@query(f"SELECT pair, layer, round(sum(e) OVER (PARTITION BY pair ORDER BY layer DESC ROWS UNBOUNDED PRECEDING), 6) AS cum, round(lead(e) OVER (PARTITION BY pair ORDER BY layer) - e, 6) AS step FROM {_L}")
def topdown_cumulative(spark, d):
    """W04, W09."""
    down = W.partitionBy("pair").orderBy(F.col("layer").desc()).rowsBetween(W.unboundedPreceding, 0)
    up = W.partitionBy("pair").orderBy("layer")
    return pair_layers(spark, d).select("pair", "layer", F.round(F.sum("e").over(down), 6).alias("cum"), F.round(F.lead("e").over(up) - F.col("e"), 6).alias("step"))


@query(f"SELECT pair, round(abs(sum(a)) / nullif(sum(abs(a)), 0), 6) AS cancel, sign(sum(e)) = sign(sum(a)) AS sign_ok FROM {_L} GROUP BY pair")
def cancellation(spark, d):
    """Sums of doubles add up in the order of the table, so that halves of the last digit fall as in the twin on one thread."""
    x = placed(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("layer"), "l_extendedprice", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("q"), *PLACE)
    x = x.repartition("pair").sortWithinPartitions("pair", "layer", *PLACE).groupBy("pair", "layer").agg((F.sum("l_extendedprice") / 1000).alias("e"), (F.sum("q") - 25).alias("a"), F.min(F.struct(*PLACE)).alias("first"))
    return x.sortWithinPartitions("pair", "first").groupBy("pair").agg(F.round(F.abs(F.sum("a")) / F.nullif(F.sum(F.abs("a")), F.lit(0.0)), 6).alias("cancel"), (F.signum(F.sum("e")) == F.signum(F.sum("a"))).alias("sign_ok"))


@query(f"SELECT layer, round((sqrt(count(*)) - sum(abs(a)) / sqrt(sum(a * a))) / nullif(sqrt(count(*)) - 1, 0), 6) AS hoyer, round(avg(a), 6) AS mean, round(median(a), 6) AS median, round(coalesce(stddev_samp(a), 0), 6) AS std FROM {_L} GROUP BY layer")
def hoyer_density(spark, d):
    """V29, A24."""
    a = F.col("a")
    return pair_layers(spark, d).groupBy("layer").agg(F.round(V.hoyer(F.count("*"), F.sum(F.abs(a)), F.sum(a * a)), 6).alias("hoyer"), F.round(F.avg(a), 6).alias("mean"), F.round(F.percentile(a, F.lit(0.5)), 6).alias("median"), F.round(F.coalesce(F.stddev_samp(a), F.lit(0.0)), 6).alias("std"))


@query(f"SELECT pair, layer, round(sum(abs(a)) OVER (PARTITION BY pair ORDER BY abs(a) DESC, layer ROWS UNBOUNDED PRECEDING) / nullif(sum(abs(a)) OVER (PARTITION BY pair), 0), 6) AS mass FROM {_L}")
def cumulative_mass(spark, d):
    """W03."""
    w = W.partitionBy("pair").orderBy(F.abs("a").desc(), "layer").rowsBetween(W.unboundedPreceding, 0)
    return pair_layers(spark, d).select("pair", "layer", F.round(F.sum(F.abs("a")).over(w) / F.nullif(F.sum(F.abs("a")).over(W.partitionBy("pair")), F.lit(0.0)), 6).alias("mass"))


_S = "(SELECT event_type AS series, event_id AS x, value AS y FROM events)"


def series(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("x"), F.col("value").alias("y"))


@query(f"""WITH m AS (SELECT *, median(y) OVER w AS med FROM {_S} WINDOW w AS (PARTITION BY series ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
n AS (SELECT *, median(abs(y - med)) OVER (PARTITION BY series ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mad FROM m)
SELECT series, x, round(med, 6) AS med, round(mad, 6) AS mad, mad * 1.4826 > 1e-8 AND abs(y - med) > 3 * mad * 1.4826 AS outlier FROM n""")
def rolling_mad(spark, d):
    """W05, W06."""
    return O.rolling_mad(series(spark, d), "series", "x", "y").select("series", "x", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), "outlier")


@query(f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY x) AS i FROM (SELECT series, x, CASE WHEN x % 5 <> 0 THEN y END AS y FROM {_S})),
n AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN i END) OVER (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING) AS pi, min(CASE WHEN y IS NOT NULL THEN i END) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM i)
SELECT n.series, n.x, round(coalesce(n.y, CASE WHEN ni > pi THEN p.y + (q.y - p.y) * (n.i - pi) / (ni - pi) END, p.y, q.y), 6) AS y FROM n LEFT JOIN i p ON p.series = n.series AND p.i = pi LEFT JOIN i q ON q.series = n.series AND q.i = ni""")
def interpolated(spark, d):
    """W06."""
    x = series(spark, d).withColumn("y", F.when(F.col("x") % 5 != 0, F.col("y")))
    return O.interpolate(x, "series", "x", "y").select("series", "x", F.round("y", 6).alias("y"))


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY x) AS i FROM {_S}), r(series, i, x, e) AS (SELECT series, i, x, y FROM s WHERE i = 1 UNION ALL SELECT s.series, s.i, s.x, 0.2 * s.y + 0.8 * r.e FROM r JOIN s ON s.series = r.series AND s.i = r.i + 1)
SELECT series, x, round(e, 6) AS ema FROM r""")
def ema(spark, d):
    """W07."""
    return O.ema(series(spark, d), "series", "x", "y", 0.2).select("series", "x", F.round("ema", 6).alias("ema"))


@query(f"WITH c AS (SELECT *, sum(y) OVER (PARTITION BY series ORDER BY x ROWS UNBOUNDED PRECEDING) AS cum FROM {_S}) SELECT series, t.t::DOUBLE AS t, min_by(x, cum) AS x FROM c JOIN (SELECT unnest([100, 1000, 5000]) AS t) t ON t.t <= cum GROUP BY 1, 2")
def threshold_crossing(spark, d):
    """W14, R02's batch form."""
    c = O.prefix_sum(series(spark, d), "x", "y", ("series",)).withColumn("cum", F.col("before") + F.col("y"))
    t = F.filter(F.array(*[F.lit(v) for v in (100.0, 1000.0, 5000.0)]), lambda v: v <= F.col("cum"))
    return c.select("series", "x", "cum", F.explode(t).alias("t")).groupBy("series", "t").agg(F.min_by("x", "cum").alias("x"))


@query(f"WITH b AS (SELECT series, min(y) AS lo, max(y) AS hi FROM {_S} GROUP BY 1), g AS (SELECT series, lo, hi, unnest(range(0, CASE WHEN hi > lo THEN 200 ELSE 1 END)) AS bin FROM b) SELECT g.series, g.bin, count(v.y) AS n FROM g LEFT JOIN (SELECT series, y, CASE WHEN hi > lo THEN least(floor((y - lo) / ((hi - lo) / 200)), 199)::BIGINT ELSE 0 END AS bin FROM {_S} JOIN b USING (series)) v ON v.series = g.series AND v.bin = g.bin GROUP BY 1, 2")
def histogram(spark, d):
    """X11: 200 bins, empty ones too."""
    return O.histogram(series(spark, d), "series", "y", 200)


@query(f"SELECT series, round(arg_min(y, x), 6) AS first, round(arg_max(y, x), 6) AS last, min(x) AS lo, max(x) AS hi, count(y) AS n FROM {_S} GROUP BY 1")
def first_last(spark, d):
    """A12."""
    return series(spark, d).groupBy("series").agg(F.round(F.min_by("y", "x"), 6).alias("first"), F.round(F.max_by("y", "x"), 6).alias("last"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("y").alias("n"))


@query("WITH p AS (SELECT user_id, event_type AS domain, arg_min(value, event_id) AS b, arg_max(value, event_id) AS a FROM events GROUP BY 1, 2) SELECT domain, round(-avg(a - b), 6) AS f_avg, round(avg((a - b < -1)::INT), 6) AS f_ratio FROM p GROUP BY domain")
def forgetting_scores(spark, d):
    """The first and the last value of each user and domain; a side that lacks an id raises."""
    e = table(spark, d, "events").withColumn("domain", F.col("event_type"))
    side = lambda f, n: e.groupBy("user_id", "domain").agg(f("value", "event_id").alias(n))
    j = O.join_equal_keys(side(F.min_by, "b"), side(F.max_by, "a"), ["user_id", "domain"]).withColumn("delta", F.col("a") - F.col("b"))
    return j.groupBy("domain").agg(F.round(-F.avg("delta"), 6).alias("f_avg"), F.round(O.rate(F.col("delta") < -1), 6).alias("f_ratio"))


@query("SELECT event_type, round(sum(value * 0.5) / greatest(sum(value), 1e-12), 6) AS r, round(exp(-avg(value / 100)), 6) AS confidence, CASE WHEN avg(value / 100) < 50 THEN round(exp(avg(value / 100)), 6) END AS ppl FROM events GROUP BY 1")
def r_weighted(spark, d):
    """A17, V14."""
    v = F.col("value")
    nll = F.avg(v / 100)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(V.transmission(F.sum(v * 0.5), F.sum(v)), 6).alias("r"), F.round(F.exp(-nll), 6).alias("confidence"), F.when(nll < 50, F.round(F.exp(nll), 6)).alias("ppl"))


_N = "(SELECT n_name AS subject, n_regionkey AS reg, sum(o_totalprice) AS v, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def nations(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("n_name").alias("subject"), F.col("n_regionkey").alias("reg")).agg(F.sum("o_totalprice").alias("v"), F.avg("o_totalprice").alias("m"))


@query(f"WITH b AS (SELECT reg, arg_min(v, subject) AS base FROM {_N} GROUP BY 1) SELECT subject, round((v - base) / nullif(base, 0), 6) AS change FROM {_N} JOIN b USING (reg)")
def relative_change_baseline(spark, d):
    """J14, V31."""
    x = nations(spark, d)
    b = x.groupBy("reg").agg(F.min_by("v", "subject").alias("base"))
    return x.join(b, "reg").select("subject", F.round(V.relative_change(F.col("v"), F.col("base")), 6).alias("change"))


@query(f"SELECT subject, round(m - coalesce(lag(m) OVER (PARTITION BY reg ORDER BY subject), m), 6) AS delta FROM {_N}")
def stage_lag_change(spark, d):
    """J15."""
    w = W.partitionBy("reg").orderBy("subject")
    return nations(spark, d).select("subject", F.round(F.col("m") - F.coalesce(F.lag("m").over(w), F.col("m")), 6).alias("delta"))


@query(f"SELECT round(corr(v, m), 6) AS r, round(regr_slope(m, v) * 1e6, 4) AS slope, count(*) AS n FROM {_N}")
def subject_correlation(spark, d):
    """J04, X01, X12."""
    return nations(spark, d).agg(F.round(O.safe_corr(F.col("v"), F.col("m")), 6).alias("r"), F.round(F.regr_slope("m", "v") * 1e6, 4).alias("slope"), F.count("*").alias("n"))


@query("SELECT event_id, 'plasticity/' || event_type || '/' || f AS key, CASE f WHEN 'value' THEN round(value, 6) ELSE user_id::DOUBLE END AS value FROM events, (SELECT unnest(['value', 'user']) AS f)")
def melt_history(spark, d):
    """P06, P11."""
    x = table(spark, d, "events").select("event_id", "event_type", F.round("value", 6).alias("value"), F.col("user_id").cast("double").alias("user"))
    m = x.unpivot(["event_id", "event_type"], ["value", "user"], "f", "value")
    return m.select("event_id", F.concat_ws("/", F.lit("plasticity"), "event_type", "f").alias("key"), "value")


@query("SELECT r_name, n_name, prio, row_number() OVER (ORDER BY r_name, n_name, prio) - 1 AS job FROM region JOIN nation ON r_regionkey = n_regionkey, (SELECT DISTINCT o_orderpriority AS prio FROM orders)")
def job_grid(spark, d):
    """J11."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    prio = table(spark, d, "orders").select(F.col("o_orderpriority").alias("prio")).distinct()
    g = O.cross_pairs(prio, r.join(n, r["r_regionkey"] == n["n_regionkey"]).select("r_name", "n_name"))
    job = O.numbered(g.withColumn("key", F.struct("r_name", "n_name", "prio")), "key", "job")
    return job.select("r_name", "n_name", "prio", F.col("job").cast("bigint").alias("job"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def qc_unique(spark, d):
    """G01, G05."""
    return O.require_unique(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AND count(DISTINCT doc_id) = count(*) AS contiguous, count(*) FILTER (text IS NULL) AS missing FROM documents")
def qc_contiguous(spark, d):
    """G02, G03."""
    i = F.col("doc_id")
    return table(spark, d, "documents").agg(((F.min(i) == 0) & (F.max(i) == F.count("*") - 1) & (F.count_distinct(i) == F.count("*"))).alias("contiguous"), F.count_if(F.col("text").isNull()).alias("missing"))


@query("SELECT count(*) FILTER (NOT (l_discount BETWEEN 0 AND 1)) AS bad_discount, count(*) FILTER (NOT (l_tax BETWEEN 0 AND 0.05)) AS bad_tax FROM lineitem")
def qc_ranges(spark, d):
    """G09."""
    return table(spark, d, "lineitem").agg(F.count_if(~F.col("l_discount").between(0, 1)).alias("bad_discount"), F.count_if(~F.col("l_tax").between(0, 0.05)).alias("bad_tax"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 10 AND value < 50) AS kept FROM events WHERE user_id IN (1, 2, 3, 5, 8) AND event_id >= 100 GROUP BY 1")
def filter_set(spark, d):
    """F01, F04, F07."""
    x = table(spark, d, "events").where(F.col("user_id").isin(1, 2, 3, 5, 8) & (F.col("event_id") >= 100))
    v = F.col("value")
    return x.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(V.finite(v) & (v > 10) & (v < 50)).alias("kept"))


@query("SELECT p_partkey, contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), '1') AND p_size > 10 OR p_brand LIKE '%2%' AS hit FROM part")
def fuzzy_filter(spark, d):
    """F02, F03."""
    canon = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "")
    return table(spark, d, "part").select("p_partkey", ((canon.contains("1") & (F.col("p_size") > 10)) | F.col("p_brand").contains("2")).alias("hit"))


@query("SELECT s, round(avg(value), 6) AS mean FROM (SELECT event_type AS s, value FROM events) GROUP BY 1")
def csv_round_trip(spark, d):
    """Written with a union of columns and read with coercion."""
    import uuid

    from ripplework.session import shared_dir
    from ripplework.sources import io

    e = table(spark, d, "events")
    path = f"{shared_dir(spark)}/ripplework/csv-{uuid.uuid4().hex}"
    io.write_csv([e.where("event_type = 'click'").select("event_type", "value"), e.where("not event_type <=> 'click'").select("value", "event_type", "user_id")], path)
    back = io.read_delimited(spark, path, ["event_type", "value"], numeric=("value",))
    return back.groupBy(F.col("event_type").alias("s")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT conv_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def jsonl_round_trip(spark, d):
    """Every text survives."""
    import uuid

    from ripplework.session import shared_dir
    from ripplework.sources import io

    path = f"{shared_dir(spark)}/ripplework/jsonl-{uuid.uuid4().hex}"
    io.write_jsonl(table(spark, d, "conversations"), path, sort_keys=True)
    back = io.read_jsonl(spark, path, "conv_id long, turn long, role string, text string", strict=True)
    return back.groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "|")).alias("h"))


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY x) AS i FROM {_S}),
r(series, i, x, a, w, y) AS (SELECT series, i, x, 0.0::DOUBLE, 0.0::DOUBLE, y FROM s WHERE i = 1 UNION ALL SELECT s.series, s.i, s.x, 0.5::DOUBLE * (r.a + r.y), 0.5::DOUBLE * (r.w + 1), s.y FROM r JOIN s ON s.series = r.series AND s.i = r.i + 1)
SELECT series, x, round(a / w, 6) AS history FROM r WHERE i > 1""")
def decayed_history(spark, d):
    """The mean of all that came before, weights halved with each step back."""
    return O.decayed_mean(series(spark, d), "series", "x", "y", 0.5, "history").where("history is not null").select("series", "x", F.round("history", 6).alias("history"))


@query(f"SELECT series, round(q1 - 0.05 * (q2 - q1), 6) AS lo, round(q2 + 0.05 * (q2 - q1), 6) AS hi FROM (SELECT series, quantile_cont(y, 0.01) AS q1, quantile_cont(y, 0.99) AS q2 FROM {_S} GROUP BY 1)")
def robust_limits(spark, d):
    """The 1st and 99th percentile, padded by a twentieth of their distance."""
    q = F.percentile("y", F.array(F.lit(0.01), F.lit(0.99)))
    g = series(spark, d).groupBy("series").agg(F.get(q, F.lit(0)).alias("a"), F.get(q, F.lit(1)).alias("b"))
    pad = F.lit(0.05) * (F.col("b") - F.col("a"))
    return g.select("series", F.round(F.col("a") - pad, 6).alias("lo"), F.round(F.col("b") + pad, 6).alias("hi"))


@query("SELECT event_id FROM events WHERE value > 5 ORDER BY md5('13:' || event_id), event_id LIMIT 200")
def scatter_subsample(spark, d):
    """Finite rows, without replacement."""
    v = F.col("value")
    return O.shuffle_take(table(spark, d, "events").where(V.finite(v) & (v > 5)), "event_id", 200, 13).select("event_id")


@query("SELECT event_type, sum(try_cast(json_extract_string(props, '$.k') AS INT))::BIGINT AS k, round(avg(try_cast(json_extract_string(props, '$.k') AS INT)), 6) AS mean FROM events GROUP BY 1")
def json_components(spark, d):
    """Means of a path in JSON."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).cast("bigint").alias("k"), F.round(F.avg(k), 6).alias("mean"))


@query("SELECT date_trunc('day', ts) AS day, count(*) AS rows, count(DISTINCT event_id // 3) AS exact, true AS near, true AS median_near FROM events GROUP BY 1")
def sketch_rollup(spark, d):
    """Sketches stored by day and type, rolled up to days; distinct counts within 6 % and medians within 5 % of rank of exact ones."""
    e = table(spark, d, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"), "event_type", F.expr("event_id div 3").alias("u"), "value")
    up = sketches.rolled_up(materialize(sketches.sketched(e, ["day", "event_type"], "u", "value"), "sketches"), ["day"], (0.5,))
    rank = F.avg((F.col("value") <= F.col("q50")).cast("double"))
    exact = e.join(up.select("day", "q50"), "day").groupBy("day").agg(F.count_distinct("u").alias("exact"), rank.alias("rank"))
    return up.join(exact, "day").select("day", "rows", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= 0.06 * F.col("exact") + 1).alias("near"), (F.abs(F.col("rank") - 0.5) <= 0.05).alias("median_near"))
