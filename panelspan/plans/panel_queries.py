"""Queries of the panel, tape, join, window and measure operators over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import asof, grid, match, measure, robust
from ..operators import window as W
from .frames import PANEL, TAPE, panel, table, tape

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


IC = f"""WITH {PANEL}, c AS (SELECT user_id, d, value - lag(value) OVER (PARTITION BY user_id ORDER BY d) AS chg FROM p),
 l AS (SELECT d, chg, lag(chg) OVER (PARTITION BY user_id ORDER BY d) AS prev FROM c), b AS (SELECT * FROM l WHERE chg IS NOT NULL AND prev IS NOT NULL),
 k AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY prev) + (count(*) OVER (PARTITION BY d, prev) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY d ORDER BY chg) + (count(*) OVER (PARTITION BY d, chg) - 1) / 2.0 AS ry FROM b),
 ic AS (SELECT d, count(*) AS n, corr(rx::DOUBLE, ry::DOUBLE) AS ic FROM k GROUP BY d HAVING count(*) >= 10 AND var_pop(rx::DOUBLE) > 0 AND var_pop(ry::DOUBLE) > 0)"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("d")
    c = panel(spark, sf).withColumn("chg", F.col("value") - F.lag("value").over(w))
    return c.withColumn("prev", F.lag("chg").over(w))


@query(IC + " SELECT d, n, round(ic, 6) AS ic FROM ic")
def daily_rank_ic(spark, sf):
    return measure.rank_ic(changes(spark, sf), "d", "prev", "chg", 10).select("d", "n", r6("ic").alias("ic"))


@query(IC + " SELECT count(ic) AS n, round(avg(ic), 6) AS mean, round(sqrt(count(ic)) * avg(ic) / nullif(stddev_samp(ic), 0), 5) AS t FROM ic")
def rank_ic_summary(spark, sf):
    s = measure.t_summary(measure.rank_ic(changes(spark, sf), "d", "prev", "chg", 10), "ic")
    return s.select("n", r6("mean").alias("mean"), F.round("t", 5).alias("t"))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice > 905")
def scan_project_pushdown(spark, sf):
    return table(spark, sf, "part").where(F.col("p_size").between(10, 20) & (F.col("p_retailprice") > 905)).select("p_partkey", "p_brand", "p_retailprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_universe(spark, sf):
    u = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(u, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def anti_join_unmatched(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def natural_join_dims(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS custkey, coalesce(n_f, 0) AS n_f, coalesce(n_o, 0) AS n_o FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_align(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias(n)) for s, n in (("F", "n_f"), ("O", "n_o")))
    return a.join(b, "custkey", "full").select("custkey", F.coalesce("n_f", F.lit(0)).alias("n_f"), F.coalesce("n_o", F.lit(0)).alias("n_o"))


@query("SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1")
def dedupe_keep_last(spark, sf):
    return W.keep_last(table(spark, sf, "lineitem"), ["l_suppkey", "l_shipdate"], [F.col("l_orderkey").desc_nulls_last(), F.col("l_linenumber").desc_nulls_last()]).select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY o_custkey")
def last_by_key(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_price"))


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_shipdate >= DATE '1998-01-01'")
def distinct_universe(spark, sf):
    return table(spark, sf, "lineitem").where("l_shipdate >= '1998-01-01'").select("l_suppkey").distinct()


@query("""SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, round(coalesce(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), avg(l_extendedprice)), 6) AS vwap, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def vwap_daily(spark, sf):
    px, q = F.col("l_extendedprice"), F.col("l_quantity")
    vwap = F.coalesce(F.sum(px * q) / F.nullif(F.sum(q), F.lit(0.0)), F.avg(px))
    return table(spark, sf, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("d")).agg(F.round(vwap, 6).alias("vwap"), F.count("*").alias("n"))


@query(f"WITH {TAPE} SELECT user_id, d, round(avg(value) FILTER (side = 'P'), 6) AS p, round(avg(value) FILTER (side = 'S'), 6) AS s, round(avg(value) FILTER (side = 'P') - avg(value) FILTER (side = 'S'), 6) AS round_trip FROM t GROUP BY 1, 2 HAVING count(*) FILTER (side = 'P') > 0 AND count(*) FILTER (side = 'S') > 0")
def dealer_round_trip(spark, sf):
    wide = tape(spark, sf).groupBy("user_id", "d").pivot("side", ["P", "S"]).agg(F.avg("value")).where("P is not null and S is not null")
    return wide.select("user_id", "d", r6("P").alias("p"), r6("S").alias("s"), r6(F.col("P") - F.col("S")).alias("round_trip"))


@query("SELECT coalesce(o_orderpriority, 'ALL') AS slice, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def slice_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("o_orderpriority", F.lit("ALL")).alias("slice"), "n", "total")


@query("SELECT s AS status, count(*) AS days, round(avg(m), 6) AS mean, round(sqrt(count(*)) * avg(m) / nullif(stddev_pop(m), 0), 5) AS t FROM (SELECT o_orderstatus AS s, o_orderdate AS d, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def two_level_fm_mean(spark, sf):
    day = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), "o_orderdate").agg(F.avg("o_totalprice").alias("m"))
    t = F.sqrt(F.count("*")) * F.avg("m") / F.nullif(F.stddev_pop("m"), F.lit(0.0))
    return day.groupBy("status").agg(F.count("*").alias("days"), r6(F.avg("m")).alias("mean"), F.round(t, 5).alias("t"))


@query("SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def mode_per_group(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").count()
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("count"), "event_type")).alias("mode"))


@query("SELECT event_type, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def normalized_counts(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type").count()
    return n.select("event_type", r6(F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def quantile_profile(spark, sf):
    q = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select("l_returnflag", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("q10", "q50", "q90"))])


@query(f"WITH {PANEL} SELECT user_id, d, round(lag(value) OVER w, 6) AS prev, round(lead(value) OVER w, 6) AS next, round(value - lag(value) OVER w, 6) AS chg, CAST(date_diff('day', lag(d) OVER w, d) AS INT) AS gap FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d)")
def lag_lead_diff(spark, sf):
    w = Window.partitionBy("user_id").orderBy("d")
    return panel(spark, sf).select("user_id", "d", r6(F.lag("value").over(w)).alias("prev"), r6(F.lead("value").over(w)).alias("next"), r6(F.col("value") - F.lag("value").over(w)).alias("chg"), F.datediff("d", F.lag("d").over(w)).alias("gap"))


@query(f"WITH {PANEL} SELECT user_id, d, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS mean20 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def rolling_mean_min_periods(spark, sf):
    return panel(spark, sf).select("user_id", "d", r6(W.rolling(F.avg, "value", ["user_id"], ["d"], -20, -1, 5)).alias("mean20"))


@query(f"WITH {PANEL} SELECT user_id, d, CASE WHEN count(value) OVER w >= 5 THEN round(stddev_samp(value) OVER w, 6) END AS sd10 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def rolling_std_lagged(spark, sf):
    return panel(spark, sf).select("user_id", "d", r6(W.rolling(F.stddev_samp, "value", ["user_id"], ["d"], -10, -1, 5)).alias("sd10"))


@query(f"WITH {PANEL} SELECT user_id, d, CASE WHEN count(value) OVER w = 5 THEN round(sum(value) OVER w, 6) END AS next5 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)")
def forward_sum(spark, sf):
    return panel(spark, sf).select("user_id", "d", r6(W.rolling(F.sum, "value", ["user_id"], ["d"], 0, 4, 5)).alias("next5"))


@query(f"WITH {PANEL}, c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d)), g AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY d) AS run FROM c) SELECT user_id, d, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY user_id, run ORDER BY d) - 1 AS same_for FROM g")
def run_length_unchanged(spark, sf):
    w = Window.partitionBy("user_id").orderBy("d")
    p = panel(spark, sf).withColumn("_last", F.lag("event_type").over(w)).withColumn("run", W.run_length(~F.col("event_type").eqNullSafe(F.col("_last")), ["user_id"], ["d"]))
    return p.select("user_id", "d", "run", (F.row_number().over(Window.partitionBy("user_id", "run").orderBy("d")) - 1).cast("long").alias("same_for"))


@query(f"WITH {PANEL} SELECT user_id, d, round((rank() OVER (PARTITION BY d ORDER BY value) + (count(*) OVER (PARTITION BY d, value) - 1) / 2.0::DOUBLE) / count(value) OVER (PARTITION BY d), 6) AS pr FROM p WHERE value IS NOT NULL")
def pct_rank_by_date(spark, sf):
    return panel(spark, sf).where("value is not null").select("user_id", "d", r6(W.pct_rank("value", ["d"])).alias("pr"))


@query(f"WITH {PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY value, user_id) AS rn, count(*) OVER (PARTITION BY d) AS n FROM p) SELECT user_id, d, CASE WHEN n = 1 THEN 0 ELSE CAST(greatest(ceil((rn - 1) * 5 / (n - 1)::DOUBLE) - 1, 0) AS INT) END AS q FROM r")
def qcut_quintiles(spark, sf):
    return panel(spark, sf).select("user_id", "d", W.qcut_rank([F.col("value"), F.col("user_id")], ["d"], 5).alias("q"))


@query(f"""WITH {PANEL}, f AS (SELECT user_id, d, value, lead(value) OVER (PARTITION BY user_id ORDER BY d) AS nxt FROM p), r AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY value) + (count(*) OVER (PARTITION BY d, value) - 1) / 2.0::DOUBLE AS ar, count(*) OVER (PARTITION BY d) AS n FROM f)
 SELECT CAST(least(floor((ar - 1) / n * 10), 9) AS INT) AS decile, count(*) AS n, round(avg(nxt), 6) AS mean_next FROM r GROUP BY 1""")
def decile_floor_profile(spark, sf):
    f = panel(spark, sf).withColumn("nxt", F.lead("value").over(Window.partitionBy("user_id").orderBy("d"))).withColumn("decile", W.decile_floor("value", ["d"]))
    return f.groupBy("decile").agg(F.count("*").alias("n"), r6(F.avg("nxt")).alias("mean_next"))


@query(f"WITH {PANEL} SELECT user_id, d, event_type, round((rank() OVER (PARTITION BY d, event_type ORDER BY value) + (count(*) OVER (PARTITION BY d, event_type, value) - 1) / 2.0::DOUBLE) / count(value) OVER (PARTITION BY d, event_type), 6) AS pr FROM p WHERE value IS NOT NULL")
def rank_within_cell(spark, sf):
    return panel(spark, sf).where("value is not null").select("user_id", "d", "event_type", r6(W.pct_rank("value", ["d", "event_type"])).alias("pr"))


@query(f"WITH {PANEL}, x AS (SELECT user_id, d, CASE WHEN event_type = 'purchase' THEN value END AS px FROM p) SELECT user_id, d, round(last_value(px IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ff, round(first_value(px IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bf FROM x")
def ffill_bfill(spark, sf):
    x = panel(spark, sf).withColumn("px", F.when(F.col("event_type") == "purchase", F.col("value")))
    return x.select("user_id", "d", r6(W.fill("px", ["user_id"], ["d"])).alias("ff"), r6(W.fill("px", ["user_id"], ["d"], backward=True)).alias("bf"))


@query(f"WITH {PANEL} SELECT a.user_id, a.d, round(sum(b.value * pow(0.5, date_diff('day', b.d, a.d) / 10.0::DOUBLE)), 6) AS decayed FROM p a JOIN p b ON a.user_id = b.user_id AND b.d <= a.d GROUP BY 1, 2")
def decayed_sum(spark, sf):
    return W.decayed_sums(panel(spark, sf), "user_id", "d", "value", 10.0).select("user_id", "d", r6("decayed").alias("decayed"))


@query(f"WITH {TAPE} SELECT event_id, row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS nth FROM t")
def nth_print_of_day(spark, sf):
    return tape(spark, sf).select("event_id", F.row_number().over(Window.partitionBy("user_id", "d").orderBy("ts", "event_id")).cast("long").alias("nth"))


@query(f"WITH {PANEL}, x AS (SELECT user_id, d, CASE WHEN event_type = 'purchase' THEN d END AS pd FROM p) SELECT user_id, d, CAST(date_diff('day', max(pd) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d) AS INT) AS stale FROM x")
def previous_obs_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("event_type") == "purchase", F.col("d"))).over(w)
    return panel(spark, sf).select("user_id", "d", F.datediff("d", seen).alias("stale"))


@query(f"WITH {PANEL}, m AS (SELECT *, median(value) OVER (PARTITION BY d) AS med FROM p), k AS (SELECT *, greatest(1.4826 * median(abs(value - med)) OVER (PARTITION BY d), 1e-6) AS mad FROM m) SELECT user_id, d, round(med, 6) AS med, round(mad, 6) AS mad, abs(value - med) > 3 * mad AS extreme FROM k")
def mad_outliers(spark, sf):
    return robust.mad_flags(panel(spark, sf), "value", ["d"], 3).select("user_id", "d", r6("med").alias("med"), r6("mad").alias("mad"), "extreme")


@query(f"WITH {PANEL}, q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM p WHERE d < DATE '2024-01-16') SELECT user_id, d, round(greatest(least(value, hi), lo), 6) AS clipped FROM p, q")
def winsor_train_quantiles(spark, sf):
    p = robust.winsorise_at_train_quantiles(panel(spark, sf), "value", F.col("d") < F.lit("2024-01-16").cast("date"), 0.05, 0.95)
    return p.select("user_id", "d", r6("clipped").alias("clipped"))


@query(f"WITH {PANEL}, h AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS nu, count(*) OVER (PARTITION BY d) AS nd FROM p) SELECT user_id, d FROM h WHERE nu >= 10 AND nd >= 5")
def sparse_date_filter(spark, sf):
    h = panel(spark, sf).withColumns({"nu": F.count("*").over(Window.partitionBy("user_id")), "nd": F.count("*").over(Window.partitionBy("d"))})
    return h.where("nu >= 10 and nd >= 5").select("user_id", "d")


@query(f"WITH {PANEL}, c AS (SELECT d, count(*) AS n FROM p GROUP BY d), m AS (SELECT d, n, median(n) OVER (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS med FROM c), b AS (SELECT d, n, first_value(med IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS med FROM m) SELECT d, n, round(med, 6) AS med, n < 0.6 * med AS partial FROM b")
def partial_day_rule(spark, sf):
    w = Window.orderBy("d")
    c = panel(spark, sf).groupBy("d").agg(F.count("*").alias("n")).withColumn("m", F.percentile("n", F.lit(0.5)).over(w.rowsBetween(-20, -1)))
    c = c.withColumn("med", F.first("m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return c.select("d", "n", r6("med").alias("med"), (F.col("n") < 0.6 * F.col("med")).alias("partial"))


@query(f"WITH {PANEL}, m AS (SELECT *, median(value) OVER (PARTITION BY d) AS med FROM p) SELECT d, round(avg((abs(value - med) > 50)::INT), 6) AS share, avg((abs(value - med) > 50)::INT) > 0.4 AS dispersed FROM m GROUP BY d")
def dispersion_day_rule(spark, sf):
    m = panel(spark, sf).withColumn("med", F.median("value").over(Window.partitionBy("d")))
    share = F.avg((F.abs(F.col("value") - F.col("med")) > 50).cast("double"))
    return m.groupBy("d").agg(r6(share).alias("share"), (share > 0.4).alias("dispersed"))


def _asof(spark, sf, side="S", **how):
    t = tape(spark, sf)
    return asof.asof_join(t.where("side = 'P'"), t.where(F.col("side") == side), ["user_id"], "ts", "ts", ["event_id", "value"], order=["event_id"], **how)


def _asof_sql(on: str, pick: str = "1 = 1") -> str:
    return f"WITH {TAPE} SELECT a.event_id, CASE WHEN {pick} THEN b.event_id END AS asof_event_id, CASE WHEN {pick} THEN round(b.value, 6) END AS asof_value FROM (SELECT * FROM t WHERE side = 'P') a ASOF LEFT JOIN (SELECT * FROM t WHERE side = 'S') b ON a.user_id = b.user_id AND {on}"


@query(_asof_sql("a.ts > b.ts"))
def asof_strict(spark, sf):
    return _asof(spark, sf).select("event_id", "asof_event_id", r6("asof_value").alias("asof_value"))


@query(_asof_sql("a.ts >= b.ts"))
def asof_inclusive(spark, sf):
    return _asof(spark, sf, strict=False).select("event_id", "asof_event_id", r6("asof_value").alias("asof_value"))


@query(_asof_sql("a.ts <= b.ts"))
def asof_forward(spark, sf):
    return _asof(spark, sf, strict=False, forward=True).select("event_id", "asof_event_id", r6("asof_value").alias("asof_value"))


@query(_asof_sql("a.ts > b.ts", "a.ts - b.ts <= INTERVAL 3 DAY"))
def asof_tolerance(spark, sf):
    near = F.col("ts") - F.col("asof_ts") <= F.expr("INTERVAL 3 DAY")
    return _asof(spark, sf).select("event_id", F.when(near, F.col("asof_event_id")).alias("asof_event_id"), F.when(near, r6("asof_value")).alias("asof_value"))


@query(f"WITH {PANEL}, cal AS (SELECT d, lag(d) OVER (ORDER BY d) AS prev FROM (SELECT DISTINCT d FROM p)) SELECT a.user_id, a.d, round(b.value, 6) AS prev_value FROM p a JOIN cal ON a.d = cal.d LEFT JOIN p b ON b.user_id = a.user_id AND b.d = cal.prev")
def asof_global_calendar(spark, sf):
    p = panel(spark, sf)
    cal = p.select("d").distinct().withColumn("prev", F.lag("d").over(Window.orderBy("d")))
    right = p.select("user_id", F.col("d").alias("prev"), F.col("value").alias("pv"))
    return p.join(F.broadcast(cal), "d").join(right, ["user_id", "prev"], "left").select("user_id", "d", r6("pv").alias("prev_value"))


@query(f"WITH {TAPE} SELECT a.event_id, b.d AS exit_day FROM (SELECT * FROM t WHERE side = 'P') a ASOF LEFT JOIN (SELECT DISTINCT user_id, d FROM t WHERE side = 'S') b ON a.user_id = b.user_id AND a.d < b.d")
def next_other_side(spark, sf):
    t = tape(spark, sf)
    found = asof.asof_join(t.where("side = 'P'"), t.where("side = 'S'").select("user_id", "d").distinct(), ["user_id"], "d", "d", [], strict=True, forward=True)
    return found.select("event_id", F.col("asof_d").alias("exit_day"))


@query(f"WITH {TAPE}, a AS (SELECT *, date_trunc('day', ts) + INTERVAL 6 DAY AS cut FROM t WHERE side = 'P') SELECT a.event_id, CASE WHEN b.ts > a.ts THEN b.event_id END AS exit_id FROM a ASOF LEFT JOIN (SELECT * FROM t WHERE side = 'D') b ON a.user_id = b.user_id AND a.cut > b.ts")
def exit_at_cut(spark, sf):
    t = tape(spark, sf)
    a = t.where("side = 'P'").withColumn("cut", (F.date_trunc("day", "ts") + F.expr("INTERVAL 6 DAY")).cast("timestamp_ntz"))
    found = asof.asof_join(a, t.where("side = 'D'"), ["user_id"], "cut", "ts", ["event_id"], order=["event_id"])
    return found.select("event_id", F.when(F.col("asof_ts") > F.col("ts"), F.col("asof_event_id")).alias("exit_id"))


@query(f"WITH {TAPE} SELECT a.event_id, count(b.event_id) AS prints_20d FROM t a LEFT JOIN t b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 20 DAY GROUP BY 1")
def prints_in_20d(spark, sf):
    t = tape(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    now = asof.asof_join(t.select("event_id", "user_id", "ts"), t, ["user_id"], "ts", "ts", ["n"], order=["event_id"], prefix="now_")
    now = now.select("event_id", "user_id", "now_n", (F.col("ts") - F.expr("INTERVAL 20 DAY")).alias("past"))
    then = asof.asof_join(now, t, ["user_id"], "past", "ts", ["n"], order=["event_id"], prefix="then_")
    return then.select("event_id", (F.coalesce("now_n", F.lit(0)) - F.coalesce("then_n", F.lit(0))).cast("long").alias("prints_20d"))


@query(f"WITH {TAPE} SELECT event_id, lag(event_id) OVER w AS prev_id, round(value - lag(value) OVER w, 6) AS chg, side || '>' || lag(side) OVER w AS sides FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def print_to_print_pairs(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return tape(spark, sf).select("event_id", F.lag("event_id").over(w).alias("prev_id"), r6(F.col("value") - F.lag("value").over(w)).alias("chg"), F.concat("side", F.lit(">"), F.lag("side").over(w)).alias("sides"))


PAIRS = f"WITH {TAPE}, c AS (SELECT a.event_id AS a, b.event_id AS b, abs(a.value - b.value) AS gap FROM t a JOIN t b ON a.user_id = b.user_id AND a.d = b.d WHERE a.side = 'P' AND b.side = 'S' AND abs(b.value / nullif(a.value, 0) - 1) <= 0.25)"


@query(PAIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY gap, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY gap, a) AS rb FROM c) SELECT a, b, round(gap, 6) AS gap FROM r WHERE ra = 1 AND rb = 1")
def mutual_best_match(spark, sf):
    t = tape(spark, sf).select("event_id", "user_id", "d", "value", "side")
    a, b = (t.where(F.col("side") == s).select("user_id", "d", F.col("event_id").alias(n), F.col("value").alias(f"v{n}")) for s, n in (("P", "a"), ("S", "b")))
    c = a.join(b, ["user_id", "d"]).where(F.abs(F.col("vb") / F.nullif("va", F.lit(0.0)) - 1) <= 0.25).withColumn("gap", F.abs(F.col("va") - F.col("vb")))
    return match.mutual_best(c, "a", "b", "gap").select("a", "b", r6("gap").alias("gap"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'R'),
 b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'A')
 SELECT a.l_partkey AS part, a.l_orderkey AS sell_order, b.l_orderkey AS buy_order FROM a JOIN b ON a.l_partkey = b.l_partkey AND a.l_quantity = b.l_quantity AND a.k = b.k""")
def ordinal_tier_match(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), "l_quantity", "l_orderkey", "l_linenumber", "l_returnflag")
    a = l.where("l_returnflag = 'R'").select("part", "l_quantity", F.col("l_orderkey").alias("sell_order"), F.col("l_linenumber").alias("sl"))
    b = l.where("l_returnflag = 'A'").select("part", "l_quantity", F.col("l_orderkey").alias("buy_order"), F.col("l_linenumber").alias("bl"))
    return match.ordinal_match(a, b, ["part", "l_quantity"], ["sell_order", "sl"], ["buy_order", "bl"]).select("part", "sell_order", "buy_order")


FIFO = """WITH x AS MATERIALIZED (SELECT l_partkey AS e, l_shipdate AS ts, l_orderkey AS o, l_linenumber AS ln, l_orderkey * 100 + l_linenumber AS id, l_returnflag <> 'R' AS buy, l_quantity AS q FROM lineitem WHERE l_quantity > 0),
 c AS (SELECT *, sum(CASE WHEN buy THEN q ELSE 0 END) OVER w AS bb, sum(CASE WHEN buy THEN 0 ELSE q END) OVER w AS ss FROM x WINDOW w AS (PARTITION BY e ORDER BY ts, o, ln)),
 u AS (SELECT *, greatest(0, max(ss - bb) OVER (PARTITION BY e ORDER BY ts, o, ln)) AS un FROM c), v AS MATERIALIZED (SELECT *, coalesce(lag(un) OVER (PARTITION BY e ORDER BY ts, o, ln), 0) AS u0 FROM u),
 s AS MATERIALIZED (SELECT e, id AS sell_id, ss - q - u0 AS s0, ss - un AS s1 FROM v WHERE NOT buy), b AS MATERIALIZED (SELECT e, id AS buy_id, bb - q AS b0, bb AS b1 FROM v WHERE buy),
 f AS (SELECT b.e AS part, buy_id, sell_id, least(b1, s1) - greatest(b0, s0) AS par FROM b JOIN s ON b.e = s.e AND b0 < s1 AND s0 < b1 WHERE s1 > s0)"""


def _fifo(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), "l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"))
    return match.fifo_lots(l, "part", ["l_shipdate", "l_orderkey", "l_linenumber"], F.col("l_returnflag") != "R", "l_quantity", "id")


@query(FIFO + " SELECT part, buy_id, sell_id, CAST(par AS DOUBLE) AS par FROM f")
def fifo_lots(spark, sf):
    return _fifo(spark, sf).select("part", "buy_id", "sell_id", "par")


@query(FIFO + " SELECT part, count(*) AS pairs, CAST(sum(par) AS DOUBLE) AS par FROM f GROUP BY 1")
def fifo_lot_rollup(spark, sf):
    return _fifo(spark, sf).groupBy("part").agg(F.count("*").alias("pairs"), F.sum("par").alias("par"))


@query(f"WITH {PANEL}, g AS (SELECT user_id, d, CAST(round(value * 100) AS BIGINT) AS c, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS s, count(value) OVER w AS n FROM p WINDOW w AS (PARTITION BY d, event_type)) SELECT user_id, d, CAST(c * n - s AS DOUBLE) / CAST(100 * n AS DOUBLE) AS demeaned FROM g")
def neutralized_demean(spark, sf):
    # In whole hundredths: sums don't hang on their order then.
    cell = Window.partitionBy("d", "event_type")
    p = panel(spark, sf).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    n = F.count("c").over(cell)
    return p.select("user_id", "d", ((F.col("c") * n - F.sum("c").over(cell)).cast("double") / (n * 100).cast("double")).alias("demeaned"))


@query("SELECT o_orderpriority, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept FROM orders GROUP BY 1")
def fm_slope_univariate(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.regr_slope("o_totalprice", "o_custkey"), 6).alias("slope"), F.round(F.regr_intercept("o_totalprice", "o_custkey"), 4).alias("intercept"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * l_quantity), 4) AS zz_0_0, round(sum(l_quantity * l_discount), 4) AS zz_0_1, round(sum(l_discount * l_discount), 4) AS zz_1_1, round(sum(l_quantity * l_tax), 4) AS zr_0, round(sum(l_discount * l_tax), 4) AS zr_1, round(sum(l_tax * l_tax), 4) AS rr FROM lineitem GROUP BY 1")
def gram_moments(spark, sf):
    g = measure.gram(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"], "l_tax")
    return g.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in g.columns[2:]])


@query("""WITH g AS (SELECT l_returnflag AS k, count(*) AS n, covar_pop(l_extendedprice, l_quantity) AS xy, covar_pop(l_extendedprice, l_discount) AS zy, var_pop(l_quantity) AS xx, var_pop(l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz FROM lineitem GROUP BY 1)
 SELECT k AS l_returnflag, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 4) AS b_quantity, round((zy * xx - xy * xz) / (xx * zz - xz * xz), 2) AS b_discount FROM g""")
def ols_gram_two_var(spark, sf):
    y, x, z = "l_extendedprice", "l_quantity", "l_discount"
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.covar_pop(y, x).alias("xy"), F.covar_pop(y, z).alias("zy"), F.var_pop(x).alias("xx"), F.var_pop(z).alias("zz"), F.covar_pop(x, z).alias("xz"))
    det = F.expr("xx * zz - xz * xz")
    return g.select("l_returnflag", F.round(F.expr("xy * zz - zy * xz") / det, 4).alias("b_quantity"), F.round(F.expr("zy * xx - xy * xz") / det, 2).alias("b_discount"))


AR = f"WITH {PANEL}, l AS (SELECT d, event_type, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY d) AS x FROM p), b AS (SELECT * FROM l WHERE x IS NOT NULL)"


def _ar(spark, sf):
    return panel(spark, sf).select("d", "event_type", F.col("value").alias("y"), F.lag("value").over(Window.partitionBy("user_id").orderBy("d")).alias("x")).where("x is not null")


def _slope(n, sx, sy, sxx, sxy):
    return (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))


@query(AR + " SELECT event_type, count(*) AS n, round((count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(count(*) * sum(x * x) - sum(x) * sum(x), 0), 6) AS phi FROM b GROUP BY 1")
def ar1_running_sums(spark, sf):
    return _ar(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), r6(_slope(F.count("*"), F.sum("x"), F.sum("y"), F.sum(F.expr("x * x")), F.sum(F.expr("x * y")))).alias("phi"))


@query(AR + ", s AS (SELECT d, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM b GROUP BY d), e AS (SELECT d, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM s WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT d, round((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 6) AS phi FROM e")
def expanding_ar1(spark, sf):
    s = _ar(spark, sf).groupBy("d").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.expr("x * x")).alias("sxx"), F.sum(F.expr("x * y")).alias("sxy"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("d", *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]).select("d", r6(_slope(*map(F.col, ("n", "sx", "sy", "sxx", "sxy")))).alias("phi"))


@query(f"WITH {PANEL}, o AS (SELECT avg(value) AS pool FROM p) SELECT event_type, count(value) AS n, round(avg(value), 6) AS own, round(count(value) / (count(value) + 500.0::DOUBLE) * avg(value) + (1 - count(value) / (count(value) + 500.0::DOUBLE)) * any_value(pool), 6) AS shrunk FROM p, o GROUP BY 1")
def shrunk_group_means(spark, sf):
    return robust.shrunk_means(panel(spark, sf), "event_type", "value", 500.0).select("event_type", "n", r6("own").alias("own"), r6("shrunk").alias("shrunk"))


@query(f"WITH {PANEL}, l AS (SELECT value AS v, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 5) OVER w AS l5 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d)) SELECT round(corr(v, l1), 6) AS acf1, round(corr(v, l2), 6) AS acf2, round(corr(v, l5), 6) AS acf5 FROM l")
def acf_lags(spark, sf):
    w = Window.partitionBy("user_id").orderBy("d")
    l = panel(spark, sf).select("value", *[F.lag("value", k).over(w).alias(f"l{k}") for k in (1, 2, 5)])
    return l.agg(*[r6(F.corr("value", f"l{k}")).alias(f"acf{k}") for k in (1, 2, 5)])


WEIGHTS = f"WITH {PANEL}, w AS (SELECT d, user_id, value / sum(value) OVER (PARTITION BY d) AS w FROM p)"


def _weights(spark, sf):
    return panel(spark, sf).select("d", "user_id", (F.col("value") / F.sum("value").over(Window.partitionBy("d"))).alias("w"))


@query(WEIGHTS + ", cal AS (SELECT d, lead(d) OVER (ORDER BY d) AS nd FROM (SELECT DISTINCT d FROM w)), b AS (SELECT nd AS d, user_id, w FROM w JOIN cal USING (d) WHERE nd IS NOT NULL) SELECT coalesce(w.d, b.d) AS d, round(sum(abs(coalesce(w.w, 0) - coalesce(b.w, 0))) / 2, 6) AS turnover FROM w FULL JOIN b ON w.d = b.d AND w.user_id = b.user_id GROUP BY 1")
def turnover(spark, sf):
    return measure.turnover(_weights(spark, sf), "d", "user_id", "w").select("d", r6("turnover").alias("turnover"))


@query(WEIGHTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY w DESC, user_id) AS rn FROM w) SELECT d, round(sum(w * w), 6) AS hhi, round(1 / sum(w * w), 4) AS breadth, round(sum(w) FILTER (rn <= 5), 6) AS top5, count(*) AS names FROM r GROUP BY d")
def concentration_hhi(spark, sf):
    r = _weights(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("w"), "user_id")))
    h = F.sum(F.expr("w * w"))
    return r.groupBy("d").agg(r6(h).alias("hhi"), F.round(1 / h, 4).alias("breadth"), r6(F.sum(F.when(F.col("rn") <= 5, F.col("w")))).alias("top5"), F.count("*").alias("names"))


@query(AR + ", f AS (SELECT d, y, avg(y) OVER (PARTITION BY event_type) AS fit FROM b) SELECT round(1 - sum((y - fit) * (y - fit)) / sum(y * y), 6) AS total_r2, count(*) AS n FROM f")
def total_r2(spark, sf):
    f = _ar(spark, sf).withColumn("fit", F.avg("y").over(Window.partitionBy("event_type")))
    return f.agg(r6(1 - F.sum(F.expr("(y - fit) * (y - fit)")) / F.sum(F.expr("y * y"))).alias("total_r2"), F.count("*").alias("n"))


@query(f"WITH {PANEL}, q AS (SELECT event_type, quantile_cont(value, 0.9) AS q FROM p GROUP BY 1) SELECT p.event_type, round(avg(CASE WHEN value >= q THEN 0.9 * (value - q) ELSE 0.1 * (q - value) END), 6) AS pinball, round(avg((value <= q)::INT), 6) AS coverage FROM p JOIN q USING (event_type) GROUP BY 1")
def pinball_coverage(spark, sf):
    p = panel(spark, sf)
    q = p.groupBy("event_type").agg(F.percentile("value", F.lit(0.9)).alias("q"))
    j = p.join(q, "event_type")
    loss = F.when(F.col("value") >= F.col("q"), 0.9 * (F.col("value") - F.col("q"))).otherwise(0.1 * (F.col("q") - F.col("value")))
    return j.groupBy("event_type").agg(r6(F.avg(loss)).alias("pinball"), r6(F.avg((F.col("value") <= F.col("q")).cast("double"))).alias("coverage"))


@query("WITH p AS (SELECT o_orderpriority AS k, avg((o_orderstatus = 'F')::INT) AS p FROM orders GROUP BY 1) SELECT k, round(avg(CASE WHEN o_orderstatus = 'F' THEN ln(p) ELSE ln(1 - p) END), 6) AS loglik FROM orders JOIN p ON o_orderpriority = k GROUP BY 1")
def bernoulli_loglik(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_orderstatus") == "F").alias("won"))
    j = o.join(o.groupBy("k").agg(F.avg(F.col("won").cast("double")).alias("p")), "k")
    return j.groupBy("k").agg(r6(F.avg(F.when(F.col("won"), F.log("p")).otherwise(F.log1p(-F.col("p"))))).alias("loglik"))


@query(AR + " SELECT event_type, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse FROM b GROUP BY 1")
def mae_by_slice(spark, sf):
    return _ar(spark, sf).groupBy("event_type").agg(r6(F.avg(F.abs(F.expr("y - x")))).alias("mae"), r6(F.sqrt(F.avg(F.expr("(y - x) * (y - x)")))).alias("rmse"))


@query(f"WITH {PANEL}, s AS (SELECT d, avg(value) AS v FROM p GROUP BY d), u AS (SELECT d, v, v - avg(v) OVER () AS u FROM s), l AS (SELECT v, u, lag(u, 1) OVER (ORDER BY d) AS u1, lag(u, 2) OVER (ORDER BY d) AS u2, lag(u, 3) OVER (ORDER BY d) AS u3 FROM u) SELECT count(*) AS n, round(avg(v), 6) AS mean, round(avg(v) / sqrt((avg(u * u) + 2 * 0.75 * sum(u * u1) / count(*) + 2 * 0.5 * sum(u * u2) / count(*) + 2 * 0.25 * sum(u * u3) / count(*)) / count(*)), 4) AS t FROM l")
def newey_west_t(spark, sf):
    s = panel(spark, sf).groupBy("d").agg(F.avg("value").alias("v"))
    return measure.newey_west(s, "d", "v", 3).select("n", r6("mean").alias("mean"), F.round("t", 4).alias("t"))


CURVES = [(k, pos, float(pos) * 2 - 10, round(1 / (1 + 1.2 ** (pos - 5 - j)), 6)) for j, k in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) for pos in range(12)]
CURVE_SQL = "cv(k, pos, q, p) AS (VALUES " + ", ".join(f"('{k}', {pos}, {q}::DOUBLE, {p}::DOUBLE)" for k, pos, q, p in CURVES) + ")"


@query(f"WITH {CURVE_SQL}, o AS (SELECT o_orderkey, o_orderpriority AS k, (o_custkey % 7)::DOUBLE AS c FROM orders), b AS (SELECT o.*, q, p, (q + 5 + c) * p AS u, row_number() OVER (PARTITION BY o_orderkey ORDER BY (q + 5 + c) * p DESC, pos) AS rn FROM o JOIN cv USING (k)) SELECT o_orderkey, q AS best_q, round(p, 6) AS best_p, round(u, 6) AS best_u FROM b WHERE rn = 1")
def argmax_grid(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("k"), F.expr("cast(o_custkey % 7 as double)").alias("c"))
    found = grid.argmax_on_curve(o, spark.createDataFrame(CURVES, "k string, pos int, q double, p double"), "k", "c", 5.0)
    return found.where("best_q is not null").select("o_orderkey", "best_q", r6("best_p").alias("best_p"), r6("best_u").alias("best_u"))


@query("WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 5 END AS g, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice - 150000 END AS dist FROM orders) SELECT g AS outcome, count(*) AS n, CAST(sum(CASE WHEN coalesce(CASE WHEN g = 3 THEN dist > 1e-6 ELSE dist >= -1e-6 END, false) THEN 1 ELSE 0 END) AS BIGINT) AS won FROM o GROUP BY 1")
def win_rule_groups(spark, sf):
    g = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 3).otherwise(5)
    o = table(spark, sf, "orders").select(g.alias("outcome"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") - 150000).alias("dist"))
    return o.groupBy("outcome").agg(F.count("*").alias("n"), F.sum(grid.wins(F.col("outcome"), F.col("dist")).cast("long")).alias("won"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg((abs(o_totalprice - 150000) <= 50000)::INT), 6) AS share, avg((abs(o_totalprice - 150000) <= 50000)::INT) >= 0.25 AS passes FROM orders GROUP BY 1")
def replay_gate(spark, sf):
    share = F.avg((F.abs(F.col("o_totalprice") - 150000) <= 50000).cast("double"))
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(r6(share).alias("share"), (share >= 0.25).alias("passes"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_totalprice AS v FROM orders), w AS (SELECT unnest(range(0, 11)) AS k), r AS (SELECT m, k, k * 40000.0::DOUBLE AS width, avg((v >= k * 40000)::INT) AS rate FROM o, w GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY abs(rate - 0.5), k) AS rn FROM r)
 SELECT m AS month, width, round(rate, 6) AS rate FROM x WHERE rn = 1""")
def frontier_match(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("v"))
    rates = o.groupBy("month").agg(*[F.avg((F.col("v") >= k * 40000).cast("double")).alias(f"r{k}") for k in range(11)])
    each = rates.select("month", F.posexplode(F.array(*[f"r{k}" for k in range(11)])).alias("k", "rate"))
    return each.groupBy("month").agg(F.min_by(F.struct((F.col("k") * 40000.0).alias("width"), "rate"), F.struct(F.abs(F.col("rate") - 0.5), "k")).alias("b")).select("month", "b.width", r6("b.rate").alias("rate"))


@query(f"WITH {PANEL}, s AS (SELECT d, sum(value) AS v FROM p GROUP BY d) SELECT d, round(sum(v) OVER (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS gross5 FROM s")
def gross_trailing(spark, sf):
    s = panel(spark, sf).groupBy("d").agg(F.sum("value").alias("v"))
    return s.select("d", F.round(F.sum("v").over(Window.orderBy("d").rowsBetween(-4, 0)), 4).alias("gross5"))


@query("WITH s AS (SELECT s_nationkey AS k, avg(s_acctbal) AS a, count(*)::DOUBLE AS b, max(s_acctbal) AS c FROM supplier GROUP BY 1) SELECT k, round(a, 6) AS a, b, round(c, 6) AS c FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND (y.a > x.a OR y.b > x.b OR y.c > x.c))")
def pareto_front(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("a"), F.count("*").cast("double").alias("b"), F.max("s_acctbal").alias("c"))
    x, y = s.alias("x"), F.broadcast(s.alias("y"))
    front = x.join(y, F.expr("y.a >= x.a and y.b >= x.b and y.c >= x.c and (y.a > x.a or y.b > x.b or y.c > x.c)"), "left_anti")
    return front.select("k", r6("a").alias("a"), "b", r6("c").alias("c"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS setting, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT a.month, b.setting, sum(b.s) / sum(b.n) AS mean FROM (SELECT DISTINCT month FROM m) a JOIN m b ON b.month < a.month GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY mean DESC, setting) AS rn FROM r)
 SELECT month, setting AS pick FROM x WHERE rn = 1""")
def walk_forward_pick(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("setting")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    grid_ = m.select("month").distinct().join(F.broadcast(m.select("setting").distinct()))
    w = Window.partitionBy("setting").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    r = grid_.join(m, ["month", "setting"], "left").withColumn("mean", F.sum("s").over(w) / F.sum("n").over(w)).where("mean is not null")
    return r.groupBy("month").agg(F.min_by("setting", F.struct(-F.col("mean"), "setting")).alias("pick"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def topk_abs(spark, sf):
    return table(spark, sf, "customer").orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("SELECT s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def union_by_name(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return s.unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")), allowMissingColumns=True)


@query("(SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customer only' FROM customer EXCEPT SELECT s_nationkey, 'customer only' FROM supplier)")
def intersect_except(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).union(c.subtract(s).withColumn("kind", F.lit("customer only")))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1")
def json_props(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("n"))


@query("SELECT CASE WHEN p_retailprice IS NULL THEN 'UNKNOWN' WHEN p_retailprice < 950 THEN '<950' WHEN p_retailprice < 1200 THEN '<1200' ELSE 'high' END AS bucket, CASE WHEN p_size <= 0 THEN 'NA' WHEN p_size <= 10 THEN 's' WHEN p_size <= 30 THEN 'm' WHEN p_size <= 50 THEN 'l' ELSE 'NA' END AS size, count(*) AS n FROM part GROUP BY 1, 2")
def bucket_ladders(spark, sf):
    p = table(spark, sf, "part").select(S.ladder(F.col("p_retailprice"), [950, 1200], ["<950", "<1200", "high"]).alias("bucket"), S.cut(F.col("p_size"), [0, 10, 30, 50], ["s", "m", "l"]).alias("size"))
    return p.groupBy("bucket", "size").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate AS a, max(o_orderdate) OVER () AS b FROM orders), d AS (SELECT o_orderkey, a, b, least(day(a), 30) AS d1, day(b) AS d2 FROM o) SELECT o_orderkey, CAST(360 * (year(b) - year(a)) + 30 * (month(b) - month(a)) + CASE WHEN d2 = 31 AND d1 = 30 THEN 30 ELSE d2 END - d1 AS INT) AS days FROM d""")
def day_count_30_360(spark, sf):
    o = table(spark, sf, "orders")
    last = o.agg(F.max("o_orderdate").alias("b"))
    return o.join(F.broadcast(last)).select("o_orderkey", S.days_30_360(F.col("o_orderdate"), F.col("b")).cast("int").alias("days"))


@query("SELECT o_orderkey, (o_orderstatus = 'O')::INT::DOUBLE AS is_o, (o_orderstatus = 'P')::INT::DOUBLE AS is_p FROM orders")
def one_hot_reference(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *[(F.col("o_orderstatus") == s).cast("double").alias(f"is_{s.lower()}") for s in ("O", "P")])


@query(f"WITH {PANEL}, pool AS (SELECT quantile_cont(value, 0.9) AS q, 'x' AS j FROM p), c AS (SELECT event_type, d, quantile_cont(value, 0.9) AS q, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 20) SELECT p.user_id, p.d, round(coalesce(c.q, pool.q), 6) AS q90 FROM p LEFT JOIN c ON p.event_type = c.event_type AND p.d = c.d, pool")
def grid_quantiles_fallback(spark, sf):
    p = panel(spark, sf)
    pool = p.agg(F.percentile("value", F.lit(0.9)).alias("q0"))
    cells = p.groupBy("event_type", "d").agg(F.percentile("value", F.lit(0.9)).alias("q"), F.count("*").alias("n")).where("n >= 20")
    return p.join(cells, ["event_type", "d"], "left").join(F.broadcast(pool)).select("user_id", "d", r6(F.coalesce("q", "q0")).alias("q90"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS win_old, round(avg((o_totalprice > 120000)::INT), 6) AS win_new, CAST(sum((o_orderstatus = 'F' AND o_totalprice > 120000)::INT) AS BIGINT) AS kept, CAST(sum((o_orderstatus <> 'F' AND o_totalprice > 120000)::INT) AS BIGINT) AS gained, CAST(sum((o_orderstatus = 'F' AND NOT o_totalprice > 120000)::INT) AS BIGINT) AS given_up, round(sum(CASE WHEN o_totalprice > 120000 THEN o_totalprice ELSE 0 END - CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 1) AS delta FROM orders GROUP BY 1")
def scorecard_pair(spark, sf):
    old, new, v = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 120000, F.col("o_totalprice")
    n = lambda c: F.sum(c.cast("long"))
    delta = F.sum(F.when(new, v).otherwise(0.0) - F.when(old, v).otherwise(0.0))
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), r6(F.avg(old.cast("double"))).alias("win_old"), r6(F.avg(new.cast("double"))).alias("win_new"), n(old & new).alias("kept"), n(~old & new).alias("gained"), n(old & ~new).alias("given_up"), F.round(delta, 1).alias("delta"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(bit_xor(o_orderkey * 31 + o_custkey) AS BIGINT) AS fingerprint FROM orders")
def table_fingerprint(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.bit_xor(F.col("o_orderkey") * 31 + F.col("o_custkey")).alias("fingerprint"))
