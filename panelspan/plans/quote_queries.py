"""Queries of quote replay, validation and portfolio measures over the star-schema tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

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


MONTH = "strftime(o_orderdate, '%Y-%m')"


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))


@query(f"WITH {PANEL}, m AS (SELECT user_id, d, value - median(value) OVER (PARTITION BY d) AS own FROM p) SELECT user_id, d, round(own, 4) AS beyond_market FROM m")
def common_markout(spark, sf):
    return panel(spark, sf).select("user_id", "d", F.round(F.col("value") - F.median("value").over(Window.partitionBy("d")), 4).alias("beyond_market"))


@query(f"""WITH {PANEL}, l AS (SELECT d, event_type AS b, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY d) AS x FROM p), k AS (SELECT d, b, rank() OVER (PARTITION BY d, b ORDER BY x) + (count(*) OVER (PARTITION BY d, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY d, b ORDER BY y) + (count(*) OVER (PARTITION BY d, b, y) - 1) / 2.0 AS ry FROM l WHERE x IS NOT NULL),
 c AS (SELECT d, b, count(*) AS n, corr(rx::DOUBLE, ry::DOUBLE) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 5) SELECT d, round(sum(n * ic) / sum(n), 6) AS ic, CAST(sum(n) AS BIGINT) AS n FROM c WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY d""")
def bucket_ic_weighted(spark, sf):
    l = panel(spark, sf).select("d", F.col("event_type").alias("b"), F.col("value").alias("y"), F.lag("value").over(Window.partitionBy("user_id").orderBy("d")).alias("x")).where("x is not null")
    k = l.select("d", "b", W.average_rank("x", ["d", "b"]).alias("rx"), W.average_rank("y", ["d", "b"]).alias("ry"))
    c = k.groupBy("d", "b").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("ic")).where("n >= 5 and ic is not null and not isnan(ic)")
    return c.groupBy("d").agg(r6(F.sum(F.expr("n * ic")) / F.sum("n")).alias("ic"), F.sum("n").alias("n"))


@query("SELECT o_orderstatus AS term, count(*) AS n, round(sum(o_totalprice - 150000) / (SELECT count(*) FROM orders), 4) AS part FROM orders GROUP BY 1")
def outcome_terms(spark, sf):
    o = _orders(spark, sf)
    g = o.groupBy(F.col("o_orderstatus").alias("term")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice") - 150000).alias("s"))
    return g.select("term", "n", F.round(F.col("s") / F.sum("n").over(Window.partitionBy()), 4).alias("part"))


@query(f"WITH {PANEL}, days AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT d FROM p)), v AS (SELECT k, value FROM p JOIN days USING (d)) SELECT days.d, round(quantile_cont(v.value, 0.5), 6) AS centre, count(*) AS n FROM days JOIN v ON v.k < days.k AND v.k >= days.k - 5 GROUP BY 1")
def trailing_centre(spark, sf):
    p = panel(spark, sf)
    days = p.select("d").distinct().withColumn("k", F.row_number().over(Window.orderBy("d")))
    # Each day's values go to the five days after it: an equality join on the day's number.
    v = p.join(F.broadcast(days), "d").select("value", F.explode(F.sequence(F.col("k") + 1, F.col("k") + 5)).alias("k"))
    return v.join(F.broadcast(days), "k").groupBy("d").agg(r6(F.percentile("value", F.lit(0.5))).alias("centre"), F.count("*").alias("n"))


@query(f"""WITH {PANEL}, l AS (SELECT d, value AS y, lag(value) OVER w AS x, lag(value, 2) OVER w AS z FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d)), g AS (SELECT d, covar_pop(y, x) AS xy, covar_pop(y, z) AS zy, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz FROM l WHERE z IS NOT NULL GROUP BY d HAVING count(*) >= 30),
 b AS (SELECT (xy * zz - zy * xz) / nullif(xx * zz - xz * xz, 0) AS beta FROM g) SELECT count(beta) AS dates, round(avg(beta), 6) AS beta, round(sqrt(count(beta)) * avg(beta) / nullif(stddev_pop(beta), 0), 4) AS t FROM b""")
def fama_macbeth_controlled(spark, sf):
    w = Window.partitionBy("user_id").orderBy("d")
    l = panel(spark, sf).select("d", F.col("value").alias("y"), F.lag("value").over(w).alias("x"), F.lag("value", 2).over(w).alias("z")).where("z is not null")
    g = l.groupBy("d").agg(F.covar_pop("y", "x").alias("xy"), F.covar_pop("y", "z").alias("zy"), F.var_pop("x").alias("xx"), F.var_pop("z").alias("zz"), F.covar_pop("x", "z").alias("xz"), F.count("*").alias("n")).where("n >= 30")
    b = g.select((F.expr("xy * zz - zy * xz") / F.nullif(F.expr("xx * zz - xz * xz"), F.lit(0.0))).alias("beta"))
    return b.agg(F.count("beta").alias("dates"), r6(F.avg("beta")).alias("beta"), F.round(F.sqrt(F.count("beta")) * F.avg("beta") / F.nullif(F.stddev_pop("beta"), F.lit(0.0)), 4).alias("t"))


@query()
def block_bootstrap_t(spark, sf):
    """One row: mean daily value over its spread across 500 draws of five-day moving blocks. Thirty days come to the driver."""
    days = np.array([r.v for r in panel(spark, sf).groupBy("d").agg(F.avg("value").alias("v")).orderBy("d").collect()])
    size = min(5, len(days))
    rng = np.random.default_rng(11)
    starts = rng.integers(0, len(days) - size + 1, (500, -(-len(days) // size)))
    draws = days[(starts[:, :, None] + np.arange(size)).reshape(500, -1)[:, : len(days)]].mean(1)
    return spark.createDataFrame([(len(days), float(days.mean()), float(days.mean() / draws.std()))], "n long, mean double, t double")


@query(f"WITH m AS (SELECT {MONTH} AS month, count(*) AS n, sum(o_custkey) AS sx, sum(o_totalprice) AS sy, sum(o_custkey * o_custkey) AS sxx, sum(o_custkey * o_totalprice) AS sxy FROM orders GROUP BY 1), e AS (SELECT month, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT month, round((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 4) AS slope FROM e")
def walk_forward_slope(spark, sf):
    x, y = F.col("o_custkey").cast("double"), F.col("o_totalprice")
    m = _orders(spark, sf).groupBy("month").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    e = m.select("month", *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    return e.select("month", F.round(F.expr("n * sxy - sx * sy") / F.nullif(F.expr("n * sxx - sx * sx"), F.lit(0.0)), 4).alias("slope"))


@query(f"""WITH {TAPE}, u AS (SELECT DISTINCT user_id, d, side FROM t WHERE side IN ('P', 'S')), cal AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT d FROM u)), x AS (SELECT u.*, k FROM u JOIN cal USING (d)),
 only_p AS (SELECT * FROM x WHERE side = 'P' AND NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = x.user_id AND u.d = x.d AND u.side = 'S')) SELECT a.user_id, a.d AS d, b.d AS other_day FROM only_p a JOIN x b ON a.user_id = b.user_id AND b.side = 'S' AND abs(a.k - b.k) = 1""")
def adjacent_day_match(spark, sf):
    u = tape(spark, sf).where("side in ('P', 'S')").select("user_id", "d", "side").distinct()
    cal = u.select("d").distinct().withColumn("k", F.row_number().over(Window.orderBy("d")))
    x = u.join(F.broadcast(cal), "d")
    sells = x.where("side = 'S'")
    rest = x.where("side = 'P'").join(sells.select("user_id", "d"), ["user_id", "d"], "left_anti")
    near = rest.select("user_id", "d", F.explode(F.array(F.col("k") - 1, F.col("k") + 1)).alias("k"))
    return near.join(sells.select("user_id", F.col("d").alias("other_day"), "k"), ["user_id", "k"]).select("user_id", "d", "other_day")


@query("""WITH f AS (SELECT l_partkey AS k, l_shipdate, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q FROM lineitem) SELECT k AS part, l_orderkey, l_linenumber, CAST(sum(q) OVER (PARTITION BY k ORDER BY l_shipdate, l_orderkey, l_linenumber) AS DOUBLE) AS position FROM f""")
def inventory_position(spark, sf):
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", F.sum(q).over(w).cast("double").alias("position"))


@query(f"WITH {PANEL}, s AS (SELECT d, avg(value) - 49 AS r FROM p GROUP BY d), c AS (SELECT d, r, sum(r) OVER (ORDER BY d) AS cum FROM s), m AS (SELECT *, greatest(max(cum) OVER (ORDER BY d), 0) AS peak FROM c) SELECT round(sqrt(252) * avg(r) / nullif(stddev_samp(r), 0), 6) AS sharpe, round(max(peak - cum), 6) AS drawdown FROM m")
def sharpe_drawdown(spark, sf):
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    s = panel(spark, sf).groupBy("d").agg((F.avg("value") - 49).alias("r")).withColumn("cum", F.sum("r").over(w))
    m = s.withColumn("peak", F.greatest(F.max("cum").over(w), F.lit(0.0)))
    return m.agg(r6(F.sqrt(F.lit(252.0)) * F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("sharpe"), r6(F.max(F.col("peak") - F.col("cum"))).alias("drawdown"))


@query("SELECT o_orderpriority AS priority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY 1")
def crosstab(spark, sf):
    wide = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("priority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT CASE WHEN a.k IS NULL THEN 'right only' WHEN b.k IS NULL THEN 'left only' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def coverage_audit(spark, sf):
    a = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct().withColumn("a", F.lit(True))
    b = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")).distinct().withColumn("b", F.lit(True))
    side = F.when(F.col("a").isNull(), "right only").when(F.col("b").isNull(), "left only").otherwise("both")
    return a.join(b, "k", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT o_orderpriority AS k, avg(o_totalprice) FILTER (o_orderdate < DATE '1998-01-01') - 150000 AS pick, avg(o_totalprice) FILTER (o_orderdate >= DATE '1998-01-01') - 150000 AS proof FROM orders GROUP BY 1) SELECT k AS setting, round(pick, 4) AS selected, round(proof, 4) AS confirmed, sign(pick) = sign(proof) AS agrees FROM h")
def select_confirm(spark, sf):
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    h = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("setting")).agg((F.avg(F.when(early, F.col("o_totalprice"))) - 150000).alias("a"), (F.avg(F.when(~early, F.col("o_totalprice"))) - 150000).alias("b"))
    return h.select("setting", F.round("a", 4).alias("selected"), F.round("b", 4).alias("confirmed"), (F.signum("a") == F.signum("b")).alias("agrees"))


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, 0.2) AS e1, quantile_cont(o_totalprice, 0.4) AS e2, quantile_cont(o_totalprice, 0.6) AS e3, quantile_cont(o_totalprice, 0.8) AS e4 FROM orders)
 SELECT CAST((o_totalprice > e1)::INT + (o_totalprice > e2)::INT + (o_totalprice > e3)::INT + (o_totalprice > e4)::INT AS INT) AS quintile, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS won FROM orders, e GROUP BY 1""")
def quintile_cuts(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("double").alias("won"))
    edges = o.agg(F.percentile("o_totalprice", F.array(*[F.lit(k / 5) for k in range(1, 5)])).alias("e"))
    above = [(F.col("o_totalprice") > F.col("e")[k]).cast("int") for k in range(4)]
    return o.join(F.broadcast(edges)).groupBy((above[0] + above[1] + above[2] + above[3]).alias("quintile")).agg(F.count("*").alias("n"), r6(F.avg("won")).alias("won"))
