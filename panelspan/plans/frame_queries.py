"""Queries of projections, filters, point-in-time joins, aggregates, windows and scalar functions over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import special as X
from ..operators import asof, match, measure, series, shape
from ..operators import window as W
from ..sources import pull, store
from .frames import PANEL, TAPE, panel, table, tape
from .registry import Registry, r4, r6

query = Registry()
DAY = "CAST(o_orderdate AS DATE)"


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))


@query("SELECT p_partkey, CAST(NULL AS DOUBLE) AS p_absent, CAST(p_size AS DOUBLE) AS p_size FROM part")
def reindex_columns(spark, sf):
    return shape.reindex(table(spark, sf, "part"), {"p_partkey": "bigint", "p_absent": "double", "p_size": "double"})


@query("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, o_orderkey % 3 + 1) AS DOUBLE) AS rank FROM orders")
def safe_numeric_cast(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.substr("o_orderpriority", F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")).try_cast("double").alias("rank"))


SPOILT = "s AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'nan'::DOUBLE WHEN event_id % 7 = 2 THEN 'inf'::DOUBLE ELSE value END AS v FROM events)"


def _spoilt(spark, sf):
    k = F.col("event_id") % 7
    return table(spark, sf, "events").select("event_id", F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).otherwise(F.col("value")).alias("v"))


@query(f"WITH {SPOILT} SELECT event_id, v FROM s WHERE v IS NOT NULL AND isfinite(v)")
def finite_filter(spark, sf):
    return shape.drop_missing(_spoilt(spark, sf), ["v"])


@query(f"WITH {SPOILT} SELECT event_id % 10 AS g, round(avg(v), 6) AS mean, count(v) AS n FROM s WHERE v IS NULL OR isfinite(v) GROUP BY 1")
def mean_without_nan(spark, sf):
    s = _spoilt(spark, sf).withColumn("v", S.finite(F.col("v")))
    return s.groupBy((F.col("event_id") % 10).alias("g")).agg(r6(F.avg("v")).alias("mean"), F.count("v").alias("n"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 0 AND p_retailprice > 1e-8")
def positive_risk(spark, sf):
    return table(spark, sf, "part").where("p_size > 0 and p_retailprice > 1e-8").select("p_partkey", "p_size", "p_retailprice")


@query(f"WITH {PANEL}, g AS (SELECT user_id, d, date_diff('day', lag(d) OVER (PARTITION BY user_id ORDER BY d), d) AS gap FROM p) SELECT user_id, d, CAST(gap AS INTEGER) AS gap FROM g WHERE coalesce(gap, 1) <= 2")
def gap_filter_null_tolerant(spark, sf):
    p = panel(spark, sf).select("user_id", "d", F.datediff("d", F.lag("d").over(Window.partitionBy("user_id").orderBy("d"))).alias("gap"))
    return p.where(F.coalesce("gap", F.lit(1)) <= 2)


@query(f"WITH {SPOILT} SELECT event_id, CASE WHEN isfinite(v) THEN v END AS v FROM s WHERE NOT coalesce(CASE WHEN isfinite(v) THEN v END > 50, false)")
def negated_rule_keeps_missing(spark, sf):
    return shape.excluding(_spoilt(spark, sf).withColumn("v", S.finite(F.col("v"))), F.col("v") > 50)


@query(f"WITH {TAPE}, m AS (SELECT *, median(value) OVER (PARTITION BY d) AS med FROM t), x AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY d) AS mad FROM m) SELECT event_id, value FROM x WHERE abs(value - med) <= 1.5 * mad")
def tape_mad(spark, sf):
    day = Window.partitionBy("d")
    t = tape(spark, sf).withColumn("med", F.median("value").over(day)).withColumn("dev", F.abs(F.col("value") - F.col("med")))
    return t.withColumn("mad", F.median("dev").over(day)).where("dev <= 1.5 * mad").select("event_id", "value")


@query(f"WITH {PANEL}, c AS (SELECT d, value - lag(value) OVER (PARTITION BY user_id ORDER BY d) AS chg FROM p) SELECT d, count(*) AS n, round(avg((abs(chg) > 40)::INT), 6) AS share, avg((abs(chg) > 40)::INT) > 0.3 AS repriced FROM c WHERE chg IS NOT NULL GROUP BY d")
def repricing_days(spark, sf):
    c = panel(spark, sf).select("d", (F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("d"))).alias("chg")).where("chg is not null")
    share = F.avg((F.abs("chg") > 40).cast("double"))
    return c.groupBy("d").agg(F.count("*").alias("n"), r6(share).alias("share"), (share > 0.3).alias("repriced"))


@query("SELECT feature FROM (SELECT 'l_quantity' AS feature, count(DISTINCT l_quantity) AS k FROM lineitem WHERE l_shipdate < DATE '1998-01-01' UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem WHERE l_shipdate < DATE '1998-01-01' UNION ALL SELECT 'flat', 1) WHERE k > 1")
def usable_features(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("flat", F.lit(1.0))
    found = shape.usable_features(l, ["l_quantity", "l_tax", "flat"], F.col("l_shipdate") < "1998-01-01")
    return spark.createDataFrame([(c,) for c in found], "feature string")


@query(f"""WITH o AS (SELECT o_custkey, {DAY} AS d, o_orderkey, o_orderstatus FROM orders), c AS (SELECT UNNEST([DATE '1996-01-01', DATE '1998-01-01', DATE '2000-01-01']) AS cut),
 x AS (SELECT o_custkey, cut, max((d, o_orderkey, o_orderstatus)) FILTER (d < cut) AS seen, max((d, o_orderkey, o_orderstatus)) AS latest FROM o, c GROUP BY 1, 2) SELECT o_custkey, cut, coalesce(seen, latest)[3] AS status FROM x""")
def point_in_time_dimension(spark, sf):
    cuts = spark.sql("SELECT explode(array(DATE '1996-01-01', DATE '1998-01-01', DATE '2000-01-01')) AS cut")
    return shape.last_before(_orders(spark, sf), "o_custkey", "d", cuts, "cut", ["o_orderkey", "o_orderstatus"]).select("o_custkey", "cut", F.col("o_orderstatus").alias("status"))


@query("SELECT DISTINCT regexp_replace(p_brand, '^Brand#', '') AS symbol FROM part WHERE p_type LIKE 'ECONOMY%'")
def symbol_discovery(spark, sf):
    return pull.symbols(table(spark, sf, "part"), "p_brand", "Brand#", F.col("p_type").startswith("ECONOMY"))


@query("SELECT CAST(1994 + i AS VARCHAR) AS pkey, CAST(b AS BIGINT) AS batch, CAST((1994 + i) * 1000 + s AS BIGINT) AS mark, 'S' || s AS symbol FROM range(3) a(i), range(7) x(s), range(3) z(b) WHERE b = s // 3")
def batched_pull(spark, sf):
    def fetch(pkey: str, symbols: list[str]) -> list[tuple[str, int]]:
        return [(s, int(pkey) * 1000 + int(s[1:])) for s in symbols]

    return pull.batched(spark, [str(1994 + k) for k in range(3)], [f"S{k}" for k in range(7)], 3, fetch, "symbol string, mark long")


@query("""WITH m AS (SELECT l_suppkey AS "CUSIP", CAST(l_shipdate AS DATE) AS "DATE", l_tax AS y, l_returnflag AS src, CASE WHEN l_linenumber % 3 > 0 THEN l_orderkey END AS pub, l_linenumber AS seq, l_partkey FROM lineitem WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'),
 u AS (SELECT median(abs(y)) < 1 AS dec FROM m WHERE isfinite(y)), r AS (SELECT m.*, row_number() OVER (PARTITION BY "CUSIP", "DATE" ORDER BY src DESC NULLS LAST, pub DESC NULLS LAST, seq DESC NULLS LAST, l_partkey DESC) AS k FROM m)
 SELECT "CUSIP" AS cusip, "DATE" AS d, CASE WHEN dec THEN y * 100 ELSE y END AS y FROM r, u WHERE k = 1""")
def closing_marks(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cusip"), F.to_date("l_shipdate").alias("d"), F.col("l_tax").alias("y"), F.col("l_returnflag").alias("source"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_orderkey")).alias("published"), F.col("l_linenumber").alias("seq"), "l_partkey")
    marks, _ = store.closing_marks(l, ident="cusip", date="d", level="y", order=["source", "published", "seq", "l_partkey"], window=("1996-01-01", "1996-12-31"))
    return marks.select("cusip", "d", "y")


@query("""WITH m AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') SELECT count(*) AS rows_read, count(DISTINCT (l_suppkey, d)) AS rows_kept, count(DISTINCT l_suppkey) AS idents, count(DISTINCT d) AS dates FROM m""")
def closing_marks_audit(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cusip"), F.to_date("l_shipdate").alias("d"), F.col("l_tax").alias("y"), "l_orderkey", "l_linenumber")
    return store.closing_marks(l, ident="cusip", date="d", level="y", order=["l_orderkey", "l_linenumber"], window=("1996-01-01", "1996-12-31"))[1]


@query("""SELECT p_brand AS key, CAST(pos AS INTEGER) AS pos, round((pos * 0.5 * 2.0 + 1.0) * 100, 6) AS quantile_bp, round(0.9 - 0.2 * pos, 6) AS prob FROM (SELECT DISTINCT p_brand FROM part), range(4) r(pos)""")
def curve_snapshots(spark, sf):
    inner = F.to_json(F.struct(F.array(*[F.lit(0.5 * k) for k in range(4)]).alias("quantiles"), F.lit(2.0).alias("stdev"), F.lit(1.0).alias("mean"), F.array(*[F.lit(0.9 - 0.2 * k) for k in range(4)]).alias("probabilities")))
    lines = table(spark, sf, "part").select("p_brand").distinct().select(F.col("p_brand").alias("file"), F.concat(F.lit('{"'), "p_brand", F.lit('":'), inner, F.lit("}")).alias("json"))
    return store.read_curves(lines).select("key", "pos", r6("quantile_bp").alias("quantile_bp"), r6("prob").alias("prob"))


@query(f"""WITH n AS (SELECT o_orderkey % 1000 AS k, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 1000 <> 13) SELECT k, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM n GROUP BY k""")
def incremental_merge(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 1000 != 13, F.col("o_orderkey") % 1000).alias("k"), "o_orderkey", "o_totalprice")
    half = F.col("o_orderkey") % 2 == 0
    return store.merge_keep_last(o.where(half), o.where(~half), ["k"], ["o_orderkey"])


@query("SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 4 = 2 AS flag FROM orders WHERE o_orderkey % 4 <> 3")
def mixed_booleans(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, " Yes").when(k == 1, "false").when(k == 2, "1.0").otherwise(None)
    return table(spark, sf, "orders").select("o_orderkey", S.flag(text).alias("flag")).where("flag is not null")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def sniffed_dates(spark, sf):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return table(spark, sf, "orders").select("o_orderkey", S.date_of(text).alias("d"), F.to_date("o_orderdate").alias("real")).select("o_orderkey", F.when(F.col("real") >= "2000-01-01", F.col("d")).otherwise(F.when(k < 2, F.col("real"))).alias("d"))


@query("SELECT p_partkey, ['AAA', 'AA+', 'AA', 'AA-', 'A+', 'A', 'A-', 'BBB+', 'BBB', 'BBB-', 'BB+', 'BB', 'BB-', 'B+', 'B', 'B-', 'CCC+', 'CCC', 'CCC-', 'CC', 'C', 'D'][p_size % 22 + 1] AS rating, CAST(21 - p_size % 22 AS INTEGER) AS number FROM part")
def rating_scale(spark, sf):
    given = F.get(F.array(*map(F.lit, S.RATINGS)), (F.col("p_size") % 22).cast("int"))
    r = X.rating_with_fallback(F.when(F.col("p_partkey") % 2 == 0, F.lower(given)).otherwise("n/a"), given)
    return table(spark, sf, "part").select("p_partkey", r.alias("rating"), S.rating_number(r).alias("number"))


# ---- joins


@query(f"""WITH {TAPE}, p AS (SELECT DISTINCT user_id, ts, value FROM t WHERE side = 'P'), s AS (SELECT event_id, user_id, ts FROM t WHERE side = 'S'),
 f AS (SELECT s.event_id, s.user_id, s.ts, arg_min(p.value, p.ts) AS ahead FROM s LEFT JOIN p ON p.user_id = s.user_id AND p.ts >= s.ts GROUP BY ALL), b AS (SELECT s.event_id, arg_max(p.value, p.ts) AS back FROM s LEFT JOIN p ON p.user_id = s.user_id AND p.ts < s.ts GROUP BY ALL)
 SELECT event_id, coalesce(ahead, back) AS mark FROM f JOIN b USING (event_id)""")
def asof_forward_then_back(spark, sf):
    t = tape(spark, sf)
    p = t.where("side = 'P'").select("user_id", F.col("ts").alias("at"), "value").distinct()
    return asof.asof_either(t.where("side = 'S'").select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "at", ["value"]).select("event_id", F.col("asof_value").alias("mark"))


@query(f"""WITH {PANEL} SELECT a.user_id, a.d, arg_max(b.value, b.d) AS prior FROM p a LEFT JOIN p b ON a.user_id = b.user_id AND b.d <= a.d - 2 AND b.d >= a.d - 5 GROUP BY 1, 2""")
def asof_minimum_age(spark, sf):
    p = panel(spark, sf)
    found = asof.asof_aged(p.select("user_id", "d"), p.select("user_id", F.col("d").alias("seen"), "value"), ["user_id"], "d", "seen", ["value"], 2, 5)
    return found.select("user_id", "d", F.col("asof_value").alias("prior"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END AS weight FROM orders")
def map_lookup(spark, sf):
    return shape.lookup(table(spark, sf, "orders"), "o_orderpriority", {"1-URGENT": 1, "2-HIGH": 2}, "weight", 9).select("o_orderkey", "weight")


@query("SELECT a.c_custkey, a.c_acctbal, b.s_acctbal AS c_acctbal_right FROM customer a LEFT JOIN supplier b ON a.c_custkey = b.s_suppkey")
def suffixed_join(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return shape.single_match(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), s, ["c_custkey"])


BD = "(CAST(floor(({0} - DATE '1970-01-05') / 7.0) AS INTEGER) * 5 + least(({0} - DATE '1970-01-05') % 7, 4))"


@query(f"""WITH l AS (SELECT l_suppkey AS k, CAST(l_quantity AS BIGINT) AS q, CAST(l_shipdate AS DATE) AS d, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS f FROM lineitem),
 a AS MATERIALIZED (SELECT * FROM l WHERE f = 'R'), b AS MATERIALIZED (SELECT * FROM l WHERE f = 'A'),
 t1 AS MATERIALIZED (SELECT x.id AS aid, y.id AS bid, 1 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY k, q, d ORDER BY id) AS n FROM a) x JOIN (SELECT *, row_number() OVER (PARTITION BY k, q, d ORDER BY id) AS n FROM b) y USING (k, q, d, n)),
 a2 AS MATERIALIZED (SELECT * FROM a WHERE id NOT IN (SELECT aid FROM t1)), b2 AS MATERIALIZED (SELECT * FROM b WHERE id NOT IN (SELECT bid FROM t1)),
 m2 AS (SELECT a2.id AS aid, b2.id AS bid, abs(b2.q::DOUBLE / a2.q - 1) AS gap FROM a2 JOIN b2 USING (k, d) WHERE abs(b2.q::DOUBLE / a2.q - 1) <= 0.25),
 t2 AS MATERIALIZED (SELECT aid, bid, 2 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY gap, bid) AS i, row_number() OVER (PARTITION BY bid ORDER BY gap, aid) AS j FROM m2) WHERE i = 1 AND j = 1),
 m3 AS (SELECT x.id AS aid, y.id AS bid FROM (SELECT *, {BD.format('d')} AS n FROM a2 WHERE id NOT IN (SELECT aid FROM t2)) x JOIN (SELECT *, {BD.format('d')} AS n FROM b2 WHERE id NOT IN (SELECT bid FROM t2)) y ON x.k = y.k AND x.q = y.q AND abs(x.n - y.n) = 1),
 t3 AS (SELECT aid, bid, 3 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY bid) AS i, row_number() OVER (PARTITION BY bid ORDER BY aid) AS j FROM m3) WHERE i = 1 AND j = 1)
 SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3""")
def tiered_match(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("long").alias("q"), F.to_date("l_shipdate").alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag")
    a, b = (l.where(F.col("l_returnflag") == f).withColumnRenamed("id", n) for f, n in (("R", "aid"), ("A", "bid")))
    return match.tiered_match(a, b, ["k"], "q", "d", "aid", "bid")


# ---- aggregates


@query("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b, o_totalprice AS x, o_custkey AS y FROM orders)
 SELECT count(*) AS n, round(corr(x::DOUBLE, y::DOUBLE), 6) AS pearson, round(corr(a::DOUBLE, b::DOUBLE), 6) AS spearman FROM r""")
def pooled_correlations(spark, sf):
    return measure.pooled_correlations(table(spark, sf, "orders"), "o_totalprice", "o_custkey").select("n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query("""WITH v AS (SELECT l_suppkey AS k, floor((l_extendedprice - 50000) / 100) AS b FROM lineitem WHERE abs(l_extendedprice - 50000) <= 30000), c AS (SELECT k, b, count(*) AS n FROM v GROUP BY 1, 2),
 u AS (SELECT k, b, sum(n) OVER (PARTITION BY k ORDER BY b) AS upto, sum(n) OVER (PARTITION BY k) AS n FROM c) SELECT k, CAST(n AS BIGINT) AS n, (min(b) + 0.5) * 100 AS level FROM u WHERE upto * 2 >= n AND n >= 3 GROUP BY k, n""")
def histogram_medians(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_extendedprice") - 50000).alias("dev"))
    return series.histogram_median(l, ["k"], "dev", 100.0, 30000.0).select("k", "n", "level")


@query("""WITH w AS (SELECT l_returnflag AS g, l_suppkey AS s, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(w) DESC, s) AS k FROM w)
 SELECT g, round(sum(w * w) / pow(sum(abs(w)), 2), 6) AS hhi, round(sum(abs(w)) FILTER (k <= 5) / sum(abs(w)), 6) AS top5, round(pow(sum(abs(w)), 2) / sum(w * w), 4) AS breadth, round(sum(abs(w)), 4) AS gross, round(sum(w), 4) AS net, count(*) FILTER (w > 0) AS long_names, count(*) FILTER (w < 0) AS short_names FROM r GROUP BY g""")
def concentration_full(spark, sf):
    signed = F.sum(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity")))
    w = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("s")).agg(signed.alias("w"))
    return measure.concentration(w, ["g"], "s", "w").select("g", r6("hhi").alias("hhi"), r6("top5").alias("top5"), r4("breadth").alias("breadth"), r4("gross").alias("gross"), r4("net").alias("net"), "long_names", "short_names")


R2 = f"WITH {PANEL}, f AS (SELECT user_id, d, value - 50 AS y, lag(value) OVER (PARTITION BY user_id ORDER BY d) - 50 AS yhat FROM p), v AS (SELECT * FROM f WHERE yhat IS NOT NULL)"


@query(R2 + """, n AS (SELECT 1 - sum((y - yhat) * (y - yhat)) / nullif(sum(y * y), 0) AS r FROM v GROUP BY user_id HAVING count(*) >= 5), t AS (SELECT 1 - sum((y - yhat) * (y - yhat)) / nullif(sum(y * y), 0) AS r FROM v GROUP BY d)
 SELECT round((SELECT 1 - sum((y - yhat) * (y - yhat)) / sum(y * y) FROM v), 6) AS total, round((SELECT median(r) FROM n), 6) AS median_name, round((SELECT avg(r) FROM t), 6) AS mean_date, round((SELECT sum(abs(y - yhat)) / sum(abs(y)) FROM v), 6) AS pricing_error""")
def r2_family(spark, sf):
    f = panel(spark, sf).select("user_id", "d", (F.col("value") - 50).alias("y"), (F.lag("value").over(Window.partitionBy("user_id").orderBy("d")) - 50).alias("yhat")).where("yhat is not null")
    return measure.r2_family(f, "user_id", "d", "y", "yhat", 5).select(*[r6(c).alias(c) for c in ("total", "median_name", "mean_date", "pricing_error")])


@query(f"""WITH {PANEL}, s AS (SELECT d, avg(value) - 50 AS v FROM p GROUP BY d), u AS (SELECT row_number() OVER (ORDER BY d) AS k, v - avg(v) OVER () AS u, avg(v) OVER () AS m, count(*) OVER () AS n FROM s), l AS (SELECT DISTINCT n, m, CAST(least(floor(4 * pow(n / 100.0, 2.0 / 9)), n - 1) AS INTEGER) AS lags FROM u),
 g AS (SELECT sum(a.u * a.u) AS g0 FROM u a), h AS (SELECT coalesce(sum(2 * (1 - (b.k - a.k) / (l.lags + 1.0)) * a.u * b.u), 0) AS gl FROM u a JOIN u b ON b.k > a.k JOIN l ON b.k - a.k <= l.lags) SELECT n, lags, round(m, 6) AS mean, round(m / sqrt((g0 + gl) / n / n), 5) AS t FROM l, g, h""")
def newey_west_default_lag(spark, sf):
    s = panel(spark, sf).groupBy("d").agg((F.avg("value") - 50).alias("v"))
    return series.newey_west(s, "d", "v").select("n", "lags", r6("mean").alias("mean"), F.round("t", 5).alias("t"))


@query(f"""WITH o AS (SELECT date_trunc('week', o_orderdate) AS w, o_totalprice / 1000 - 150 AS v FROM orders), a AS (SELECT avg(v) AS m, count(*) AS n FROM o), c AS (SELECT w, sum(v) - count(*) * any_value(m) AS u FROM o, a GROUP BY w), u AS (SELECT u, row_number() OVER (ORDER BY w) AS k, count(*) OVER () AS g FROM c),
 l AS (SELECT DISTINCT g, CAST(least(floor(4 * pow(g / 100.0, 2.0 / 9)), g - 1) AS INTEGER) AS lags FROM u), h AS (SELECT coalesce(sum(2 * (1 - (y.k - x.k) / (l.lags + 1.0)) * x.u * y.u), 0) AS gl FROM u x JOIN u y ON y.k > x.k JOIN l ON y.k - x.k <= l.lags)
 SELECT n, g AS clusters, round(m, 5) AS mean, round(m * n / sqrt((SELECT sum(u * u) FROM u) + gl), 4) AS t FROM a, l, h""")
def week_clustered_t(spark, sf):
    o = table(spark, sf, "orders").select(F.date_trunc("week", "o_orderdate").alias("w"), (F.col("o_totalprice") / 1000 - 150).alias("v"))
    return series.clustered_t(o, "w", "v").select("n", "clusters", F.round("mean", 5).alias("mean"), r4("t").alias("t"))


@query()
def moving_block_bootstrap(spark, sf):
    return series.block_bootstrap_t(panel(spark, sf).groupBy("d").agg((F.avg("value") - 49).alias("v")), "d", "v")


@query(f"""WITH {PANEL}, s AS (SELECT d, avg(value) - 50 AS r, count(*) / 100.0 AS turn FROM p GROUP BY d) SELECT count(*) AS days, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS sharpe, round(avg(r - 0.5 * turn) / stddev_samp(r - 0.5 * turn) * sqrt(252), 5) AS net_sharpe, round(avg(r) / avg(turn), 5) AS break_even FROM s""")
def sharpe_net_of_cost(spark, sf):
    s = panel(spark, sf).groupBy("d").agg((F.avg("value") - 50).alias("r"), (F.count("*") / 100.0).alias("turn"))
    return measure.net_sharpe(s, "r", "turn", 0.5).select("days", *[F.round(c, 5).alias(c) for c in ("sharpe", "net_sharpe", "break_even")])


@query(R2 + " SELECT coalesce(user_id % 5, -1) AS slice, count(*) AS n, round(avg(abs(y)), 6) AS mae_old, round(avg(abs(y - yhat)), 6) AS mae_new, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse_new, round(1 - avg(abs(y - yhat)) / avg(abs(y)), 6) AS gain, round(avg(abs(y) - abs(y - yhat)) / stddev_samp(abs(y) - abs(y - yhat)) * sqrt(count(*)), 5) AS t FROM v GROUP BY ROLLUP (user_id % 5)")
def mae_gain_by_slice(spark, sf):
    f = panel(spark, sf).select((F.col("user_id") % 5).alias("slice"), (F.col("value") - 50).alias("y"), (F.lag("value").over(Window.partitionBy("user_id").orderBy("d")) - 50).alias("yhat")).where("yhat is not null")
    g = measure.gain_by_slice(f, "slice", F.abs("y"), F.abs(F.col("y") - F.col("yhat")))
    return g.select(F.coalesce("slice", F.lit(-1)).alias("slice"), "n", *[r6(c).alias(c) for c in ("mae_old", "mae_new", "rmse_new", "gain")], F.round("t", 5).alias("t"))


@query("""WITH c AS (SELECT l_returnflag AS g, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS u FROM lineitem) SELECT g, count(*) AS n, round(avg(u * u * u) / pow(avg(u * u), 1.5), 5) AS skewness, round(avg(u * u * u * u) / pow(avg(u * u), 2) - 3, 5) AS kurtosis FROM c GROUP BY g""")
def moments_of_shape(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.count("*").alias("n"), F.round(F.skewness("l_extendedprice"), 5).alias("skewness"), F.round(F.kurtosis("l_extendedprice"), 5).alias("kurtosis"))


@query(f"WITH {PANEL}, q AS (SELECT value, ntile(20) OVER (ORDER BY value, user_id, d) AS b FROM p) SELECT b AS bin, count(*) AS n, min(value) AS low, max(value) AS high FROM q GROUP BY b")
def quantile_quantile(spark, sf):
    q = panel(spark, sf).select("value", F.ntile(20).over(Window.orderBy("value", "user_id", "d")).alias("bin"))
    return q.groupBy("bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT count(*) AS n, md5(string_agg(x, ',' ORDER BY x)) AS fingerprint FROM (SELECT md5(concat_ws('|', n_nationkey, n_name, n_regionkey)) AS x FROM nation)")
def whole_row_fingerprint(spark, sf):
    n = table(spark, sf, "nation")
    each = n.select(F.md5(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey")).alias("x"))
    return each.agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("x")), ",")).alias("fingerprint"))


@query(f"WITH {PANEL}, z AS (SELECT least(floor(abs(value - 50) / 10), 4) AS bin, value - 50 AS e FROM p) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(e * e), 5) AS ms, round((1 / avg(e * e)) / (SELECT sum(1 / m) FROM (SELECT avg(e * e) AS m FROM z GROUP BY bin)), 6) AS weight FROM z GROUP BY bin")
def inverse_variance_weights(spark, sf):
    z = panel(spark, sf).select(F.least(F.floor(F.abs(F.col("value") - 50) / 10), F.lit(4)).cast("long").alias("bin"), (F.col("value") - 50).alias("e"))
    b = z.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col("e") * F.col("e")).alias("ms"))
    return b.select("bin", "n", F.round("ms", 5).alias("ms"), r6((1 / F.col("ms")) / F.sum(1 / F.col("ms")).over(Window.partitionBy())).alias("weight"))


@query("""WITH g AS (SELECT c_nationkey AS k, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) / count(*) AS se2 FROM customer GROUP BY 1 HAVING count(*) > 1), t AS (SELECT greatest(0, var_pop(m) - avg(se2)) AS tau2, avg(m) AS grand FROM g)
 SELECT k, n, round(m, 4) AS own, round(grand + coalesce(tau2 / nullif(tau2 + se2, 0), 0) * (m - grand), 4) AS shrunk FROM g, t""")
def empirical_bayes_means(spark, sf):
    from ..operators import robust

    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal")
    return robust.empirical_bayes(c, "k", "c_acctbal").select("k", "n", r4("own").alias("own"), r4("shrunk").alias("shrunk"))


# ---- windows, orders, sets


@query(f"""WITH {PANEL}, c AS (SELECT d, row_number() OVER (ORDER BY d) AS pos FROM (SELECT DISTINCT d FROM p)), v AS (SELECT user_id, d, value, pos FROM p JOIN c USING (d))
 SELECT user_id, d, count(value) OVER w AS have, round(sum(value) OVER w, 4) AS total FROM v WINDOW w AS (PARTITION BY user_id ORDER BY pos RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def dense_grid_windows(spark, sf):
    return series.dense_windows(panel(spark, sf), "user_id", "d", "value", 5).select("user_id", "d", "have", r4("total").alias("total"))


@query(f"""WITH {PANEL}, c AS (SELECT d, row_number() OVER (ORDER BY d) AS pos FROM (SELECT DISTINCT d FROM p)) SELECT user_id, d, CAST(max(pos) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS previous FROM p JOIN c USING (d)""")
def previous_ordinal(spark, sf):
    p = panel(spark, sf)
    c = p.select("d").distinct().withColumn("pos", F.row_number().over(Window.orderBy("d")))
    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return p.join(F.broadcast(c), "d").select("user_id", "d", F.max("pos").over(w).alias("previous"))


@query(f"""WITH {PANEL}, s AS (SELECT d, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM p GROUP BY d), x AS (SELECT d, a, b, count(*) OVER w AS n, covar_samp(a, a) OVER w AS aa, covar_samp(a, b) OVER w AS ab, covar_samp(b, b) OVER w AS bb FROM s WINDOW w AS (ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
 SELECT d, i, j, n, round(cov, 4) AS cov FROM (SELECT d, 'a' AS i, 'a' AS j, n, aa AS cov FROM x UNION ALL SELECT d, 'a', 'b', n, ab FROM x UNION ALL SELECT d, 'b', 'b', n, bb FROM x) WHERE n = 10""")
def rolling_covariances(spark, sf):
    kind = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    s = panel(spark, sf).groupBy("d").agg(kind("view").alias("a"), kind("click").alias("b"))
    return series.rolling_covariance(s, "d", ["a", "b"], 10).withColumn("cov", r4("cov"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS z FROM orders) WHERE a <= 2 OR z <= 2")
def smallest_and_largest(spark, sf):
    w = lambda c: F.row_number().over(Window.partitionBy("o_custkey").orderBy(c, "o_orderkey"))
    o = table(spark, sf, "orders").withColumns({"a": w(F.asc("o_totalprice")), "z": w(F.desc("o_totalprice"))})
    return o.where("a <= 2 or z <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p_partkey, CAST((10 < p_size)::INT + (20 < p_size)::INT + (40 < p_size)::INT AS INTEGER) AS place FROM part")
def searchsorted_places(spark, sf):
    return shape.searchsorted(table(spark, sf, "part"), "p_size", [10, 20, 40]).select("p_partkey", "place")


@query("SELECT CAST(place AS INTEGER) AS place, seg, n FROM (VALUES (0, 'MACHINERY'), (1, 'NONE SUCH'), (2, 'BUILDING')) v(place, seg) LEFT JOIN (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1) c USING (seg)")
def category_order(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    return shape.in_category_order(c, "seg", ["MACHINERY", "NONE SUCH", "BUILDING"]).select("place", "seg", "n")


@query(f"SELECT o_orderkey FROM orders WHERE substr(md5(o_orderkey || '-7'), 1, 8) < '{int(0.1 * 2**32):08x}'")
def seeded_sample(spark, sf):
    return shape.sample(table(spark, sf, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(spark, sf):
    a = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


# ---- scalar functions


@query("SELECT DISTINCT key, CASE WHEN key LIKE 'cpn3%' THEN split_part(key, '_', 1) ELSE split_part(key, '_', 1) || '_' || split_part(key, '_', 2) END AS token_group FROM (SELECT 'cpn' || (p_size % 5) || '_' || lower(split_part(p_type, ' ', 1)) || '_x' AS key FROM part)")
def token_groups(spark, sf):
    key = F.concat_ws("_", F.concat(F.lit("cpn"), F.col("p_size") % 5), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("x"))
    return table(spark, sf, "part").select(key.alias("key")).distinct().select("key", X.token_group(F.col("key")).alias("token_group"))


@query(f"""WITH o AS (SELECT o_orderkey, {DAY} AS d FROM orders) SELECT o_orderkey, CAST((SELECT count(*) FROM range(0, 21) r(i) WHERE isodow(d + CAST(i AS INTEGER)) < 6 AND i < o_orderkey % 20) AS INTEGER) AS between_days,
 (SELECT d + CAST(i AS INTEGER) FROM (SELECT i, count(*) OVER (ORDER BY i) AS k FROM range(1, 8) r(i) WHERE isodow(d + CAST(i AS INTEGER)) < 6) WHERE k = 3) AS third FROM o WHERE o_orderkey % 10 = 0""")
def business_days(spark, sf):
    o = _orders(spark, sf).where("o_orderkey % 10 = 0")
    return o.select("o_orderkey", X.business_days_between(F.col("d"), F.date_add("d", (F.col("o_orderkey") % 20).cast("int"))).alias("between_days"), X.add_business_days(F.col("d"), 3).alias("third"))


PCT = "u AS (SELECT event_id, (row_number() OVER (ORDER BY value, event_id) - 0.5) / count(*) OVER () AS u, value FROM events)"


@query(f"WITH {PCT} SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS sigma, round(ln(least(greatest(u, 1e-6), 1 - 1e-6) / (1 - least(greatest(u, 1e-6), 1 - 1e-6))), 6) AS logit FROM u")
def sigmoid_and_logit(spark, sf):
    e = table(spark, sf, "events")
    u = e.select("event_id", "value", ((F.row_number().over(Window.orderBy("value", "event_id")) - 0.5) / F.count("*").over(Window.partitionBy())).alias("u"))
    return u.select("event_id", r6(X.sigmoid((F.col("value") - 50) / 10)).alias("sigma"), r6(X.logit(F.col("u"))).alias("logit"))


@query()
def normal_scores(spark, sf):
    e = panel(spark, sf)
    return e.select("user_id", "d", X.norm_ppf((W.average_rank("value", ["d"]) - 0.5) / F.count("*").over(Window.partitionBy("d"))).alias("score"))


@query("SELECT user_id, event_id, round(exp(value / 10) / sum(exp(value / 10)) OVER (PARTITION BY user_id), 6) AS weight FROM events")
def softmax_weights(spark, sf):
    a = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") / 10).alias("s")))).alias("x"))
    a = a.select("user_id", F.explode(F.arrays_zip(F.col("x.event_id").alias("event_id"), X.softmax(F.col("x.s")).alias("weight"))).alias("z"))
    return a.select("user_id", "z.event_id", r6("z.weight").alias("weight"))


@query("""SELECT p_partkey, round(CASE WHEN p_size <= 5 THEN 1.0 WHEN p_size <= 20 THEN 1.0 + (p_size - 5) / 15.0 * 2 WHEN p_size <= 40 THEN 3.0 + (p_size - 20) / 20.0 * 1 ELSE 4.0 END, 6) AS y FROM part""")
def interpolated(spark, sf):
    arrays = [F.array(*map(F.lit, a)) for a in ([5.0, 20.0, 40.0], [1.0, 3.0, 4.0])]
    return table(spark, sf, "part").select("p_partkey", r6(X.interpolate(F.col("p_size").cast("double"), *arrays)).alias("y"))


@query("SELECT p_partkey, CASE WHEN p_size <= 1 THEN '1Y' WHEN p_size <= 2 THEN '2Y' WHEN p_size <= 3 THEN '3Y' WHEN p_size <= 5 THEN '5Y' WHEN p_size <= 10 THEN '10Y' WHEN p_size <= 15 THEN '15Y' WHEN p_size <= 20 THEN '20Y' WHEN p_size <= 25 THEN '25Y' WHEN p_size <= 30 THEN '30Y' ELSE '30Y+' END AS tenor FROM part")
def tenor_buckets(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.tenor_bucket(F.col("p_size")).alias("tenor"))


@query("SELECT l_orderkey, l_linenumber, l_tax + (l_extendedprice / 1000 - 100) / nullif(l_discount, 0) / 100 AS y FROM lineitem")
def yield_tangent(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.yield_from_price(F.col("l_tax"), F.col("l_extendedprice") / 1000, F.lit(100.0), F.col("l_discount")).alias("y"))
