"""Queries of quote replay: requests, outcomes, curves, widths, scorecards and books over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import special as X
from ..operators import asof, grid, replay, series
from ..operators import window as W
from .frames import PANEL, TAPE, panel, table, tape
from .registry import Registry, r4, r6

query = Registry()


@query("""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice / 100000 AS y FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'), q AS (SELECT l_orderkey, l_linenumber, l_tax, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS k FROM lineitem WHERE l_returnflag <> 'N')
 SELECT o_orderkey, d, y, l_tax AS quote FROM r JOIN q ON o_orderkey = l_orderkey WHERE k = 1 AND y > 0 AND l_tax > 0""")
def request_join(spark, sf):
    final = S.flag(F.when(F.col("o_orderstatus") == "P", "No").otherwise("yes"))
    error = S.flag(F.when(F.col("o_orderpriority") == "5-LOW", "1").otherwise("0"))
    r = table(spark, sf, "orders").where(final & ~error).select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_totalprice") / 100000).alias("y"))
    q = W.keep_last(table(spark, sf, "lineitem").where("l_returnflag <> 'N'"), ["l_orderkey"], [F.col(c).desc_nulls_last() for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice")])
    return r.join(q, F.col("o_orderkey") == F.col("l_orderkey")).where("y > 0 and l_tax > 0").select("o_orderkey", "d", "y", F.col("l_tax").alias("quote"))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1995-06-30' THEN 'one' WHEN CAST(o_orderdate AS DATE) <= DATE '1997-12-31' THEN 'two' WHEN CAST(o_orderdate AS DATE) <= DATE '1999-12-31' THEN 'three' END AS file FROM orders")
def curve_in_force(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return replay.in_force(o, "d", [("1995-06-30", "one"), ("1997-12-31", "two"), ("1999-12-31", "three")]).select("o_orderkey", "file")


@query("SELECT 100.0::DOUBLE AS unit, round(avg((l_linenumber % 4 = 0)::INT), 6) AS share, count(*) AS n FROM lineitem")
def carry_unit_audit(spark, sf):
    l = table(spark, sf, "lineitem").select("l_discount", (F.col("l_discount") * 100 + F.col("l_linenumber") % 4 * 0.5).alias("carry"))
    return replay.unit_of(l, "l_discount", "carry", [1.0, 100.0, 10000.0], 0.25).select("unit", r6("share").alias("share"), "n")


OUTCOMES = "o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus = 'F' AS won, o_totalprice / 1000 AS own, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000 + o_custkey % 5 - 2 END AS cover, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 1000 + o_custkey % 7 - 3 END AS printed FROM orders), g AS (SELECT *, CASE WHEN won AND cover IS NOT NULL THEN 1 WHEN won THEN 2 WHEN printed < own THEN 3 WHEN printed IS NOT NULL THEN 4 ELSE 5 END AS grp FROM o), h AS (SELECT *, CASE grp WHEN 1 THEN greatest(cover, own) WHEN 2 THEN own WHEN 3 THEN printed END AS threshold FROM g)"


def _outcomes(spark, sf):
    o = table(spark, sf, "orders").withColumns({
        "won": F.col("o_orderstatus") == "F",
        "own": F.col("o_totalprice") / 1000,
        "cover": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 1000 + F.col("o_custkey") % 5 - 2),
        "printed": F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 1000 + F.col("o_custkey") % 7 - 3),
    })
    return replay.outcomes(o, "won", "own", "cover", "printed")


@query(f"""WITH {OUTCOMES} SELECT CAST(grp AS INTEGER) AS "group", count(*) AS n, round(avg(threshold - own), 5) AS beyond, CAST(sum((grp <= 3 AND coalesce(CASE WHEN grp = 3 THEN 100 * (threshold - (own - 1.5)) > 1e-6 ELSE 100 * (threshold - (own - 1.5)) >= -1e-6 END, false))::INT) AS BIGINT) AS wins_lower FROM h GROUP BY 1""")
def outcome_groups(spark, sf):
    r = replay.replayed(_outcomes(spark, sf).withColumn("quote", F.col("own") - 1.5), "quote", "w")
    return r.groupBy("group").agg(F.count("*").alias("n"), F.round(F.avg(F.col("threshold") - F.col("own")), 5).alias("beyond"), F.sum(F.col("w").cast("long")).alias("wins_lower"))


SCORE = f"""{OUTCOMES}, e AS (SELECT *, own AS q_old, own - (o_custkey % 4) + 1 AS q_new, CASE WHEN o_orderkey % 11 > 0 THEN (o_custkey % 13 - 6) / 4.0 END AS m, 0.25 AS common, (o_orderkey % 9 + 1)::DOUBLE AS size FROM h WHERE grp <= 3),
 w AS (SELECT *, CASE WHEN grp = 3 THEN 100 * (threshold - q_old) > 1e-6 ELSE 100 * (threshold - q_old) >= -1e-6 END AS a, CASE WHEN grp = 3 THEN 100 * (threshold - q_new) > 1e-6 ELSE 100 * (threshold - q_new) >= -1e-6 END AS b FROM e),
 x AS (SELECT *, CASE WHEN NOT ((a OR b) AND m IS NULL) THEN (CASE WHEN b THEN 100 * (q_new - own) + m ELSE 0 END) - (CASE WHEN a THEN 100 * (q_old - own) + m ELSE 0 END) END AS moved, CASE WHEN NOT ((a OR b) AND m IS NULL) THEN (CASE WHEN b THEN 100 * (q_new - own) + CASE WHEN a THEN m ELSE common END ELSE 0 END) - (CASE WHEN a THEN 100 * (q_old - own) + m ELSE 0 END) END AS mc FROM w),
 cap AS (SELECT quantile_cont(abs(moved), 0.99) AS c FROM x)"""


def _scored(spark, sf):
    o = _outcomes(spark, sf).where("group <= 3").withColumns({"q_old": F.col("own"), "q_new": F.col("own") - F.col("o_custkey") % 4 + 1, "m": F.when(F.col("o_orderkey") % 11 > 0, (F.col("o_custkey") % 13 - 6) / 4.0), "common": F.lit(0.25), "size": (F.col("o_orderkey") % 9 + 1).cast("double")})
    both = replay.replayed(replay.replayed(o, "q_old", "a"), "q_new", "b")
    return both.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))


@query(f"""WITH {SCORE} SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(a::INT), 6) AS win_old, round(avg(b::INT), 6) AS win_new, CAST(sum((a AND b)::INT) AS BIGINT) AS kept, CAST(sum((NOT a AND b)::INT) AS BIGINT) AS gained, CAST(sum((a AND NOT b)::INT) AS BIGINT) AS given_up, round(avg(moved), 4) AS delta, round(avg(mc), 4) AS delta_common, round(sum(moved * size), 3) AS dollars, round(sum(greatest(least(moved, c), -c) * size), 3) AS trimmed, sum(CASE WHEN b THEN size ELSE 0 END) AS dv01 FROM x, cap GROUP BY 1""")
def scorecard_full(spark, sf):
    s = replay.scorecard(_scored(spark, sf), ["month"], "a", "b", 100 * (F.col("q_old") - F.col("own")), 100 * (F.col("q_new") - F.col("own")), "m", "common", "size")
    return s.select("month", "n", r6("win_old").alias("win_old"), r6("win_new").alias("win_new"), "kept", "gained", "given_up", r4("delta").alias("delta"), r4("delta_common").alias("delta_common"), F.round("dollars", 3).alias("dollars"), F.round("trimmed", 3).alias("trimmed"), "dv01")


@query(f"""WITH {SCORE}, s AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(moved) AS delta, avg(b::INT) - avg(a::INT) AS win, sum(moved * size) AS dollars FROM x GROUP BY 1) SELECT month, delta >= 0 AND win >= 0 AND dollars >= 0 AND (delta > 0 OR win > 0 OR dollars > 0) AS dominates, delta <= 0 AND win <= 0 AND dollars <= 0 AND (delta < 0 OR win < 0 OR dollars < 0) AS dominated FROM s""")
def dominance(spark, sf):
    s = replay.scorecard(_scored(spark, sf), ["month"], "a", "b", 100 * (F.col("q_old") - F.col("own")), 100 * (F.col("q_new") - F.col("own")), "m", "common", "size")
    axes = [F.col("delta"), F.col("win_new") - F.col("win_old"), F.col("dollars")]
    every = lambda test: test(axes[0]) & test(axes[1]) & test(axes[2])
    some = lambda test: test(axes[0]) | test(axes[1]) | test(axes[2])
    return s.select("month", (every(lambda x: x >= 0) & some(lambda x: x > 0)).alias("dominates"), (every(lambda x: x <= 0) & some(lambda x: x < 0)).alias("dominated"))


@query(f"""WITH {PANEL}, x AS (SELECT user_id, d, value, CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type = 'view' THEN -1.0 ELSE 0 END AS trade FROM p), c AS (SELECT *, sum(trade) OVER w AS pos, lag(value) OVER w AS v0, lag(d) OVER w AS d0 FROM x WINDOW w AS (PARTITION BY user_id ORDER BY d)),
 q AS (SELECT d, (pos - trade) * (value - v0) AS marked, (pos - trade) * 5.0 * (d - d0) / 360 AS carry, abs(pos) AS gross FROM c) SELECT d, round(coalesce(sum(marked), 0), 5) AS marked, round(coalesce(sum(carry), 0), 5) AS carry, sum(gross)::DOUBLE AS gross FROM q GROUP BY d""")
def book_pnl(spark, sf):
    w = Window.partitionBy("user_id").orderBy("d")
    trade = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "view", -1.0).otherwise(0.0)
    c = panel(spark, sf).withColumn("trade", trade).withColumns({"pos": F.sum("trade").over(w), "v0": F.lag("value").over(w), "d0": F.lag("d").over(w)})
    held = F.col("pos") - F.col("trade")
    q = c.select("d", (held * (F.col("value") - F.col("v0"))).alias("marked"), (held * 5.0 * S.days_30_360(F.col("d0"), F.col("d")) / 360).alias("carry"), F.abs("pos").alias("gross"))
    return q.groupBy("d").agg(F.round(F.coalesce(F.sum("marked"), F.lit(0.0)), 5).alias("marked"), F.round(F.coalesce(F.sum("carry"), F.lit(0.0)), 5).alias("carry"), F.sum("gross").alias("gross"))


@query("""WITH a AS (SELECT l_shipdate AS d, l_suppkey AS k, sum(l_quantity) AS a, sum(l_quantity + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS b FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' GROUP BY 1, 2), t AS (SELECT d, sum(a) AS a, sum(b) AS b FROM a GROUP BY d)
 SELECT round((SELECT corr(a, b) FROM t), 6) AS daily_corr, round(avg((a = b)::INT), 6) AS exact_share, count(*) AS n FROM a""")
def inventory_agreement(spark, sf):
    l = table(spark, sf, "lineitem").where("l_shipdate >= '1998-01-01'").select(F.col("l_shipdate").alias("d"), F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias("b"))
    g = l.groupBy("d", "k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    daily = g.groupBy("d").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(r6(F.corr("a", "b")).alias("daily_corr"))
    return g.agg(r6(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("exact_share"), F.count("*").alias("n")).join(daily)


@query("""WITH v AS (SELECT strftime(l_shipdate, '%Y') AS year, l_extendedprice / l_quantity AS unit, 900 + (l_partkey % 1000) AS listed FROM lineitem) SELECT year, count(*) AS n, round(median(unit / listed), 5) AS ratio, round(avg((abs(unit / listed - 1) <= 0.25)::INT), 6) AS within, round(corr(unit, listed::DOUBLE), 5) AS corr FROM v GROUP BY 1""")
def price_checks(spark, sf):
    v = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("year"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"), (900 + F.col("l_partkey") % 1000).cast("double").alias("listed"))
    ratio = F.col("unit") / F.col("listed")
    return v.groupBy("year").agg(F.count("*").alias("n"), F.round(F.median(ratio), 5).alias("ratio"), r6(F.avg((F.abs(ratio - 1) <= 0.25).cast("double"))).alias("within"), F.round(F.corr("unit", "listed"), 5).alias("corr"))


BAND = "v AS (SELECT strftime(o_orderdate, '%Y') AS y, (o_custkey % 100)::DOUBLE AS med, (o_custkey % 40 + 5)::DOUBLE AS half, o_totalprice / 1000 - 150 AS m FROM orders)"


@query(f"""WITH {BAND}, y AS (SELECT DISTINCT y FROM v), s AS (SELECT y.y, regr_slope(m, med) AS slope FROM y JOIN v ON v.y < y.y GROUP BY y.y), r AS (SELECT y.y, slope, median(abs(m - slope * med)) / median(half) AS ratio, median(half) AS mid FROM y JOIN s USING (y) JOIN v ON v.y < y.y GROUP BY y.y, slope)
 SELECT v.y AS year, count(*) AS n, round(any_value(slope), 6) AS slope, round(any_value(ratio), 5) AS ratio, round(avg(ratio * half), 4) AS width FROM v JOIN r ON v.y = r.y GROUP BY v.y""")
def band_width_walk_forward(spark, sf):
    o = table(spark, sf, "orders")
    v = o.select(F.date_format("o_orderdate", "yyyy").alias("y"), (F.col("o_custkey") % 100).cast("double").alias("med"), (F.col("o_custkey") % 40 + 5).cast("double").alias("half"), (F.col("o_totalprice") / 1000 - 150).alias("m"))
    # Few years: the rows before each are read once for its slope and once for its ratio.
    years = F.broadcast(v.select(F.col("y").alias("year")).distinct())
    past = v.join(years, F.col("y") < F.col("year"))
    slope = past.groupBy("year").agg(F.regr_slope("m", "med").alias("slope"))
    ratio = past.join(F.broadcast(slope), "year").groupBy("year", "slope").agg((F.median(F.abs(F.col("m") - F.col("slope") * F.col("med"))) / F.median("half")).alias("ratio"))
    return v.join(F.broadcast(ratio), F.col("y") == F.col("year")).groupBy("year").agg(F.count("*").alias("n"), r6(F.first("slope")).alias("slope"), F.round(F.first("ratio"), 5).alias("ratio"), r4(F.avg(F.col("ratio") * F.col("half"))).alias("width"))


@query("""WITH v AS (SELECT ln(l_quantity) AS x, l_discount AS z, ln(l_extendedprice) AS y FROM lineitem), a AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM v), b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM a)
 SELECT k::DOUBLE AS k, round(avg(k * exp(my + b1 * (x - mx) + b2 * (z - mz))), 2) AS width FROM v, b, (VALUES (0.5), (1.0), (2.0)) t(k) GROUP BY k""")
def width_family(spark, sf):
    from ..operators import regression

    v = table(spark, sf, "lineitem").select(F.lit(1).alias("g"), F.log("l_quantity").alias("x"), F.col("l_discount").alias("z"), F.log("l_extendedprice").alias("y"))
    f = regression.least_squares(v, ["g"], ["x", "z"], "y").select("beta")
    w = F.exp(F.get("beta", F.lit(0)) + F.get("beta", F.lit(1)) * F.col("x") + F.get("beta", F.lit(2)) * F.col("z"))
    each = v.join(F.broadcast(f)).select(w.alias("w")).agg(F.avg("w").alias("w"))
    return each.select(F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))).alias("k"), "w").select("k", F.round(F.col("k") * F.col("w"), 2).alias("width"))


@query("""WITH o AS (SELECT o_orderpriority AS a, o_custkey % 50 AS b, o_totalprice / 1000 AS m FROM orders), c AS (SELECT a, b, count(*) AS n, avg(m) AS own FROM o GROUP BY 1, 2), f AS (SELECT a, avg(m) AS wide FROM o GROUP BY 1) SELECT a, b, n, round(CASE WHEN n >= 60 THEN own ELSE wide END, 5) AS expected FROM c JOIN f USING (a)""")
def expected_markout_cells(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("a"), (F.col("o_custkey") % 50).alias("b"), (F.col("o_totalprice") / 1000).alias("m"))
    c = o.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("m").alias("own"))
    wide = o.groupBy("a").agg(F.avg("m").alias("wide"))
    return c.join(F.broadcast(wide), "a").select("a", "b", "n", F.round(F.when(F.col("n") >= 60, F.col("own")).otherwise(F.col("wide")), 5).alias("expected"))


CURVES = "c AS (SELECT n_name AS key, CAST(pos AS INTEGER) AS pos, pos * 2.0 - 6 AS q, 1 / (1 + exp((pos * 2.0 - 6) / (2 + n_nationkey % 4))) AS p FROM nation, range(7) r(pos))"


def _curves(spark, sf):
    q = F.col("pos") * 2.0 - 6
    n = table(spark, sf, "nation").select(F.col("n_name").alias("key"), "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("pos"))
    return n.select("key", "pos", q.alias("q"), (1 / (1 + F.exp(q / (2 + F.col("n_nationkey") % 4)))).alias("p"))


@query(f"""WITH {CURVES}, s AS (SELECT a.key, a.pos, a.q, greatest(least(a.q * 1.3, 6), -6) AS z FROM c a) SELECT s.key, s.pos, s.q, round(lo.p + (hi.p - lo.p) * (z - lo.q) / 2, 6) AS p FROM s JOIN c lo ON lo.key = s.key AND lo.pos = least(floor((z + 6) / 2), 5) JOIN c hi ON hi.key = s.key AND hi.pos = lo.pos + 1""")
def curve_stretch(spark, sf):
    return replay.stretched(_curves(spark, sf), ["key"], 1.3).select("key", "pos", "q", r6("p").alias("p"))


@query(f"WITH {CURVES} SELECT key, pos, q, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.4))), 6) AS p FROM c")
def curve_tilt(spark, sf):
    return replay.tilted(_curves(spark, sf), 0.4).withColumn("p", r6("p"))


@query(f"WITH {CURVES}, s AS (SELECT n_name AS key, CAST(c_custkey % 7 AS INTEGER) AS pos, count(*) AS n, sum((c_acctbal > 3000)::INT) AS won FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT key, pos, q, round((coalesce(won, 0) + 20 * p) / (coalesce(n, 0) + 20), 6) AS p FROM c LEFT JOIN s USING (key, pos)")
def curve_refit(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = c.groupBy(F.col("n_name").alias("key"), (F.col("c_custkey") % 7).cast("int").alias("pos")).agg(F.count("*").alias("n"), F.sum((F.col("c_acctbal") > 3000).cast("int")).alias("won"))
    return replay.refitted(_curves(spark, sf), seen, ["key", "pos"], 20.0).withColumn("p", r6("p"))


@query(f"""WITH {CURVES}, u AS (SELECT key, q, p * (q + 1 - 0.5 * (0.25 * greatest(0, -(q + 1 - 4)) + 0.5 * greatest(0, -(q + 1)) + 0.25 * greatest(0, -(q + 1 + 4)))) AS u FROM c) SELECT key, arg_max(q, u) AS best_q, round(max(u), 6) AS best_u FROM u GROUP BY key""")
def shortfall_optimum(spark, sf):
    c = _curves(spark, sf)
    u = c.withColumn("u", replay.shortfall(c, [(0.25, -4.0), (0.5, 0.0), (0.25, 4.0)], 0.5, 1.0))
    return u.groupBy("key").agg(F.max_by("q", F.struct("u", -F.col("pos"))).alias("best_q"), r6(F.max("u")).alias("best_u"))


@query("""WITH o AS (SELECT o_orderpriority AS g, o_totalprice / 1000 AS x, ((o_custkey * 37) % 101)::DOUBLE AS m FROM orders), e AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS q FROM o), b AS (SELECT g, CAST((x > q[1])::INT + (x > q[2])::INT + (x > q[3])::INT + (x > q[4])::INT AS INTEGER) AS bin, m FROM o, e),
 c AS (SELECT g, bin, count(*) AS n, avg(m) AS mean, var_samp(m) / count(*) AS se2 FROM b GROUP BY 1, 2 HAVING count(*) > 1), t AS (SELECT g, greatest(0, var_pop(mean) - avg(se2)) AS tau2, avg(mean) AS grand FROM c GROUP BY g) SELECT g, bin, n, round(grand + coalesce(tau2 / nullif(tau2 + se2, 0), 0) * (mean - grand), 5) AS b FROM c JOIN t USING (g)""")
def value_term(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 1000).alias("x"), ((F.col("o_custkey") * 37) % 101).cast("double").alias("m"))
    edges = [series.exact_percentile(o, "x", s).toDF(f"e{k}") for k, s in enumerate((0.2, 0.4, 0.6, 0.8))]
    for e in edges:
        o = o.join(F.broadcast(e))
    bins = sum(((F.col("x") > F.col(f"e{k}")).cast("int") for k in range(4)), F.lit(0))
    c = o.groupBy("g", bins.alias("bin")).agg(F.count("*").alias("n"), F.avg("m").alias("mean"), (F.var_samp("m") / F.count("*")).alias("se2")).where("n > 1")
    w = Window.partitionBy("g")
    tau2, grand = F.greatest(F.lit(0.0), F.var_pop("mean").over(w) - F.avg("se2").over(w)), F.avg("mean").over(w)
    return c.select("g", "bin", "n", F.round(grand + F.coalesce(tau2 / F.nullif(tau2 + F.col("se2"), F.lit(0.0)), F.lit(0.0)) * (F.col("mean") - grand), 5).alias("b"))


@query()
def book_by_policy(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("edge"), F.lit(1.0).alias("par"))
    return replay.book_replay(o, {"own": (60.0, 0.0), "book": (0.0, 8.0), "hedged": (30.0, 4.0)}, "d", "o_orderkey", "o_custkey", "edge", "par", 5)


@query()
def average_cost_inventory(spark, sf):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    l = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", signed.alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    return replay.average_cost(l, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "q", "px")


@query(f"""WITH {PANEL}, s AS (SELECT d, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM p GROUP BY d), c AS (SELECT d, covar_samp(a, a) OVER w AS aa, covar_samp(a, b) OVER w AS ab, covar_samp(b, b) OVER w AS bb, count(*) OVER w AS n FROM s WINDOW w AS (ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
 x AS (SELECT d, (count(*) FILTER (event_type = 'view'))::DOUBLE AS xa, (count(*) FILTER (event_type = 'click'))::DOUBLE AS xb FROM p GROUP BY d) SELECT c.d, round(sqrt(greatest(0, xa * xa * aa + 2 * xa * xb * ab + xb * xb * bb)), 4) AS sd FROM c JOIN x USING (d) WHERE n = 10""")
def exante_book_sd(spark, sf):
    p = panel(spark, sf)
    kind = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    cov = series.rolling_covariance(p.groupBy("d").agg(kind("view").alias("a"), kind("click").alias("b")), "d", ["a", "b"], 10)
    x = p.where("event_type in ('view', 'click')").groupBy("d", F.when(F.col("event_type") == "view", "a").otherwise("b").alias("i")).agg(F.count("*").cast("double").alias("x"))
    return replay.exante_sd(x, cov, "d").select("d", r4("sd").alias("sd"))


@query(f"""WITH {PANEL}, days AS (SELECT d, avg(value) AS y5, avg(value) + count(*) / 100.0 AS y10 FROM p GROUP BY d), t AS (SELECT user_id, d, 5 + user_id % 6 AS tenor, lag(d) OVER (PARTITION BY user_id ORDER BY d) AS d0 FROM p), i AS (SELECT t.user_id, t.d, a.y5 + (a.y10 - a.y5) * (tenor - 5) / 5.0 - b.y5 - (b.y10 - b.y5) * (tenor - 5) / 5.0 AS move FROM t JOIN days a ON a.d = t.d JOIN days b ON b.d = t.d0) SELECT user_id, d, round(move, 5) AS move FROM i""")
def curve_move(spark, sf):
    p = panel(spark, sf)
    days = p.groupBy("d").agg(F.avg("value").alias("y5"), (F.avg("value") + F.count("*") / 100.0).alias("y10"))
    t = p.select("user_id", "d", (5 + F.col("user_id") % 6).cast("double").alias("tenor"), F.lag("d").over(Window.partitionBy("user_id").orderBy("d")).alias("d0"))
    grid_, at = F.array(F.lit(5.0), F.lit(10.0)), lambda: X.interpolate(F.col("tenor"), grid_, F.array("y5", "y10"))
    now = t.join(F.broadcast(days), "d").select("user_id", "d", "d0", "tenor", at().alias("now"))
    then = now.join(F.broadcast(days.withColumnRenamed("d", "d0")), "d0").withColumn("then", at())
    return then.select("user_id", "d", F.round(F.col("now") - F.col("then"), 5).alias("move"))


@query(f"""WITH {TAPE}, p AS (SELECT DISTINCT user_id, ts, value FROM t WHERE side = 'P'), s AS (SELECT event_id, user_id, ts, value FROM t WHERE side = 'S'), j AS (SELECT s.event_id, s.value AS quote, arg_max(p.value, p.ts) AS last FROM s JOIN p ON p.user_id = s.user_id AND p.ts < s.ts AND p.ts >= s.ts - INTERVAL 7 DAY GROUP BY ALL) SELECT count(*) AS n, round(avg(quote - last), 6) AS skew, round(avg(abs(quote - last)), 6) AS miss FROM j""")
def lost_print_audit(spark, sf):
    t = tape(spark, sf)
    p = t.where("side = 'P'").select("user_id", F.col("ts").alias("at"), "value").distinct()
    j = asof.asof_join(t.where("side = 'S'").select("event_id", "user_id", "ts", F.col("value").alias("quote")), p, ["user_id"], "ts", "at", ["value"])
    fresh = j.where(F.col("asof_at") >= F.col("ts") - F.expr("INTERVAL 7 DAYS"))
    miss = F.col("quote") - F.col("asof_value")
    return fresh.agg(F.count("*").alias("n"), r6(F.avg(miss)).alias("skew"), r6(F.avg(F.abs(miss))).alias("miss"))


@query(f"""WITH {CURVES}, r AS (SELECT c_custkey, n_name AS key, round((c_custkey % 5) * 0.5, 2) AS charge FROM customer JOIN nation ON c_nationkey = n_nationkey), u AS (SELECT c_custkey, v, q, pos, (q + 6.5 + charge) * pv AS u FROM r JOIN (SELECT key, pos, q, 'record' AS v, p AS pv FROM c UNION ALL SELECT key, pos, q, 'tilt', 1 / (1 + exp(-(ln(p / (1 - p)) + 0.4))) FROM c) x USING (key)), b AS (SELECT c_custkey, v, max((round(u, 9), -pos, q))[3] AS q FROM u GROUP BY 1, 2)
 SELECT v AS variant, count(*) AS n, round(avg(q), 6) AS mean_q FROM b GROUP BY v""")
def curve_family_replay(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("key"), F.round((F.col("c_custkey") % 5) * 0.5, 2).alias("charge"))
    curves = _curves(spark, sf)
    out = []
    for name, own in (("record", curves), ("tilt", replay.tilted(curves, 0.4))):
        best = grid.argmax_on_curve(c, own, "key", "charge", 6.5)
        out.append(best.agg(F.lit(name).alias("variant"), F.count("*").alias("n"), r6(F.avg("best_q")).alias("mean_q")))
    return out[0].unionByName(out[1])
