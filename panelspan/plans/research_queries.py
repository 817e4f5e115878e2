"""Queries of the instrument panel, regressions, portfolios, forecasts, trade validation and memories over the star-schema tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import special as X
from ..operators import asof, measure, regression
from ..operators import window as W
from . import factor, instruments
from .frames import PANEL, TAPE, panel, table, tape
from .registry import Registry, r4, r6

query = Registry()


def _dates():
    return Window.partitionBy("user_id").orderBy("d")


INSTRUMENTS = f"""WITH {PANEL}, m AS (SELECT *, median(value) OVER (PARTITION BY d) AS med FROM p), e AS (SELECT *, abs(value - med) > 1.5 * greatest(1.4826 * median(abs(value - med)) OVER (PARTITION BY d), 1e-6) AS extreme FROM m),
 l AS (SELECT *, lag(value) OVER w AS y1, date_diff('day', lag(d) OVER w, d) AS gap, lag(extreme) OVER w AS was FROM e WINDOW w AS (PARTITION BY user_id ORDER BY d)), f AS (SELECT *, (value <> y1)::INT::DOUBLE AS moved FROM l WHERE NOT (extreme OR coalesce(was, false)) AND gap <= 7),
 q AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 END AS rating, CASE WHEN count(moved) OVER w >= 5 THEN avg(moved) OVER w END AS liquid FROM f WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 b AS (SELECT *, greatest(least(10 * (value - y1), 250), -250) AS target, sum(moved) OVER (PARTITION BY user_id ORDER BY d) AS run FROM q WHERE y1 IS NOT NULL), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY d) - 1 AS still FROM b),
 r AS (SELECT *, coalesce((rank() OVER (PARTITION BY d ORDER BY y1) + (count(*) OVER (PARTITION BY d, y1) - 1) / 2.0) / count(y1) OVER (PARTITION BY d) - 0.5, 0) AS z_level,
  CASE WHEN rating IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY d ORDER BY rating NULLS LAST) + (count(*) OVER (PARTITION BY d, rating) - 1) / 2.0) / count(rating) OVER (PARTITION BY d) - 0.5 END AS z_rating,
  CASE WHEN liquid IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY d ORDER BY liquid NULLS LAST) + (count(*) OVER (PARTITION BY d, liquid) - 1) / 2.0) / count(liquid) OVER (PARTITION BY d) - 0.5 END AS z_liquidity,
  (rank() OVER (PARTITION BY d ORDER BY still) + (count(*) OVER (PARTITION BY d, still) - 1) / 2.0) / count(*) OVER (PARTITION BY d) - 0.5 AS z_run, (event_type = 'view')::INT::DOUBLE AS in_state FROM s),
 h AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM r) WHERE k >= 5), i AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY d) AS j FROM h) WHERE j >= 5)"""


def _instruments(spark, sf):
    return instruments.instrument_panel(panel(spark, sf), "user_id", "d", "value", "event_type", {"purchase": 3, "view": 2, "click": 1}, "view", scale=10.0, k=1.5, date_size=5)


Z = ["z_level", "z_rating", "z_liquidity", "z_run", "in_state"]


@query(INSTRUMENTS + " SELECT user_id, d, round(target, 4) AS target, round(z_level, 6) AS z_level, round(z_rating, 6) AS z_rating, round(z_liquidity, 6) AS z_liquidity, round(z_run, 6) AS z_run, in_state FROM i")
def instrument_panel(spark, sf):
    return _instruments(spark, sf).select("user_id", "d", r4("target").alias("target"), *[r6(z).alias(z) for z in Z[:4]], "in_state")


@query(INSTRUMENTS + """, t AS (SELECT d, sum(target * target) / count(*) AS ms FROM i GROUP BY d) SELECT d, round(CASE WHEN ms > 0 THEN least(4, (SELECT median(ms) FROM t WHERE ms > 0) / ms) ELSE 0 END, 6) AS weight FROM t""")
def date_weights(spark, sf):
    m = factor.moments(_instruments(spark, sf), "d", Z, "target")
    return spark.createDataFrame(list(factor.date_weights(m).items()), "d date, weight double").select("d", r6("weight").alias("weight"))


@query()
def instrument_residuals(spark, sf):
    found = factor.walk_forward_residuals(_instruments(spark, sf), "d", Z, "target", 2, lambda days: factor.calendar_folds(days, days[10], days[-1], 7), cap=4.0)
    return found.select("user_id", "d", "gamma_version", r6("fitted").alias("fitted"), r6("residual").alias("residual"))


@query()
def factor_number_by_parsimony(spark, sf):
    m = factor.moments(_instruments(spark, sf), "d", Z, "target")
    k, means = factor.choose_k(m, factor.calendar_folds(m.dates, m.dates[12], m.dates[-1], 7), 3)
    return spark.createDataFrame([(n + 1, float(v), n + 1 == k) for n, v in enumerate(means)], "k int, explained double, chosen boolean")


@query()
def gamma_swap(spark, sf):
    m = factor.moments(_instruments(spark, sf), "d", Z, "target")
    return spark.createDataFrame([(n, float(v)) for n, v in factor.swapped_gammas(m, np.arange(len(m.dates)) < len(m.dates) // 2, 2).items()], "measure string, value double")


TERM = "t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(365 * (o_orderkey % 30) + 100 AS INTEGER) AS maturity, CAST(o_orderdate AS DATE) + CAST(300 * (o_orderkey % 11) - 200 AS INTEGER) AS call, o_orderkey % 3 > 0 AS callable, (o_custkey % 7)::DOUBLE AS coupon, o_totalprice / 100000 AS y1 FROM orders)"


@query(f"""WITH {TERM}, w AS (SELECT *, callable AND call > d AND coupon > y1 AS c FROM t) SELECT o_orderkey, c AS priced_to_call, round(((CASE WHEN c THEN call ELSE maturity END) - d) / 365.25, 6) AS years_to_worst, round(greatest(0, (maturity - (CASE WHEN c THEN call ELSE maturity END)) / 365.25), 6) AS extension FROM w""")
def term_characteristics(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    o = o.select("o_orderkey", "d", F.date_add("d", (365 * (k % 30) + 100).cast("int")).alias("maturity"), F.date_add("d", (300 * (k % 11) - 200).cast("int")).alias("call"), (k % 3 > 0).alias("callable"), (F.col("o_custkey") % 7).cast("double").alias("coupon"), (F.col("o_totalprice") / 100000).alias("y1"))
    t = instruments.term_characteristics(o, "d", "maturity", "call", "callable", "coupon", "y1")
    return t.select("o_orderkey", "priced_to_call", r6("years_to_worst").alias("years_to_worst"), r6("extension").alias("extension"))


@query(f"WITH {PANEL} SELECT user_id, d, round((rank() OVER (PARTITION BY d ORDER BY value) + (count(*) OVER (PARTITION BY d, value) - 1) / 2.0) / count(*) OVER (PARTITION BY d) - 0.5, 6) AS z FROM p")
def rank_normalise(spark, sf):
    return panel(spark, sf).select("user_id", "d", r6(instruments.rank_normalised("value", ["d"])).alias("z"))


# ---- regressions

TWO = """a AS (SELECT {by} count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * count(*) AS xx, var_pop(z) * count(*) AS zz, var_pop(y) * count(*) AS yy, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy FROM v {group}),
 b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM a), c AS (SELECT *, my - b1 * mx - b2 * mz AS b0, yy - b1 * xy - b2 * zy AS rss FROM b)"""


@query(f"""WITH v AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount AS z, l_extendedprice / 1000 AS y FROM lineitem), {TWO.format(by='g,', group='GROUP BY g')}
 SELECT g, n, round(b0, 4) AS const, round(b1, 5) AS b1, round(b2, 4) AS b2, round(sqrt(rss / (n - 3) * zz / (xx * zz - xz * xz)), 5) AS se1, round(sqrt(rss / (n - 3) * xx / (xx * zz - xz * xz)), 4) AS se2, round(1 - rss / yy, 5) AS r2 FROM c""")
def ols_with_errors(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"), (F.col("l_extendedprice") / 1000).alias("y"))
    f = regression.least_squares(l, ["g"], ["x", "z"], "y")
    b, se = (lambda k: F.get("beta", F.lit(k))), (lambda k: F.get("se", F.lit(k)))
    return f.select("g", "n", r4(b(0)).alias("const"), F.round(b(1), 5).alias("b1"), r4(b(2)).alias("b2"), F.round(se(1), 5).alias("se1"), r4(se(2)).alias("se2"), F.round("r2", 5).alias("r2"))


@query(f"""WITH v AS (SELECT l_quantity AS x, l_discount AS z, l_extendedprice / 1000 AS y FROM lineitem), {TWO.format(by='', group='')} SELECT n, round(xy * xy / xx / yy, 6) AS r2_first, round(1 - rss / yy, 6) AS r2_both, round(1 - rss / yy - xy * xy / xx / yy, 6) AS added FROM c""")
def incremental_r2(spark, sf):
    l = table(spark, sf, "lineitem").select(F.lit(1).alias("g"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"), (F.col("l_extendedprice") / 1000).alias("y"))
    one, two = regression.least_squares(l, ["g"], ["x"], "y").select("g", F.col("r2").alias("r1")), regression.least_squares(l, ["g"], ["x", "z"], "y")
    return two.join(one, "g").select("n", r6("r1").alias("r2_first"), r6("r2").alias("r2_both"), r6(F.col("r2") - F.col("r1")).alias("added"))


LAGS = f"{PANEL}, v AS (SELECT user_id, d, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY d) AS x, lag(value, 2) OVER (PARTITION BY user_id ORDER BY d) AS z FROM p)"


@query(f"""WITH {LAGS.replace('v AS', 'u AS')}, v AS (SELECT * FROM u WHERE z IS NOT NULL), {TWO.format(by='d,', group='GROUP BY d HAVING count(*) >= 30')}, e AS (SELECT 'const' AS regressor, b0 AS b FROM c UNION ALL SELECT 'l1', b1 FROM c UNION ALL SELECT 'l2', b2 FROM c)
 SELECT regressor, count(*) AS dates, round(avg(b), 5) AS mean, round(sqrt(count(*)) * avg(b) / nullif(stddev_pop(b), 0), 4) AS t FROM e GROUP BY 1 HAVING count(*) > 2""")
def fama_macbeth_two(spark, sf):
    lagged, names = regression.lag_design(panel(spark, sf), ["user_id"], ["d"], "value", 2)
    return regression.fama_macbeth(lagged, "d", names, "value").select("regressor", "dates", F.round("mean", 5).alias("mean"), r4("t").alias("t"))


@query(f"""WITH {LAGS.replace('v AS', 'u AS')}, v AS (SELECT d, y - avg(y) OVER c AS y, x - avg(x) OVER c AS x FROM (SELECT u.*, event_type FROM u JOIN p USING (user_id, d) WHERE x IS NOT NULL) WINDOW c AS (PARTITION BY d, event_type)),
 b AS (SELECT d, regr_slope(y, x) AS b FROM v GROUP BY d HAVING count(*) >= 30 AND var_pop(x) > 0) SELECT count(*) AS dates, round(avg(b), 5) AS mean, round(sqrt(count(*)) * avg(b) / nullif(stddev_pop(b), 0), 4) AS t FROM b HAVING count(*) > 2""")
def fama_macbeth_neutralised(spark, sf):
    lagged, _ = regression.lag_design(panel(spark, sf), ["user_id"], ["d"], "value", 1)
    cell = Window.partitionBy("d", "event_type")
    own = lagged.select("d", *[(F.col(c) - F.avg(c).over(cell)).alias(n) for c, n in (("value", "y"), ("l1", "x"))])
    return regression.fama_macbeth(own, "d", ["x"], "y").where("regressor = 'x'").select("dates", F.round("mean", 5).alias("mean"), r4("t").alias("t"))


@query(f"""WITH {LAGS.replace('v AS', 'u AS')}, v AS (SELECT * FROM u WHERE z IS NOT NULL AND d < DATE '2024-01-20'), {TWO.format(by='', group='')}, o AS (SELECT u.y, b0 + b1 * x + b2 * z AS yhat, my FROM u, c WHERE u.z IS NOT NULL AND d >= DATE '2024-01-20')
 SELECT count(*) AS n, round(1 - sum((y - yhat) * (y - yhat)) / sum((y - my) * (y - my)), 6) AS r2, round(avg(abs(y - yhat)), 5) AS mae FROM o""")
def autoregression_out_of_sample(spark, sf):
    lagged, names = regression.lag_design(panel(spark, sf), ["user_id"], ["d"], "value", 2)
    train = F.col("d") < "2024-01-20"
    fit = regression.least_squares(lagged.where(train).withColumn("_g", F.lit(1)), ["_g"], names, "value").select("beta")
    mean = lagged.where(train).agg(F.avg("value").alias("my"))
    o = lagged.where(~train).join(F.broadcast(fit)).join(F.broadcast(mean)).select(F.col("value").alias("y"), "my", (F.get("beta", F.lit(0)) + sum((F.get("beta", F.lit(k + 1)) * F.col(n) for k, n in enumerate(names)), F.lit(0.0))).alias("yhat"))
    e = F.col("y") - F.col("yhat")
    return o.agg(F.count("*").alias("n"), r6(1 - F.sum(e * e) / F.sum((F.col("y") - F.col("my")) ** 2)).alias("r2"), F.round(F.avg(F.abs(e)), 5).alias("mae"))


@query("""WITH t AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem WHERE l_shipdate < DATE '1998-01-01'), v AS (SELECT (l_quantity - mq) / sq AS x, (l_discount - md) / sd AS z, l_extendedprice / 1000 AS y FROM lineitem, t WHERE l_shipdate < DATE '1998-01-01'),
 a AS (SELECT count(*) AS n, avg(y) AS my, sum(x * x) + 50 AS xx, sum(z * z) + 50 AS zz, sum(x * z) AS xz, sum(x * (y - (SELECT avg(y) FROM v))) AS xy, sum(z * (y - (SELECT avg(y) FROM v))) AS zy FROM v) SELECT n, round(my, 4) AS const, round((zz * xy - xz * zy) / (xx * zz - xz * xz), 5) AS b1, round((xx * zy - xz * xy) / (xx * zz - xz * xz), 5) AS b2 FROM a""")
def ridge_standardised(spark, sf):
    train = F.col("l_shipdate") < "1998-01-01"
    l = regression.standardised(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], train).where(train).select(F.lit(1).alias("g"), "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))
    f = regression.least_squares(l, ["g"], ["l_quantity", "l_discount"], "y", ridge=50.0)
    return f.select("n", r4(F.get("beta", F.lit(0))).alias("const"), *[F.round(F.get("beta", F.lit(k)), 5).alias(f"b{k}") for k in (1, 2)])


@query("""WITH m AS (SELECT l_returnflag AS f, l_linestatus AS s, l_extendedprice / 1000 AS y FROM lineitem WHERE l_shipdate < DATE '1998-01-01'), c AS (SELECT f, avg(y) AS fit FROM m GROUP BY f), o AS (SELECT l_returnflag AS f, l_extendedprice / 1000 AS y FROM lineitem WHERE l_shipdate >= DATE '1998-01-01')
 SELECT f AS slice, count(*) AS n, round(avg(abs(y - (SELECT avg(y) FROM m))), 4) AS mae_flat, round(avg(abs(y - fit)), 4) AS mae_model FROM o JOIN c USING (f) GROUP BY f""")
def charge_model_by_slice(spark, sf):
    l = table(spark, sf, "lineitem").select("l_shipdate", F.col("l_returnflag").alias("f"), (F.col("l_extendedprice") / 1000).alias("y"), F.lit(1).alias("g"))
    train = F.col("l_shipdate") < "1998-01-01"
    levels = sorted(r.f for r in l.where(train).select("f").distinct().collect())
    l, names = regression.dummies(l, "f", levels)
    fit = regression.least_squares(l.where(train), ["g"], names, "y").select("g", "beta")
    flat = l.where(train).agg(F.avg("y").alias("flat"))
    yhat = F.get("beta", F.lit(0)) + sum((F.get("beta", F.lit(k + 1)) * F.col(n) for k, n in enumerate(names)), F.lit(0.0))
    o = l.where(~train).join(F.broadcast(fit), "g").join(F.broadcast(flat))
    return o.groupBy(F.col("f").alias("slice")).agg(F.count("*").alias("n"), r4(F.avg(F.abs(F.col("y") - F.col("flat")))).alias("mae_flat"), r4(F.avg(F.abs(F.col("y") - yhat))).alias("mae_model"))


# ---- portfolios

BETAS = f"{PANEL}, l AS (SELECT user_id, d, value, (lag(value) OVER w - 50) / 50 AS b1, (lag(value, 2) OVER w - 50) / 50 AS b2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d)), v AS (SELECT * FROM l WHERE b2 IS NOT NULL), s AS (SELECT d, sum(b1 * b1) + 0.1 AS a, sum(b1 * b2) AS b, sum(b2 * b2) + 0.1 AS c FROM v GROUP BY d), w AS (SELECT v.*, (c * b1 - b * b2) / (a * c - b * b) AS w1, (a * b2 - b * b1) / (a * c - b * b) AS w2 FROM v JOIN s USING (d))"


def _betas(spark, sf):
    p = panel(spark, sf).select("user_id", "d", "value", ((F.lag("value").over(_dates()) - 50) / 50).alias("b1"), ((F.lag("value", 2).over(_dates()) - 50) / 50).alias("b2"))
    return factor.mimicking(p, "d", ["b1", "b2"], 0.1)


@query(f"WITH {BETAS} SELECT user_id, d, round(w1, 6) AS weight_1, round(w2, 6) AS weight_2, round(w1 * b1 + w2 * b2, 6) AS hat FROM w")
def mimicking_weights(spark, sf):
    return _betas(spark, sf).select("user_id", "d", *[r6(c).alias(c) for c in ("weight_1", "weight_2", "hat")])


@query(f"WITH {BETAS} SELECT d, round(sum(w1 * b1), 5) AS own_1, round(sum(w1 * b2), 5) AS cross_1, round(sum(w2 * b2), 5) AS own_2, round(sum(abs(w1)), 5) AS gross_1, round(pow(sum(abs(w1)), 2) / sum(w1 * w1), 4) AS breadth_1 FROM w GROUP BY d")
def mimicking_check(spark, sf):
    w = _betas(spark, sf)
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    g = F.sum(F.abs("weight_1"))
    return w.groupBy("d").agg(F.round(s("weight_1", "b1"), 5).alias("own_1"), F.round(s("weight_1", "b2"), 5).alias("cross_1"), F.round(s("weight_2", "b2"), 5).alias("own_2"), F.round(g, 5).alias("gross_1"), r4(g * g / s("weight_1", "weight_1")).alias("breadth_1"))


@query(f"WITH {BETAS}, f AS (SELECT d, sum(w1 * value) AS f1, sum(w2 * value) AS f2 FROM w GROUP BY d) SELECT user_id, d, round(value - b1 * f1 - b2 * f2, 5) AS residual FROM w JOIN f USING (d)")
def residual_maker(spark, sf):
    w = _betas(spark, sf)
    f = w.groupBy("d").agg(F.sum(F.col("weight_1") * F.col("value")).alias("f1"), F.sum(F.col("weight_2") * F.col("value")).alias("f2"))
    return w.join(f, "d").select("user_id", "d", F.round(F.col("value") - F.col("b1") * F.col("f1") - F.col("b2") * F.col("f2"), 5).alias("residual"))


@query(f"""WITH {PANEL}, l AS (SELECT user_id, d, value, lead(value) OVER w - value AS gain, (lag(value) OVER w - 50) / 50 AS b, lag(value) OVER w IS NULL AS none FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d)), r AS (SELECT *, -(value - 50) + avg(value - 50) OVER (PARTITION BY d) AS s FROM l WHERE b IS NOT NULL),
 j AS (SELECT *, s - b * sum(s * b) OVER (PARTITION BY d) / nullif(sum(b * b) OVER (PARTITION BY d), 0) AS w FROM r), u AS (SELECT *, w / nullif(sum(abs(w)) OVER (PARTITION BY d), 0) AS x FROM j) SELECT d, count(*) AS names, round(sum(x * b), 6) AS exposure, round(sum(x * gain), 6) AS pnl FROM u GROUP BY d""")
def paper_portfolio(spark, sf):
    day = Window.partitionBy("d")
    p = panel(spark, sf).select("user_id", "d", "value", (F.lead("value").over(_dates()) - F.col("value")).alias("gain"), ((F.lag("value").over(_dates()) - 50) / 50).alias("b")).where("b is not null")
    s = p.withColumn("s", -(F.col("value") - 50) + F.avg(F.col("value") - 50).over(day))
    off = s.withColumn("w", F.col("s") - F.col("b") * F.sum(F.col("s") * F.col("b")).over(day) / F.nullif(F.sum(F.col("b") * F.col("b")).over(day), F.lit(0.0)))
    x = off.withColumn("x", F.col("w") / F.nullif(F.sum(F.abs("w")).over(day), F.lit(0.0)))
    return x.groupBy("d").agg(F.count("*").alias("names"), r6(F.sum(F.col("x") * F.col("b"))).alias("exposure"), r6(F.sum(F.col("x") * F.col("gain"))).alias("pnl"))


@query(f"""WITH {PANEL}, c AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos FROM (SELECT DISTINCT d FROM p)), q AS (SELECT user_id, d, pos, value, lead(value) OVER (PARTITION BY user_id ORDER BY d) - value AS gain, least(floor((rank() OVER (PARTITION BY d ORDER BY value) + (count(*) OVER (PARTITION BY d, value) - 1) / 2.0 - 1) / count(*) OVER (PARTITION BY d) * 10), 9) AS dec FROM p JOIN c USING (d)),
 f AS (SELECT *, CASE WHEN pos % 5 = 0 THEN CASE WHEN dec = 0 THEN 1 WHEN dec = 9 THEN -1 ELSE 0 END END AS flag FROM q), h AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS held FROM f)
 SELECT d, CAST(count(*) FILTER (held > 0) AS BIGINT) AS longs, CAST(count(*) FILTER (held < 0) AS BIGINT) AS shorts, round(coalesce(avg(gain) FILTER (held > 0), 0) - coalesce(avg(gain) FILTER (held < 0), 0), 6) AS spread FROM h GROUP BY d""")
def long_short_held(spark, sf):
    p = panel(spark, sf)
    c = p.select("d").distinct().withColumn("pos", F.row_number().over(Window.orderBy("d")) - 1)
    q = p.join(F.broadcast(c), "d").withColumns({"gain": F.lead("value").over(_dates()) - F.col("value"), "dec": W.decile_floor("value", ["d"])})
    flag = F.when(F.col("pos") % 5 == 0, F.when(F.col("dec") == 0, 1).when(F.col("dec") == 9, -1).otherwise(0))
    held = F.coalesce(F.last("flag", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("pos").rangeBetween(-4, 0)), F.lit(0))
    h = q.withColumn("flag", flag).withColumn("held", held)
    side = lambda s: F.coalesce(F.avg(F.when(F.col("held") == s, F.col("gain"))), F.lit(0.0))
    return h.groupBy("d").agg(F.count(F.when(F.col("held") > 0, 1)).alias("longs"), F.count(F.when(F.col("held") < 0, 1)).alias("shorts"), r6(side(1) - side(-1)).alias("spread"))


# ---- forecasts and signals


@query(f"""WITH {PANEL}, l AS (SELECT d, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY d) AS x FROM p), q AS (SELECT quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM l WHERE d < DATE '2024-01-20'), w AS (SELECT d, y, greatest(least(x, hi), lo) AS x FROM l, q WHERE l.x IS NOT NULL),
 f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM w WHERE d < DATE '2024-01-20') SELECT count(*) AS n, round(any_value(b), 6) AS slope, round(avg(abs(y - a - b * x)), 5) AS mae FROM w, f WHERE d >= DATE '2024-01-20'""")
def winsor_ar1(spark, sf):
    from ..operators import robust

    l = panel(spark, sf).select("d", F.col("value").alias("y"), F.lag("value").over(_dates()).alias("x"))
    train = F.col("d") < "2024-01-20"
    w = robust.winsorise_at_train_quantiles(l, "x", train, 0.05, 0.95).where("x is not null")
    f = w.where(train).agg(F.regr_slope("y", "clipped").alias("b"), F.regr_intercept("y", "clipped").alias("a"))
    return w.where(~train).join(F.broadcast(f)).agg(F.count("*").alias("n"), r6(F.first("b")).alias("slope"), F.round(F.avg(F.abs(F.col("y") - F.col("a") - F.col("b") * F.col("clipped"))), 5).alias("mae"))


@query(f"WITH {PANEL}, t AS (SELECT value, avg(value) OVER w AS m, count(value) OVER w AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT count(*) AS n, round(avg(abs(value - m)), 5) AS mae FROM t WHERE n >= 3")
def trailing_mean_forecast(spark, sf):
    p = panel(spark, sf).select("value", W.rolling(F.avg, "value", ["user_id"], ["d"], -10, -1, 3).alias("m")).where("m is not null")
    return p.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("value") - F.col("m"))), 5).alias("mae"))


@query(f"""WITH {PANEL}, l AS (SELECT value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY d) AS x, event_type AS g FROM p), v AS (SELECT * FROM l WHERE x IS NOT NULL), a AS (SELECT regr_slope(y, x) AS b FROM v), s AS (SELECT g, count(*) AS n, regr_slope(y, x) AS own FROM v GROUP BY g)
 SELECT g, n, round(own, 6) AS own, round(CASE WHEN n < 200 THEN b ELSE n / (n + 500.0) * own + 500.0 / (n + 500.0) * b END, 6) AS slope FROM s, a""")
def conditional_ar1(spark, sf):
    v = panel(spark, sf).select(F.col("value").alias("y"), F.lag("value").over(_dates()).alias("x"), F.col("event_type").alias("g")).where("x is not null")
    s = v.groupBy("g").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("own")).join(F.broadcast(v.agg(F.regr_slope("y", "x").alias("b"))))
    w = F.col("n") / (F.col("n") + 500.0)
    return s.select("g", "n", r6("own").alias("own"), r6(F.when(F.col("n") < 200, F.col("b")).otherwise(w * F.col("own") + (1 - w) * F.col("b"))).alias("slope"))


@query(f"""WITH {PANEL}, l AS (SELECT d, value, lead(value) OVER (PARTITION BY user_id ORDER BY d) AS ahead FROM p), q AS (SELECT quantile_cont(value, 0.3) AS lo, quantile_cont(value, 0.7) AS hi FROM p)
 SELECT CASE WHEN value < lo THEN 'low' WHEN value > hi THEN 'high' ELSE 'mid' END AS regime, count(*) AS n, round(avg(ahead), 6) AS mean FROM l, q WHERE ahead IS NOT NULL GROUP BY 1""")
def regime_means(spark, sf):
    p = panel(spark, sf)
    q = p.agg(F.percentile("value", 0.3).alias("lo"), F.percentile("value", 0.7).alias("hi"))
    l = p.select("value", F.lead("value").over(_dates()).alias("ahead")).where("ahead is not null").join(F.broadcast(q))
    return l.groupBy(F.when(F.col("value") < F.col("lo"), "low").when(F.col("value") > F.col("hi"), "high").otherwise("mid").alias("regime")).agg(F.count("*").alias("n"), r6(F.avg("ahead")).alias("mean"))


@query()
def expanding_isotonic_by_key(spark, sf):
    p = panel(spark, sf).select("d", "event_type", (F.lag("value").over(_dates()) / 100).alias("x"), (F.col("value") > 50).cast("double").alias("y")).where("event_type is not null")
    return factor.expanding_isotonic(p, "d", "event_type", "x", "y", least_key=200, least_all=300)


@query()
def boosted_level(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("label"), "l_quantity", "l_discount", "l_tax", "l_shipdate")
    v = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(l)
    train = F.col("l_shipdate") < "1998-01-01"
    model = GBTRegressor(lossType="absolute", maxIter=5, maxDepth=3, seed=7).fit(v.where(train))
    flat = v.where(train).agg(F.median("label").alias("flat"))
    return model.transform(v.where(~train)).join(F.broadcast(flat)).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"), F.avg(F.abs(F.col("label") - F.col("flat"))).alias("mae_flat"))


@query(f"""WITH {PANEL}, l AS (SELECT d, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY d) AS a, avg(value) OVER (PARTITION BY d) AS c FROM p), v AS (SELECT * FROM l WHERE a IS NOT NULL), g AS (SELECT k / 10.0 AS lam FROM range(11) r(k)), s AS (SELECT lam, avg(abs(y - lam * a - (1 - lam) * c)) AS mae FROM v, g WHERE d < DATE '2024-01-20' GROUP BY lam),
 b AS (SELECT arg_min(lam, (round(mae, 9), lam)) AS lam FROM s) SELECT CAST(any_value(b.lam) AS DOUBLE) AS weight, count(*) AS n, round(avg(abs(y - b.lam * a - (1 - b.lam) * c)), 5) AS mae, round(quantile_cont(abs(y - b.lam * a - (1 - b.lam) * c), 0.8), 5) AS half_width FROM v, b WHERE d >= DATE '2024-01-20'""")
def shrinkage_mid(spark, sf):
    l = panel(spark, sf).select("d", F.col("value").alias("y"), F.lag("value").over(_dates()).alias("a"), F.avg("value").over(Window.partitionBy("d")).alias("c")).where("a is not null")
    train = F.col("d") < "2024-01-20"
    miss = lambda k: F.abs(F.col("y") - k * F.col("a") - (1 - k) * F.col("c"))
    grid = l.where(train).agg(*[F.round(F.avg(miss(F.lit(k / 10))), 9).alias(str(k)) for k in range(11)])
    best = grid.select(F.array_min(F.array(*[F.struct(F.col(str(k)).alias("mae"), F.lit(k / 10).alias("lam")) for k in range(11)])).alias("b")).select("b.lam")
    o = l.where(~train).join(F.broadcast(best)).withColumn("e", miss(F.col("lam")))
    return o.agg(F.first("lam").alias("weight"), F.count("*").alias("n"), F.round(F.avg("e"), 5).alias("mae"), F.round(F.percentile("e", 0.8), 5).alias("half_width"))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]) AS a FROM lineitem), c AS (SELECT l_suppkey AS k, count(*) AS n, quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]) AS o FROM lineitem GROUP BY 1)
 SELECT k, n, round(n / (n + 500.0) * o[1] + 500.0 / (n + 500.0) * a[1], 3) AS q10, round(n / (n + 500.0) * o[2] + 500.0 / (n + 500.0) * a[2], 3) AS q50, round(n / (n + 500.0) * o[3] + 500.0 / (n + 500.0) * a[3], 3) AS q90 FROM c, q""")
def shrunk_quantile_grid(spark, sf):
    from ..operators import series

    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("y"))
    shares = (0.1, 0.5, 0.9)
    own = l.groupBy("k").agg(F.count("*").alias("n"), F.percentile("y", F.array(*map(F.lit, shares))).alias("o"))
    for s in shares:
        own = own.join(F.broadcast(series.exact_percentile(l, "y", s).toDF(f"a{int(100 * s)}")))
    w = F.col("n") / (F.col("n") + 500.0)
    return own.select("k", "n", *[F.round(w * F.get("o", F.lit(k)) + (1 - w) * F.col(f"a{int(100 * s)}"), 3).alias(f"q{int(100 * s)}") for k, s in enumerate(shares)])


@query("""WITH v AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM v), e AS (SELECT x, abs(y - a - b * x) AS e, y - a - b * x AS u FROM v, f), s AS (SELECT regr_slope(e, x) AS sb, regr_intercept(e, x) AS sa FROM e), z AS (SELECT u / greatest(sa + sb * x, 0.01) AS z FROM e, s)
 SELECT round(any_value(a), 4) AS location_0, round(any_value(b), 5) AS location_1, round(any_value(sa), 4) AS scale_0, round(any_value(sb), 5) AS scale_1, round((SELECT quantile_cont(z, 0.1) FROM z), 5) AS z10, round((SELECT quantile_cont(z, 0.9) FROM z), 5) AS z90 FROM f, s""")
def location_scale(spark, sf):
    from ..operators import series

    v = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    f = v.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    u = v.join(F.broadcast(f)).select("x", "a", "b", (F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("u"))
    s = u.agg(F.regr_slope(F.abs("u"), F.col("x")).alias("sb"), F.regr_intercept(F.abs("u"), F.col("x")).alias("sa"))
    z = u.join(F.broadcast(s)).select((F.col("u") / F.greatest(F.col("sa") + F.col("sb") * F.col("x"), F.lit(0.01))).alias("z"))
    q = [series.exact_percentile(z, "z", k).toDF(n) for k, n in ((0.1, "z10"), (0.9, "z90"))]
    return f.join(s).join(q[0]).join(q[1]).select(r4("a").alias("location_0"), F.round("b", 5).alias("location_1"), r4("sa").alias("scale_0"), F.round("sb", 5).alias("scale_1"), F.round("z10", 5).alias("z10"), F.round("z90", 5).alias("z90"))


@query(f"""WITH {PANEL}, l AS (SELECT d, value AS y, (lag(value) OVER (PARTITION BY user_id ORDER BY d) - 50) / 50 AS z FROM p), s AS (SELECT d, y, q, exp(4 * w * z) AS e FROM l, (VALUES ('cheap', -1), ('rich', 1)) v(q, w) WHERE z IS NOT NULL) SELECT d, q AS query, round(sum(e * y) / sum(e), 6) AS value, round(pow(sum(e), 2) / sum(e * e), 5) AS effective_n FROM s GROUP BY 1, 2""")
def attention_factors(spark, sf):
    l = panel(spark, sf).select("d", "value", ((F.lag("value").over(_dates()) - 50) / 50).alias("z"))
    return factor.attention(l, "d", {"cheap": {"z": -1.0}, "rich": {"z": 1.0}}, "value").select("d", "query", r6("value").alias("value"), F.round("effective_n", 5).alias("effective_n"))


@query(f"""WITH {PANEL}, l AS (SELECT user_id, d, value, avg(value) OVER (PARTITION BY d) AS m FROM p),
 h AS (SELECT 1 AS h, value - lag(value, 1) OVER w AS stale, value - lag(value, 1) OVER w - m + lag(m, 1) OVER w AS rolled FROM l WINDOW w AS (PARTITION BY user_id ORDER BY d) UNION ALL SELECT 2, value - lag(value, 2) OVER w, value - lag(value, 2) OVER w - m + lag(m, 2) OVER w FROM l WINDOW w AS (PARTITION BY user_id ORDER BY d) UNION ALL SELECT 5, value - lag(value, 5) OVER w, value - lag(value, 5) OVER w - m + lag(m, 5) OVER w FROM l WINDOW w AS (PARTITION BY user_id ORDER BY d))
 SELECT h, count(*) AS n, round(avg(abs(stale)), 5) AS stale, round(avg(abs(rolled)), 5) AS rolled FROM h WHERE stale IS NOT NULL GROUP BY h""")
def roll_forward(spark, sf):
    l = panel(spark, sf).withColumn("m", F.avg("value").over(Window.partitionBy("d")))
    stale = lambda k: F.col("value") - F.lag("value", k).over(_dates())
    each = [F.struct(F.lit(k).alias("h"), stale(k).alias("stale"), (stale(k) - F.col("m") + F.lag("m", k).over(_dates())).alias("rolled")) for k in (1, 2, 5)]
    x = l.select(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*").where("stale is not null")
    return x.groupBy("h").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("stale")), 5).alias("stale"), F.round(F.avg(F.abs("rolled")), 5).alias("rolled"))


@query(f"""WITH {TAPE}, m AS (SELECT d, avg(value) AS m FROM t GROUP BY d), s AS (SELECT d, CASE side WHEN 'P' THEN 1.0 WHEN 'S' THEN -1.0 ELSE 0 END * (event_id % 9 + 1) AS w, m, value - m AS e FROM t JOIN m USING (d)), g AS (SELECT d, sum(w * m) / sum(abs(w)) AS factor_part, sum(w * e) / sum(abs(w)) AS own_part FROM s GROUP BY d)
 SELECT count(*) AS days, round(avg(factor_part), 6) AS factor_mean, round(avg(own_part), 6) AS own_mean, round(var_samp(own_part) / var_samp(factor_part + own_part), 6) AS own_share FROM g""")
def flow_decomposition(spark, sf):
    t = tape(spark, sf).withColumn("m", F.avg("value").over(Window.partitionBy("d")))
    w = F.when(F.col("side") == "P", 1.0).when(F.col("side") == "S", -1.0).otherwise(0.0) * (F.col("event_id") % 9 + 1)
    g = t.withColumn("w", w).groupBy("d").agg((F.sum(F.col("w") * F.col("m")) / F.sum(F.abs("w"))).alias("f"), (F.sum(F.col("w") * (F.col("value") - F.col("m"))) / F.sum(F.abs("w"))).alias("o"))
    return g.agg(F.count("*").alias("days"), r6(F.avg("f")).alias("factor_mean"), r6(F.avg("o")).alias("own_mean"), r6(F.var_samp("o") / F.var_samp(F.col("f") + F.col("o"))).alias("own_share"))


@query(f"""WITH {PANEL}, l AS (SELECT d, user_id % 10 AS dur, -value AS s, lead(value) OVER (PARTITION BY user_id ORDER BY d) - value AS y FROM p), v AS (SELECT d, s, y, dur, s - (regr_slope(s, dur) OVER c * dur + regr_intercept(s, dur) OVER c) AS off FROM l WHERE y IS NOT NULL WINDOW c AS (PARTITION BY d)),
 i AS (SELECT d, corr(s, y) AS raw, corr(off, y) AS net, corr(s, dur) AS tilt FROM v GROUP BY d HAVING count(*) >= 10) SELECT count(*) AS days, round(avg(raw), 6) AS raw, round(avg(net), 6) AS net, round(avg(tilt), 6) AS tilt FROM i""")
def duration_tilt(spark, sf):
    l = panel(spark, sf).select("d", (F.col("user_id") % 10).cast("double").alias("dur"), (-F.col("value")).alias("s"), (F.lead("value").over(_dates()) - F.col("value")).alias("y")).where("y is not null")
    fit = l.groupBy("d").agg(F.regr_slope("s", "dur").alias("b"), F.regr_intercept("s", "dur").alias("a"))
    v = l.join(F.broadcast(fit), "d").withColumn("off", F.col("s") - F.col("b") * F.col("dur") - F.col("a"))
    i = v.groupBy("d").agg(F.corr("s", "y").alias("raw"), F.corr("off", "y").alias("net"), F.corr("s", "dur").alias("tilt"), F.count("*").alias("n")).where("n >= 10")
    return i.agg(F.count("*").alias("days"), *[r6(F.avg(c)).alias(c) for c in ("raw", "net", "tilt")])


@query(f"""WITH {PANEL} SELECT user_id, d, -value AS score, d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS signal_available_date FROM p""")
def score_export(spark, sf):
    return panel(spark, sf).select("user_id", "d", (-F.col("value")).alias("score"), X.add_business_days(F.col("d"), 1).alias("signal_available_date"))


@query()
def three_state_filter(spark, sf):
    p = panel(spark, sf)
    few = p.where("user_id % 10 = 0").toPandas().pivot_table(index="user_id", columns="d", values="value") - 50
    model = factor.fit_three_state(few.to_numpy(float), (1.0, 2.0, 1.0, 1.0))
    return factor.filter_three_state(p.withColumn("value", F.col("value") - 50), "user_id", "d", "value", model, blocks=8)


@query(f"""WITH e AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], [0.0 FOR x IN embedding]) AS y, md5(vec_id || '-7') AS h FROM embeddings), r AS (SELECT label, vec_id, y, lead(y) OVER (PARTITION BY label ORDER BY h) AS peer FROM e) SELECT label, count(*) AS n, round(avg(abs(y - peer)), 6) AS gap FROM r WHERE peer IS NOT NULL GROUP BY label""")
def random_peers(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)).alias("y"), F.md5(F.concat_ws("-", "vec_id", F.lit("7"))).alias("h"))
    r = e.select("label", "y", F.lead("y").over(Window.partitionBy("label").orderBy("h")).alias("peer")).where("peer is not null")
    return r.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("peer")))).alias("gap"))


# ---- trade validation and memories


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem WHERE l_linestatus = 'F')
 SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'D' END AS side, round(ln(greatest(l_quantity * 1000, 1)), 6) AS log_size, round(100 * (l_discount - l_tax), 4) AS error_bp FROM r WHERE k = 1""")
def trade_standardiser(spark, sf):
    l = table(spark, sf, "lineitem").where("l_linestatus = 'F'")
    l = W.keep_last(l, ["l_orderkey", "l_linenumber"], [F.col(c).desc_nulls_last() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")])
    side = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("D")
    return l.select("l_orderkey", "l_linenumber", side.alias("side"), r6(F.log(F.greatest(F.col("l_quantity") * 1000, F.lit(1.0)))).alias("log_size"), r4(100 * (F.col("l_discount") - F.col("l_tax"))).alias("error_bp"))


@query(f"""WITH {PANEL}, g AS (SELECT date_diff('day', lag(d) OVER (PARTITION BY user_id ORDER BY d), d) AS gap FROM p) SELECT CASE WHEN gap IS NULL THEN 'first_print' WHEN gap <= 1 THEN '0-1' WHEN gap <= 3 THEN '2-3' WHEN gap <= 7 THEN '4-7' ELSE '8+' END AS bucket, count(*) AS n FROM g GROUP BY 1""")
def recency_buckets(spark, sf):
    gap = panel(spark, sf).select(F.datediff("d", F.lag("d").over(_dates())).alias("gap"))
    return gap.groupBy(S.ladder(F.col("gap"), [2, 4, 8], ["0-1", "2-3", "4-7", "8+"], "first_print").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL}, l AS (SELECT user_id, d, value - lag(value) OVER w AS signal, lead(value) OVER w - value AS revision FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d)), q AS (SELECT revision, greatest(CAST(ceil((row_number() OVER (PARTITION BY d ORDER BY signal, user_id) - 1) * 5 / nullif(count(*) OVER (PARTITION BY d) - 1.0, 0)) AS INTEGER) - 1, 0) AS quintile FROM l WHERE signal IS NOT NULL AND revision IS NOT NULL)
 SELECT coalesce(quintile, 0) AS quintile, count(*) AS n, round(avg(revision), 6) AS mean, round(avg((revision < 0)::INT), 6) AS down FROM q GROUP BY 1""")
def revision_test(spark, sf):
    l = panel(spark, sf).select("user_id", "d", (F.col("value") - F.lag("value").over(_dates())).alias("signal"), (F.lead("value").over(_dates()) - F.col("value")).alias("revision")).where("signal is not null and revision is not null")
    q = l.select("revision", W.qcut_rank(["signal", "user_id"], ["d"], 5).alias("quintile"))
    return q.groupBy("quintile").agg(F.count("*").alias("n"), r6(F.avg("revision")).alias("mean"), r6(F.avg((F.col("revision") < 0).cast("double"))).alias("down"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, (o_custkey % 100)::DOUBLE AS x, o_totalprice / 1000 AS y FROM orders), s AS (SELECT m, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy FROM o GROUP BY m),
 b AS (SELECT m, n, (sum(n) OVER w * sum(xy) OVER w - sum(sx) OVER w * sum(sy) OVER w) / nullif(sum(n) OVER w * sum(xx) OVER w - pow(sum(sx) OVER w, 2), 0) AS slope FROM s WINDOW w AS (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT o.m AS month, count(*) AS n, round(any_value(slope), 6) AS slope, round(avg(slope * (x - 50) * y), 4) AS gain FROM o JOIN b ON o.m = b.m WHERE slope IS NOT NULL GROUP BY o.m""")
def economic_sizing(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_custkey") % 100).cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    s = o.groupBy("month").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    before = lambda c: F.sum(c).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    b = s.select("month", ((before("n") * before("xy") - before("sx") * before("sy")) / F.nullif(before("n") * before("xx") - before("sx") * before("sx"), F.lit(0.0))).alias("slope")).where("slope is not null")
    return o.join(F.broadcast(b), "month").groupBy("month").agg(F.count("*").alias("n"), r6(F.first("slope")).alias("slope"), r4(F.avg(F.col("slope") * (F.col("x") - 50) * F.col("y"))).alias("gain"))


@query(f"""WITH {PANEL}, {TAPE}, j AS (SELECT t.event_id, t.d, t.side, t.value AS y, (SELECT arg_max(p.value, p.d) FROM p WHERE p.user_id = t.user_id AND p.d < t.d) AS score FROM t WHERE side IS NOT NULL), q AS (SELECT *, least(floor((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 - 1) / count(*) OVER () * 10), 9) AS dec FROM j WHERE score IS NOT NULL)
 SELECT CAST(dec AS INTEGER) AS dec, side, count(*) AS n, CAST(sum(CAST(round(y * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS mean FROM q GROUP BY 1, 2""")
def frozen_score_validation(spark, sf):
    t = tape(spark, sf).where("side is not null").select("event_id", "user_id", "d", "side", F.col("value").alias("y"))
    p = panel(spark, sf).select("user_id", F.col("d").alias("seen"), F.col("value").alias("score"))
    j = asof.asof_join(t, p, ["user_id"], "d", "seen", ["score"]).where("asof_score is not null")
    ranks = measure.global_ranks(j, "asof_score")
    n = j.agg(F.count("*").alias("_n"))
    dec = F.least(F.floor((F.col("r_asof_score") - 1) / F.col("_n") * 10), F.lit(9)).cast("int")
    # In whole hundredths: sums don't hang on their order then.
    mean = F.sum(F.round(F.col("y") * 100).cast("long")).cast("double") / (100 * F.count("*")).cast("double")
    return j.join(ranks, "asof_score").join(F.broadcast(n)).groupBy(dec.alias("dec"), "side").agg(F.count("*").alias("n"), mean.alias("mean"))


MEMORY = "SELECT a.event_id, round(sum(b.value * pow(0.5, (a.k - b.k) / 3.0)) / sum(pow(0.5, (a.k - b.k) / 3.0)), 5) AS memory FROM n a LEFT JOIN n b ON {on} AND b.k < a.k GROUP BY a.event_id"


@query(f"WITH {TAPE}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM t) " + MEMORY.format(on="a.user_id = b.user_id"))
def pooled_memory(spark, sf):
    return W.remembered(tape(spark, sf), ["user_id"], ["ts", "event_id"], "value", 3, "memory").select("event_id", F.round("memory", 5).alias("memory"))


@query(f"WITH {TAPE}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY ts, event_id) AS k FROM t WHERE side IS NOT NULL) " + MEMORY.format(on="a.user_id = b.user_id AND a.side = b.side"))
def same_side_memory(spark, sf):
    return W.remembered(tape(spark, sf).where("side is not null"), ["user_id", "side"], ["ts", "event_id"], "value", 3, "memory").select("event_id", F.round("memory", 5).alias("memory"))


@query(f"WITH {PANEL}, g AS (SELECT user_id, d, CAST(round(value * 100) AS BIGINT) AS v, sum(CAST(round(value * 100) AS BIGINT)) OVER c AS s, count(*) OVER c AS n FROM p WINDOW c AS (PARTITION BY d, event_type)) SELECT user_id, d, CAST(n - 1 AS BIGINT) AS others, CAST(s - v AS DOUBLE) / CAST(100 * (n - 1) AS DOUBLE) AS memory FROM g WHERE n > 1")
def leave_one_out_cluster(spark, sf):
    # In whole hundredths, so that sums don't hang on their order.
    c = Window.partitionBy("d", "event_type")
    v = panel(spark, sf).withColumn("v", F.round(F.col("value") * 100).cast("long"))
    g = v.select("user_id", "d", "v", F.sum("v").over(c).alias("s"), F.count("*").over(c).alias("n")).where("n > 1")
    return g.select("user_id", "d", (F.col("n") - 1).alias("others"), ((F.col("s") - F.col("v")).cast("double") / (100 * (F.col("n") - 1)).cast("double")).alias("memory"))


@query(f"WITH {PANEL}, e AS (SELECT user_id, d, abs(value - 50) AS e FROM p), b AS (SELECT user_id, d, e, quantile_cont(e, 0.8) OVER w AS band, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT count(*) AS n, round(avg((e <= band)::INT), 6) AS coverage, round(avg(band), 5) AS width FROM b WHERE n >= 5")
def conformal_bands(spark, sf):
    w = _dates().rowsBetween(-20, -1)
    b = panel(spark, sf).withColumn("e", F.abs(F.col("value") - 50)).select("e", F.percentile("e", 0.8).over(w).alias("band"), F.count("*").over(w).alias("n")).where("n >= 5")
    return b.agg(F.count("*").alias("n"), r6(F.avg((F.col("e") <= F.col("band")).cast("double"))).alias("coverage"), F.round(F.avg("band"), 5).alias("width"))


@query(f"""WITH {PANEL}, l AS (SELECT user_id, d, value, lead(value) OVER (PARTITION BY user_id ORDER BY d) AS y, md5(user_id || '-' || strftime(d, '%Y-%m-%d')) AS h FROM p), q AS (SELECT y, coalesce(greatest(CAST(ceil((row_number() OVER (PARTITION BY d ORDER BY value, user_id) - 1) * 5 / nullif(count(*) OVER (PARTITION BY d) - 1.0, 0)) AS INTEGER) - 1, 0), 0) AS a, coalesce(greatest(CAST(ceil((row_number() OVER (PARTITION BY d ORDER BY h) - 1) * 5 / nullif(count(*) OVER (PARTITION BY d) - 1.0, 0)) AS INTEGER) - 1, 0), 0) AS b FROM l WHERE y IS NOT NULL)
 SELECT 'real' AS sort, a AS quintile, count(*) AS n, round(avg(y), 6) AS mean FROM q GROUP BY a UNION ALL SELECT 'placebo', b, count(*), round(avg(y), 6) FROM q GROUP BY b""")
def premium_sorts_placebo(spark, sf):
    l = panel(spark, sf).select("user_id", "d", "value", F.lead("value").over(_dates()).alias("y"), F.md5(F.concat_ws("-", "user_id", F.date_format("d", "yyyy-MM-dd"))).alias("h")).where("y is not null")
    q = l.select("y", W.qcut_rank(["value", "user_id"], ["d"], 5).alias("real"), W.qcut_rank(["h"], ["d"], 5).alias("placebo"))
    each = q.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("sort"), F.col(n).alias("quintile")) for n in ("real", "placebo")])).alias("s")).select("y", "s.*")
    return each.groupBy("sort", "quintile").agg(F.count("*").alias("n"), r6(F.avg("y")).alias("mean"))


@query(f"""WITH {PANEL}, s AS (SELECT d, avg(value) FILTER (event_type = 'view') - 50 AS a, avg(value) FILTER (event_type = 'click') - 50 AS b FROM p GROUP BY d), x AS (SELECT d, row_number() OVER (ORDER BY d) AS k, a * b AS ab FROM s WHERE a IS NOT NULL AND b IS NOT NULL) SELECT u.d, round(sum(v.ab * pow(0.5, (u.k - v.k) / 5.0)) / sum(pow(0.5, (u.k - v.k) / 5.0)), 5) AS cov FROM x u JOIN x v ON v.k <= u.k GROUP BY u.d""")
def decayed_covariance(spark, sf):
    kind = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value"))) - 50
    x = panel(spark, sf).groupBy("d").agg(kind("view").alias("a"), kind("click").alias("b")).where("a is not null and b is not null").select("d", F.row_number().over(Window.orderBy("d")).alias("k"), (F.col("a") * F.col("b")).alias("ab"), F.lit(1.0).alias("one"), F.lit(0).alias("g"))
    both = W.decayed(W.decayed(x, ["g"], "k", "ab", 5, "s"), ["g"], "k", "one", 5, "w")
    return both.select("d", F.round(F.col("s") / F.col("w"), 5).alias("cov"))
