"""Operators against brute force and the edge cases of panels."""

import hashlib
import random
from collections import deque
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspan.functions import scalar, special
from panelspan.operators import asof, grid, match, regression, robust, series
from panelspan.operators import window as W
from panelspan.plans import factor
from panelspan.sources import pull, store
from panelspan.streaming.bars import daily_bars, upsert_keep_last


def test_asof_ties_and_absent_keys(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("b", 9, 3), ("c", 1, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 3, 1, 10.0), ("a", 3, 2, 11.0), ("a", 5, 3, 12.0), ("b", 10, 4, 13.0)], "k string, t int, o int, v double")
    get = lambda **how: {r.id: r.asof_v for r in asof.asof_join(left, right, ["k"], "t", "t", ["v"], order=["o"], **how).collect()}
    assert get() == {1: 11.0, 2: None, 3: None, 4: None}
    assert get(strict=False) == {1: 12.0, 2: 11.0, 3: None, 4: None}
    assert get(strict=False, forward=True) == {1: 12.0, 2: 10.0, 3: 13.0, 4: None}
    assert get(forward=True) == {1: None, 2: 12.0, 3: 13.0, 4: None}


def test_fifo_against_a_queue(spark):
    rng = random.Random(5)
    trades = [(e, t, t, rng.random() < 0.5, float(rng.randint(0, 4))) for e in range(6) for t in range(40)]
    want = []
    for e in range(6):
        queue = deque()
        for _, t, i, buy, q in [x for x in trades if x[0] == e]:
            if buy:
                queue.append([i, q])
                continue
            while q > 0 and queue:
                take = min(q, queue[0][1])
                if take:
                    want.append((e, queue[0][0], i, take))
                q, queue[0][1] = q - take, queue[0][1] - take
                if not queue[0][1]:
                    queue.popleft()
    df = spark.createDataFrame(trades, "e int, t int, i int, buy boolean, q double")
    assert sorted(map(tuple, match.fifo_lots(df, "e", ["t"], F.col("buy"), "q", "i").collect())) == sorted(want)


def test_pct_rank_equals_pandas_and_skips_nulls(spark):
    x = [3.0, 1.0, 1.0, None, 2.0]
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(x)], "d int, k int, v double")
    got = [r.p for r in df.select("k", W.pct_rank("v", ["d"]).alias("p")).orderBy("k").collect()]
    want = pd.Series(x).rank(pct=True)
    assert [g if g is None else round(g, 12) for g in got] == [None if np.isnan(w) else round(w, 12) for w in want]


def test_qcut_of_one_row_and_uneven_groups(spark):
    df = spark.createDataFrame([(0, 0)] + [(1, k) for k in range(7)], "d int, k int")
    got = {(r.d, r.k): r.q for r in df.select("d", "k", W.qcut_rank([F.col("k")], ["d"], 4).alias("q")).collect()}
    assert got[0, 0] == 0 and [got[1, k] for k in range(7)] == pd.qcut(pd.Series(range(7)), 4, labels=False).tolist()


def test_mad_flags_null_and_infinite(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.1), (0, 0.9), (0, 50.0), (0, None), (0, float("inf"))], "d int, v double")
    got = {r.v: r.extreme for r in robust.mad_flags(df, "v", ["d"], 6).collect()}
    assert got == {1.0: False, 1.1: False, 0.9: False, 50.0: True, None: True, float("inf"): True}


def test_argmax_takes_the_first_of_equals_and_keeps_misses(spark):
    curves = spark.createDataFrame([("a", 0, 1.0, 0.5), ("a", 1, 0.5, 1.0), ("a", 2, 0.1, 0.1)], "k string, pos int, q double, p double")
    req = spark.createDataFrame([(1, "a", 0.0), (2, "b", 0.0), (3, "a", None)], "id int, k string, c double")
    got = {r.id: r.best_q for r in grid.argmax_on_curve(req, curves, "k", "c", 0.0).collect()}
    assert got == {1: 1.0, 2: None, 3: None}


def test_level_to_reaches_target_or_bound(spark):
    rows = [("a", float(k), 0.5) for k in range(10)] + [("b", 100.0, 0.5)] + [("c", 0.0, 1.0)]
    got = {r.g: r.level for r in grid.level_to(spark.createDataFrame(rows, "g string, d double, t double"), "g", "d", "t").collect()}
    assert abs(got["a"] - 4) < 1e-2 and got["b"] == 40.0 and got["c"] == 0.0


def test_scalars(spark):
    df = spark.createDataFrame([(" aa+ ", "20240229", "Y"), ("NR", "2024-03-01T10", "0"), (None, "1999-01-01", None), ("d", "1709251200000", "3")], "r string, s string, f string")
    got = df.select(scalar.rating_number(F.col("r")), scalar.date_of(F.col("s")), scalar.flag(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(20, date(2024, 2, 29), True), (None, date(2024, 3, 1), False), (None, None, None), (0, date(2024, 3, 1), True)]


def test_ipca_recovers_planted_factors():
    rng = np.random.default_rng(2)
    T, N, L, K = 60, 80, 5, 2
    gamma = np.linalg.qr(rng.normal(size=(L, K)))[0]
    f = rng.normal(size=(T, K)) * [2.0, 1.0]
    Z = rng.normal(size=(T, N, L))
    r = np.einsum("tnl,lk,tk->tn", Z, gamma, f) + 0.01 * rng.normal(size=(T, N))
    m = factor.Moments(list(range(T)), np.einsum("tni,tnj->tij", Z, Z), np.einsum("tni,tn->ti", Z, r), (r**2).sum(1), np.full(T, N))
    found, _, explained = factor.fit_ipca(m, K)
    assert explained > 0.999 and np.allclose(np.linalg.svd(found.T @ gamma)[1], 1, atol=1e-3)


def test_walk_forward_uses_only_the_past(spark):
    rng = np.random.default_rng(3)
    rows = [(t, n, *z, float(z @ [0.5, -0.2] * (1 + t % 3))) for t in range(12) for n in range(15) for z in [rng.normal(size=2)]]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "d double, n double, z0 double, z1 double, r double")
    out = factor.walk_forward_residuals(df, "d", ["z0", "z1"], "r", 1, [(np.arange(12) < a, (np.arange(12) >= a) & (np.arange(12) < a + 2)) for a in (6, 8, 10)]).toPandas()
    assert (out.gamma_version < out.d).all() and out.residual.abs().max() < 1e-6 and sorted(out.d.unique()) == [6, 7, 8, 9, 10, 11]


def test_store_overwrites_merges_and_plans(spark, tmp_path):
    s = store.PartitionStore(spark, "file://" + str(tmp_path / "t"))
    windows = store.partitions(date(2024, 1, 10), date(2024, 2, 20))
    assert windows == [("2024-01", date(2024, 1, 10), date(2024, 2, 1)), ("2024-02", date(2024, 2, 1), date(2024, 2, 21))]
    assert s.missing(windows) == ["2024-01", "2024-02"]
    s.write(spark.createDataFrame([(1, 1.0, "2024-01"), (2, 2.0, "2024-02")], "id int, v double, pkey string"), windows)
    s.write(spark.createDataFrame([(3, 3.0, "x", "2024-02")], "id int, v double, extra string, pkey string"), windows[1:])
    assert sorted(tuple(r) for r in s.read(["id", "extra", "absent"]).collect()) == [(1, None), (3, "x")]
    assert s.missing(windows) == [] and s.missing(windows, force=True) == ["2024-01", "2024-02"]


def test_closing_marks_order(spark):
    rows = [("c", 1, None, "B", 0.031, 1), ("c", 1, datetime(2024, 1, 1), "A", 0.04, 2), ("c", 1, datetime(2024, 1, 2), "B", 0.05, 1), ("c", 1, datetime(2024, 1, 2), "B", 0.06, 2)]
    rows += [("c", 2, None, "A", float("inf"), 1), ("c", 3, None, "A", 0.07, 1)]
    df = spark.createDataFrame(rows, "ident string, date int, published timestamp, source string, level double, sequence int")
    marks, audit = store.closing_marks(df, window=(1, 2))
    assert [round(r.level, 9) for r in marks.orderBy("date").collect()] == [6.0, float("inf")]
    assert tuple(audit.first()) == (5, 2, 1, 2)


def test_weeks_and_empty_windows(spark, tmp_path):
    assert store.partitions(date(2024, 1, 3), date(2024, 1, 9), "week") == [("2024-W01", date(2024, 1, 3), date(2024, 1, 8)), ("2024-W02", date(2024, 1, 8), date(2024, 1, 10))]
    assert store.partitions(date(2024, 2, 1), date(2024, 1, 1)) == []
    s = store.PartitionStore(spark, "file://" + str(tmp_path / "t"))
    windows = store.partitions(date(2024, 1, 1), date(2024, 2, 20))
    s.write(spark.createDataFrame([(1, "2024-01"), (2, "2024-02")], "id int, pkey string"), windows)
    s.write(spark.createDataFrame([], "id int, pkey string"), windows[1:])
    assert [r.id for r in s.read().collect()] == [1] and {r.pkey: r.rows for r in s.manifest().collect()} == {"2024-01": 1, "2024-02": 0}


def test_asof_never_matches_nulls(spark):
    left = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, "a", 5), (4, "b", 1)], "id int, k string, t int")
    right = spark.createDataFrame([(None, 1, 1.0), ("a", None, 10.0), ("b", 2, 3.0)], "k string, u int, v double")
    for forward, want in ((False, {}), (True, {4: 3.0})):
        got = asof.asof_join(left, right, ["k"], "t", "u", ["v"], forward=forward)
        assert {r.id: r.asof_v for r in got.collect() if r.asof_v is not None} == want and got.count() == 4


def test_retries_and_kept_answers(spark, tmp_path):
    calls, naps = [], []

    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return 7

    assert pull.retried(shaky, sleep=naps.append) == 7 and naps == [1.0, 2.0]
    with pytest.raises(OSError):
        pull.retried(lambda: (_ for _ in ()).throw(OSError("never")), attempts=2, sleep=naps.append)
    cache = "file://" + str(tmp_path / "answers")
    ask = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "key string")
    got = pull.enriched(ask, "key", cache, lambda keys: [k.upper() for k in keys])
    assert sorted(map(str, (r.answer for r in got.collect()))) == ["A", "A", "B", "None"]
    again = pull.enriched(ask, "key", cache, lambda keys: [1 / 0])
    assert again.where("answer is not null").count() == 3
    path = "file://" + str(tmp_path / "measures")
    pull.record(spark, path, "fit", k=3, loss=0.5)
    pull.record(spark, path, "fit", k=4)
    assert {(r.name, r.value) for r in pull.recorded(spark, path).collect()} == {("k", "4"), ("loss", "0.5")}


def test_normal_quantile_and_bootstrap(spark):
    from statistics import NormalDist

    values = [1e-9, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999999, 0.0, 1.0]
    got = [r.z for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, p double").select("k", special.norm_ppf(F.col("p")).alias("z")).orderBy("k").collect()]
    assert got[-2:] == [None, None] and all(abs(z - NormalDist().inv_cdf(p)) < 1e-7 for z, p in zip(got, values[:-2]))
    x = [0.3, -0.1, 0.8, 0.2, 0.9, -0.4, 0.5, 0.7]
    row = series.block_bootstrap_t(spark.createDataFrame(list(enumerate(x)), "d int, v double"), "d", "v", block=3, draws=40).first()
    means = []
    for draw in range(1, 41):
        starts = [int(hashlib.md5(f"7-{draw}-{b}".encode()).hexdigest()[:8], 16) % (len(x) - 2) for b in range(1, 4)]
        means.append(sum(sum(x[s : s + 3]) for s in starts) / 9)
    assert abs(row.t - (sum(x) / 8) / np.std(means)) < 1e-9


def test_percentile_by_bins(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=500), np.round(rng.normal(size=301), 1), np.zeros(7), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        for share in (0.0, 0.1, 0.5, 0.99, 1.0):
            assert abs(series.exact_percentile(df, "v", share, bins=16).first().value - np.quantile(values, share)) < 1e-12


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + rng.normal(size=90)
    rows = [(k % 2, *map(float, x[k]), float(y[k])) for k in range(90)] + [(7, 1.0, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0, 1.0)] + [(8, float(k), 2.0 * k, 1.0, float(k)) for k in range(9)]
    got = {r.g: r for r in regression.least_squares(spark.createDataFrame(rows, "g int, a double, b double, c double, y double"), ["g"], ["a", "b", "c"], "y").collect()}
    assert set(got) == {0, 1}
    for g in (0, 1):
        z = np.column_stack([np.ones(45), x[g::2]])
        beta, rss = np.linalg.lstsq(z, y[g::2])[:2]
        se = np.sqrt(rss[0] / 41 * np.diag(np.linalg.inv(z.T @ z)))
        assert np.allclose(got[g].beta, beta) and np.allclose(got[g].se, se) and abs(got[g].r2 - (1 - rss[0] / ((y[g::2] - y[g::2].mean()) ** 2).sum())) < 1e-9


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rows = [(1, datetime(2024, 1, 1, h), float(h), 1.0) for h in range(3)]
    spark.createDataFrame(rows, "user_id int, ts timestamp, value double, quantity double").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("user_id int, ts timestamp, value double, quantity double").parquet(str(src))
    upsert_keep_last(stream, str(out), str(tmp_path / "c1"), ["user_id"], ["ts"]).start().awaitTermination()
    spark.createDataFrame([(1, datetime(2023, 1, 1), -1.0, 1.0), (2, datetime(2023, 1, 1), 7.0, 1.0)], "user_id int, ts timestamp, value double, quantity double").coalesce(1).write.mode("append").parquet(str(src))
    upsert_keep_last(stream, str(out), str(tmp_path / "c1"), ["user_id"], ["ts"]).start().awaitTermination()
    assert sorted((r.user_id, r.value) for r in spark.read.parquet(str(out / "v1")).collect()) == [(1, 2.0), (2, 7.0)]
    assert daily_bars(stream).isStreaming


def test_isotonic_and_knn(spark):
    got = factor.isotonic_by_bins(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 0.0), (3.0, 1.0)], "x double, y double"), "x", "y", 4)
    assert [r.level for r in got.orderBy("bin").collect()] == [0.0, 0.5, 0.5, 1.0]
    pts = spark.createDataFrame([("g", k, [float(k), 0.0]) for k in range(5)], "g string, i int, v array<double>")
    assert {(r.i, r["rank"]): r.peer for r in factor.knn_peers(pts, "g", "i", "v", 2).collect()}[2, 1] == 1
