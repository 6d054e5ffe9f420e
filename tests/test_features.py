import datetime as dt
import math
import re

import numpy as np
import pytest
from frames import column, day, panel
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright import operators as op
from panelwright.functions import ratio, round_ln
from panelwright.plans.panels import lag_frame, panel_log, panel_percapita
from panelwright.plans.supplier import SUPPLIER
from panelwright.sources import nan_to_null, panel_nation, panel_supplier, scan_panel, unique_rows
from panelwright.sources.scan import is_scan

SF = "/root/testdata/sf0.001"


def values(df, col, *order):
    return [r[col] for r in df.orderBy(*order).collect()]


def test_round_is_half_away_from_zero(spark):
    got = column(spark, [0.5, 2.5, -0.5, -2.5]).select(F.round("x").alias("r"))
    assert [r.r for r in got.collect()] == [1.0, 3.0, -1.0, -3.0]


def test_zero_and_negative_have_no_log_and_no_ratio(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (0, 5), (-3, 1)], "cases bigint, pop bigint")
    rows = df.select(round_ln("cases").alias("l"), ratio("cases", "pop").alias("r")).collect()
    assert [r.l for r in rows] == [None, 2.0, None, None]
    assert [r.r for r in rows] == [None, None, 0.0, -3.0]


def test_integer_ratio_is_true_division(spark):
    df = spark.createDataFrame([(1, 3)], "a bigint, b bigint")
    assert op.per_capita(df, {"r": ("a", "b")}).first().r == 1 / 3


def test_band_share_is_null_when_a_band_is(spark):
    df = spark.createDataFrame([(1, 2, 10), (1, None, 10)], "a bigint, b bigint, pop bigint")
    got = op.band_shares(df, {"ab": ["a", "b"]}, "pop").collect()
    assert got[0].ab == pytest.approx(0.3) and got[1].ab is None


def test_date_keys(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 5, 1, 13),)], "t timestamp")
    assert op.date_keys(df, "t").first().ds == "2020-05-01"


def test_numeric_view_drops_text_dates_and_keys(spark):
    df = spark.createDataFrame([(1, "a", DAY, 2.0)], "k int, s string, d date, v double")
    assert op.numeric_view(df, drop=["k"]).columns == ["v"]


DAY = dt.date(2024, 1, 1)


def test_nan_becomes_null_and_does_not_pass_a_filter(spark, tmp_path):
    column(spark, [1.0, float("nan"), -1.0]).write.parquet(str(tmp_path / "p"))
    df = scan_panel(spark, str(tmp_path / "p"), {"v": "x"}, F.col("x") > 0)
    assert [r.v for r in df.collect()] == [1.0]
    assert nan_to_null(column(spark, [float("nan")])).first().x is None


def test_scan_pushes_filter_and_prunes(spark):
    df = scan_panel(
        spark, f"{SF}/orders.parquet", {"id": "o_orderkey"}, F.col("o_totalprice") > 1000
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_lags_count_rows_not_days(spark):
    df = panel(spark, {"a": {1: 10, 2: 20, 5: 50}})
    got = op.add_lags(df, {"y": "y"}, offsets=(1, 2))
    assert values(got, "y_1", "ds") == [None, 10.0, 20.0]
    assert values(got, "y_2", "ds") == [None, None, 10.0]


def test_calendar_lags_count_days(spark):
    df = panel(spark, {"a": {1: 10, 2: 20, 5: 50}, "b": {4: 1}})
    got = op.add_lags(df, {"y": "y"}, offsets=(1, 3), calendar=True)
    assert values(got, "y_1", "entity_id", "ds") == [None, 10.0, None, None]
    assert values(got, "y_3", "entity_id", "ds") == [None, None, 20.0, None]


def test_lags_stay_inside_the_entity_and_keep_single_rows(spark):
    df = panel(spark, {"a": {1: 1, 2: 2}, "b": {3: 3}})
    assert values(op.add_lags(df, {"y": "y"}, (1,)), "y_1", "entity_id", "ds") == [None, 1.0, None]


@pytest.mark.parametrize("how", [{}, {"calendar": True}, {"max_rows": 2}])
def test_duplicate_keys_fail(spark, how):
    df = panel(spark, {"a": {1: 1, 2: 2, 3: 1, 9: 4}}).union(panel(spark, {"a": {2: 5}}))
    with pytest.raises(PySparkException, match="duplicate key"):
        op.add_lags(df, {"y": "y"}, (1,), **how).collect()


def test_lag_of_lag_adds_offsets(spark):
    df = panel(spark, {e: {d: d * d + i for d in range(20)} for i, e in enumerate("abc")})
    twice = op.add_lags(op.add_lags(df, {"p": "y"}, (2,)), {"q": "p_2"}, (3,))
    both = op.add_lags(twice, {"r": "y"}, (5,))
    assert both.where(~F.col("q_3").eqNullSafe(F.col("r_5"))).count() == 0


@pytest.mark.parametrize("rows", [31, 40, 333, 10_000])
def test_ranged_lags_equal_one_window(spark, rows):
    crowded = {int(d): int(d) for d in 5000 * np.random.default_rng(0).random(700) ** 6}
    df = panel(spark, {"hot": {d: d for d in range(900)}, "b": {d: -d for d in range(0, 50, 3)}, "crowded": crowded})
    offsets = (1, 7, 31)
    plain = op.add_lags(df, {"y": "y"}, offsets)
    ranged = op.add_lags(df, {"y": "y"}, offsets, max_rows=rows)
    assert plain.exceptAll(ranged).count() == 0 and ranged.exceptAll(plain).count() == 0


def test_ranged_lags_of_other_order_keys(spark):
    rows = [("a", k % 3, k * 1.5, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * k), float(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "entity_id string, tie int, x double, t timestamp, y double")
    for order in ("x", "t", ["x", "tie"]):
        plain = op.add_lags(df, {"y": "y"}, (1, 5), order=order)
        ranged = op.add_lags(df, {"y": "y"}, (1, 5), order=order, max_rows=20)
        assert plain.exceptAll(ranged).count() == 0


def test_ranges_need_an_order_that_can_be_measured(spark):
    df = spark.createDataFrame([("a", "x", 1.0)], "entity_id string, ds string, y double")
    with pytest.raises(ValueError, match="order by"):
        op.add_lags(df, {"y": "y"}, (1,), max_rows=5)


def test_ranged_lags_hold_no_whole_entity(spark):
    """The window with the lags is over ranges, and the only other one over counts of cells."""
    df = panel(spark, {"hot": {d: d for d in range(400)}})
    ranged = op.add_lags(df, {"y": "y"}, (1,), max_rows=50)
    plan = ranged._jdf.queryExecution().optimizedPlan().toString()
    raw = [line for line in plan.splitlines() if "Window [" in line and "__value_y" in line]
    assert raw and all("__range" in w for w in raw)
    largest = ranged.withColumn("n", F.count("*").over(Window.partitionBy("entity_id"))).first()
    assert largest.n == 400


def test_unread_lags_leave_the_plan(spark):
    df = panel(spark, {"a": {1: 1}})
    plan = op.add_lags(df, {"y": "y"}).select("y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_lags_share_one_shuffle_and_sort(spark):
    got = panel_log(panel_supplier(spark, SF, wide=False), NARROW)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # One shuffle of collapsed rows by entity and month, one by entity.
    assert plan.count("Exchange hashpartitioning(") == 2
    assert len(re.findall(r"Exchange hashpartitioning\(entity_id#\d+L, \d+\)", plan)) == 1
    assert plan.count("Window [lag(") == 1


NARROW = type(SUPPLIER)(
    **{
        **SUPPLIER.__dict__,
        "shares": {}, "bands": {}, "percapita_shares": (), "percapita_statics": (),
    }
)


def source(spark, rows):
    return spark.createDataFrame(
        rows,
        "entity_id int, entity_name string, ds date, cases bigint, deaths bigint, pop bigint, "
        "acctbal double",
    )


ROWS = [
    (1, "x", day(1), 10, 1, 100, 5.0),
    (1, "x", day(2), 20, 0, 100, 5.0),
    (1, "x", day(3), 30, 3, 100, 5.0),
    (2, "x", day(2), 7, 2, 50, 5.0),
    (3, "z", day(1), 9, 9, 10, -1.0),
]


def test_filter_runs_before_the_lags(spark):
    got = panel_log(source(spark, ROWS), NARROW).orderBy("entity_id", "ds").collect()
    assert [(r.entity_id, r.y) for r in got] == [(1, 10), (1, 30), (2, 7)]
    assert got[1].DT_1 == 1 and got[1].CCT_1 == round(math.log(10))
    raw = lag_frame(source(spark, ROWS), NARROW, keys=True).where("entity_id = 1")
    assert values(raw, "CCT_1", "ds") == [None, 10, 20]


def test_log_panel_mixes_logged_and_raw_as_documented(spark):
    r = panel_log(source(spark, ROWS), NARROW).where("y = 30").first()
    assert (r.log_cases, r.y, r.log_deaths, r.CC_PER_CAPITA, r.D_PER_CC) == (3.0, 30, 1.0, 0.3, 0.1)


def test_logged_column_may_take_the_source_name(spark):
    spec = type(NARROW)(**{**NARROW.__dict__, "log_prefix": "", "statics": ()})
    r = panel_log(source(spark, ROWS), spec).where("y = 30").first()
    assert (r.cases, r.CC_PER_CAPITA, r.deaths, r.DT_1) == (3.0, 0.3, 1.0, 1)


def test_lags_by_name_mix_entities_and_by_key_do_not(spark):
    by_key = panel_percapita(source(spark, ROWS), NARROW)
    by_name = panel_percapita(source(spark, ROWS), NARROW, by_name=True)
    assert by_key.where("entity_id = 2").first().CCT_1 is None
    assert by_name.where("entity_id = 2").first().CCT_1 == 0.1


def test_unique_rows(spark):
    df = panel(spark, {"a": {1: 1, 2: 2}})
    assert unique_rows(df, ["entity_id", "ds"]).exceptAll(df).count() == 0
    with pytest.raises(PySparkException, match="duplicate key"):
        unique_rows(df.union(df.limit(1)), ["entity_id", "ds"]).collect()


def test_split_future_and_union(spark):
    df = panel(spark, {"a": {0: 1, 1: 2, 9: 3}, "b": {0: 1}, "c": {0: 1}})
    train = op.train_split(df, ["a", "b"], str(day(1)))
    assert train.count() == 3
    future = op.future_dates(train, horizon=14)
    assert future.where("is_future").count() == 28 and future.count() == 31
    first = future.where("is_future").groupBy("entity_id").agg(F.min("ds").alias("d"))
    assert {r.entity_id: r.d for r in first.collect()} == {"a": day(2), "b": day(1)}
    both = op.union_entities(train, df.limit(1).withColumn("extra", F.lit(1)))
    assert both.where("extra is null").count() == 3 and both.count() == 4


# Keys and plans ----------------------------------------------------------------------------


def test_null_keys_are_rejected(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", day(1), 3)], "entity_id string, ds date, y int")
    for calendar in (False, True):
        with pytest.raises(Exception, match="NULL key"):
            op.add_lags(df, {"y": "y"}, (1,), calendar=calendar).collect()


def test_a_table_is_tested_once_for_its_keys(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([("a", 1), ("a", 1)], "k string, d int").write.parquet(path)
    with pytest.raises(ValueError, match="duplicate key"):
        scan_panel(spark, path, unique=("k", "d"))
    assert scan_panel(spark, path).count() == 2


def test_an_error_column_of_the_panel_is_kept(spark):
    predicted = spark.createDataFrame([("a", day(1), 2.0)], "entity_id string, ds date, yhat double")
    source = spark.createDataFrame([("a", day(1), 5.0, 9.0)], "entity_id string, ds date, y double, error double")
    r = op.forecast_error(predicted, source).first()
    assert (r.error, r.error_panel) == (3.0, 9.0)


def test_entity_frames_equal_the_union_of_frames(spark):
    df = panel(spark, {e: {d: d for d in range(3)} for e in "abc"})
    frames = [df.where(F.col("entity_id") == e) for e in "ab"]
    frames[0] = frames[0].withColumn("twice", 2 * F.col("y"))
    one = op.entity_frames(df, ["a", "b"], {"a": {"twice": 2 * F.col("y")}})
    assert sorted(map(str, one.collect())) == sorted(map(str, op.union_entities(*frames).collect()))


def test_line_items_are_read_once_and_all_counted(spark, tmp_path):
    lines = [(1, dt.datetime(2020, 1, 5), q, d, "O", "R") for q, d in ((0.0, -0.02), (75.0, 0.5), (50.0, 0.1))]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_discount double, l_linestatus string, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "s", 1.0, 3)], "s_suppkey long, s_name string, s_acctbal double, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    out = panel_supplier(spark, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    r = out.first()
    assert (r.pop, r.O_q01_05, r.O_q46_50, r.disc_00, r.disc_10) == (3, 1, 2, 1, 2)
    assert sum(r[c] for c in out.columns if c.startswith(("O_", "F_"))) == 3


def test_uniqueness_needs_no_sorted_aggregate(spark):
    df = panel(spark, {"a": {d: d for d in range(3)}})
    plan = op.join_actual_pred(df, df.withColumnRenamed("y", "yhat"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_a_sixth_segment_fails(spark, tmp_path):
    customer = spark.read.parquet(f"{SF}/customer.parquet")
    other = F.when(F.col("c_custkey") % 50 == 0, "GARDEN").otherwise(F.col("c_mktsegment"))
    customer.withColumn("c_mktsegment", other).write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    with pytest.raises(PySparkException, match="unknown market segment: GARDEN"):
        panel_nation(spark, str(tmp_path)).collect()


def test_a_scan_is_told_by_its_nodes(spark):
    df = spark.read.parquet(f"{SF}/customer.parquet")
    assert is_scan(df.where("c_custkey > 3").select(F.col("c_custkey").alias("Join"), F.lit("\nSort").alias("Window")))
    assert not is_scan(df.join(df.select("c_custkey"), "c_custkey")) and not is_scan(df.distinct())


def supplier_tables(spark, at, lines, suppliers):
    month = [dt.datetime(2024, 1 + k, 5) for k in range(12)]
    rows = [(s, month[m], "R" if m % 2 else "N", "O" if q % 2 else "F", float(q), q % 11 / 100) for s, m, q in lines]
    kinds = "l_suppkey bigint, l_shipdate timestamp_ntz, l_returnflag string, l_linestatus string, l_quantity double, l_discount double"
    spark.createDataFrame(rows, kinds).write.parquet(f"{at}/lineitem.parquet")
    rows = [(s, f"S{s}", 10.0 * s, 1) for s in suppliers]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_acctbal double, s_nationkey int").write.parquet(f"{at}/supplier.parquet")


def test_lines_collapse_to_one_count_before_the_shuffle(spark, tmp_path):
    rng = np.random.default_rng(3)
    lines = [(None if s == 7 else int(s), int(m), int(q)) for s, m, q in rng.integers([0, 0, 1], [9, 12, 50], (400, 3))]
    supplier_tables(spark, tmp_path, lines, [*range(7), 3])  # one supplier's row comes twice
    out = panel_supplier(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = [x for x in plan if "Aggregate [" in x][-1]  # the one next to the scan
    assert first.count("count(") == 1 and "sum(" not in first
    got = {}
    for r in out.collect():
        got.setdefault((r.entity_id, r.ds.month - 1), []).append(r)
    assert set(got) == {(s, m) for s, m, _ in lines if s is not None and s < 7}
    for (s, m), rows in got.items():
        assert len(rows) == (2 if s == 3 else 1)
        own = [q for e, _, q in lines if e == s]
        for r in rows:
            assert r.cases == sum((e, k) == (s, m) for e, k, _ in lines) and r.pop == len(own)
            assert r.O_q01_05 == sum(q % 2 == 1 and q <= 5 for q in own) and r.F_q46_50 == sum(q % 2 == 0 and q >= 46 for q in own)
            assert r.disc_03 == sum(q % 11 == 3 for q in own)


def test_parts_of_the_panel_grow_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("panelwright.sources.standin.LINES", 10)
    supplier_tables(spark, tmp_path, [(s, m, 5) for s in range(20) for m in range(12)], range(20))
    for wide in (False, True):
        assert panel_supplier(spark, str(tmp_path), wide).rdd.getNumPartitions() == 24
