"""Reference tables, contracts on them, accounting, views, and the optional parts of the entry."""

import datetime
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skyledger.functions import columns as C
from skyledger.operators import features as X
from skyledger.operators import quality as Q
from skyledger.plans import legs as L
from skyledger.plans import queries, views
from skyledger.sources import raw as S

SF, ROOT = "/root/testdata/sf0.001", Path(__file__).resolve().parent.parent


def test_reference_tables_are_scanned_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text('note,b,a\n"x, y",7, N00 \n,,N01\n,z,\n')
    rows = S.scan_reference(spark, str(tmp_path / "t.csv"), "a string, b int").collect()
    assert [tuple(r) for r in rows] == [("N00", 7), ("N01", None), (None, None)]
    with pytest.raises(ValueError, match="no column c"):
        S.scan_reference(spark, str(tmp_path / "t.csv"), "a string, c int")


def test_month_keys_of_text(spark):
    rows = spark.createDataFrame([("2001-07",), (" 1999-12 ",), ("2001-13",), ("2001-7",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(C.ym_of_text("t")).collect()] == [200107, 199912, None, None, None, None]


def test_contract_of_dated_labels(spark):
    schema = "airline string, grp string, cls string, start_ym int, end_ym int"
    good = spark.createDataFrame([("A", "G", "FSC", None, 199912), ("A", "H", "LCC", 200001, None)], schema)
    assert good.where("1 = 0").columns and Q.dated_table(good, L.CLASSES).where("not passed").isEmpty()
    bad = good.unionByName(spark.createDataFrame([("A", "K", "no", 199901, 199812), ("B", None, None, 200001, None)], schema))
    assert {r["name"]: r["detail"] for r in Q.dated_table(bad, L.CLASSES).where("not passed").collect()} == {"labels are there": "1", "classes are known": "2", "periods begin before they end": "1", "periods do not overlap": "1"}
    assert Q.dated_table(good.drop("cls"), L.CLASSES).first()["detail"] == "cls"
    table = spark.createDataFrame([("a", "X1"), ("b", "Y1")], "category string, code string")
    assert sorted(map(tuple, Q.code_differences(table, {"a": ("X1", "X2")}).collect())) == [("a", "X2", "declared"), ("b", "Y1", "table")]


def test_capacity_is_the_latest_declared(spark):
    day = datetime.date
    declared = spark.createDataFrame([("N", day(2000, 1, 10), 5), ("N", day(2000, 2, 1), 2)], "icao string, from_day date, per_hour int")
    moved = spark.createDataFrame([("N", day(2000, 1, 9), 9), ("N", day(2000, 1, 10), 5), ("N", day(2000, 1, 31), 4), ("N", day(2000, 2, 1), 2), ("M", day(2000, 2, 1), 9)], "icao string, day date, movements long")
    got = {(r["ym"], r["per_hour"]): (r["n_hours"], r["n_full"]) for r in Q.capacity_in_force(moved, declared).collect()}
    assert got == {(200001, 5): (2, 1), (200002, 2): (1, 1)}


def test_counts_taken_while_writing(spark):
    table, seen = Q.observed(spark.createDataFrame([(1, "a"), (2, None), (None, None)], "x int, y string"), "t")
    S.materialised(table, "t")
    assert {r["metric"]: r["value"] for r in Q.metrics_rows(spark, "t", seen).collect()} == {"n_rows": 3, "null_x": 1, "null_y": 2}


def test_views_answer_in_sql(spark):
    names = queries._views(spark, SF)
    assert len(names) == 18 and all(spark.catalog.tableExists(n) for n in names)
    assert spark.sql("select count(*) from v_check_additivity").first()[0] == 0
    both = spark.sql("select (select sum(f) from v_route_month), (select sum(flights) from v_fact), (select count(*) from v_flights_repl), (select sum(movements) from v_city_month) / 2").first()
    assert len(set(map(int, both))) == 1


def test_tables_as_given_out(spark):
    panel = spark.createDataFrame([(200001, " a-b ", 2.0000005, 1, 1.5)], "ym int, route string, z double, sched_dep_h00 int, sum_x double").withColumn("b", F.lit(1.25))
    assert views.published(panel).columns == ["ym", "route", "b", "z"]
    assert tuple(views.allowed(panel, ["route", "b"]).first()) == ("A-B", 1.25)
    with pytest.raises(ValueError, match="lacks c"):
        views.allowed(panel, ["route", "c"])
    slim = views.slim_fact(panel)
    assert "sched_dep_h00" not in slim.columns and dict(slim.dtypes)["z"] == "float" and slim.first()["z"] == 2.0


def test_a_table_is_written_once_and_anew_for_other_files(spark, tmp_path):
    for t in L.TABLES:
        spark.range(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    made = []
    make = lambda: (made.append(1), spark.range(len(made)))[1]
    assert [L.written_once(spark, str(tmp_path), "n", make).count() for _ in range(2)] == [1, 1] and len(made) == 1
    spark.range(9).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    assert L.written_once(spark, str(tmp_path), "n", make).count() == 2 and len(made) == 2


def test_planted_leaks_are_seen(spark):
    """Each check of the report turns false on features that break it."""
    features, fact = queries._features(spark, SF).cache(), queries._fact(spark, SF)
    seen = fact.withColumn("arr_seen", X._observed("arr", L.LAST_LEGACY_YEAR))
    special, legs = queries._dims(spark, SF)["special"], L.legs(spark, SF)
    used = [c for c in features.columns if c not in (*X.TARGETS, *X.DIAGNOSTICS, "leg_id", "flight_date")]

    def failed(df, columns=used):
        return {r["name"] for r in Q.leakage_report(df, legs, seen, columns, special).where("not passed").collect()}

    assert failed(features) == set()
    assert failed(features, [*used, "late15_arr"]) == {"no outcome among features"} and failed(features, [*used, "prev_dep_delay"]) == {"hour-before columns are marked"}
    broken = {
        "inbound lands before departure": {"prev_leg": F.lit(1), "prev_turnaround_min": F.lit(-5.0)}, "no turnaround without inbound": {"prev_leg": F.lit(0), "prev_turnaround_min": F.lit(9.0)},
        "targets only where readable": {"late15_arr": F.lit(1.0), "is_realized": F.lit(False)}, "first year has no percentile": {"origin_p90_hour": F.lit(1.0)},
        "movements recount": {"origin_movements_hour": F.col("origin_movements_hour") + 1}, "holidays as dated": {"is_holiday": 1 - F.col("is_holiday")},
    }
    for name, new in broken.items():
        assert name in failed(features.withColumns(new)), name
    rates = seen.groupBy("route", "ym").agg(C.ratio(F.sum("arr_delayed_gt15"), F.sum("arr_seen")).alias("own"))
    leak = features.drop("route_late15_l1").join(rates, ["route", "ym"]).withColumnRenamed("own", "route_late15_l1")
    assert "lag is the month before" in failed(leak)
    with pytest.raises(ValueError, match="movements recount"):
        Q.assert_all(Q.leakage_report(features.withColumns(broken["movements recount"]), legs, seen, used, special))


def test_the_entry_without_the_text_part(tmp_path):
    """Without the text operators, and with nothing but an empty folder of theirs, all else is there."""
    for name in ("__spark_entry__.py", "skyledger"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for part in (ROOT / "skyledger").iterdir():
        if part.name != "llm":
            (tmp_path / "skyledger" / part.name).symlink_to(part)
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    for step in ("none", "empty"):
        if step == "empty":
            (tmp_path / "skyledger" / "llm" / "__pycache__").mkdir(parents=True)
        out = subprocess.run([sys.executable, "-B", "-c", ask], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
        n, m, pipeline = out.stdout.split()[-3:]
        assert int(n) == len(queries.QUERIES) and int(m) > 50 and pipeline == "False", out.stderr[-500:]


def test_lines_are_shuffled_once_for_their_order_and_customer(spark):
    from skyledger.plans import legs

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = legs.computed_legs(spark, SF)
        joins = re.findall(r"Join Inner[^\n]*", df._jdf.queryExecution().optimizedPlan().toString())
        assert len(joins) == 3 and sum("custkey" in j for j in joins) == 1
        plan = df._jdf.queryExecution().executedPlan().toString()
        # above the join with customers, the lines are shuffled for orders and for suppliers
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 6
        plain = spark.sql(legs.LEGS, **{t: spark.read.parquet(f"{SF}/{t}.parquet") for t in legs.TABLES})
        assert df.drop("dow").exceptAll(plain).isEmpty() and df.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_legs_are_added_up_before_they_meet_their_baselines(spark):
    from skyledger.plans import queries as Q

    text = Q.naive_baselines(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "leg_id" not in text and "arr_delay_min" not in text and "skyledger-outcomes" in " ".join(Q.naive_baselines(spark, SF).inputFiles())


def test_ranges_of_staged_files_are_as_many_as_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from skyledger.plans import legs
    from skyledger.sources import raw

    rows, asked, real = legs.legs(spark, SF), [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *c: asked.append(n) or real(self, n, *c))
    raw.write_staged(rows, str(tmp_path / "staged"), file_rows=50)
    assert asked and asked[0] <= spark.sparkContext.defaultParallelism
    staged = raw.read_staged(spark, str(tmp_path / "staged"))
    sizes = [r["count"] for r in staged.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == rows.count()


def test_the_leakage_report_makes_features_once(spark, capsys):
    """Its checks read a written table: no plan of theirs makes inbound legs anew."""
    from skyledger.plans import queries

    report = queries.leakage_report(spark, SF)
    report.explain()
    assert "landed" not in capsys.readouterr().out
    assert report.count() == 9 and report.where("not passed").isEmpty()
