import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skyledger.functions import columns as C
from skyledger.functions import measures as M
from skyledger.operators import regress as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_keys(spark):
    rows = spark.createDataFrame([("N00", "N05", 199712), ("X", None, 200001)], "o string, d string, ym int")
    got = rows.select(C.node_of("o", {"N00": "M1"}).alias("n"), C.route_of("o", "d").alias("r"), C.shift_ym("ym", 1).alias("a"), C.shift_ym("ym", -12).alias("b"), C.month_index("ym").alias("i")).collect()
    assert [tuple(r) for r in got] == [("M1", "N00-N05", 199801, 199612, 1997 * 12 + 11), ("X", None, 200002, 199901, 24000)]


def test_text(spark):
    rows = spark.createDataFrame([(" realizado ", "7", " n/a", "ab"), ("CANCELADO", "A", "r", "A1"), ("?", "b", "", None), (None, "x", None, "ABC")], "s string, d string, l string, c string")
    got = rows.select(C.clean_status("s"), C.clean_di("d"), C.clean_line("l"), C.clean_code("c")).collect()
    assert [tuple(r) for r in got] == [("realized", 7, None, "AB"), ("cancelled", 10, "R", None), ("other", 11, None, None), ("other", None, None, None)]
    assert one(spark, k=C.cause_key(F.lit("Atrasos não específicos – outros,")))["k"] == "ATRASOS NAO ESPECIFICOS OUTROS"
    assert one(spark, a=C.parse_time(F.lit("31/12/1999 23:59")), b=C.parse_time(F.lit("31/02/1999 23:59")), c=C.parse_time(F.lit(""))) == {"a": datetime(1999, 12, 31, 23, 59), "b": None, "c": None}


def test_delays(spark):
    rows = spark.createDataFrame([(datetime(2000, 1, 1, 10), datetime(2000, 1, 1, 9, 30)), (datetime(2000, 1, 1), None)], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in rows.select(C.minutes_between("a", "b")).collect()] == [-30.0, None]
    far = spark.createDataFrame([(datetime(2000, 1, 1), datetime(2090, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert far.select(C.block_minutes("a", "b")).first()[0] is None
    assert one(spark, a=C.suspect(F.lit(1440.0), F.lit(None).cast("double")), b=C.suspect(F.lit(None).cast("double"), F.lit(3.0))) == {"a": True, "b": False}
    assert one(spark, a=C.log_odds(F.lit(0.5)), b=C.log_odds(F.lit(1.0)), c=C.log_odds(F.lit(0.0))) == {"a": 0.0, "b": None, "c": None}
    assert one(spark, a=C.greater_end(F.lit(1.0), F.lit(2.0)), b=C.greater_end(F.lit(1.0), F.lit(None).cast("double"))) == {"a": 2.0, "b": None}
    assert one(spark, a=C.finite(F.lit(float("inf"))), b=C.ratio(F.lit(1), F.lit(0)), c=C.ratio(F.lit(1), F.lit(4))) == {"a": None, "b": None, "c": 0.25}


def test_every_measure_has_one_end_and_follows_from_what_is_summed():
    names = [m.name for m in (*M.SUMMED, *M.FOLLOWING)]
    assert len(set(names)) == len(names) and set(M.of_end("dep", "arr", "both", None)) == set(M.ADDITIVE)
    assert all(re.fullmatch("[a-z_0-9]+", w) is None or w in names for m in M.FOLLOWING for w in re.split("[^a-z_0-9]+", m.how) if w)


def test_measures_of_a_few_legs(spark):
    """Counts take every realised delay, sums those within the threshold, and p15 the whole delay."""
    rows = [("realized", 20.0, 40.0, 60, 80, 23, 6, "XO"), ("realized", 400.0, -5.0, 60, None, 8, 1, None), ("realized", None, None, None, None, 0, 2, "ZZ"), ("cancelled", None, None, 60, None, 5, 5, "XN")]
    legs = spark.createDataFrame(rows, "status string, dep_delay_min double, arr_delay_min double, sched_block_min int, actual_block_min int, dep_hour int, dow int, cause_code string")
    at = F.lit(datetime(2000, 1, 1)).cast("timestamp_ntz")
    seen = lambda e: F.when(F.col(f"{e}_delay_min").isNotNull(), at)
    legs = legs.withColumns({"is_realized": F.col("status") == "realized", "k": F.lit(1), "sched_dep": at, "sched_arr": at, "actual_dep": seen("dep"), "actual_arr": seen("arr")})
    got = M.completed(M.add_up(legs, ["k"])).first().asDict()
    want = {"flights": 4, "realized": 3, "cancelled": 1, "dep_delay_obs": 2, "dep_missing_actual": 1, "dep_delayed_gt60": 1, "dep_outliers": 1, "sum_dep_delay_min": 20.0, "sum_dep_delay_p15_min": 20.0,
            "arr_early": 1, "sum_arr_delay_min": 35.0, "sum_arr_delay_pos_min": 40.0, "arr_delayed_1530": 0, "arr_delayed_gt30": 1, "recovery_obs": 2, "sum_recovery_min": -385.0, "recovered_gt15": 1,
            "sched_block_obs": 3, "padding_obs": 1, "sum_padding_min": -20.0, "night_flights": 3, "weekend_flights": 2, "cause_none": 1, "cause_other": 2, "cause_weather": 1, "cause_set_prwheather": 1,
            "cancel_technical": 1, "cancel_weather": 0, "sched_dep_h23": 1, "sched_dep_h08": 1}
    assert {n: got[n] for n in want} == want and set(got) == {"k", *M.ADDITIVE}


def test_chi_square():
    assert R.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert R.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert R.chi2_tail(0.0, 3) == 1.0
