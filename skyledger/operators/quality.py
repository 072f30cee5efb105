"""Contracts on tables, as operators: each gives rows that say what is wrong, and the ``assert_*``
forms raise with a sample. A whole table's checks run in one pass wherever they can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.functions.columns import ratio
from skyledger.operators.features import DIAGNOSTICS, HOUR_BEFORE, TARGETS, airport_movements


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df`` if its keys are unique. Nothing is ever deduplicated."""
    bad = duplicates(df, keys)
    n = bad.agg(F.count(F.lit(1)).alias("keys"), F.sum("n_rows").alias("rows")).first()
    if n["keys"]:
        raise ValueError(f"{what}: {n['rows']} rows share {n['keys']} keys, such as {[r.asDict() for r in bad.limit(5).collect()]}")
    return df


def profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys (none of them null), and each column's nulls: one row a column, from one aggregate."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)]
    whole = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*keys).alias("n_keys"), *nulls)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    return whole.select("n_rows", "n_keys", F.explode(entries).alias("e")).select("e.column", "n_rows", "n_keys", "e.n_null")


def schema_problems(df: DataFrame, wanted: StructType) -> list[str]:
    """Every difference of names, order and types."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in wanted}
    out = [f"missing: {c}" for c in want if c not in have] + [f"not declared: {c}" for c in have if c not in want]
    out += [f"{c}: {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]]
    if not out and [f.name for f in df.schema] != [f.name for f in wanted]:
        out.append("the order of columns differs")
    return out


def validate_schema(df: DataFrame, wanted: StructType, what: str) -> DataFrame:
    if found := schema_problems(df, wanted):
        raise ValueError(f"{what}: {'; '.join(found)}")
    return df


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def one_universe(columns: list[str]) -> None:
    """A set of columns may not mix both universes."""
    if any(c.endswith("_repl") for c in columns) and any(c.endswith("_ml") for c in columns):
        raise ValueError("columns of the replication and of the prediction universe stand together")


def constraint_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """For each rule how many rows break it; a rule that is null for a row is not broken."""
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~rule).alias(f"r_{i}") for i, rule in enumerate(rules.values())])
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r_{i}").alias("n_broken")) for i, n in enumerate(rules)])
    return one.select("n_rows", F.explode(entries).alias("e")).select("e.rule", "n_rows", "e.n_broken")


def fact_rules() -> dict[str, Column]:
    """What holds in every row of a fact table."""
    c = F.col
    return {
        "ym": c("ym") == c("year") * 100 + c("month"),
        "route": c("route") == F.concat("origin_node", F.lit("-"), "dest_node"),
        "realized": c("realized") + c("cancelled") <= c("flights"),
        "nested_dep": (c("dep_delayed_gt60") <= c("dep_delayed_gt30")) & (c("dep_delayed_gt30") <= c("dep_delayed_gt15")) & (c("dep_delayed_gt15") <= c("dep_delayed_gt0")),
        "nested_arr": (c("arr_delayed_gt60") <= c("arr_delayed_gt30")) & (c("arr_delayed_gt30") <= c("arr_delayed_gt15")) & (c("arr_delayed_gt15") <= c("arr_delayed_gt0")),
        "causes": c("cause_none") + reduce(lambda a, b: a + b, [c(f"cause_{k}") for k in ("weather", "airport_restricted", "rotation", "technical", "operational", "authorised", "other")]) == c("flights"),
        "hours": reduce(lambda a, b: a + b, [c(f"sched_dep_h{h:02d}") for h in range(24)]) == c("flights"),
    }


def lossless_casts(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """How many values of each column a cast would change or lose."""
    kinds = {f.name: f.dataType for f in df.schema}
    rules = {n: F.col(n).isNull() | F.col(n).try_cast(t).cast(kinds[n]).eqNullSafe(F.col(n)) for n, t in casts.items()}
    return constraint_report(df, rules)


def provenance(df: DataFrame, required: tuple[str, ...] = ("source", "confidence")) -> DataFrame:
    return constraint_report(df, {c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False)) for c in required})


def code_sets(table: DataFrame) -> DataFrame:
    """The codes of each category in order, to compare with the declared ones."""
    return table.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def additivity(fact: DataFrame, legs: DataFrame) -> DataFrame:
    """Routes and months where the fact's flights are not the legs counted directly."""
    a = fact.groupBy("ym", "route").agg(F.sum("flights").alias("fact_flights"))
    b = legs.where("universe_repl and route is not null and ym is not null").groupBy("ym", "route").agg(F.count(F.lit(1)).alias("staged_flights"))
    return a.join(b, ["ym", "route"], "full").where(~F.col("fact_flights").eqNullSafe(F.col("staged_flights")))


def table_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of which ``values`` differ, or that only one table has."""
    a = old.select(*keys, F.struct(*values).alias("old"))
    b = new.select(*keys, F.struct(*values).alias("new"))
    found = a.join(b, keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return found.select(*keys, kind.alias("kind"))


#: Columns of features that ``leakage_report`` reads.
CHECKED = (
    "year", "ym", "route", "flight_date", "origin_icao", "sched_dep_hour", "origin_movements_hour", "origin_p90_hour", "is_holiday", "route_late15_l1",
    "prev_leg", "prev_turnaround_min", "late15_arr", "is_realized", "actual_time_suspect",
)


def leakage_report(features: DataFrame, legs: DataFrame, fact: DataFrame, used: list[str], holidays: DataFrame) -> DataFrame:
    """One row a check: ``name, passed, detail``."""
    spark = features.sparkSession
    banned = sorted(set(used) & {*TARGETS, *DIAGNOSTICS})
    # what is known of the inbound leg an hour before only, by its name; the eve's list may hold no other such column
    late = sorted(c for c in used if c.startswith("prev_") and c not in (*HOUR_BEFORE, "prev_leg", "prev_turnaround_min"))
    static = [("no outcome among features", not banned, ",".join(banned)), ("hour-before columns are marked", not late, ",".join(late))]
    names = spark.createDataFrame(static, "name string, passed boolean, detail string")
    first_year = features.agg(F.min("year")).first()[0]
    counts = features.agg(
        F.count_if((F.col("prev_leg") == 1) & (F.col("prev_turnaround_min") < 0)).alias("late_inbound"),
        F.count_if((F.col("prev_leg") == 0) & F.col("prev_turnaround_min").isNotNull()).alias("stray_turnaround"),
        F.count_if(F.col("late15_arr").isNotNull() & ~(F.col("is_realized") & ~F.col("actual_time_suspect"))).alias("stray_target"),
        F.count_if((F.col("year") == F.lit(first_year)) & F.col("origin_p90_hour").isNotNull()).alias("first_year_p90"),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(c) == 0).alias("passed"), F.col(c).cast("string").alias("detail")) for n, c in (
        ("inbound lands before departure", "late_inbound"), ("no turnaround without inbound", "stray_turnaround"),
        ("targets only where readable", "stray_target"), ("first year has no percentile", "first_year_p90"))])
    plain = counts.select(F.explode(rows).alias("r")).select("r.*")
    recount = airport_movements(legs).select("year", F.col("icao").alias("origin_icao"), F.col("day").alias("flight_date"), F.col("hour").alias("sched_dep_hour"), F.col("movements").alias("m"))
    joined = features.join(recount, ["year", "origin_icao", "flight_date", "sched_dep_hour"], "left").agg(F.count_if(~F.col("m").eqNullSafe(F.col("origin_movements_hour"))).alias("n"))
    moved = joined.select(F.lit("movements recount").alias("name"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("detail"))
    special = features.join(F.broadcast(holidays.select(F.col("day").alias("flight_date"), F.lit(1).alias("h")).distinct()), "flight_date", "left")
    dated = special.agg(F.count_if(F.coalesce("h", F.lit(0)) != F.col("is_holiday")).alias("n")).select(F.lit("holidays as dated").alias("name"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("detail"))
    return names.unionByName(plain).unionByName(moved).unionByName(dated).unionByName(lag_check(features, fact))


def lag_check(features: DataFrame, fact: DataFrame, share: float = 0.999) -> DataFrame:
    """The route's lagged rate is that of the month before, and not of the month itself, where the
    two differ. ``fact`` needs the observations of the same reading (``arr_seen``)."""
    from skyledger.functions.columns import shift_ym

    month = fact.groupBy("route", "ym").agg(ratio(F.sum("arr_delayed_gt15"), F.sum("arr_seen")).alias("rate"))
    own = month.select("route", "ym", F.col("rate").alias("own"))
    before = month.select("route", shift_ym("ym", 1).alias("ym"), F.col("rate").alias("before"))
    rows = features.select("route", "ym", "route_late15_l1").join(own, ["route", "ym"]).join(before, ["route", "ym"]).where("own <> before")
    hit = rows.agg(F.avg((F.abs(F.col("route_late15_l1") - F.col("before")) < 1e-6).cast("double")).alias("hit"))
    return hit.select(F.lit("lag is the month before").alias("name"), (F.coalesce("hit", F.lit(1.0)) >= share).alias("passed"), F.col("hit").cast("string").alias("detail"))


def assert_all(report: DataFrame) -> None:
    """Raise once, with every check that failed. A report is a row a check."""
    bad = [f"{r['name']} ({r['detail']})" for r in report.where(~F.col("passed")).collect()]
    if bad:
        raise ValueError("; ".join(bad))


def dated_table(table: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """What is wrong with a table of dated carrier labels, a row a rule: columns that it must have,
    classes that are known, periods that end before they begin, and periods that overlap."""
    from skyledger.operators.fact import overlapping_periods

    wanted = ("airline", "grp", "cls", "start_ym", "end_ym")
    if lacking := missing_columns(table, list(wanted)):
        rows = [("required columns", False, ",".join(lacking))]
        return table.sparkSession.createDataFrame(rows, "name string, passed boolean, detail string")
    counts = table.agg(
        F.count_if(F.col("airline").isNull() | F.col("grp").isNull()).alias("labels are there"),
        F.count_if(~F.coalesce(F.col("cls").isin(*classes), F.lit(False))).alias("classes are known"),
        F.count_if(F.col("start_ym") > F.col("end_ym")).alias("periods begin before they end"),
    )
    plain = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("n")) for c in counts.columns])).alias("r")).select("r.*")
    overlaps = overlapping_periods(table).agg(F.count(F.lit(1)).alias("n")).select(F.lit("periods do not overlap").alias("name"), "n")
    return plain.unionByName(overlaps).select("name", (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("detail"))


def code_differences(table: DataFrame, declared: dict[str, tuple[str, ...]]) -> DataFrame:
    """Codes of a code table (``category, code``) and of the declared categories that only one of them
    has: ``category, code, only_in``."""
    have = table.select("category", "code").distinct()
    want = table.sparkSession.createDataFrame([(k, c) for k, codes in declared.items() for c in codes], "category string, code string")
    extra = have.join(want, ["category", "code"], "left_anti").withColumn("only_in", F.lit("table"))
    return extra.unionByName(want.join(have, ["category", "code"], "left_anti").withColumn("only_in", F.lit("declared")))


def coverage(legs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Listed airports that legs touch, listed ones that they do not, and airports that no list has:
    ``kind, n_airports, n_movements``. ``nodes`` has ``icao``."""
    touched = legs.select(F.explode(F.array("origin_icao", "dest_icao")).alias("icao")).where("icao is not null").groupBy("icao").agg(F.count(F.lit(1)).alias("n"))
    listed = nodes.select("icao").distinct()
    kinds = (("listed and flown", touched.join(listed, "icao", "left_semi")), ("flown, not listed", touched.join(listed, "icao", "left_anti")), ("listed, not flown", listed.join(touched, "icao", "left_anti").withColumn("n", F.lit(0).cast("long"))))
    parts = [df.agg(F.count(F.lit(1)).alias("n_airports"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_movements")).select(F.lit(k).alias("kind"), "n_airports", "n_movements") for k, df in kinds]
    return reduce(DataFrame.unionByName, parts)


def population(legs: DataFrame, last_year: int) -> DataFrame:
    """What becomes of each year's legs on the way to a model's rows, and the rows of legacy years whose
    empty times count as on time; needs ``class``. The years' sum is the row of the null year."""
    universe, flown = F.col("universe_repl"), F.col("universe_repl") & F.col("is_realized")
    usable = universe & F.col("sched_dep").isNotNull() & F.col("sched_arr").isNotNull()
    blank = flown & F.col("actual_arr").isNull()
    counts = {
        "n_legs": F.count(F.lit(1)), "n_universe": F.count_if(universe), "n_unusable_schedule": F.count_if(universe & ~usable), "n_realized": F.count_if(flown),
        "n_null_arrival": F.count_if(blank), "n_on_time_by_reading": F.count_if(blank & (F.col("year") <= last_year) & F.col("class").isin("FSC", "LCC", "regional")),
        "n_suspect": F.count_if(flown & F.col("actual_time_suspect")), "n_with_target": F.count_if(flown & F.col("arr_delay_min").isNotNull() & ~F.col("actual_time_suspect")),
    }
    return legs.rollup("year").agg(*[c.alias(n) for n, c in counts.items()])


def capacity_in_force(movements: DataFrame, declared: DataFrame) -> DataFrame:
    """Hours of each airport and month against the capacity declared for it: the latest declaration
    (``icao, from_day, per_hour``) not after the day. Days before the first one have none and are left out.

    Declarations become spans of days, so a day meets one of them by a range, and airports are few rows each."""
    span = Window.partitionBy("icao").orderBy("from_day")
    spans = declared.withColumn("to_day", F.lead("from_day").over(span)).select(F.col("icao").alias("_icao"), "from_day", "to_day", "per_hour")
    inside = (F.col("icao") == F.col("_icao")) & (F.col("day") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day")))
    met = movements.join(spans, inside).withColumn("ym", F.year("day") * 100 + F.month("day"))
    out = met.groupBy("icao", "ym", "per_hour").agg(F.count(F.lit(1)).alias("n_hours"), F.count_if(F.col("movements") >= F.col("per_hour")).alias("n_full"), F.sum("movements").alias("movements"))
    return out.withColumn("sh_full", ratio("n_full", "n_hours"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows and the nulls of its columns as it is written, and what holds the
    counts afterwards: no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns]), seen


def metrics_rows(spark: SparkSession, table: str, seen: Observation) -> DataFrame:
    """The counts of an observed table that was written, as ``table, metric, value``."""
    return spark.createDataFrame([(table, k, int(v)) for k, v in sorted(seen.get.items())], "table string, metric string, value long")
