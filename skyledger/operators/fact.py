"""The fact table and what stands beside it: carrier labels, context, movements, year accounts.

Legs are shuffled once, on the fact's key; everything coarser starts from the fact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import OUTLIER_MIN, effective_delay, ratio, shift_ym, within
from skyledger.functions.measures import add_up, completed

FACT_KEYS = ("ym", "year", "month", "route", "origin_node", "dest_node", "group", "class")
ROUTE_KEYS = FACT_KEYS[:6]


def label_carriers(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with ``group`` and ``class`` of its carrier in its month; without one the carrier's
    own code and ``other``. ``groups`` has open ends as null and no overlaps; it is a reference
    table of a few rows a carrier, and so it is broadcast."""
    g = groups.select(F.col("airline").alias("g_airline"), "grp", "cls", "start_ym", "end_ym")
    inside = (F.col("start_ym").isNull() | (F.col("ym") >= F.col("start_ym"))) & (F.col("end_ym").isNull() | (F.col("ym") <= F.col("end_ym")))
    joined = df.join(F.broadcast(g), (df["airline"] == F.col("g_airline")) & inside, "left")
    named = joined.withColumns({"group": F.coalesce("grp", "airline"), "class": F.coalesce("cls", F.lit("other"))})
    return named.drop("g_airline", "grp", "cls", "start_ym", "end_ym")


def overlapping_periods(groups: DataFrame) -> DataFrame:
    """Periods that begin before an earlier one of the same carrier has ended."""
    start, end = F.coalesce("start_ym", F.lit(0)), F.coalesce("end_ym", F.lit(999912))
    before = Window.partitionBy("airline").orderBy("first", "last", "grp").rowsBetween(Window.unboundedPreceding, -1)
    spans = groups.select("airline", "grp", start.alias("first"), end.alias("last"))
    return spans.withColumn("before", F.max("last").over(before)).where("before >= first").select("airline", "grp", "first", "last", "before")


def build_fact(legs: DataFrame, groups: DataFrame, threshold: float = OUTLIER_MIN) -> DataFrame:
    """One row for each group, route and month of universe legs: all additive measures, the exact
    number of flight numbers, and whether the group entered or left the route.

    The distinct count has a grouping of its own, of the keys and the flight number alone, so that the
    wide sums are shuffled once and on the coarser key.
    """
    rows = label_carriers(legs.where(F.col("universe_repl") & F.col("route").isNotNull() & F.col("ym").isNotNull()), groups)
    sums = completed(add_up(rows, list(FACT_KEYS), threshold))
    numbers = rows.select(*[F.col(k).alias(f"_{k}") for k in FACT_KEYS], "flight_number").distinct()
    numbers = numbers.groupBy(*[f"_{k}" for k in FACT_KEYS]).agg(F.count("flight_number").alias("n_flight_numbers"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in FACT_KEYS]
    fact = sums.join(numbers, reduce(lambda a, b: a & b, same)).drop(*[f"_{k}" for k in FACT_KEYS])
    spell = Window.partitionBy("route", "group").orderBy("ym")
    entry = F.coalesce(F.lag("ym").over(spell) != shift_ym("ym", -1), F.lit(True))
    left = F.coalesce(F.lead("ym").over(spell) != shift_ym("ym", 1), F.lit(True))
    return fact.withColumns({"is_entry": entry.cast("int"), "is_exit": left.cast("int")})


def route_month_context(legs: DataFrame, threshold: float = OUTLIER_MIN, empty_means_on_time: bool = True) -> DataFrame:
    """Counts over all legs of a route and month, and the median and 90th percentile of universe
    delays. Order statistics don't add up: coarser ones come from ``delay_counts``, not from these."""
    rows = legs.where(F.col("route").isNotNull() & F.col("ym").isNotNull())
    out = [
        F.count(F.lit(1)).alias("n_rows_all"),
        F.count_if(F.col("di").isin(1, 2)).alias("n_extra"),
        F.count_if(F.col("di") == 3).alias("n_return"),
        F.count_if(F.col("line_type") == "I").alias("n_intl_leg"),
        F.count_if(F.col("line_type").isin("C", "G")).alias("n_cargo"),
        F.count_if(F.col("line_type") == "L").alias("n_postal"),
        # a null line or authorisation is not counted
        F.count_if(~(F.col("line_type").isin("N", "R", "E") & (F.col("di") == 0))).alias("n_off_universe"),
    ]
    for side in ("dep", "arr"):
        delay = effective_delay(side, empty_means_on_time)
        used = F.when(F.col("universe_repl") & F.col("is_realized") & within(delay, threshold), delay)
        out += [F.percentile(used, F.lit(q)).alias(f"{side}_delay_{name}_min") for name, q in (("median", 0.5), ("p90", 0.9))]
    return rows.groupBy(*ROUTE_KEYS).agg(*out)


def delay_counts(legs: DataFrame, keys: tuple[str, ...] = ROUTE_KEYS, threshold: float = OUTLIER_MIN, empty_means_on_time: bool = True) -> DataFrame:
    """How many realised universe legs of ``keys`` have which delay: ``side, delay, n``. These counts add
    up, and so the order statistics of any coarser key follow from them without the legs."""
    rows = legs.where(F.col("route").isNotNull() & F.col("ym").isNotNull() & F.col("universe_repl") & F.col("is_realized"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), effective_delay(s, empty_means_on_time).cast("double").alias("delay")) for s in ("dep", "arr")])
    long = rows.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*").where(within("delay", threshold))
    return long.groupBy(*keys, "side", "delay").agg(F.count(F.lit(1)).alias("n"))


def delay_percentiles(counts: DataFrame, keys: list[str], levels: tuple[tuple[str, float], ...] = (("median", 0.5), ("p90", 0.9))) -> DataFrame:
    """Exact percentiles of both sides by ``keys``, out of counts by any finer keys."""
    merged = counts.groupBy(*keys, "side", "delay").agg(F.sum("n").alias("n"))
    of = lambda side, q: F.percentile(F.when(F.col("side") == side, F.col("delay")), F.lit(q), F.col("n"))
    return merged.groupBy(*keys).agg(*[F.sum(F.when(F.col("side") == s, F.col("n"))).alias(f"{s}_n") for s in ("dep", "arr")], *[of(s, q).alias(f"{s}_delay_{name}_min") for s in ("dep", "arr") for name, q in levels])


def both_sides(legs: DataFrame, *columns: str, place: str = "node") -> DataFrame:
    """A row for the departure and one for the arrival of each leg, with ``place``, ``hour`` and
    ``columns``. A leg is read once."""
    side = lambda end, hour: F.struct(F.col(f"{end}_{place}").alias(place), F.col(hour).alias("hour"))
    ends = F.array(side("origin", "dep_hour"), side("dest", "arr_hour"))
    return legs.select(*columns, F.explode(ends).alias("s")).select(*columns, f"s.{place}", "s.hour")


def node_day_hour(legs: DataFrame) -> DataFrame:
    """Movements of each node, day and scheduled hour, both sides of each universe leg."""
    rows = legs.where(F.col("universe_repl") & F.col("ym").isNotNull() & F.col("flight_date").isNotNull())
    sides = both_sides(rows.withColumn("day", F.col("flight_date")), "year", "ym", "day").where("node is not null and hour is not null")
    return sides.groupBy("node", "year", "ym", "day", "hour").agg(F.count(F.lit(1)).alias("movements"))


def out_of_window(legs: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Rows dated outside ``years``, a null year included."""
    return legs.where(F.col("year").isNull() | ~F.col("year").isin(*years)).groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


def missing_actual_by_year(fact: DataFrame) -> DataFrame:
    """Share of realised legs without an actual time, by year and side."""
    sums = fact.groupBy("year").agg(*[F.sum(c).alias(c) for c in ("realized", "dep_missing_actual", "arr_missing_actual")])
    return sums.withColumns({f"sh_{s}_missing": ratio(f"{s}_missing_actual", "realized") for s in ("dep", "arr")})


def months_on_route() -> Column:
    """Months since the group last entered the route; needs ``route, group, ym, is_entry``."""
    from skyledger.functions.columns import month_index

    so_far = Window.partitionBy("route", "group").orderBy("ym").rowsBetween(Window.unboundedPreceding, 0)
    began = F.last(F.when(F.col("is_entry") == 1, month_index("ym")), ignorenulls=True).over(so_far)
    return (month_index("ym") - began + 1).cast("int")
