"""Flight-level features of closed windows only, and the targets beside them.

Monthly rates are keyed by the month they are a feature of, so the join downstream is an equality.
Small monthly tables join by their keys; only legs are large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.columns import in_scope, minutes_between, month_index, ratio, scoped_delay, shift_ym
from skyledger.operators.fact import both_sides, label_carriers, months_on_route
from skyledger.operators.project import MIN_DAY_HOURS, PERCENTILE
from skyledger.sources.raw import materialised

LATE, LATE_30, KNOWN_BEFORE = 15, 30, 60
HIGH_SEASON = (1, 7, 12)
#: Names that a model may never see: targets, and what is known only after departure.
TARGETS = ("late15_arr", "late30_arr", "arr_delay_min", "late15_dep", "cancelled")
DIAGNOSTICS = ("is_realized", "has_arr_actual", "has_dep_actual", "actual_time_suspect", "on_time_no_bav", "prev_arr_known_h1")
#: Columns of legs that no feature or target is made of; rows are sorted without them.
NOT_FEATURED = ("cause_code", "actual_block_min", "dep_delay_min", "arr_delay_min", "universe_repl", "universe_ml", "line_type", "di", "dow", "dep_hour", "arr_hour", "flight_date", "month")
HOUR_BEFORE = ("prev_arr_delay_min", "prev_late15", "prev_cancelled")


def airport_movements(legs: DataFrame) -> DataFrame:
    """Scheduled movements of each airport, day and hour over all legs, by the year of the leg (a
    leg that lands on 1 January counts in the table of the year it left in)."""
    sides = F.array(
        F.struct(F.col("origin_icao").alias("icao"), F.to_date("sched_dep").alias("day"), F.hour("sched_dep").alias("hour")),
        F.struct(F.col("dest_icao").alias("icao"), F.to_date("sched_arr").alias("day"), F.hour("sched_arr").alias("hour")),
    )
    rows = legs.select("year", F.explode(sides).alias("s")).select("year", "s.*").where("icao is not null and day is not null")
    return rows.groupBy("year", "icao", "day", "hour").agg(F.count(F.lit(1)).alias("movements"))


def daily(movements: DataFrame) -> DataFrame:
    return movements.groupBy("year", "icao", "day").agg(F.sum("movements").alias("movements"))


def p90_of_year_before(movements: DataFrame) -> DataFrame:
    """For each airport and year, the 90th percentile of the hours of the built year before it."""
    limits = movements.groupBy("icao", "year").agg(F.percentile("movements", F.lit(PERCENTILE)).alias("threshold"), F.count(F.lit(1)).alias("n_day_hours"))
    built = movements.select("year").distinct().withColumn("next_year", F.lead("year").over(Window.orderBy("year")))
    kept = limits.where(F.col("n_day_hours") >= MIN_DAY_HOURS).join(F.broadcast(built), "year").where("next_year is not null")
    return kept.select("icao", F.col("next_year").alias("year"), "threshold", "n_day_hours")


def collapse_fact(fact: DataFrame) -> DataFrame:
    """One row a key where an older table has several: counts add, flags take the least."""
    keys = ["ym", "route", "origin_node", "dest_node", "group", "class"]
    how: dict[str, Column] = {"year": F.min("year"), "month": F.min("month"), "n_flight_numbers": F.max("n_flight_numbers"), "is_entry": F.min("is_entry"), "is_exit": F.min("is_exit")}
    return fact.groupBy(*keys).agg(*[how.get(c, F.sum(c)).alias(c) for c in fact.columns if c not in keys])


def _observed(side: str, last_year: int) -> Column:
    scope = (F.col("year") <= last_year) & F.col("class").isin("FSC", "LCC", "regional")
    return F.col(f"{side}_delay_obs") + F.when(scope, F.col(f"{side}_missing_actual")).otherwise(0)


def monthly_lags(fact: DataFrame, last_year: int) -> dict[str, DataFrame]:
    """Rates of the month before (and of the same month a year before), by route, group, node,
    group on route and group at node."""
    rows = fact.withColumns({"arr_seen": _observed("arr", last_year), "dep_seen": _observed("dep", last_year)})
    month = rows.groupBy("route", "ym").agg(*[F.sum(c).alias(c) for c in ("flights", "arr_seen", "arr_delayed_gt15")])
    rate = month.withColumn("late15", ratio("arr_delayed_gt15", "arr_seen"))
    one = rate.select("route", shift_ym("ym", 1).alias("ym"), F.col("late15").alias("route_late15_l1"), F.col("arr_seen").alias("route_obs_l1"))
    twelve = rate.select("route", shift_ym("ym", 12).alias("ym"), F.col("late15").alias("route_late15_l12"))
    route = one.join(twelve, ["route", "ym"], "full").withColumn("route_obs_l1", F.coalesce("route_obs_l1", F.lit(0)))

    by_group = rows.groupBy("group", "ym").agg(F.sum("arr_seen").alias("n"), F.sum("arr_delayed_gt15").alias("late"))
    group = by_group.select("group", shift_ym("ym", 1).alias("ym"), ratio("late", "n").alias("group_late15_l1"))

    def node_rates(end: str, side: str) -> DataFrame:
        sums = rows.groupBy(F.col(f"{end}_node").alias("node"), "ym").agg(
            F.sum("flights").alias("n"), F.sum(f"{side}_seen").alias("seen"), F.sum(f"{side}_delayed_gt15").alias("late"), F.sum("cause_weather").alias("weather")
        )
        return sums.select("node", shift_ym("ym", 1).alias("ym"), ratio("late", "seen").alias(f"node_{side}_late15_l1"), ratio("weather", "n").alias(f"node_weather_{side}_l1"))

    node = node_rates("origin", "dep").join(node_rates("dest", "arr"), ["node", "ym"], "full")
    on_route = rows.groupBy("group", "route", "ym").agg(F.sum("flights").alias("flights"), F.min("is_entry").alias("is_entry"))
    share = ratio("flights", F.sum("flights").over(Window.partitionBy("route", "ym")))
    group_route = on_route.select("group", "route", shift_ym("ym", 1).alias("ym"), share.alias("airline_route_share_l1"), months_on_route().alias("months_on_route"))
    at_node = rows.groupBy("group", F.col("origin_node").alias("node"), "ym").agg(F.sum("flights").alias("flights"))
    share = ratio("flights", F.sum("flights").over(Window.partitionBy("node", "ym")))
    group_node = at_node.select("group", "node", shift_ym("ym", 1).alias("ym"), share.alias("airline_origin_share_l1"))
    return {"route": route, "group": group, "node": node, "group_route": group_route, "group_node": group_node}


def flight_number_lag(legs: DataFrame, groups: DataFrame, last_year: int, months: int = 3) -> DataFrame:
    """Late arrivals of a flight number in the ``months`` closed months before each month: each
    month's counts are dealt to the months they are a feature of and added up there."""
    rows = label_carriers(legs.where("universe_repl and airline is not null and flight_number is not null and ym is not null"), groups)
    delay = scoped_delay("arr", last_year)
    counts = rows.groupBy("airline", "flight_number", "ym").agg(
        F.count_if(F.col("is_realized") & delay.isNotNull()).alias("obs"), F.count_if(F.col("is_realized") & (delay > LATE)).alias("late")
    )
    ahead = counts.withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(months))))
    window = ahead.groupBy("airline", "flight_number", shift_ym("ym", F.col("ahead")).alias("ym")).agg(F.sum("obs").alias("obs"), F.sum("late").alias("late"))
    return window.withColumn("late15", ratio("late", "obs"))


def calendar(days: DataFrame, special: DataFrame) -> DataFrame:
    """``days`` (``day``) with holiday, holiday window and high season; ``special`` has ``day``,
    ``is_holiday`` and ``is_observance``, a few rows a year."""
    marked = days.join(F.broadcast(special), "day", "left").select(
        "day", F.coalesce("is_holiday", F.lit(0)).alias("is_holiday"), F.coalesce("is_observance", F.lit(0)).alias("is_observance")
    )
    # the neighbours of a special day, by moving it and not by a window over all days
    near = special.where("is_holiday = 1 or is_observance = 1").select(F.explode(F.array(*[F.date_add("day", k) for k in (-1, 0, 1)])).alias("day")).distinct()
    return (
        marked.join(F.broadcast(near.withColumn("near", F.lit(1))), "day", "left")
        .withColumns({"is_holiday_window": F.coalesce("near", F.lit(0)), "is_high_season": F.month("day").isin(*HIGH_SEASON).cast("int")})
        .drop("near")
    )


def inbound_leg(legs: DataFrame) -> DataFrame:
    """``legs`` with ``leg_index`` and the latest earlier leg of the same airline, number and day
    that lands where this one starts: ``p_leg_id, p_sched_arr, p_actual_arr, p_arr_delay,
    p_status``.

    Arrivals and departures of a key are put in one order of time, and each departure takes the
    last arrival before it, so a key's legs are sorted once and never paired with each other. At
    equal times arrivals come first; of equal arrivals the one of the greater ``leg_id`` counts. A
    leg that ends where it starts without taking time is nobody's inbound, nor its own.
    """
    key = ["airline", "flight_number", "sched_date"]
    legs = legs.select(*[c for c in legs.columns if c not in NOT_FEATURED])
    first = legs.withColumn("sched_date", F.to_date("sched_dep"))
    first = first.withColumn("leg_index", F.row_number().over(Window.partitionBy(*key).orderBy("sched_dep", "leg_id")))
    moves = (F.col("origin_icao") != F.col("dest_icao")) | (F.col("sched_arr") > F.col("sched_dep"))
    arrival = F.struct(F.col("sched_arr").alias("p_sched_arr"), F.col("leg_id").alias("p_leg_id"), F.col("eff_actual_arr").alias("p_actual_arr"), F.col("eff_arr_delay").alias("p_arr_delay"), F.col("status").alias("p_status"))
    whole = F.struct(*[F.col(f"`{c}`") for c in first.columns])
    kinds = first.select(arrival.alias("landed"), whole.alias("leg")).schema
    none = {n: F.lit(None).cast(kinds[n].dataType) for n in ("landed", "leg")}
    event = lambda icao, at, kind, landed, leg: F.struct(F.col(icao).alias("icao"), F.col(at).alias("at"), F.lit(kind).alias("kind"), landed.alias("landed"), leg.alias("leg"))
    lands = event("dest_icao", "sched_arr", 0, F.when(moves, arrival).otherwise(none["landed"]), none["leg"])
    leaves = event("origin_icao", "sched_dep", 1, none["landed"], whole)
    events = first.select(*key, "leg_id", F.explode(F.array(lands, leaves)).alias("e")).select(*key, "leg_id", "e.*")
    before = Window.partitionBy(*key, "icao").orderBy("at", "kind", "leg_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("p", F.last("landed", ignorenulls=True).over(before)).where("kind = 1").select("leg.*", "p.*")


def flight_rows(legs: DataFrame, groups: DataFrame, last_year: int) -> DataFrame:
    """Universe legs with a usable schedule, their carrier, their delays under the narrower
    reading, and their inbound leg."""
    usable = legs.where("universe_repl and sched_dep is not null and sched_arr is not null and route is not null and ym is not null and origin_icao is not null and dest_icao is not null")
    rows = label_carriers(usable, groups)
    scope = in_scope(last_year)
    rows = rows.withColumns(
        {
            "no_bav": F.coalesce(scope & (F.col("actual_arr").isNull() | F.col("actual_dep").isNull()), F.lit(False)),
            "eff_arr_delay": scoped_delay("arr", last_year),
            "eff_dep_delay": scoped_delay("dep", last_year),
            "eff_actual_arr": F.when(F.col("actual_arr").isNotNull(), F.col("actual_arr")).when(scope, F.col("sched_arr")),
        }
    )
    return inbound_leg(rows)


def targets_of(rows: DataFrame) -> DataFrame:
    """``rows`` with the targets (null unless the leg was realised and its times can be read) and
    the diagnostics."""
    usable = F.col("is_realized") & ~F.col("actual_time_suspect")
    late = lambda c, cut: F.when(usable & F.col(c).isNotNull(), (F.col(c) > cut).cast("float"))
    lead = minutes_between("p_actual_arr", "sched_dep")
    return rows.withColumns(
        {
            "late15_arr": late("eff_arr_delay", LATE),
            "late30_arr": late("eff_arr_delay", LATE_30),
            "arr_delay_target": F.when(usable, F.col("eff_arr_delay")).cast("float"),
            "late15_dep": late("eff_dep_delay", LATE),
            "cancelled": (F.col("status") == "cancelled").cast("int"),
            "has_arr_actual": F.col("actual_arr").isNotNull(),
            "has_dep_actual": F.col("actual_dep").isNotNull(),
            "on_time_no_bav": F.col("no_bav"),
            "prev_arr_known_h1": F.when(F.col("p_actual_arr").isNotNull(), (lead >= KNOWN_BEFORE).cast("float")),
        }
    )


def route_kind(shuttles: tuple[str, ...]) -> Column:
    return (
        F.when(F.col("route").isin(*shuttles), "shuttle")
        .when((F.col("origin_metro") == 1) & (F.col("dest_metro") == 1), "metro")
        .when(F.col("o_known") & F.col("d_known"), "capital")
        .when(F.col("o_known") | F.col("d_known"), "mixed")
        .otherwise("other")
    )


def airport_hours(legs: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """A written table of each airport's hours: movements of the hour (``mh``) and of the day (``md``),
    the percentile of the year before (``p90``), and what the reference tables say of the airport.
    Every leg's own hours are among them."""
    hours = materialised(airport_movements(legs), "hours")
    days, limits = daily(hours).withColumnRenamed("movements", "md"), p90_of_year_before(hours).select("icao", "year", F.col("threshold").alias("p90"))
    airports = dims["nodes"].select("icao", F.col("is_metro").alias("metro"), F.lit(True).alias("known")).join(dims["slots"].select("icao", F.col("slot_from_ym").alias("slot")), "icao", "full")
    out = hours.withColumnRenamed("movements", "mh").join(days, ["year", "icao", "day"]).join(limits, ["year", "icao"], "left").join(airports, "icao", "left")
    return materialised(out, "airport-hours")


def months_of_routes(fact: DataFrame, distances: DataFrame, last_year: int) -> DataFrame:
    """A written table of the fact's groups, routes and months with the rates of the month before each,
    by all the keys of ``monthly_lags``."""
    whole = materialised(collapse_fact(fact), "collapsed")
    lags = monthly_lags(whole, last_year)
    out = whole.select("group", "route", "origin_node", "dest_node", "ym").distinct()
    for m, node in (("o", "origin_node"), ("d", "dest_node")):
        out = out.join(lags["node"].select(F.col("node").alias(node), "ym", *[F.col(c).alias(f"{m}_{c}") for c in lags["node"].columns if c not in ("node", "ym")]), [node, "ym"], "left")
    out = out.join(distances, ["origin_node", "dest_node"], "left").join(lags["route"], ["route", "ym"], "left").join(lags["group"], ["group", "ym"], "left")
    out = out.join(lags["group_route"], ["group", "route", "ym"], "left").join(lags["group_node"].withColumnRenamed("node", "origin_node"), ["group", "origin_node", "ym"], "left")
    return materialised(out, "months")


def build_features(legs: DataFrame, fact: DataFrame, groups: DataFrame, dims: dict[str, DataFrame], last_year: int, shuttles: tuple[str, ...] = ()) -> DataFrame:
    """The feature table, one row a schedulable leg.

    ``dims``: ``calendar`` (day ...), ``nodes`` (icao, is_metro), ``slots`` (icao, slot_from_ym) and
    ``distances`` (origin_node, dest_node, distance_km): reference tables whose size hangs on days
    and airports. What hangs on an airport's hour, and what hangs on a group, route and month, is
    gathered in one table each, at that small grain, so legs meet few tables and each by equality.
    Those tables are written first, so that Spark knows their sizes when it plans: it broadcasts the
    small ones, and the legs are not shuffled for them.
    """
    rows = targets_of(flight_rows(legs, groups, last_year))
    hours, months = airport_hours(legs, dims), months_of_routes(fact, dims["distances"], last_year)
    number = flight_number_lag(legs, groups, last_year).select("airline", "flight_number", "ym", F.col("late15").alias("flight_no_late15_l3"), F.col("obs").alias("fn_obs"))
    out = rows.withColumns({"arr_date": F.to_date("sched_arr"), "dep_h": F.hour("sched_dep"), "arr_h": F.hour("sched_arr")})
    out = out.join(materialised(dims["calendar"], "calendar").withColumnRenamed("day", "sched_date"), "sched_date", "left")
    for m, end, day, hour in (("o", "origin", "sched_date", "dep_h"), ("d", "dest", "arr_date", "arr_h")):
        here = hours.select("year", F.col("icao").alias(f"{end}_icao"), F.col("day").alias(day), F.col("hour").alias(hour), *[F.col(c).alias(f"{m}_{c}") for c in ("mh", "md", "p90", "metro", "known", "slot")])
        out = out.join(here, ["year", f"{end}_icao", day, hour], "left")
    out = out.join(months.drop("origin_node", "dest_node"), ["group", "route", "ym"], "left")
    out = out.join(materialised(number, "numbers"), ["airline", "flight_number", "ym"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = out.withColumns({"origin_metro": zero("o_metro"), "dest_metro": zero("d_metro"), "o_known": F.col("o_known").isNotNull(), "d_known": F.col("d_known").isNotNull()})
    return out.select(
        "leg_id", F.col("sched_date").alias("flight_date"), F.year("sched_date").alias("year"), (F.year("sched_date") * 100 + F.month("sched_date")).alias("ym"),
        "flight_number", "route", F.month("sched_date").alias("month"), F.weekday("sched_date").alias("dow"), (F.weekday("sched_date") >= 5).cast("int").alias("is_weekend"),
        *[zero(c).alias(c) for c in ("is_holiday", "is_observance", "is_holiday_window", "is_high_season")],
        F.col("dep_h").alias("sched_dep_hour"), F.col("arr_h").alias("sched_arr_hour"), "sched_block_min", "leg_index", "origin_icao", "dest_icao", "origin_node", "dest_node",
        route_kind(shuttles).alias("route_kind"), F.col("distance_km").cast("double").alias("distance_km"), "origin_metro", "dest_metro",
        flag(F.col("ym") >= F.col("o_slot")).alias("origin_slot_coordinated"), flag(F.col("ym") >= F.col("d_slot")).alias("dest_slot_coordinated"),
        zero("o_mh").alias("origin_movements_hour"), zero("d_mh").alias("dest_movements_hour"), zero("o_md").alias("origin_movements_day"), zero("d_md").alias("dest_movements_day"),
        *[F.when(F.col(f"{m}_p90").isNotNull(), (zero(f"{m}_mh") >= F.col(f"{m}_p90")).cast("float")).alias(f"{end}_p90_hour") for m, end in (("o", "origin"), ("d", "dest"))],
        "airline", "group", "class", "airline_route_share_l1", "airline_origin_share_l1", "months_on_route", F.col("months_on_route").isNull().cast("int").alias("is_new_on_route"),
        "route_late15_l1", zero("route_obs_l1").alias("route_obs_l1"), "route_late15_l12", "group_late15_l1", "flight_no_late15_l3", zero("fn_obs").alias("flight_no_obs_l3"),
        F.col("o_node_dep_late15_l1").alias("origin_late15_l1"), F.col("d_node_arr_late15_l1").alias("dest_late15_l1"),
        F.col("o_node_weather_dep_l1").alias("origin_weather_l1"), F.col("d_node_weather_arr_l1").alias("dest_weather_l1"),
        F.col("p_sched_arr").isNotNull().cast("int").alias("prev_leg"), minutes_between("p_sched_arr", "sched_dep").alias("prev_turnaround_min"),
        F.col("p_arr_delay").alias("prev_arr_delay_min"), F.when(F.col("p_arr_delay").isNotNull(), (F.col("p_arr_delay") > LATE).cast("float")).alias("prev_late15"),
        F.when(F.col("p_sched_arr").isNotNull(), (F.col("p_status") == "cancelled").cast("float")).alias("prev_cancelled"),
        "is_realized", "has_arr_actual", "has_dep_actual", "actual_time_suspect", "on_time_no_bav", "prev_arr_known_h1",
        "late15_arr", "late30_arr", F.col("arr_delay_target").alias("arr_delay_min"), "late15_dep", "cancelled",
    )
