"""The engine's tables as temporary views, so that plain SQL can be asked of them.

``register`` names each one in the session's catalogue. Views stand on the written legs and fact and
on the tables made from them; a view holds a plan and no data, so nothing is computed until it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import fact as A
from skyledger.operators import project as J
from skyledger.operators import quality as Q
from skyledger.operators.panel import in_sample


def route_sums(fact: DataFrame) -> DataFrame:
    """What adds up of a route and month. Shares are left to ``project``: those of sums are not sums of shares."""
    kept = ("arr_delayed_gt15", "arr_delay_obs", "arr_missing_actual", "sum_arr_delay_min", "cause_set_prwheather", "cause_set_princident", "cause_set_pr_connc")
    short = {"f": F.sum("flights"), "fl_real": F.sum("realized"), "fl_can": F.sum(F.col("flights") - F.col("realized")), "fl_odel": F.sum("dep_delayed_gt0"), "fl_ddel": F.sum("arr_delayed_gt0")}
    return fact.groupBy(*A.ROUTE_KEYS).agg(F.count_distinct("group").alias("n_groups"), *[c.alias(n) for n, c in short.items()], *[F.sum(n).alias(n) for n in kept])


def node_movements(fact: DataFrame) -> DataFrame:
    """Each row of the fact as its origin and as its destination sees it."""
    seen = lambda side, node, late: F.struct(F.col(node).alias("node"), F.col(late).alias("delayed_gt15"), F.lit(side).alias("side"))
    ends = F.explode(F.array(seen("departure", "origin_node", "dep_delayed_gt15"), seen("arrival", "dest_node", "arr_delayed_gt15")))
    return fact.select("ym", "year", "month", "group", "class", "flights", "realized", "cancelled", ends.alias("s")).select("s.node", "ym", "year", "month", "group", "class", "flights", "realized", "cancelled", "s.delayed_gt15", "s.side")


def city_sums(movements: DataFrame) -> DataFrame:
    sums = {"movements": "flights", "movements_realized": "realized", "movements_cancelled": "cancelled", "movements_delayed_gt15": "delayed_gt15"}
    return movements.groupBy("node", "ym", "year", "month").agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count_distinct("group").alias("n_groups"))


def register(spark: SparkSession, legs: DataFrame, fact: DataFrame, panel: DataFrame, city: DataFrame, airline_city: DataFrame, references: dict[str, DataFrame], window: tuple[int, int]) -> list[str]:
    """Register every view and return their names. ``airline_city`` comes from ``project.add_hub``;
    ``references`` has ``groups``, ``cause_codes``, ``nodes`` and ``distances``."""
    movements, universe = node_movements(fact), legs.where("universe_repl")
    views = {
        "v_flights": legs,
        "v_flights_repl": universe,
        "v_flights_ml": legs.where("universe_ml"),
        "v_fact": fact,
        "v_route_month": route_sums(fact),
        "v_route_hhi": fact.where("flights > 0").groupBy("ym", "route").agg(J.hhi("flights").alias("hhi_flights"), J.leader_share("flights").alias("sh_leader")),
        "v_node_movements": movements,
        "v_city_month": city_sums(movements),
        "v_panel": panel,
        "v_panel_article": in_sample(panel, *window).where("f > 0"),
        "v_city": city,
        "v_airline_city": airline_city,
        "v_hubs": airline_city.where("is_hub = 1").select("ym", "node", "group", "movements", "city_share", "hub_score"),
        "v_check_additivity": Q.additivity(fact, legs),
        **{f"v_{n}": references[n] for n in ("groups", "cause_codes", "nodes", "distances")},
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def published(panel: DataFrame, digits: int = 6) -> DataFrame:
    """The panel as it is given out: without the sums that its shares are made from and without the
    hours, floats rounded half to even, keys first and the other columns in order of name."""
    keys = [c for c in A.ROUTE_KEYS if c in panel.columns]
    hidden = [c for c in panel.columns if c.startswith("sum_") or c in J.HOURS]
    rest = sorted(set(panel.columns) - {*keys, *hidden})
    floats = {f.name for f in panel.schema if f.dataType.simpleString() in ("double", "float")}
    return panel.select(*keys, *[F.bround(F.col(c).cast("double"), digits).alias(c) if c in floats else F.col(c) for c in rest])


def slim_fact(fact: DataFrame, digits: int = 3) -> DataFrame:
    """The fact as it is given out: no hours, sums as rounded single floats."""
    floats = {f.name for f in fact.schema if f.dataType.simpleString() in ("double", "float")}
    return fact.select(*[F.bround(F.col(f"`{c}`"), digits).cast("float").alias(c) if c in floats else F.col(f"`{c}`") for c in fact.columns if c not in J.HOURS])


def allowed(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The estimation's own columns and no others, keys trimmed and in capitals; a missing one is an error."""
    if missing := Q.missing_columns(panel, columns):
        raise ValueError(f"the panel lacks {', '.join(missing)}")
    texts = {f.name for f in panel.schema if f.dataType.simpleString() == "string"}
    return panel.select(*[F.upper(F.trim(F.col(c))).alias(c) if c in texts else F.col(c) for c in columns])


#: Columns of the panel that the estimation reads.
ESTIMATION = ["ym", "route", "f", "fl_real", "fl_can", "all_prdelarr", "all_prdeldep", "all_minsarr", "all_minsdep", "hhi_flights", "maxcthhi_flights", "gmchhi_flights", "maxcongested", "maxalccfu", "lcc", "dailyfl00", "distance_km"]
