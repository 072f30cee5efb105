"""The registered queries of the punctuality engine. Each reads the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.functions import columns as C
from skyledger.functions import measures as M
from skyledger.operators import boost
from skyledger.operators import evaluate as E
from skyledger.operators import fact as A
from skyledger.operators import features as X
from skyledger.operators import increment as I
from skyledger.operators import panel as P
from skyledger.operators import project as J
from skyledger.operators import quality as Q
from skyledger.operators import regress as R
from skyledger.plans import legs as L
from skyledger.plans import views as V
from skyledger.sources import raw as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats to a fixed number of digits, so that the order of sums does not show."""
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), digits) for c in floats}) if floats else df


def _fact(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table, written once: all coarser tables start from it."""
    return L.written_once(spark, sf, "fact", lambda: A.build_fact(L.legs(spark, sf), L.groups(spark)))


def _day_hour(spark: SparkSession, sf: str) -> DataFrame:
    return L.written_once(spark, sf, "day_hour", lambda: A.node_day_hour(L.legs(spark, sf)))


def _context(spark: SparkSession, sf: str) -> DataFrame:
    return L.written_once(spark, sf, "context", lambda: A.route_month_context(L.legs(spark, sf)))


def _route(spark: SparkSession, sf: str) -> DataFrame:
    return L.written_once(spark, sf, "route_month", lambda: J.route_month(_fact(spark, sf), L.LCC_GROUPS, L.CLASSES))


def _city(spark: SparkSession, sf: str) -> DataFrame:
    return L.written_once(spark, sf, "city_month", lambda: J.city_month(_fact(spark, sf), _day_hour(spark, sf), L.LCC_GROUPS, L.CLASSES))


def _panel_fact(spark: SparkSession, sf: str) -> DataFrame:
    return P.in_panel(_fact(spark, sf), L.PANEL_NODES)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled universe legs with a deterministic score and a label, for metrics and moments."""
    base = A.label_carriers(L.legs(spark, sf).where("universe_repl"), L.groups(spark))
    key = F.split("leg_id", "-")
    score = F.pmod(key[0].cast("long") * 13 + key[2].cast("long") * 7, F.lit(101)) / 100.0
    return base.withColumns({"p": score, "y": F.when(F.col("arr_delay_min").isNotNull(), (F.col("arr_delay_min") > 15).cast("int"))})


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    """A small panel of routes and months with regressors and instruments, for the estimators."""
    rows = L.legs(spark, sf).where("universe_repl and dep_delay_min is not null and abs(dep_delay_min) < 313.25 and abs(arr_delay_min) < 313.25")
    out = rows.groupBy(F.col("route").alias("od"), "ym").agg(
        F.avg("arr_delay_min").alias("y"), F.avg("dep_delay_min").alias("x"), F.count(F.lit(1)).cast("double").alias("w"),
        F.avg((F.col("dep_hour") >= 12).cast("double")).alias("z1"), F.avg("sched_block_min").alias("z2"), F.avg((F.col("cause_code") == "AR").cast("double")).alias("z3"),
        F.avg((F.col("arr_delay_min") > 15).cast("double")).alias("y2"), F.avg((F.col("dep_delay_min") > 15).cast("double")).alias("x2"), F.avg((F.col("dow") >= 5).cast("double")).alias("z4"), F.avg(F.col("flight_number").cast("double")).alias("z5"),
    )
    # the estimators pass over it several times
    return S.materialised(out.withColumns({"t": C.month_index("ym"), "z3": F.coalesce("z3", F.lit(0.0))}), "monthly")


@query
def stage_legs(spark, sf):
    l = L.legs(spark, sf)
    raw = l.select("leg_id", "airline", "flight_number", "line_type", "di", "origin_icao", "dest_icao", "status", "cause_code", "sched_dep", "actual_dep", "sched_arr", "actual_arr")
    out = S.staged(raw, L.METRO)
    return rounded(out.select("leg_id", "flight_date", "ym", "origin_node", "dest_node", "route", "dep_delay_min", "arr_delay_min", *[F.col(c).cast("int").alias(c) for c in ("year", "month", "dow", "dep_hour", "arr_hour", "sched_block_min", "actual_block_min")], "universe_repl", "universe_ml", "is_realized", "actual_time_suspect"))


def _spelled(spark: SparkSession, sf: str) -> DataFrame:
    """Legs in the words of the raw files."""
    stamp = lambda c: F.coalesce(F.date_format(c, "dd/MM/yyyy HH:mm"), F.lit(""))
    return L.legs(spark, sf).select(
        "leg_id", "year", "airline", F.format_string("%04d", "flight_number").alias("number"), F.col("di").cast("string").alias("di"), "line_type", "origin_icao", "dest_icao",
        *[stamp(c).alias(c) for c in ("sched_dep", "actual_dep", "sched_arr", "actual_arr")],
        F.when(F.col("is_realized"), "Realizado").otherwise(" CANCELADO ").alias("status"), F.coalesce("cause_code", F.lit("N/A")).alias("cause"),
    )


@query
def raw_layout_staging(spark, sf):
    """Legs spelled as files of the older layout, written, and staged from them."""
    path = S.scratch_path(spark, "raw")
    _spelled(spark, sf).drop("leg_id", "year").write.option("header", True).option("encoding", "ISO-8859-1").option("quote", "").option("emptyValue", "").csv(path)
    staged = S.stage_legs(spark, {S.LEGACY: [path]}, L.METRO, L.groups(spark))
    return rounded(staged.groupBy("year", "group", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("dep_delay_min").alias("minutes"), F.count("cause_code").alias("n_coded"), F.count_if("universe_repl").alias("n_repl")).withColumn("year", F.col("year").cast("int")))


#: The first year whose legs are spelled in the wide layout, and the one in so many lines that is cut short.
WIDE_FROM, CUT = 1998, 97


@query
def two_layouts_with_rejects(spark, sf):
    """Legs spelled in the layout of their year, some lines cut short, some with a field more, some of the
    wide ones not in its encoding; staged in one plan, and what was left out by layout and reason."""
    text = _spelled(spark, sf)
    key = F.pmod(F.split("leg_id", "-")[0].cast("long") * 7 + F.split("leg_id", "-")[2].cast("long"), F.lit(CUT))
    none = F.lit("")
    fields = {
        S.LEGACY: [F.col(c) for c in ("airline", "number", "di", "line_type", "origin_icao", "dest_icao", "sched_dep", "actual_dep", "sched_arr", "actual_arr", "status", "cause")],
        S.WIDE: [F.col("airline"), F.lit("Viação"), F.col("number"), F.col("di"), F.col("line_type"), none, none, F.col("origin_icao"), none, F.col("sched_dep"), F.col("actual_dep"), F.col("dest_icao"), none, F.col("sched_arr"), F.col("actual_arr"), F.col("status"), *[none] * 4],
    }
    paths, out = {}, None
    for layout, rows in ((S.LEGACY, text.where(F.col("year") < WIDE_FROM)), (S.WIDE, text.where(F.col("year") >= WIDE_FROM))):
        line = F.concat_ws(layout.separator, *fields[layout])
        line = F.when(key == 0, F.substring_index(line, layout.separator, 5)).when(key == 1, F.concat(line, F.lit(layout.separator + "?"))).otherwise(line)
        raw = F.encode(line, layout.encoding)
        if layout is S.WIDE:
            raw = F.when(key == 2, F.concat(raw, F.lit(b"\xe9"))).otherwise(raw)
        paths[layout] = [S.scratch_path(spark, f"raw-{layout.name}")]
        headed = rows.select(raw.cast("string").alias("value")).repartition(4)
        title = ";".join(f"f{i}" for i in range(layout.width))
        headed.mapInArrow(_with_first_line(title), "value string").write.text(paths[layout][0])
        bad = S.rejects(spark, paths[layout], layout).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("line") > 1).alias("n_below_header"))
        bad = bad.select(F.lit(layout.name).alias("layout"), "reason", "n", "n_below_header")
        out = bad if out is None else out.unionByName(bad)
    staged = S.stage_legs(spark, paths, L.METRO)
    good = staged.groupBy(F.when(F.col("year") < WIDE_FROM, S.LEGACY.name).otherwise(S.WIDE.name).alias("layout")).agg(F.count(F.lit(1)).alias("n"), F.count("dep_delay_min").alias("n_below_header"))
    return out.unionByName(good.select("layout", F.lit("staged").alias("reason"), "n", "n_below_header"))


def _with_first_line(title: str):
    """A step that puts a line before those of a task."""

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([title])], names=["value"])
        yield from batches

    return run


@query
def staged_layout(spark, sf):
    """Legs staged in files of some thousands, and how many of them a route may be in."""
    path, legs = S.scratch_path(spark, "staged"), L.legs(spark, sf)
    S.write_staged(legs, path, file_rows=5000)
    staged = S.read_staged(spark, path)
    needed = S.files_for(staged, "M1-M2")
    return needed.select(F.col("n_rows"), (F.col("n_needed") < F.col("n_files")).alias("prunes"))


CAUSES = [("AUTORIZADO", True, "XB"), ("AUTORIZADO", False, "OA"), ("CONDICOES METEOROLOGICAS", False, "WO"), ("CONDICOES METEOROLOGICAS", True, "XO")]


@query
def cause_text_to_code(spark, sf):
    legs = L.legs(spark, sf)
    text = F.when(F.col("cause_code").isin("XA", "XB", "AR"), "Autorizado!").when(F.col("cause_code").isin("WO", "XO"), " Condições – meteorológicas").when(F.col("cause_code").isNotNull(), "sem código")
    rows = legs.withColumn("text_key", C.cause_key(text)).drop("cause_code")
    return S.cause_codes(rows, spark.createDataFrame(CAUSES, "text_key string, cancelled boolean, code string")).groupBy("status", "text_key", "cause_code").agg(F.count(F.lit(1)).alias("n"))


@query
def label_carriers(spark, sf):
    return A.label_carriers(L.legs(spark, sf), L.groups(spark)).groupBy("airline", "ym", "group", "class").agg(F.count(F.lit(1)).alias("n"))


@query
def interval_overlaps(spark, sf):
    """Carriers' observed spans on routes as periods: which begin before an earlier one ended."""
    spans = L.legs(spark, sf).groupBy("airline", F.col("route").alias("grp")).agg(F.min("ym").alias("start_ym"), F.max("ym").alias("end_ym"))
    return A.overlapping_periods(spans)


@query
def fact_group_route_month(spark, sf):
    return rounded(_fact(spark, sf))


@query
def route_month_context(spark, sf):
    return rounded(_context(spark, sf))


def _delay_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.written_once(spark, sf, "delay_counts", lambda: A.delay_counts(L.legs(spark, sf)))


@query
def route_year_percentiles(spark, sf):
    """Percentiles of routes and years out of the counts of routes and months."""
    return rounded(A.delay_percentiles(_delay_counts(spark, sf), ["year", "route"]))


@query
def city_month_percentiles(spark, sf):
    """Departures of the city that a route starts from, arrivals of the one that it ends at."""
    at = F.when(F.col("side") == "dep", F.col("origin_node")).otherwise(F.col("dest_node"))
    return rounded(A.delay_percentiles(_delay_counts(spark, sf).withColumn("node", at), ["ym", "node"]))


@query
def fact_in_increments(spark, sf):
    """The fact out of three deliveries of files, each read once: the years up to 1996, those up to 1998,
    and the rest with a month that lies within the first delivery's years."""
    late = F.col("ym") == 199607
    part = F.when((F.col("year") <= 1996) & ~late, 1).when((F.col("year") <= 1998) & ~late, 2).otherwise(3)
    path = S.scratch_path(spark, "deliveries")
    L.legs(spark, sf).withColumn("part", part).write.partitionBy("part").parquet(path)
    store = I.FactStore(spark, S.scratch_path(spark, "store"), L.groups(spark))
    for k in (1, 2, 3):  # each time with all files that are there
        now = S.manifest(spark, [f"{path}/part={i}" for i in range(1, k + 1)])
        store.update(now, lambda paths: spark.read.parquet(*paths))
    return rounded(store.fact().select(*_fact(spark, sf).columns))


@query
def node_day_hour(spark, sf):
    return _day_hour(spark, sf)


@query
def out_of_window(spark, sf):
    return A.out_of_window(L.legs(spark, sf), L.YEARS[1:-1])


@query
def missing_actual_by_year(spark, sf):
    return rounded(A.missing_actual_by_year(_fact(spark, sf)))


@query
def route_month(spark, sf):
    return rounded(_route(spark, sf))


@query
def route_ratios(spark, sf):
    r = J.route_ratios(_route(spark, sf))
    return rounded(r.select(*A.ROUTE_KEYS, *[c for c in r.columns if c.startswith("sh_") or c.endswith(("mean_min", "pos_min", "sd_min", "denominator")) and not c.startswith("sum_") or c in ("peak_hour_share", "hhi_hours", "prwheather", "princident", "pr_connc")]))


@query
def route_structure(spark, sf):
    r = _route(spark, sf)
    return rounded(r.select("ym", "route", "n_groups", "hhi_flights", J.normalised_hhi(F.col("hhi_flights"), F.col("n_groups")).alias("hhi_norm"), "sh_leader", "n_entries", "n_exits", "entry_lcc"))


@query
def city_month(spark, sf):
    return rounded(_city(spark, sf))


@query
def airline_city_month(spark, sf):
    return rounded(J.city_sums(_fact(spark, sf), with_group=True))


@query
def city_congestion(spark, sf):
    return rounded(J.monthly_congestion(_day_hour(spark, sf)))


@query
def hubs(spark, sf):
    return rounded(J.add_hub(J.city_sums(_fact(spark, sf), with_group=True)).select("ym", "node", "group", "class", "movements", "city_share", "hub_score", "is_hub"))


@query
def panel_slices(spark, sf):
    return rounded(P.panel_slices(_panel_fact(spark, sf), P.slice_masks(L.LCC_GROUPS, L.FSC_GROUPS)))


@query
def presence(spark, sf):
    return P.presence(_panel_fact(spark, sf), L.PRESENCE)


def _distances(spark: SparkSession) -> DataFrame:
    nodes = list(L.PANEL_NODES)
    rows = [(a, b, 200.0 + 300.0 * abs(i - j)) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if a != b]
    return spark.createDataFrame(rows, "origin_node string, dest_node string, distance_km double")


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    def make() -> DataFrame:
        fact = _panel_fact(spark, sf)
        # the city stands at both ends of a route, and is made once, out of the panel's own routes
        city = S.materialised(J.city_month(fact, _day_hour(spark, sf), L.LCC_GROUPS, L.CLASSES), "city")
        return P.assemble_panel(fact, _route(spark, sf), _context(spark, sf), city, _distances(spark), lcc_groups=L.LCC_GROUPS, fsc_groups=L.FSC_GROUPS, wanted=L.PRESENCE)

    return L.written_once(spark, sf, "panel", make)


@query
def panel_route_month(spark, sf):
    return rounded(_panel(spark, sf))


@query
def estimation_panel(spark, sf):
    """The columns that the estimation may read, of the months of its window."""
    return rounded(P.in_sample(V.allowed(_panel(spark, sf), V.ESTIMATION), *L.WINDOW))


@query
def slim_fact(spark, sf):
    return rounded(V.slim_fact(_fact(spark, sf)))


def _references(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Reference tables out of the legs and the fixed values, kept as CSV and scanned from there."""
    legs = L.legs(spark, sf)
    airports = legs.select(F.explode(F.array(F.struct(F.col("origin_icao").alias("icao"), F.col("origin_node").alias("node")), F.struct(F.col("dest_icao").alias("icao"), F.col("dest_node").alias("node")))).alias("s")).select("s.*").distinct()
    spans = A.label_carriers(legs, L.groups(spark)).groupBy("airline", F.col("group").alias("grp"), F.col("class").alias("cls")).agg(F.min("ym").alias("start_ym"), F.max("ym").alias("end_ym"))
    codes = spark.createDataFrame([(c, k) for k, v in M.CATEGORIES.items() for c in v], "code string, category string")
    tables = {
        "groups": (spans, "airline string, grp string, cls string, start_ym int, end_ym int"), "cause_codes": (codes, "code string, category string"),
        "nodes": (airports, "icao string, node string"), "distances": (_distances(spark), "origin_node string, dest_node string, distance_km double"),
    }
    out = {}
    for name, (df, schema) in tables.items():
        path = S.scratch_path(spark, f"reference-{name}")
        df.coalesce(1).write.option("header", True).csv(path)  # some dozens of rows
        out[name] = S.scan_reference(spark, path, schema)
    return out


@query
def reference_groups(spark, sf):
    return _references(spark, sf)["groups"]


@query
def dated_contract(spark, sf):
    """The contract of dated labels on the carriers' observed spans, which overlap where a label comes back."""
    return Q.dated_table(_references(spark, sf)["groups"], L.CLASSES)


@query
def code_differences(spark, sf):
    """Codes that the legs have and no category declares, and the other way round."""
    legs = L.legs(spark, sf).where("cause_code is not null").select(F.col("cause_code").alias("code")).distinct()
    table = legs.join(F.broadcast(_references(spark, sf)["cause_codes"]), "code", "left").withColumn("category", F.coalesce("category", F.lit("none")))
    return Q.code_differences(table, M.CATEGORIES)


def _views(spark: SparkSession, sf: str) -> list[str]:
    fact = _fact(spark, sf)
    city = _city(spark, sf)
    airline_city = J.add_hub(J.city_sums(fact, with_group=True), L.HUBS)
    return V.register(spark, L.legs(spark, sf), fact, _panel(spark, sf), city, airline_city, _references(spark, sf), L.WINDOW)


@query
def view_rows(spark, sf):
    """Every view by name and how many rows it has, asked for in SQL."""
    names = _views(spark, sf)
    return spark.sql(" union all ".join(f"select '{n}' as view, count(*) as n_rows from {n}" for n in names))


@query
def view_route_month(spark, sf):
    _views(spark, sf)
    return rounded(spark.sql("select * from v_route_month join v_route_hhi using (ym, route)"))


@query
def view_city_month(spark, sf):
    _views(spark, sf)
    return rounded(spark.sql("select * from v_city_month"))


@query
def view_hubs(spark, sf):
    _views(spark, sf)
    return rounded(spark.sql("select * from v_hubs"))


@query
def population_accounting(spark, sf):
    return Q.population(A.label_carriers(L.legs(spark, sf), L.groups(spark)), L.LAST_LEGACY_YEAR)


@query
def airport_coverage(spark, sf):
    listed = spark.createDataFrame([(f"N0{k}",) for k in range(7)] + [("N77",)], "icao string")
    return Q.coverage(L.legs(spark, sf), listed)


@query
def capacity_in_force(spark, sf):
    declared = spark.createDataFrame(L.CAPACITY, "icao string, from_day string, per_hour int").withColumn("from_day", F.to_date("from_day"))
    return rounded(Q.capacity_in_force(X.airport_movements(L.legs(spark, sf)), declared))


@query
def routes_dropped(spark, sf):
    """Routes of carriers flown in a year and not in the next one."""
    flown = L.legs(spark, sf).where("universe_repl and year is not null").select("airline", "route", "year").distinct()
    return flown.exceptAll(flown.withColumn("year", F.col("year") - 1)).where(F.col("year") < max(L.YEARS))


@query
def month_key_from_text(spark, sf):
    text = F.when(F.col("flight_number") == 0, F.date_format("flight_date", "yyyy-MM")).when(F.col("flight_number") == 1, F.concat(F.lit(" "), F.date_format("flight_date", "yyyy-MM"))).otherwise(F.date_format("flight_date", "yyyy/MM"))
    return L.legs(spark, sf).select(C.ym_of_text(text).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query
def run_metrics(spark, sf):
    """Counts taken while a table is written."""
    table, seen = Q.observed(L.legs(spark, sf).select("leg_id", "route", "cause_code", "actual_dep", "actual_arr", "arr_delay_min"), "legs")
    S.materialised(table, "observed")
    return Q.metrics_rows(spark, "legs", seen)


@query
def log_odds(spark, sf):
    r = J.route_ratios(_route(spark, sf))
    return rounded(r.select("ym", "route", C.log_odds("sh_arr_gt15").alias("oddsarr"), C.log_odds("sh_dep_gt15").alias("oddsdep")))


@query
def effective_delay_reading_a(spark, sf):
    e = C.effective_delay("arr")
    return rounded(L.legs(spark, sf).where("universe_repl").groupBy("year").agg(F.count(e).alias("obs"), F.sum(e).alias("minutes"), F.count_if(e > 15).alias("late")))


@query
def effective_delay_reading_b(spark, sf):
    e = C.scoped_delay("arr", L.LAST_LEGACY_YEAR)
    rows = A.label_carriers(L.legs(spark, sf).where("universe_repl"), L.groups(spark))
    return rounded(rows.groupBy("year", "class").agg(F.count(e).alias("obs"), F.sum(e).alias("minutes"), F.count_if(e > 15).alias("late")))


@query
def airport_movements(spark, sf):
    return X.airport_movements(L.legs(spark, sf))


@query
def p90_previous_year(spark, sf):
    return rounded(X.p90_of_year_before(X.airport_movements(L.legs(spark, sf))))


def _lags(spark, sf):
    return X.monthly_lags(_fact(spark, sf), L.LAST_LEGACY_YEAR)


@query
def route_lags(spark, sf):
    return rounded(_lags(spark, sf)["route"])


@query
def group_lags(spark, sf):
    return rounded(_lags(spark, sf)["group"])


@query
def node_lags(spark, sf):
    return rounded(_lags(spark, sf)["node"])


@query
def months_on_route(spark, sf):
    return rounded(_lags(spark, sf)["group_route"])


@query
def group_node_lags(spark, sf):
    return rounded(_lags(spark, sf)["group_node"])


@query
def flight_number_lag3(spark, sf):
    return rounded(X.flight_number_lag(L.legs(spark, sf), L.groups(spark), L.LAST_LEGACY_YEAR))


@query
def inbound_leg_asof(spark, sf):
    rows = X.flight_rows(L.legs(spark, sf), L.groups(spark), L.LAST_LEGACY_YEAR)
    return rounded(rows.select("leg_id", "leg_index", "p_leg_id", "p_sched_arr", "p_arr_delay", "p_status"))


def _dims(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    days = L.legs(spark, sf).select(F.to_date("sched_dep").alias("day")).distinct()
    years = spark.createDataFrame([(y,) for y in range(1990, 2005)], "y int")
    special = years.select(F.explode(F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in ((1, 1), (5, 1), (12, 25))])).alias("day"), F.lit(1).alias("is_holiday"), F.lit(0).alias("is_observance"))
    nodes = spark.createDataFrame([(f"N0{k}", int(k < 5)) for k in range(7)], "icao string, is_metro int")
    slots = spark.createDataFrame([("N00", 199701)], "icao string, slot_from_ym int")
    return {"special": special, "calendar": X.calendar(days, special), "nodes": nodes, "slots": slots, "distances": _distances(spark)}


@query
def calendar_windows(spark, sf):
    return _dims(spark, sf)["calendar"]


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return X.build_features(L.legs(spark, sf), _fact(spark, sf), L.groups(spark), _dims(spark, sf), L.LAST_LEGACY_YEAR, shuttles=("M1-M2", "M2-M1"))


@query
def flight_features(spark, sf):
    f = _features(spark, sf)
    return rounded(f.drop(*X.TARGETS, *X.DIAGNOSTICS))


@query
def feature_targets(spark, sf):
    return rounded(X.targets_of(X.flight_rows(L.legs(spark, sf), L.groups(spark), L.LAST_LEGACY_YEAR)).select("leg_id", "late15_arr", "late30_arr", "arr_delay_target", "late15_dep", "cancelled", "on_time_no_bav", "prev_arr_known_h1"))


@query
def null_rate_by_carrier_year(spark, sf):
    rows = A.label_carriers(L.legs(spark, sf), L.groups(spark)).where("is_realized")
    out = rows.groupBy("airline", "year").agg(F.max_by("group", F.struct("ym", "group")).alias("group"), F.count(F.lit(1)).alias("realized"), F.count_if(F.col("actual_arr").isNull()).alias("missing"))
    return rounded(out.withColumn("null_rate", C.ratio("missing", "realized")))


@query
def null_rate_pivot(spark, sf):
    """The rate of the four carriers with most legs, a column a year."""
    rows = L.legs(spark, sf).where("is_realized")
    top = rows.groupBy("airline").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "airline").limit(4)
    kept = rows.join(F.broadcast(top), "airline", "left_semi")
    wide = kept.groupBy("airline").pivot("year", list(L.YEARS)).agg(F.avg(F.col("actual_arr").isNull().cast("double")))
    return rounded(wide.select("airline", *[F.col(str(y)).alias(f"y{y}") for y in L.YEARS]))


@query
def yearly_growth(spark, sf):
    return rounded(P.yearly_growth(_fact(spark, sf)))


@query
def stride_sample(spark, sf):
    return E.stride_sample(L.legs(spark, sf).select("leg_id", "year", "route", "sched_dep"), ["year", "route"], ["sched_dep", "leg_id"], 20)


@query
def route_hash_sample(spark, sf):
    return E.route_sample(L.legs(spark, sf), 0.4).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query
def profile_table(spark, sf):
    return Q.profile(L.legs(spark, sf).select("leg_id", "airline", "cause_code", "actual_dep", "actual_arr", "arr_delay_min"), ["leg_id"])


@query
def constraint_report(spark, sf):
    return Q.constraint_report(_fact(spark, sf), Q.fact_rules())


@query
def uniqueness_report(spark, sf):
    return Q.duplicates(L.legs(spark, sf), ["airline", "flight_number", "sched_dep"])


@query
def additivity_check(spark, sf):
    return Q.additivity(_fact(spark, sf).where("route <> 'M1-M2'"), L.legs(spark, sf))


@query
def table_diff(spark, sf):
    """The fact under another outlier threshold against the fact as it is."""
    other = A.build_fact(L.legs(spark, sf), L.groups(spark), threshold=75.0)
    return Q.table_diff(_fact(spark, sf), other, ["ym", "route", "group"], ["flights", "arr_outliers"])


@query
def leakage_report(spark, sf):
    features, fact = _features(spark, sf), _fact(spark, sf)
    used = [c for c in features.columns if c not in (*X.TARGETS, *X.DIAGNOSTICS, "leg_id", "flight_date")]
    held = S.materialised(features.select(*Q.CHECKED), "checked")  # five checks read it
    return Q.leakage_report(held, L.legs(spark, sf), fact.withColumn("arr_seen", X._observed("arr", L.LAST_LEGACY_YEAR)), used, _dims(spark, sf)["special"])


@query
def binary_metrics(spark, sf):
    return rounded(E.binary_metrics(_rows(spark, sf), "y", "p", ["year"]))


@query
def calibration(spark, sf):
    return rounded(E.calibration_table(_rows(spark, sf), "y", "p"))


@query
def naive_baselines(spark, sf):
    """The late rates of the route and of the carrier group a month ago, or where there is none that of
    the years before, and this rate alone, against the outcomes of each year."""
    rows = _rows(spark, sf).where("y is not null")
    # all rows of a route, group and month have the same baselines, so legs are added up before these are met
    cells = S.materialised(rows.groupBy("year", "route", "group", "ym").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")), "outcomes")
    yearly = cells.groupBy("year").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    past = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    rates = yearly.select("year", (F.sum("pos").over(past) / F.sum("n").over(past)).alias("before")).where("before is not null")  # a row a year
    lags = _lags(spark, sf)
    joined = cells.join(F.broadcast(rates), "year").join(lags["route"].select("route", "ym", "route_late15_l1"), ["route", "ym"], "left")
    joined = joined.join(lags["group"].select("group", "ym", "group_late15_l1"), ["group", "ym"], "left")
    names = {"route": "route_late15_l1", "group": "group_late15_l1"}
    out = E.naive_baselines(joined, {f"b_{k}": c for k, c in names.items()} | {"b_rate": "before"}, F.col("before"))
    long = out.select("year", "pos", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), F.col(f"b_{k}").alias("p")) for k in (*names, "rate")])).alias("b")).select("year", "pos", "n", "b.*")
    keys = ["year", "baseline"]
    steps = long.where("p is not null").groupBy(*keys, "p").agg(F.sum("pos").cast("double").alias("pos"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("neg"))
    return rounded(E.metrics_of_counts(steps, keys))


NUMBERS = ("arr_delay_min", "dep_delay_min", "sched_block_min", "actual_block_min")


@query
def descriptives(spark, sf):
    return rounded(R.descriptives(L.legs(spark, sf).where("universe_repl"), list(NUMBERS)))


@query
def correlations(spark, sf):
    return rounded(R.correlations(L.legs(spark, sf).where("universe_repl"), list(NUMBERS)))


@query
def gram_moments(spark, sf):
    rows = L.legs(spark, sf).where("universe_repl").select(*NUMBERS)
    sums = R.cross_products(rows, list(NUMBERS))
    return rounded(spark.createDataFrame([(a, b, v) for (a, b), v in sorted(sums.items())], "a string, b string, v double"), 3)


@query
def hac_moments(spark, sf):
    s = R.lagged_moments(_monthly(spark, sf), "od", "t", ["y", "x"], 2)
    return rounded(spark.createDataFrame([(i, j, float(s[i, j])) for i in range(2) for j in range(2)], "i int, j int, v double"), 3)


def _coefficients(spark: SparkSession, fit: dict) -> DataFrame:
    se = fit.get("se", [None] * len(fit["b"]))
    return spark.createDataFrame([(n, float(b), None if s is None else float(s)) for n, b, s in zip(fit["names"], fit["b"], se, strict=True)], "name string, b double, se double")


#: Regions of the given nodes, invented as the distances are.
REGIONS = {"a": ("M1", "N05"), "b": ("M2", "N06"), "c": ("N07", "N08")}
#: Routes, months, and for each region the month of the year on routes that it is an end of.
EFFECTS = ["od", "t", *[f"season_{r}" for r in REGIONS]]


def _with_effects(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.split("od", "-")
    touches = lambda nodes: ends[0].isin(*nodes) | ends[1].isin(*nodes)
    return _monthly(spark, sf).withColumns({f"season_{r}": F.when(touches(nodes), (F.col("ym") % 100).cast("int")).otherwise(0) for r, nodes in REGIONS.items()})


@query
def estimation_sample(spark, sf):
    """Routes with 36 months or more in the window, and their first and last ones."""
    rows = R.estimation_sample(_monthly(spark, sf).drop("t"), "y", first=L.WINDOW[0], last=L.WINDOW[1], least_rows=36)
    return rows.groupBy("od").agg(F.count(F.lit(1)).alias("n"), F.min("ym").alias("first_ym"), F.max("ym").alias("last_ym"))


@query
def ols_panel(spark, sf):
    return rounded(_coefficients(spark, R.ols(_monthly(spark, sf), "y", ["x"])).select("name", "b"))


@query
def iv_just_identified(spark, sf):
    return rounded(_coefficients(spark, R.gmm(_monthly(spark, sf), "y", [], ["x"], ["z1"])).select("name", "b"))


@query
def ols_effects(spark, sf):
    """``ols_panel`` with route, month and season effects; that one is pooled, as its SQL twin is."""
    return rounded(_coefficients(spark, R.ols(_with_effects(spark, sf), "y", ["x"], effects=EFFECTS)))


@query
def iv_effects(spark, sf):
    """``iv_just_identified`` with route, month and season effects."""
    return rounded(_coefficients(spark, R.gmm(_with_effects(spark, sf), "y", [], ["x"], ["z1"], effects=EFFECTS)))


@query
def gmm_panel(spark, sf):
    return _coefficients(spark, R.gmm(_with_effects(spark, sf), "y", ["w"], ["x"], ["z1", "z2", "z3"], effects=EFFECTS))


@query
def liml_panel(spark, sf):
    return _coefficients(spark, R.liml(_with_effects(spark, sf), "y", ["w"], ["x"], ["z1", "z2", "z3"], effects=EFFECTS)).select("name", "b")


#: Tables of the given panel: mean delays and late shares on one or two measures of departures.
SPECIFICATIONS = [
    R.Specification("delays", 1, "y", ("w",), ("x",), ("z1", "z2", "z3")),
    R.Specification("delays", 2, "y", ("w",), ("x", "x2"), ("z1", "z2", "z3", "z4", "z5")),
    R.Specification("delays", 3, "y", ("w",), ("x", "x2"), ("z1", "z2", "z3", "z4", "z5"), "liml"),
    R.Specification("delays", 4, "y", ("w",), ("x", "x2"), (), "ols"),
    R.Specification("late", 1, "y2", ("w",), ("x", "x2"), ("z1", "z2", "z3", "z4", "z5")),
    R.Specification("late", 2, "y2", ("w",), ("x2",), (), "ols"),
]


@query
def estimation_tables(spark, sf):
    """Every specification with route and month effects, and the same with season effects."""
    return R.tables(_with_effects(spark, sf), SPECIFICATIONS, {"routes, months": EFFECTS[:2], "routes, months, seasons": EFFECTS})


@query
def estimates_within_routes(spark, sf):
    """Estimates of one regressor, pooled and within routes, with the measures of their fit."""
    specs = [R.Specification("ols", 1, "y", ("x",), estimator="ols"), R.Specification("ols", 2, "y2", ("x",), estimator="ols"), R.Specification("iv", 1, "y", (), ("x",), ("z1",))]
    found = R.tables(_monthly(spark, sf), specs, {"none": None, "routes": ["od"]})
    return rounded(found.where("name in ('x', 'n', 'k', 'adj_r2', 'rmse', 'j_df')").drop("error"))


@query
def hac_row_order(spark, sf):
    """``hac_moments`` with lags of so many rows in the order of routes and months."""
    s = R.lagged_moments(_monthly(spark, sf), "od", "t", ["y", "x"], 3, by_unit=False)
    return rounded(spark.createDataFrame([(i, j, float(s[i, j])) for i in range(2) for j in range(2)], "i int, j int, v double"), 3)


@query
def rank_tests(spark, sf):
    """The tests of one and of two endogenous columns, every rank of these among them."""
    rows, out = _with_effects(spark, sf), []
    for endog, instruments in ((["x"], ["z1", "z2", "z3"]), (["x", "x2"], ["z1", "z2", "z3", "z4", "z5"])):
        found = R.rank_tests(rows, ["w"], endog, instruments, bandwidth=4, effects=EFFECTS)
        out += [(len(endog), k, float(v)) for k, v in found.items()]
    return spark.createDataFrame(out, "n_endogenous int, statistic string, value double")


CATEGORICAL = ["airline", "group", "class", "origin_icao", "dest_icao", "origin_node", "dest_node", "route_kind"]
KEYS = ("leg_id", "flight_date", "year", "ym", "flight_number", "route")
#: The fifth of ``X.TARGETS``, ``arr_delay_min``, is in minutes and has no area under a curve.
BINARY_TARGETS = [c for c in X.TARGETS if c != "arr_delay_min"]


def horizons(features: DataFrame) -> dict[str, list[str]]:
    """The columns known the day before, and an hour before."""
    eve = [c for c in features.columns if c not in (*KEYS, *X.TARGETS, *X.DIAGNOSTICS, *X.HOUR_BEFORE)]
    return {"D-1": eve, "H-1": [*eve, *X.HOUR_BEFORE]}


def all_folds(rows: DataFrame) -> list[E.Fold]:
    """A fold for each year of the rows that has two earlier years to train and validate on."""
    years = sorted(r["year"] for r in rows.select("year").where("year is not null").distinct().collect())
    return E.rolling_origin(tuple(y for y in years if y - 2 >= years[0]), years[0]) if years else []


def _model_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, list[str]]]:
    features = _features(spark, sf)
    lists = horizons(features)
    return S.materialised(features.select("leg_id", "year", *BINARY_TARGETS, *lists["H-1"]), "features"), lists


def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of every fold, target and horizon, written once."""

    def make() -> DataFrame:
        rows, lists = _model_rows(spark, sf)
        return E.rolling_metrics(E.rolling_scores(rows, all_folds(rows), BINARY_TARGETS, lists, CATEGORICAL))

    return L.written_once(spark, sf, "rolling", make)


@query
def gbt_rolling(spark, sf):
    return _rolling(spark, sf)


@query
def fold_summary(spark, sf):
    return E.fold_summary(_rolling(spark, sf))


def _last_fold(spark: SparkSession, sf: str) -> tuple[boost.Blocks, dict[int, list[boost.Tree]]]:
    """The models of late arrivals on the last fold, for both horizons."""
    rows, lists = _model_rows(spark, sf)
    settings = boost.Settings()
    blocks = boost.binned(rows, all_folds(rows)[-1:], ["late15_arr"], lists, CATEGORICAL, settings)
    return blocks, boost.boost(blocks, settings)


@query
def permutation_importance(spark, sf):
    """On the last fold, as the reference has it, for both horizons and every column."""
    return E.permutation_importance(*_last_fold(spark, sf)).drop("target")


@query
def gain_importance(spark, sf):
    """Of the same models, the gains of each column's splits."""
    return E.gain_importance(spark, *_last_fold(spark, sf)).drop("fold", "target")


def _slopes(spark: SparkSession, sf: str) -> DataFrame:
    """Each year's slope of arrival on departure delays by group, beside that of all years."""
    rows = A.label_carriers(L.legs(spark, sf).where("universe_repl and abs(dep_delay_min) < 313.25 and abs(arr_delay_min) < 313.25"), L.groups(spark))
    own = rows.groupBy(F.col("year").cast("string").alias("table"), F.col("group").alias("name")).agg(F.regr_slope("arr_delay_min", "dep_delay_min").alias("b"), F.stddev_samp("arr_delay_min").alias("se"))
    whole = rows.groupBy(F.col("group").alias("name")).agg(F.regr_slope("arr_delay_min", "dep_delay_min").alias("b_pub"), F.stddev_samp("arr_delay_min").alias("se_pub"))
    return own.join(whole, "name")


@query
def coefficient_scorecard(spark, sf):
    return rounded(E.scorecard(_slopes(spark, sf)))


@query
def sign_inversions(spark, sf):
    rows = _slopes(spark, sf)
    long = rows.select("table", "name", F.lit("ols").alias("estimator"), (F.col("b") - F.col("b_pub")).alias("b")).unionByName(rows.select("table", "name", F.lit("iv").alias("estimator"), (F.col("se") - F.col("se_pub")).alias("b")))
    return E.sign_inversions(long)


@query
def sign_bridge(spark, sf):
    expected = spark.createDataFrame([("G0", 1), ("G1", 1), ("G2", -1), ("G3", 1)], "name string, sign int")
    return E.sign_bridge(_slopes(spark, sf), expected)


@query
def file_manifest(spark, sf):
    return S.manifest(spark, f"{sf}/lineitem.parquet").select("file", "bytes", "sha256")


@query
def new_files(spark, sf):
    now = S.manifest(spark, f"{sf}/orders.parquet").unionByName(S.manifest(spark, f"{sf}/customer.parquet"))
    return S.new_files(now, S.manifest(spark, f"{sf}/orders.parquet")).select("file", "bytes")
