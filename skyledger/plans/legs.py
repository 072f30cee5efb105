"""Flight legs out of the order tables, so that every operator runs on data that grows.

``LEGS`` is portable SQL: Spark and DuckDB give the same rows. The queries of this package start
from ``legs``; their SQL twins put ``LEGS`` in front as a common table expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.sources.raw import materialised

METRO = {"N00": "M1", "N01": "M1", "N02": "M1", "N03": "M2", "N04": "M2"}
LAST_LEGACY_YEAR, YEARS = 1998, tuple(range(1995, 2002))
LCC_GROUPS, FSC_GROUPS, CLASSES = ("G1",), ("G0", "G2"), ("FSC", "LCC", "regional", "other")
PRESENCE = {"pres_glo": ("G1",), "pres_azu": ("G3",), "pres_tam": ("G2",), "lcc": LCC_GROUPS}
#: Months of the estimation's window, and capacities by the hour that airports declare from a day on; both invented for the given tables.
WINDOW = (199601, 199912)
CAPACITY = [("N00", "1995-01-01", 2), ("N00", "1997-06-15", 3), ("N03", "1996-03-01", 2), ("N08", "2099-01-01", 9)]
#: What makes a hub among the few cities of the given tables.
HUBS = {"city": 20, "group": 5, "share": 0.2, "ratio": 1.2}
PANEL_NODES = ("M1", "M2", "N05", "N06", "N07")

LEGS = """
SELECT leg_id, airline, flight_number, line_type, di, origin_icao, dest_icao, origin_node, dest_node,
  concat(origin_node, '-', dest_node) AS route, flight_date, yr AS year, mo AS month, ym, status, is_realized,
  CASE WHEN status = 'cancelled' THEN CASE hk % 5 WHEN 0 THEN 'XO' WHEN 1 THEN 'XN' WHEN 2 THEN 'XA' WHEN 3 THEN 'XB' ELSE 'XJ' END
       WHEN hk % 4 = 0 THEN CASE hk % 6 WHEN 0 THEN 'AR' WHEN 2 THEN 'RA' ELSE 'WO' END
       WHEN hk % 4 = 1 THEN CASE hk % 3 WHEN 0 THEN 'DF' WHEN 1 THEN 'MX' ELSE 'AT' END END AS cause_code,
  sched_dep, sched_arr,
  CASE WHEN seen THEN sched_dep + CAST(dd AS INT) * INTERVAL '1' MINUTE END AS actual_dep,
  CASE WHEN seen THEN sched_arr + CAST(da AS INT) * INTERVAL '1' MINUTE END AS actual_arr,
  CASE WHEN seen THEN CAST(dd AS DOUBLE) END AS dep_delay_min,
  CASE WHEN seen THEN CAST(da AS DOUBLE) END AS arr_delay_min,
  CAST(blk AS INT) AS sched_block_min,
  CASE WHEN seen THEN CAST(blk + da - dd AS INT) END AS actual_block_min,
  CAST(hour(sched_dep) AS INT) AS dep_hour, CAST(hour(sched_arr) AS INT) AS arr_hour,
  (line_type IN ('N','R','E') AND di = 0) AS universe_repl,
  (line_type IN ('N','R','E') AND di = 0 AND is_realized) AS universe_ml,
  (seen AND (abs(dd) >= 1440 OR abs(da) >= 1440)) AS actual_time_suspect
FROM (
  SELECT *, (is_realized AND NOT (yr <= 1998 AND hk % 10 < 6)) AS seen
  FROM (
    SELECT *,
      CASE WHEN origin_icao IN ('N00','N01','N02') THEN 'M1' WHEN origin_icao IN ('N03','N04') THEN 'M2' ELSE origin_icao END AS origin_node,
      CASE WHEN dest_icao IN ('N00','N01','N02') THEN 'M1' WHEN dest_icao IN ('N03','N04') THEN 'M2' ELSE dest_icao END AS dest_node,
      sched_dep + CAST(blk AS INT) * INTERVAL '1' MINUTE AS sched_arr,
      status = 'realized' AS is_realized,
      CASE WHEN hk % 500 = 0 THEN -2000 WHEN hk % 251 = 0 THEN 400 ELSE (hk % 97) - 20 END AS dd,
      CASE WHEN hk % 500 = 0 THEN -2000 WHEN hk % 251 = 0 THEN 400 ELSE (hk % 97) - 26 + (hk % 13) END AS da
    FROM (
      SELECT concat(CAST(l.l_orderkey AS VARCHAR(20)), '-', CAST(l.l_linenumber AS VARCHAR(20)), '-', CAST(l.l_partkey AS VARCHAR(20)), '-', CAST(l.l_suppkey AS VARCHAR(20))) AS leg_id,
        concat('A0', CAST(l.l_suppkey % 6 AS VARCHAR(2))) AS airline,
        CAST(l.l_partkey % 3 AS INT) AS flight_number,
        concat('N0', CAST(s.s_nationkey % 9 AS VARCHAR(2))) AS origin_icao,
        concat('N0', CAST(c.c_nationkey % 9 AS VARCHAR(2))) AS dest_icao,
        CAST(l.l_shipdate AS DATE) AS flight_date,
        l.l_shipdate + CAST(((l.l_partkey * 37 + l.l_linenumber * 113) % 288) * 5 AS INT) * INTERVAL '1' MINUTE AS sched_dep,
        40 + CAST(l.l_quantity AS INT) * 5 AS blk,
        l.l_orderkey * 7 + l.l_partkey * 31 + l.l_linenumber * 101 AS hk,
        CAST(year(l.l_shipdate) AS INT) AS yr, CAST(month(l.l_shipdate) AS INT) AS mo,
        CAST(year(l.l_shipdate) * 100 + month(l.l_shipdate) AS INT) AS ym,
        CASE WHEN l.l_orderkey % 11 = 0 THEN 'cancelled' ELSE 'realized' END AS status,
        CASE l.l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'I' END AS line_type,
        CASE WHEN l.l_linenumber = 7 THEN 1 ELSE 0 END AS di
      FROM {lineitem} l
      JOIN {orders} o ON o.o_orderkey = l.l_orderkey
      JOIN {customer} c ON c.c_custkey = o.o_custkey
      JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
    ) a ) b ) d
"""

GROUPS = """
SELECT * FROM (VALUES
  ('A00','G0','FSC',      CAST(NULL AS INT), 199712), ('A00','G1','LCC', 199801, CAST(NULL AS INT)),
  ('A01','G1','LCC',      CAST(NULL AS INT), CAST(NULL AS INT)),
  ('A02','G2','FSC',      CAST(NULL AS INT), CAST(NULL AS INT)),
  ('A03','G3','regional', 199601, 199912)
) AS t(airline, grp, cls, start_ym, end_ym)
"""


_JOINS = """JOIN {orders} o ON o.o_orderkey = l.l_orderkey
      JOIN {customer} c ON c.c_custkey = o.o_custkey"""
TABLES = ("lineitem", "orders", "customer", "supplier")
#: Written tables of this process, by the session's application, their name and the state of the files they were made from.
_WRITTEN: dict[tuple, DataFrame] = {}


def written_once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written when it is first asked for and read from then on, as
    long as the input files are the same (path, time and size) and the table still stands. Every step
    after it starts from files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{sf_dir}/{t}.parquet" for t in TABLES])
    state = frozenset(files.select("path", "modificationTime", "length").collect())  # a row for each file
    key = (spark.sparkContext.applicationId, name, state)
    if key not in _WRITTEN or not _stands(spark, _WRITTEN[key]):
        _WRITTEN[key] = materialised(make(), name)
    return _WRITTEN[key]


def _stands(spark: SparkSession, table: DataFrame) -> bool:
    """Whether the files of a written table are still there; an empty one is made anew."""
    files = table.inputFiles()
    if not files:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def computed_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legs, with ``dow`` (Monday is 0). A small table that comes as fewer splits than there are
    cores is spread over them first."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    cores = spark.sparkContext.defaultParallelism
    if tables["lineitem"].rdd.getNumPartitions() < cores:
        tables["lineitem"] = tables["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag").repartition(cores)
    # orders meet their customers first, so that the many lines are shuffled for one join and not for two
    orders, customer = tables.pop("orders"), tables.pop("customer")
    ends = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("o_orderkey", "c_nationkey")
    return spark.sql(LEGS.replace(_JOINS, "JOIN {ends} c ON c.o_orderkey = l.l_orderkey"), ends=ends, **tables).withColumn("dow", F.weekday("flight_date"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged legs, written once."""
    return written_once(spark, sf_dir, "legs", lambda: computed_legs(spark, sf_dir))


def groups(spark: SparkSession) -> DataFrame:
    """The dated carrier table: at most a few rows a carrier."""
    return spark.sql(GROUPS)
