"""Column expressions over flight legs. All are native and fit whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes beyond which a delay is an outlier and stays out of sums (counts keep it).
OUTLIER_MIN = 313.25
#: Minutes beyond which a time stamp is suspect.
SUSPECT_MIN = 1440
DELAY_CUTS = (0, 15, 30, 60, 120, 240)
REPLICATION_LINES = ("N", "R", "E")
NULL_LINES = ("NA", "N/A", "N/I", "NI", "")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node_of(icao: str | Column, metro: dict[str, str]) -> Column:
    """The metropolitan node of an airport, itself if it belongs to none."""
    c = col(icao)
    if not metro:
        return c
    table = F.create_map(*[F.lit(x) for pair in sorted(metro.items()) for x in pair])
    return F.coalesce(table[c], c)


def route_of(origin: str | Column, dest: str | Column) -> Column:
    """``o-d``; null if a side is null."""
    return F.concat(col(origin), F.lit("-"), col(dest))


def ym_of(day: str | Column) -> Column:
    return (F.year(col(day)) * 100 + F.month(col(day))).cast("int")


def ym_of_text(text: str | Column) -> Column:
    """The ``YYYYMM`` key of a month written ``YYYY-MM``; null where it is none."""
    parts = F.regexp_extract(F.trim(col(text)), r"^(\d{4})-(0[1-9]|1[0-2])$", 1), F.regexp_extract(F.trim(col(text)), r"^(\d{4})-(0[1-9]|1[0-2])$", 2)
    return (F.nullif(parts[0], F.lit("")).cast("int") * 100 + F.nullif(parts[1], F.lit("")).cast("int")).cast("int")


def shift_ym(ym: str | Column, months: int | Column) -> Column:
    """A ``YYYYMM`` key moved by whole months."""
    index = month_index(ym) + months
    return (F.floor(index / 12) * 100 + F.pmod(index, F.lit(12)) + 1).cast("int")


def month_index(ym: str | Column) -> Column:
    """Months since year 0, so that neighbours differ by one."""
    c = col(ym)
    return (F.floor(c / 100) * 12 + F.pmod(c, F.lit(100)) - 1).cast("int")


def clean_status(text: str | Column) -> Column:
    t = F.upper(F.trim(col(text)))
    return F.when(t == "REALIZADO", "realized").when(t == "CANCELADO", "cancelled").otherwise("other")


def clean_di(text: str | Column) -> Column:
    """The authorisation digit: 0-9, A as 10, B as 11, else null."""
    t = F.upper(F.trim(col(text)))
    return F.when(t.rlike("^[0-9]$"), t.try_cast("int")).when(t == "A", 10).when(t == "B", 11)


def clean_line(text: str | Column) -> Column:
    t = F.upper(F.trim(col(text)))
    return F.when(t.isin(*NULL_LINES), None).otherwise(t)


def clean_code(text: str | Column) -> Column:
    t = F.upper(F.trim(col(text)))
    return F.when(t.rlike("^[A-Z]{2}$"), t)


def parse_time(text: str | Column, pattern: str = "dd/MM/yyyy HH:mm") -> Column:
    """A local time without a zone, null where the text is none."""
    return F.try_to_timestamp(F.trim(col(text)), F.lit(pattern)).cast("timestamp_ntz")


#: Accented letters of Latin-1 and what they fold to.
ACCENTED, PLAIN = "ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝ", "AAAAAACEEEEIIIINOOOOOUUUUY"


def cause_key(text: str | Column) -> Column:
    """Free cause text without accents, marks and double spaces, in upper case."""
    folded = F.translate(F.upper(col(text)), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[^A-Z0-9 ]", " "), " +", " "))


def in_replication(line: str | Column = "line_type", di: str | Column = "di") -> Column:
    return F.coalesce(col(line).isin(*REPLICATION_LINES) & (col(di) == 0), F.lit(False))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Signed minutes as a double, null if a side is null."""
    return F.expr("1D") * F.timestamp_diff("SECOND", col(start), col(end)) / 60.0


def block_minutes(start: str | Column, end: str | Column) -> Column:
    """Whole minutes that fit a small integer, else null."""
    return F.timestamp_diff("MINUTE", col(start), col(end)).try_cast("smallint")


def within(delay: str | Column, threshold: float = OUTLIER_MIN) -> Column:
    return F.abs(col(delay)) < threshold


def suspect(dep: str | Column, arr: str | Column) -> Column:
    return F.coalesce(F.abs(col(dep)) >= SUSPECT_MIN, F.lit(False)) | F.coalesce(F.abs(col(arr)) >= SUSPECT_MIN, F.lit(False))


def effective_delay(side: str, empty_means_on_time: bool = True) -> Column:
    """Delay of a realised leg; an empty actual time counts as on time if the caller says so."""
    delay, actual, sched = F.col(f"{side}_delay_min"), F.col(f"actual_{side}"), F.col(f"sched_{side}")
    if not empty_means_on_time:
        return delay
    return F.when(delay.isNotNull(), delay).when(F.col("is_realized") & actual.isNull() & sched.isNotNull(), 0.0)


def scoped_delay(side: str, last_year: int, classes: tuple[str, ...] = ("FSC", "LCC", "regional")) -> Column:
    """Delay under the narrower reading: empty means on time only for realised legs of the given
    classes up to ``last_year``. Needs ``class``."""
    delay, actual = F.col(f"{side}_delay_min"), F.col(f"actual_{side}")
    return F.when(delay.isNotNull(), delay).when(in_scope(last_year, classes) & actual.isNull(), 0.0)


def in_scope(last_year: int, classes: tuple[str, ...] = ("FSC", "LCC", "regional")) -> Column:
    return F.col("is_realized") & (F.col("year") <= last_year) & F.col("class").isin(*classes)


def ratio(n: str | Column, d: str | Column) -> Column:
    """n over d as a double, null where d is zero or null."""
    return col(n).cast("double") / F.nullif(col(d).cast("double"), F.lit(0.0))


def log_odds(p: str | Column) -> Column:
    c = col(p)
    return F.when((c > 0) & (c < 1), F.ln(c / (1 - c)))


def greater_end(o: str | Column, d: str | Column) -> Column:
    """The greater of both ends, null if either is null (``greatest`` alone skips nulls)."""
    return F.when(col(o).isNotNull() & col(d).isNotNull(), F.greatest(col(o), col(d)))


def finite(c: str | Column) -> Column:
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def hash_bucket(key: str | Column, buckets: int = 1000) -> Column:
    """A bucket of the key's md5, the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))
