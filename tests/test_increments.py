import shutil

import pytest
from pyspark.sql import functions as F

from skyledger.operators import fact as A
from skyledger.operators.increment import FactStore
from skyledger.plans import legs as L
from skyledger.sources import raw as S

SF = "/root/testdata/sf0.001"


def rows_of(df, columns):
    rounded = [F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.select(*columns).dtypes]
    return sorted(map(str, df.select(*rounded).collect()))


def test_the_fact_grows_with_its_files(spark, tmp_path):
    legs = L.legs(spark, SF)
    part = F.when(F.col("ym") <= 199606, "a").when(F.col("ym").between(199609, 199712), "b").when(F.col("ym") <= 199608, "c").otherwise("d")
    legs.withColumn("part", part).write.partitionBy("part").parquet(str(tmp_path / "in"))
    store, asked = FactStore(spark, str(tmp_path / "store"), L.groups(spark)), []

    def read(paths):
        asked.append(sorted(paths))
        return spark.read.parquet(*paths)

    # the third delivery closes the gap between the first two: flags at both joints turn
    for k, parts in enumerate(("a", "ab", "abc", "abcd")):
        now = S.manifest(spark, [str(tmp_path / f"in/part={p}") for p in parts])
        assert store.update(now, read) > 0 and store.update(now, read) == 0
        done = legs.where(part.isin(*parts))
        want = A.build_fact(done, L.groups(spark))
        assert rows_of(store.fact(), want.columns) == rows_of(want, want.columns)
        assert len(asked) == k + 1 and all(f"part={parts[-1]}" in p for p in asked[-1])
    assert store.files().count() == sum(map(len, asked))


def test_an_update_does_not_read_what_has_come_in(spark, tmp_path):
    legs = L.legs(spark, SF)
    for name, rows in (("one", legs.where("year < 1998")), ("two", legs.where("year >= 1998"))):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
    store = FactStore(spark, str(tmp_path / "store"), L.groups(spark))
    first = S.manifest(spark, str(tmp_path / "one"), "*.parquet").cache()
    store.update(first, lambda paths: spark.read.parquet(*paths))
    first.count()
    shutil.rmtree(tmp_path / "one")

    def fails(paths):
        raise OSError("the files could not be read")

    second = S.manifest(spark, str(tmp_path / "two"), "*.parquet")
    with pytest.raises(OSError):
        store.update(second, fails)
    store.update(second, lambda paths: spark.read.parquet(*paths))
    want = A.build_fact(legs, L.groups(spark))
    assert rows_of(store.fact(), want.columns) == rows_of(want, want.columns)


def test_rejects_have_their_lines_over_all_blocks(spark, tmp_path):
    good = "ABC;x;0012;0;N;B7;1;SBSP;x;01/02/2010 10:00;;SBGL;y;01/02/2010 11:00;;CANCELADO;é;;;"
    lines = ["f0;f1;f2"] + [good if k % 50 else ("short;row" if k % 100 else good.replace("é", "\udce9")) for k in range(1, 4000)]
    (tmp_path / "w.csv").write_bytes("\n".join(lines).encode("utf-8", "surrogateescape"))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "bare.csv").write_bytes(b"f0;f1\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        paths = [str(tmp_path / n) for n in ("w.csv", "empty.csv", "bare.csv")]
        assert S.lines_of(spark, paths).select("path", "block").distinct().count() > 10
        bad = {(r["file"], r["line"]): r["reason"] for r in S.rejects(spark, paths, S.WIDE).collect()}
        assert bad == {("w.csv", k + 1): "width" if k % 100 else "encoding" for k in range(50, 4000, 50)}
        rows = S.scan(spark, paths, S.WIDE)
        assert rows.count() == 3999 - len(bad) and {(r["airline"], r["dest_icao"], r["actual_dep"]) for r in rows.distinct().collect()} == {("ABC", "SBGL", None)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_staged_files_are_laid_out_by_year_and_route(spark, tmp_path):
    legs = L.legs(spark, SF)
    S.write_staged(legs, str(tmp_path / "staged"), file_rows=400)
    staged = S.read_staged(spark, str(tmp_path / "staged"))
    assert staged.count() == legs.count() and rows_of(staged, ["leg_id", "arr_delay_min"]) == rows_of(legs, ["leg_id", "arr_delay_min"])
    found = S.files_for(staged, "M1-M2").first()
    assert found["n_rows"] == legs.where("route = 'M1-M2'").count() and found["n_needed"] <= found["n_files"] / 2
    assert S.files_for(staged, "none").first()["n_needed"] == 0


def test_percentiles_of_a_coarser_grain_come_from_counts(spark):
    legs = L.legs(spark, SF)
    counts = A.delay_counts(legs)
    got = A.delay_percentiles(counts, list(A.ROUTE_KEYS))
    want = A.route_month_context(legs).where("arr_delay_median_min is not null or dep_delay_median_min is not null")
    columns = [*A.ROUTE_KEYS, *[f"{s}_delay_{n}_min" for s in ("dep", "arr") for n in ("median", "p90")]]
    assert rows_of(got, columns) == rows_of(want, columns)
