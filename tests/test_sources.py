"""Text scans and Parquet round trips on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dayfield.operators import cube
from dayfield.sources import tables, weather

WEA = "place Geneva\nlatitude 46.25\nlongitude -6.13\ntime_zone -15\nsite_elevation 420.0\nweather_data_file_units 1\n1 1 0.5 0 0\n6 21 11.5 800.0 120.5\n"
EPW = "LOCATION,Geneva,-,CHE,IWEC,067000,46.25,6.13,1.0,416.0\nDESIGN CONDITIONS,0\n" + ",".join(["1983", "6", "21", "12", "60", "note?9", "20.1", "11.2", *["1"] * 6, "800", "120", *["2"] * 19]) + "\n"


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "a.wea").write_text(WEA)
    (tmp_path / "b.epw").write_text(EPW)
    return tmp_path


def test_weather_of_both_kinds(spark, files):
    got = sorted((r["month"], r["day"], r["hour"], r["dir_norm"], r["dif_horiz"]) for r in weather.read_weather(spark, str(files)).collect())
    assert got == [(1, 1, 0.5, 0.0, 0.0), (6, 21, 11.5, 800.0, 120.0), (6, 21, 11.5, 800.0, 120.5)]


def test_epw_columns(spark, files):
    row = weather.read_epw(spark, str(files / "b.epw"), ["dew_pt", 3, "note"]).first()
    assert (row["dew_pt"], row["hour"], row["note"]) == (11.2, 11.5, 0.0)
    assert len(weather.read_epw(spark, str(files / "b.epw")).columns) == 36
    with pytest.raises(ValueError):
        weather.read_epw(spark, str(files / "b.epw"), ["no"])


def test_station_headers(spark, files):
    got = {r["name"]: r for r in weather.stations(spark, str(files)).collect()}
    assert {k: got["Geneva"][k] for k in ("lat", "lon", "meridian")} == {"lat": 46.25, "lon": -6.13, "meridian": -15.0}
    (files / "c.wea").write_text("1 1 0.5 0 0\n")
    with pytest.raises(Exception, match="no station header"):
        weather.stations(spark, str(files / "c.wea")).collect()


def test_sky_input_layouts(spark):
    four = spark.createDataFrame([(0, 90.0, 0.0, 500.0, 100.0)], "t int, c1 double, c2 double, c3 double, c4 double")
    assert weather.sky_input(four).first()["sz"] == pytest.approx(1.0)
    five = spark.createDataFrame([(0, 0.0, 0.0, 2.0, 500.0, 100.0)], "t int, c1 double, c2 double, c3 double, c4 double, c5 double")
    row = weather.sky_input(five).first()
    assert row["sz"] == 1.0 and row["dir_norm"] == 500 and row["dew_pt"] == pytest.approx(10.9735311509)
    six = spark.createDataFrame([(0, 6.0, 21.0, 11.5, 500.0, 100.0, 8.0)], "t int, c1 double, c2 double, c3 double, c4 double, c5 double, c6 double")
    row = weather.sky_input(six).first()
    assert (row["month"], row["day"], row["hour"], row["dew_pt"]) == (6, 21, 11.5, 8.0)


def test_masks(spark):
    times = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "t int, is_day boolean")
    only = lambda df: sorted(r["t"] for r in df.collect())
    assert only(weather.user_mask(times, None, "none")) == [0, 2, 4, 6, 8]
    assert only(weather.user_mask(times, spark.createDataFrame([(2,), (3,)], "t int"), "rows")) == [2]
    assert only(weather.user_mask(times, spark.createDataFrame([(n, n in (1, 4)) for n in range(5)], "n int, keep boolean"), "day")) == [2, 8]
    assert only(weather.user_mask(times, spark.createDataFrame([(i, i < 5) for i in range(10)], "t int, keep boolean"), "all")) == [0, 2, 4]
    masked = weather.user_mask(times, None, "none")
    assert {r["t"]: r["masked"] for r in weather.masked_index(masked, times.where("t in (4, 5)")).collect()} == {4: 2}
    assert weather.calendar(spark).count() == 8760


def test_point_tables(spark, tmp_path):
    (tmp_path / "p3.txt").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "p4.txt").write_text("7 1 2 3\n")
    (tmp_path / "suns_sun_0012_points.tsv").write_text("1 5 1 2 3\n0 6 1 2 4\n")
    assert [(r["level"], r["pt_id"], r["z"]) for r in tables.read_points(spark, str(tmp_path / "p3.txt")).orderBy("pt_id").collect()] == [(0, 0, 3.0), (0, 1, 6.0)]
    assert tables.read_points(spark, str(tmp_path / "p4.txt")).first()["pt_id"] == 7
    suns = spark.createDataFrame([(12, 0.0, 0.0, 1.0, 2)], "sun_id long, sx double, sy double, sz double, level int")
    got = sorted((r["sun_level"], r["level"], r["pt_id"]) for r in tables.sun_points(spark, str(tmp_path / "suns_*"), suns).collect())
    assert got == [(2, 0, 6), (2, 1, 5)]


def test_ray_and_sky_round_trips(spark, tmp_path):
    rays = spark.createDataFrame([("z", s, p, i, 0.0, 0.0, 1.0, 0.1, 2.0) for s in (0, 1) for p in (1, 2) for i in (1, 2)], "zone string, src int, pt_id int, ray_id int, dx double, dy double, dz double, omega double, lum double")
    tables.write_rays(rays, str(tmp_path / "rays"))
    some = spark.createDataFrame([("z", 1, 2)], "zone string, src int, pt_id int")
    assert tables.read_rays(spark, str(tmp_path / "rays")).count() == 8 and tables.read_rays(spark, str(tmp_path / "rays"), some).count() == 2
    assert tables.append_rays(spark, str(tmp_path / "rays"), rays.limit(1)).where("omega is null").count() == 9
    tables.write_sensors(rays, str(tmp_path / "sensors"))
    assert spark.read.parquet(str(tmp_path / "sensors")).where("src = 1").count() == 4
    matrix = spark.createDataFrame([(0, p, 1.0) for p in range(17)], "t int, patch int, coef double")
    tables.write_sky(matrix, spark.range(1), spark.range(2), str(tmp_path / "sky"))
    assert tables.read_sky(spark, str(tmp_path / "sky"))[3] == 4
    lines = tables.sky_text(matrix, 3).collect()
    assert len(lines) == 17 and lines[0]["line"] == "\t".join(["1.00000e+00"] * 3)


def test_result_files(spark, tmp_path):
    r = spark.createDataFrame([(s, 1, "v", m, float(s)) for s in range(3) for m in ("a", "b")], "sky int, point long, view string, metric string, value double")
    cube.write_result(r, str(tmp_path / "r"))
    back = cube.read_result(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, r.collect()))
    cube.write_tsv(cube.printed(r, "metric", ["a", "b"]).coalesce(1), str(tmp_path / "t"))
    text = spark.read.text(str(tmp_path / "t")).collect()
    assert text[0][0] == "sky\tpoint\tview\ta\tb" and len(text) == 4
    cube.write_tsv(cube.labels(r).select("file_label", "value"), str(tmp_path / "s"), by="file_label")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "s")).select(F.countDistinct("file_label")).first()[0] == 3
