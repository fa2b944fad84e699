"""Edge tables for the column functions: codes, numbers, tiles, replies, labels."""

import math

import pytest
from pyspark.sql import functions as F

from landsight.functions import clean, text, tiles, verdict


def _one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def test_code_cleaning(spark):
    codes = [None, "", " PRT ", "\tESP\n", "US", "OWID_WRL", "nan", "-99", "éab", "\x1cFRA　"]
    df = _one_col(spark, codes).select(clean.clean_code("v").alias("c"))
    kept = [r.c for r in df.where(clean.is_valid_code("c")).collect()]
    assert kept == ["PRT", "ESP", "nan", "-99", "éab", "FRA"]


@pytest.mark.parametrize(
    "raw,expected",
    [(" 5 ", 5.0), ("1e3", 1000.0), ("inf", math.inf), ("-inf", -math.inf), ("1,000", None),
     ("abc", None), ("", None), ("nan", None), ("5d", None), ("1.5f", None), ("0x10", None),
     (None, None), ("\t7\n", 7.0)],
)
def test_to_number(spark, raw, expected):
    got = _one_col(spark, [raw]).select(clean.to_number("v").alias("n")).first().n
    assert got == expected


def test_years(spark):
    df = spark.createDataFrame([(2020.0,), (2020.5,), (None,), (1e12,)], "y double")
    rows = df.select(clean.integral_year("y").alias("i"), clean.truncated_year("y").alias("t")).collect()
    assert [(r.i, r.t) for r in rows] == [(2020, 2020), (None, 2020), (None, None), (None, None)]


def _row_edge(row, z):
    """Northern edge latitude of a tile row: the published inverse projection."""
    return math.degrees(2 * math.atan(math.exp(math.pi * (1 - 2 * row / 2**z))) - math.pi / 2)


@pytest.mark.parametrize(
    "lat,lon,z,x,y",
    [(-6, -55, 8, 88, 132), (13.5, 14, 15, 17658, 15143), (-11, -62, 15, 10740, 17391),
     (38.7075, -9.1364, 17, 62209, 50229), (90, 180, 5, 31, 0), (-90, 10, 5, 16, 31),
     (-90, 10, 1, 1, 1)],
)
def test_tile_goldens(spark, lat, lon, z, x, y):
    df = spark.createDataFrame([(float(lat), float(lon), z)], "lat double, lon double, z int")
    t = df.select(tiles.tile_xyz("lat", "lon", "z").alias("t")).first().t
    assert (t.z, t.x, t.y) == (z, x, y)


def test_tiles_hold_their_points(spark):
    """Independent of the forward formula: a point lies between the edges of its
    tile, which come from the inverse projection."""
    pts = [(la / 3.0, lo / 1.7, z) for la in range(-250, 251, 17) for lo in range(-300, 301, 23) for z in (1, 7, 15, 20)]
    df = spark.createDataFrame(pts, "lat double, lon double, z int")
    for r in df.select("lat", "lon", "z", tiles.tile_xyz("lat", "lon", "z").alias("t")).collect():
        west = r.t.x * 360 / 2**r.z - 180
        assert west - 1e-9 <= r.lon <= west + 360 / 2**r.z + 1e-9
        if abs(r.lat) < 85:
            assert _row_edge(r.t.y + 1, r.z) - 1e-9 <= r.lat <= _row_edge(r.t.y, r.z) + 1e-9
        else:
            assert r.t.y in (0, 2**r.z - 1) or r.z > 7


def test_missing_coordinates_have_no_tile(spark):
    nan = float("nan")
    rows = [(None, 1.0, 5), (nan, 1.0, 5), (1.0, None, 5), (1.0, nan, 5), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "lat double, lon double, z int")
    t = tiles.tile_xyz("lat", "lon", "z")
    got = df.select(t.alias("t"), tiles.tile_bounds("lat", "lon", "z").alias("b"), tiles.tile_file_name(t).alias("f"), tiles.tile_url(t).alias("u")).collect()
    assert all((r.t, r.b, r.f, r.u) == (None,) * 4 for r in got)
    far = spark.createDataFrame([(1.0, 540.0, 5), (1.0, -999.0, 5)], "lat double, lon double, z int")
    assert [r.t.x for r in far.select(t.alias("t")).collect()] == [31, 0]


def test_timestamps_are_utc_in_any_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.sql("SELECT timestamp_seconds(1704078000) AS t")  # 2024-01-01 03:00 UTC
        assert df.select(text.timestamp_text("t").alias("s")).first().s == "2024-01-01 03:00 UTC"
        from landsight.streaming.history import daily_risk_kpis

        log = df.select(F.col("t").alias("timestamp"), F.lit("Y").alias("danger"))
        assert str(daily_risk_kpis(log).first().day) == "2024-01-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_bounds_ring_and_names(spark):
    df = spark.createDataFrame([(38.67989, -9.32563, 15)], "lat double, lon double, z int")
    b = tiles.tile_bounds("lat", "lon", "z")
    r = df.select(
        b.alias("b"), tiles.bounds_ring(b).alias("ring"), tiles.bounds_center(b).alias("c"),
        tiles.tile_file_name(tiles.tile_xyz("lat", "lon", "z")).alias("f"),
        tiles.tile_url(tiles.tile_xyz("lat", "lon", "z")).alias("u"),
        tiles.zoom_label("z").alias("zl"), tiles.preview_zoom("z").alias("pz"),
    ).first()
    x = 15535
    y = next(row for row in range(2**15) if _row_edge(row + 1, 15) <= 38.67989)  # the row that holds the point
    assert r.b.lon_min == pytest.approx(x * 360 / 2**15 - 180)
    assert r.b.lat_max == pytest.approx(_row_edge(y, 15))
    assert r.ring[0] == r.ring[4] and len(r.ring) == 5
    assert r.c.lat == pytest.approx((r.b.lat_min + r.b.lat_max) / 2)
    assert r.f == f"esri_15_{x}_{y}.png"
    assert r.u.endswith(f"/tile/15/{y}/{x}")
    assert (r.zl, r.pz) == ("Neighbourhood", 13)
    back = spark.createDataFrame([(f"/any/dir/{r.f}",), ("nope.png",)], "p string")
    keys = [tuple(k.t) for k in back.select(tiles.tile_from_path("p").alias("t")).collect()]
    assert keys == [(15, x, y), (None, None, None)]


def test_zoom_labels(spark):
    df = spark.range(0, 22).select(F.col("id").cast("int").alias("z"))
    labels = {r.z: r.l for r in df.select("z", tiles.zoom_label("z").alias("l")).collect()}
    assert labels[0] == "" and labels[21] == ""
    assert labels[4] == "Continental view" and labels[5] == "Country / region"
    assert labels[11] == "City level" and labels[14] == "District level"
    assert labels[17] == "Neighbourhood" and labels[20] == "Building level"


REPLIES = [
    ('{"danger":"y","justification":"j"}', "Y", "j"),
    ('```json\n{"danger": "N"}\n```', "N", '```json\n{"danger": "N"}\n```'),
    ('{"justification":"only"}', "N", "only"),
    ('{"danger":null}', "NONE", '{"danger":null}'),
    ('{"danger":true}', "TRUE", '{"danger":true}'),
    ('{"danger":"y","danger":"n"}', "N", '{"danger":"y","danger":"n"}'),
    ('{"danger":"N"} extra', "Y", '{"danger":"N"} extra'),
    ('{"danger":"N"}]', "Y", '{"danger":"N"}]'),
    ('{"danger":"N"}],[{"danger":"N"}', "Y", '{"danger":"N"}],[{"danger":"N"}'),
    ("{'danger':'N'}", "Y", "{'danger':'N'}"),
    ("all calm", "N", "all calm"),
    ("  Some concern \n", "Y", "Some concern"),
    ("[1]", "N", "[1]"),
    ("5", "N", "5"),
    ("null", "N", "null"),
    ('intro ```{"danger": "y", "justification": "k"}``` outro', "Y", "k"),
    ('{"danger": "N", "justification": null}', "N", None),
    ("", "N", ""),
]


def test_verdict_of_missing_reply_is_null(spark):
    v = spark.createDataFrame([(None,)], "raw string").select(verdict.parse_verdict("raw").alias("v")).first().v
    assert (v.danger, v.justification) == (None, None)


def test_verdict_edge_table(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in REPLIES], "raw string")
    got = df.select(verdict.parse_verdict("raw").alias("v")).collect()
    for (raw, danger, just), row in zip(REPLIES, got):
        assert (row.v.danger, row.v.justification) == (danger, just), raw


def test_labels(spark):
    df = spark.createDataFrame([(0.0, -9.1364, "Y"), (-0.0, 38.67989, None)], "a double, b double, d string")
    r = df.select(
        text.coordinate_label("a", "lat").alias("la"), text.coordinate_label("b", "lon").alias("lo"),
        text.coordinate_label("b", "lon", 5).alias("lo5"),
        text.risk_label("d").alias("rl"), text.risk_color("d").alias("rc"),
    ).collect()
    assert (r[0].la, r[0].lo, r[0].rl, list(r[0].rc)) == ("N 0.0000°", "W 9.1364°", "🚨 At Risk", [220, 38, 38, 200])
    assert (r[1].la, r[1].lo5, r[1].rl, list(r[1].rc)) == ("N 0.0000°", "E 38.67989°", "✅ Safe", [22, 163, 74, 200])
    big = spark.createDataFrame([(1234567.891,)], "v double").select(text.number_text("v").alias("t")).first().t
    assert big == "1,234,567.89"
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (0.125,), (-1234.565,)], "v double")
    got = [(r.t2, r.t1) for r in odd.select(text.number_text("v").alias("t2"), text.number_text("v", 1).alias("t1")).collect()]
    assert got == [(f"{v:,.2f}", f"{v:,.1f}") for v in (float("inf"), float("-inf"), float("nan"), 0.125, -1234.565)]
    assert spark.range(1).select(text.count_text(F.lit(1234567)).alias("c")).first().c == "1,234,567"


def test_signed_degrees(spark):
    df = spark.createDataFrame([(38.5, "N"), (38.5, "S"), (9.3, "E"), (9.3, "W")], "v double, d string")
    got = [r.s for r in df.select(tiles.signed_degrees("v", "d").alias("s")).collect()]
    assert got == [38.5, -38.5, 9.3, -9.3]
