"""Scalar functions against the reference values of their definitions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import geo, num, text, time


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.9611), ("abc", "xyz", 0.0), ("same", "same", 1.0), ("abzzzzz", "abyyyyy", 0.6190)])
def test_jaro_winkler(a, b, want):
    assert round(text.jaro_winkler_of(a, b), 4) == want


@settings(max_examples=200)
@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_is_a_similarity(a, b):
    s = text.jaro_winkler_of(a, b)
    assert 0.0 <= s <= 1.0
    assert text.jaro_winkler_of(a, a) == 1.0


def test_trigrams(spark):
    r = one(spark, text.trigram(F.lit("same"), F.lit("same")), text.trigram(F.lit("word"), F.lit("entirely")), text.trigram(F.lit("Café"), F.lit("cafe")))
    assert tuple(r) == (1.0, 0.0, 1.0)


def test_numbers(spark):
    r = one(spark, num.ramp(F.lit(5.0), 0.0, 10.0), num.ramp(F.lit(5.0), 5.0, 5.0), num.decay(F.lit(4.0), 4.0), num.int_div(F.lit(-7), F.lit(2)), num.int_div(F.lit(1), F.lit(0)), F.round(F.lit(-2.5)))
    assert tuple(r) == (0.5, 1.0, 0.5, -3, None, -3.0)


def test_renormalised(spark):
    s = {"a": (F.lit(0.8), 0.1), "b": (F.lit(0.0), 0.15), "c": (F.lit(None).cast("double"), 0.5)}
    assert tuple(one(spark, num.renormalised(s), num.missing(s))) == (0.32, ["c"])


@pytest.mark.parametrize(("lat", "lng", "to", "metres"), [(59.3255, 18.0705, (59.3255, 18.0705), 0), (59.3293, 18.0686, (57.7089, 11.9746), 397_000)])
def test_haversine(spark, lat, lng, to, metres):
    d = one(spark, geo.haversine(F.lit(lat), F.lit(lng), F.lit(to[0]), F.lit(to[1])))[0]
    assert abs(d - metres) <= 0.01 * metres


def test_cells_tile_the_plane(spark):
    p = spark.range(400).select((59.2 + F.col("id") * 0.0007).alias("lat"), (17.8 + F.col("id") % 37 * 0.011).alias("lng"))
    c = geo.cell_of(F.col("lat"), F.col("lng"))
    r = p.select(c.alias("c"), "lat", "lng").withColumn("m", geo.cell_centre(F.col("c"))).withColumn("back", geo.cell_of(F.col("m.lat"), F.col("m.lng")))
    assert r.where("back <> c").count() == 0
    assert r.where(geo.haversine(F.col("lat"), F.col("lng"), F.col("m.lat"), F.col("m.lng")) > 560).count() == 0
    assert one(spark, F.size(geo.disc(F.struct(F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("r")), F.lit(2))))[0] == 19


def test_plain_text(spark):
    x = F.lit("'''Old''' [[Town|town]] {{t}}&amp; <b>gate</b> [1] .")
    r = one(spark, text.plain_text(x), text.plain_text(F.lit(" <p></p>")), text.has_markup(F.lit("plain")), text.plain_text(F.lit(None).cast("string")))
    assert tuple(r) == ("Old town & gate.", None, False, None)


def test_perishable(spark):
    r = one(spark, text.trim_perishable(F.lit("A church of brick from 1890. Open until 18:30.")), text.trim_perishable(F.lit("Open at 10:00.")))
    assert tuple(r) == ("A church of brick from 1890.", "")
    claims = {
        "By hand.": "By hand.", "It is open Wednesdays through Sundays and an admission fee is charged.": "", "A relaxed bistro with old sofas. A coffee is €1.": "A relaxed bistro with old sofas.",
        "St. Paul's is open at 10am.": "", "The tower was renovated in 1920 and the phone is old.": "The tower was renovated in 1920 and the phone is old.", "Entry is free for all. Carved doors of oak line the hall.": "Carved doors of oak line the hall.",
        "A pass is 20 euros. Its vaults are painted blue.": "Its vaults are painted blue.", "Tickets cost little here.": "",
    }
    got = {r.c: r.t for r in spark.createDataFrame([(c,) for c in claims], "c string").select("c", text.trim_perishable(F.col("c")).alias("t")).collect()}
    assert got == claims


@pytest.mark.parametrize(("spec", "minute", "want"), [("24/7", 0, True), ("Mo-Fr 09:00-17:00", 12 * 60, True), ("Mo-Fr 09:00-17:00", 9 * 60 + 10, None), ("Mo-Fr 09:00-17:00", 5 * 1440 + 720, False), ("sunrise-sunset", 600, None), ("Fr-Sa 20:00-02:00", 5 * 1440 + 0, None), (None, 0, None),
    ("Mo-Su 09:00-12:15,12:45-18:00", 13 * 60 + 10, None), ("Mo-Su 12:00-12:30", 11 * 60 + 30, None), ("Mo-Su 09:00-12:15,12:45-18:00", 20 * 60, False), ("Mo off; 08:00-20:00", 12 * 60, True),
    ("Sa-Mo 10:00-16:00", 12 * 60, True), ("Sa-Mo 10:00-16:00", 3 * 1440 + 720, False), ("Mo-Fr 9:00 - 17:00", 12 * 60, None), ("Tu closed", 1440 + 600, False), ("Mo-Su 10:00-18:00; PH off", 720, None), ("10:00-18:00", 17 * 60 + 45, None)])
def test_opening_hours(spec, minute, want):
    assert time.open_state(spec, minute) is want


def test_quiet_hours(spark):
    hours = spark.range(24).select("id", time.in_quiet_hours(F.col("id"), 22, 8).alias("q"), time.in_quiet_hours(F.col("id"), 3, 3).alias("n"))
    assert [r.id for r in hours.where("q").collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 22, 23]
    assert hours.where("n").count() == 0


def test_sun(spark):
    noon = F.lit("2026-06-21 11:00:00").cast("timestamp")
    r = one(spark, time.solar_elevation(F.lit(59.33), F.lit(18.06), noon), time.minutes_until_below(F.lit(59.33), F.lit(18.06), F.lit("2026-03-20 12:00:00").cast("timestamp"), -0.833))
    assert 53 < r[0] < 55
    assert 280 < r[1] < 340


def test_identifiers(spark):
    r = one(spark, text.sitelink(F.lit("https://sv.wikipedia.org/wiki/Gamla_stan")), text.sitelink(F.lit("en:Old Town")), text.settlement(F.lit("Stockholms kommun")))
    assert tuple(r) == ("sv:Gamla_stan", "en:Old_Town", "Stockholms")


def test_points_of_ewkb(spark):
    import struct

    good = [(59.3255, 18.0705), (-33.5, -70.25), (0.0, 0.0), (1e-300, -179.999999)]
    rows = [(struct.pack("<BII2d", 1, 0x20000001, 4326, lng, lat).hex(), lat, lng) for lat, lng in good] + [(struct.pack(">BI2d", 0, 1, lng, lat).hex().upper(), lat, lng) for lat, lng in good]
    bad = [None, "", "01", "zz" * 25, struct.pack("<BII2d", 1, 0x20000001, 4326, 18.0, 95.0).hex(), struct.pack("<BII2d", 1, 0x20000001, 4326, 18.0, 59.0).hex()[:-2], struct.pack("<BI2d", 1, 1, float("nan"), 1.0).hex()]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + [(b, None, None) for b in bad])], "i int, x string, lat double, lng double")
    for r in d.select("lat", "lng", geo.point_of_ewkb(F.col("x")).alias("p")).collect():
        assert (r.p and tuple(r.p)) == (None if r.lat is None else (r.lat, r.lng))


def test_sunset_of_many_rows(spark):
    """The first minute below by a look at every minute, nulls, and 60,000 rows within 20 s."""
    import time as clock

    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 86_400 * 3 + F.col("id") * 977)
    rows = spark.range(120).select("id", (F.col("id") % 17 * 10 - 80.0).alias("lat"), (F.col("id") * 7 % 360 - 180.0).alias("lng"), at.alias("at"))
    below = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(960)))).withColumn("e", time.sun_elevation(F.col("lat"), F.col("lng"), F.timestamp_seconds(F.unix_seconds("at") + F.col("k") * 60))).where("e <= -0.833")
    plain = {r.id: r.k for r in below.groupBy("id").agg(F.min("k").alias("k")).collect()}
    found = {r.id: r.k for r in rows.select("id", time.minutes_until_below(F.col("lat"), F.col("lng"), F.col("at"), -0.833).alias("k")).collect()}
    assert found == {i: plain.get(i) for i in range(120)} and None in found.values() and len(plain) > 60
    nothing = F.when(F.col("id") < 0, 1.0)
    assert spark.range(2).select(time.minutes_until_below(nothing, F.lit(1.0), F.lit("2026-03-20 12:00:00").cast("timestamp"), 0.0), time.sun_elevation(nothing, F.lit(1.0), F.current_timestamp())).first() == (None, None)
    many = spark.range(60_000).withColumns({"lat": F.col("id") % 1700 / 10 - 85.0, "lng": F.col("id") % 360 * 1.0, "at": F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 500)})
    began = clock.time()
    assert many.agg(F.count(time.minutes_of_light_left(F.col("lat"), F.col("lng"), F.col("at")))).first()[0] > 10_000
    assert clock.time() - began < 20
