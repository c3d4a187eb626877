import hashlib
import math
import random
from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from pulseline.functions import clock, geo, ids, text


def column(spark, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return df, lambda expr: [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_float_text_prints_like_python(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 34.0, 0.0005, 1e7, 12345678.91, 1e16, 1.5e16, 5e-05, 1e-4, -123.25, 1e22, 0.1, 999.999,
              float("nan"), float("inf"), float("-inf")]
    values += [round(rng.uniform(0, 5000), rng.choice([0, 1, 2, 3])) for _ in range(2000)]
    values += [round(rng.uniform(1e7, 1e15), 2) for _ in range(300)]
    values += [float(f"{rng.randint(1, 999999)}e{rng.randint(-12, 20)}") for _ in range(2000)]
    _, run = column(spark, values, "double")
    assert [a for a in zip(run(text.float_text(F.col("v"))), map(repr, values)) if a[0] != a[1]] == []


def test_ping_id_is_the_digest_of_the_five_fields(spark):
    df = spark.createDataFrame(
        [("71", "8472", "1001", "2026-05-04T10:00:00Z", 34.0), ("N4", "0", "0", "2026-05-04T10:00:00+00:00", None)],
        "l string, d string, p string, t string, m double")
    got = [r[0] for r in df.select(ids.ping_id(*[F.col(c) for c in "ldptm"])).collect()]
    want = [hashlib.sha256("|".join(map(str, r)).encode()).hexdigest()[:32] for r in df.collect()]
    assert got == want


def test_numbers_follow_the_feed_grammar(spark):
    _, run = column(spark, ["34", " 34.5 ", "1e3", "34d", "", "x", ".5", "nan", None, "12abc"], "string")
    got = run(text.to_double(F.col("v")))
    assert got[:3] == [34.0, 34.5, 1000.0] and math.isnan(got[7])
    assert got[3:7] == [None, None, None, 0.5] and got[8:] == [None, None]
    _, run = column(spark, ["0", " 0042", "8.0", "x", None, "-3", "99999999999"], "string")
    assert run(text.to_int(F.col("v"))) == [0, 42, None, None, None, -3, None]


def test_instants_without_offset_are_utc(spark):
    _, run = column(spark, ["2026-05-04T10:00:00Z", "2026-05-04T12:00:00+02:00", "2026-05-04 10:00:00", "10:00",
                            "yesterday", "", None], "string")
    got = run(F.unix_seconds(text.to_instant(F.col("v"))))
    moment = int(datetime(2026, 5, 4, 10, tzinfo=timezone.utc).timestamp())
    assert got == [moment, moment, moment, None, None, None, None]


def test_colours(spark):
    _, run = column(spark, ["#ab12cd", "AB12CD", " ##00ff00 ", "xyz", "", "12345", "gggggg", None], "string")
    assert run(text.colour(F.col("v"))) == ["#AB12CD", "#AB12CD", "#00FF00", None, None, None, None, None]


def vincenty_m(lon1, lat1, lon2, lat2):
    """Vincenty (1975), inverse problem on WGS84."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = math.atan((1 - f) * math.tan(math.radians(lat1))), math.atan((1 - f) * math.tan(math.radians(lat2)))
    big_l = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam),
                           math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2a = 1 - sin_a ** 2
        cos2m = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2a if cos2a else 0
        c = f / 16 * cos2a * (4 + f * (4 - 3 * cos2a))
        before = lam
        lam = big_l + (1 - c) * f * sin_a * (sigma + c * sin_s * (cos2m + c * cos_s * (2 * cos2m ** 2 - 1)))
        if abs(lam - before) < 1e-13:
            break
    usq = cos2a * (a * a - b * b) / (b * b)
    big_a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
    big_b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
    delta = big_b * sin_s * (cos2m + big_b / 4 * (cos_s * (2 * cos2m ** 2 - 1)
                             - big_b / 6 * cos2m * (4 * sin_s ** 2 - 3) * (4 * cos2m ** 2 - 3)))
    return b * big_a * (sigma - delta)


def test_geodesic_segments_agree_with_vincenty(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(200):
        lon, lat = rng.uniform(-170, 170), rng.uniform(-65, 65)
        pairs.append((lon, lat, lon + rng.uniform(-0.02, 0.02), lat + rng.uniform(-0.02, 0.02)))
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    for r in df.withColumn("m", geo.geodesic_segment_m(*[F.col(c) for c in "abcd"])).collect():
        want = vincenty_m(*r[:4])
        assert abs(r["m"] - want) <= 1e-6 * want


def test_wkt_linestrings(spark):
    _, run = column(spark, ["LINESTRING(4.3 50.8, 4.4 50.9)", "linestring (1 2,3 4)", "POINT(1 2)", "LINESTRING(1 x)",
                            "LINESTRING()", "LINESTRING(1, 2 3)", None], "string")
    got = run(geo.linestring_points(F.col("v")))
    assert [tuple(p) for p in got[0]] == [(1, 4.3, 50.8), (2, 4.4, 50.9)]
    assert len(got[1]) == 2 and got[2:] == [None] * 5


def test_service_days_around_clock_changes(spark):
    cases = [
        ("71", "2026-05-04T00:45:00Z", date(2026, 5, 3)),   # 02:45 local, before 03:30
        ("71", "2026-05-04T01:45:00Z", date(2026, 5, 4)),   # 03:45 local
        ("N4", "2026-05-03T22:30:00Z", date(2026, 5, 4)),   # 00:30 local, night line
        ("N4", "2026-05-03T21:30:00Z", date(2026, 5, 3)),
        ("71", "2026-03-29T01:15:00Z", date(2026, 3, 28)),  # 03:15 summer time
        ("71", "2026-03-29T01:45:00Z", date(2026, 3, 29)),
        ("71", "2026-10-25T02:15:00Z", date(2026, 10, 24)),  # 03:15 winter time
        ("71", "2026-10-25T02:30:00Z", date(2026, 10, 25)),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, l string, t string, want date")
    got = df.select("i", "want", clock.service_day(F.col("l"), F.col("t").cast("timestamp")).alias("got")).collect()
    assert [r["i"] for r in got if r["got"] != r["want"]] == []
