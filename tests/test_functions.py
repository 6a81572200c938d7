import math
import random

from pyspark.sql import functions as F

from tremorframe.functions import focal, geo, seismic, text, windows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lit(v):
    return F.lit(v)


def test_haversine_known_values(spark):
    quarter = math.pi * 6371.0 / 2
    assert abs(one(spark, geo.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(90.0))) - quarter) < 1e-6
    assert abs(one(spark, geo.haversine_km(lit(10.0), lit(179.9), lit(10.0), lit(-179.9))) - 21.9) < 0.1
    assert abs(one(spark, geo.haversine_km(lit(-45.0), lit(0.0), lit(45.0), lit(180.0))) - 2 * quarter) < 1e-6


def test_haversine_limit_agrees_with_distance(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-89, 89), rng.uniform(-180, 180), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    km = geo.haversine_km(F.col("a"), F.col("b"), F.col("a") + F.col("c"), F.col("b") + F.col("d"))
    term = geo.haversine_term(F.col("c"), F.col("d"), F.cos(F.radians("a")), F.cos(F.radians(F.col("a") + F.col("c"))))
    assert df.filter((km <= 100.0) != (term <= geo.haversine_limit(lit(100.0)))).count() == 0


def test_fixed_text_matches_python_formatting(spark):
    rng = random.Random(5)
    values = [0.25, 0.35, 0.05, 0.15, 7.95, 2.675, 0.125, -0.25, -0.04, 0.0, 103.4, 8.049999, 1e-9, 0.5, 1.5]
    values += [round(rng.uniform(-200, 200), 3) for _ in range(400)] + [k / 8 for k in range(80)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2):
        got = df.select("v", text.fixed(F.col("v"), digits).alias("t")).collect()
        assert [r["t"] for r in got] == [f"{r['v']:.{digits}f}" for r in got]


def test_prediction_line(spark):
    when = F.to_timestamp(lit("2008-05-12 06:28:04"))
    line = text.prediction_line(when, lit(103.4), lit(31.0), lit(7.95), lit("T1"), lit(5.44), lit(17.5))
    assert one(spark, line) == "20080512062804 103.40 31.00 8.0 5.4 (Ms) 2008051300"
    assert one(spark, text.hour_stamp(when, lit(2.5))) == "2008051208"
    hours = text.hours_between(lit("20080512062804"), lit("2008051300"))
    assert abs(one(spark, hours) - (18 - 28 / 60 - 4 / 3600)) < 1e-9
    assert one(spark, text.hours_between(lit("2008xx"), lit("2008051300"))) is None


def test_mag_bin_and_rounding(spark):
    assert [one(spark, seismic.mag_bin(lit(v))) for v in (4.6, 4.649, 5.0, 4.96)] == [4.6, 4.6, 5.0, 5.0]
    assert one(spark, seismic.round_even(lit(0.35))) == 0.4
    assert one(spark, seismic.round_even(lit(0.25))) == 0.2


def test_gk_reach(spark):
    got = [(one(spark, seismic.gk_days(lit(m))), one(spark, seismic.gk_km(lit(m)))) for m in (1.9, 2.0, 2.5, 4.49, 6.5, 9.5)]
    assert got == [(1000.0, 140.0), (6.0, 30.0), (11.5, 30.0), (83.0, 60.0), (915.0, 110.0), (1000.0, 140.0)]


def test_fault_classes(spark):
    rakes = {90.0: "Thrust", 45.0: "Thrust", -90.0: "Normal", -135.0: "Normal", 0.0: "Strike-Slip", 180.0: "Strike-Slip",
             270.0: "Normal", 44.0: "Strike-Slip"}
    for rake, kind in rakes.items():
        assert one(spark, focal.fault_type(lit(rake))) == kind
    assert one(spark, focal.fault_type(F.lit(None).cast("double"))) == "Unknown"
    codes = {10.0: "SS", 31.0: "NF", 60.0: "TF", 90.0: "TF", 121.0: "SS", 150.0: "SS", -31.0: "TF", -60.0: "NF", -130.0: "SS"}
    for rake, code in codes.items():
        assert one(spark, focal.catalog_fault_code(lit(rake))) == code
    assert one(spark, focal.fault_code(lit("Thrust"))) == "TF"


def test_time_buckets(spark):
    for window, hours, bucket in (("T1", 0.0, 0), ("T1", 3.0, 0), ("T1", 3.01, 1), ("T1", 24.0, 3), ("T1", 99.0, 3),
                                  ("T2", 36.0, 0), ("T3", 120.5, 2), ("H168", 6.0, 0), ("H168", 30.0, 1),
                                  ("H168", 72.0, 2), ("H168", 120.0, 3), ("T3", 10.0, 0)):
        assert one(spark, windows.time_bucket(lit(window), lit(hours))) == bucket


def test_expected_hours_and_alignment(spark):
    def arr(*v):
        return F.array(*[lit(float(x)) for x in v])

    assert one(spark, windows.expected_hours(lit("T1"), arr(0, 0, 0, 2))) == 18.0
    assert one(spark, windows.expected_hours(lit("T1"), arr(0, 0, 0, 0))) == (1.5 + 4.5 + 9 + 18) / 4
    got = one(spark, windows.align_probabilities(arr(0.2, 0.6), F.array(lit(0), lit(3))))
    assert [round(v, 9) for v in got] == [0.25, 0.0, 0.0, 0.75]
    assert one(spark, windows.align_probabilities(arr(0, 0), F.array(lit(0), lit(3)))) == [0.25] * 4


def test_clamps(spark):
    nan = F.lit(float("nan"))
    assert one(spark, windows.clamp_mag(nan, lit(7.0))) == 0.0
    assert one(spark, windows.clamp_mag(lit(9.0), lit(7.0))) == 7.5
    assert one(spark, windows.clamp_hours(nan, lit("T2"))) == 48.0
    assert one(spark, windows.clamp_hours(lit(1.0), lit("T2"))) == 24.000001
    assert one(spark, windows.clamp_hours(lit(999.0), lit("T3"))) == 168.0
    assert abs(one(spark, windows.rule_mag(lit("T1"), lit(7.0))) - 5.85) < 1e-9
    assert one(spark, windows.unlog_target(lit(50.0))) <= 8760.0 + 1e-6
