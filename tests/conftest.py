import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from tremorframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
                            spark_driver_memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fixtures():
    return os.path.join(ROOT, "tests", "fixtures")


CATALOG = "id string, time timestamp, latitude double, longitude double, depth double, mag double"


@pytest.fixture(scope="session")
def make_catalog(spark):
    from pyspark.sql import functions as F

    def make(rows):
        """rows: (id, time text, lat, lon, depth, mag)."""
        raw = spark.createDataFrame(
            rows, "id string, time string, latitude double, longitude double, depth double, mag double")
        return raw.withColumn("time", F.to_timestamp("time"))

    return make


@pytest.fixture(scope="session")
def random_catalog(spark, make_catalog):
    """2,500 events in a few dense places, at the date line and close to both poles."""
    import random
    from datetime import datetime, timedelta

    rng = random.Random(11)
    places = [(35.0, 140.0), (10.0, 179.6), (10.3, -179.7), (88.9, 20.0), (-89.3, -120.0), (0.0, 0.0)]
    rows = []
    for i in range(2500):
        lat0, lon0 = rng.choice(places) if rng.random() < 0.9 else (rng.uniform(-90, 90), rng.uniform(-180, 180))
        lat = max(-90.0, min(90.0, lat0 + rng.gauss(0, 0.6)))
        lon = (lon0 + rng.gauss(0, 0.6 if abs(lat0) < 80 else 60.0) + 180.0) % 360.0 - 180.0
        when = datetime(2020, 1, 1) + timedelta(seconds=rng.uniform(0, 90 * 86400))
        mag = round(4.0 + rng.expovariate(1.6), 1)
        rows.append((f"e{i}", when.isoformat(sep=" "), lat, lon, rng.uniform(0, 100), mag))
    return make_catalog(rows).cache()
