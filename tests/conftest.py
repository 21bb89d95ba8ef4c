import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tsengine.session import local_session  # noqa: E402

CORE = ("temperature", "precipitation", "humidity", "solar_radiation", "wind_speed")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Spark frame from columns; NaN becomes null."""

    def build(columns: dict, schema: str):
        pdf = pd.DataFrame(columns)
        rows = [
            tuple(None if v is None or (isinstance(v, float) and np.isnan(v)) else v for v in row)
            for row in pdf.itertuples(index=False)
        ]
        rows = [tuple(v.item() if isinstance(v, np.generic) else v for v in row) for row in rows]
        return spark.createDataFrame(rows, schema)

    return build


def days(start, n):
    return [d.date() for d in pd.date_range(start, periods=n, freq="D")]


def seasonal(n=3653, slope=0.03, noise=2.0, seed=42):
    t = np.arange(n)
    rng = np.random.default_rng(seed)
    return 25 + slope * t / 365.25 + 10 * np.sin(2 * np.pi * t / 365.25) + rng.normal(0, noise, n)


def weather(n=366, seed=42):
    """Five variables of one year, two temperatures far out."""
    rng = np.random.default_rng(seed)
    out = {
        "temperature": rng.normal(25, 3, n),
        "precipitation": rng.uniform(0, 10, n),
        "humidity": rng.uniform(30, 90, n),
        "solar_radiation": rng.uniform(10, 25, n),
        "wind_speed": rng.uniform(0, 15, n),
    }
    out["temperature"][50], out["temperature"][100] = 50.0, -10.0
    return out


@pytest.fixture
def weather_frame(make):
    n = 366
    schema = "series_id string, date date, " + ", ".join(f"{c} double" for c in CORE)
    return make({"series_id": ["a"] * n, "date": days("2020-01-01", n), **weather(n)}, schema)


@pytest.fixture
def series_frame(make):
    """Frame of one value per day and series from {series: values}."""

    def build(values: dict, value="temperature", start="2015-01-01", gaps=()):
        rows = {"series_id": [], "date": [], value: []}
        for name, ys in values.items():
            for i, (d, y) in enumerate(zip(days(start, len(ys)), ys)):
                if i not in gaps:
                    rows["series_id"].append(name)
                    rows["date"].append(d)
                    rows[value].append(None if y is None else float(y))
        return make(rows, f"series_id string, date date, {value} double")

    return build
