"""Canonical columns, Spark schemas and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SERIES = ("series_id",)
DATE = "date"

# Canonical variable names, in table order.
VARIABLES = (
    "temperature",
    "temperature_max",
    "temperature_min",
    "precipitation",
    "humidity",
    "solar_radiation",
    "wind_speed",
)
REQUIRED = ("date", "temperature", "precipitation")
# Variables used for correlation and for anomaly detection.
CORE_VARIABLES = (
    "temperature",
    "precipitation",
    "humidity",
    "solar_radiation",
    "wind_speed",
)

# Measurement units, kept as column metadata.
UNITS = {
    "temperature": "°C",
    "temperature_max": "°C",
    "temperature_min": "°C",
    "precipitation": "mm/day",
    "humidity": "%",
    "solar_radiation": "MJ/m²/day",
    "wind_speed": "m/s",
}

# Payload field -> canonical column (map-of-maps source).
MAP_PAYLOAD_COLUMNS = {
    "T2M": "temperature",
    "T2M_MAX": "temperature_max",
    "T2M_MIN": "temperature_min",
    "PRECTOTCORR": "precipitation",
    "RH2M": "humidity",
    "ALLSKY_SFC_SW_DWN": "solar_radiation",
    "WS2M": "wind_speed",
}
# Payload field -> canonical column (struct-of-arrays source).
ARRAY_PAYLOAD_COLUMNS = {
    "temperature_2m_mean": "temperature",
    "temperature_2m_max": "temperature_max",
    "temperature_2m_min": "temperature_min",
    "precipitation_sum": "precipitation",
    "relative_humidity_2m_mean": "humidity",
    "shortwave_radiation_sum": "solar_radiation",
    "windspeed_10m_max": "wind_speed",
}

# Month -> season.
SEASONS = {
    12: "Winter", 1: "Winter", 2: "Winter",
    3: "Spring", 4: "Spring", 5: "Spring",
    6: "Summer", 7: "Summer", 8: "Summer",
    9: "Autumn", 10: "Autumn", 11: "Autumn",
}

PANEL_SCHEMA = T.StructType(
    [T.StructField("series_id", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(name, T.DoubleType()) for name in VARIABLES]
)
FORECAST_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("forecast", T.DoubleType()),
        T.StructField("forecast_upper", T.DoubleType()),
        T.StructField("forecast_lower", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Settings:
    """Every threshold of the engine, with its default."""

    start_date: str = "2015-01-01"
    end_date: str = "2024-12-31"
    rolling: dict = field(
        default_factory=lambda: {"temperature": (7, 30, 365), "precipitation": (7, 30)}
    )
    lags: dict = field(default_factory=lambda: {"temperature": (1, 7, 30)})
    zscore_threshold: float = 2.5
    iqr_multiplier: float = 1.5
    contamination: float = 0.05
    forest_seed: int = 42
    forest_trees: int = 100
    forest_sample: int = 256
    season_length: int = 365
    horizon_years: int = 3
    confidence: float = 0.95
    max_trend_ratio: float = 3.0
    validation_folds: int = 3
    validation_test_days: int = 365
    validation_min_train: int = 730
    value_floor: float = -50.0
    value_ceiling: float = 60.0
    risk_weights: tuple = (0.40, 0.30, 0.30)


DEFAULTS = Settings()


def present(df: DataFrame, names) -> list[str]:
    """The given column names that the frame has, in the given order."""
    return [n for n in names if n in df.columns]


def with_units(df: DataFrame) -> DataFrame:
    """Attach measurement units as column metadata."""
    for name in present(df, UNITS):
        df = df.withMetadata(name, {"unit": UNITS[name]})
    return df
