"""Schema checks, type coercion and data-quality measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.functions.columns import nan_to_null, safe_divide, snake_case, total
from tsengine.operators.features import numeric_columns
from tsengine.operators.joins import attach
from tsengine.schema import DATE, DEFAULTS, PANEL_SCHEMA, REQUIRED, SERIES, VARIABLES, present
from tsengine.session import materialize


def schema_issues(df: DataFrame) -> list[tuple[str, str]]:
    """Missing required columns and wrong types, from the schema alone (no job)."""
    actual = {f.name: f.dataType for f in df.schema}
    issues = [("missing_column", c) for c in REQUIRED if c not in actual]
    for expected in PANEL_SCHEMA:
        if expected.name in SERIES or expected.name not in actual:
            continue
        have = actual[expected.name]
        if expected.name == DATE:
            fits = isinstance(have, (T.DateType, T.TimestampType, T.TimestampNTZType))
        else:
            fits = isinstance(have, T.NumericType) and not isinstance(have, T.DecimalType)
        if not fits:
            want = expected.dataType.simpleString()
            issues.append(
                ("type_mismatch", f"{expected.name}: expected {want}, got {have.simpleString()}")
            )
    return issues


def validate_schema(df: DataFrame) -> DataFrame:
    """The schema issues as rows ``(issue_type, detail)``."""
    return df.sparkSession.createDataFrame(schema_issues(df), "issue_type string, detail string")


def date_bounds(
    df: DataFrame, start: str = DEFAULTS.start_date, end: str = DEFAULTS.end_date, keys=SERIES
) -> DataFrame:
    """First and last day per series and whether they miss the wanted period."""
    bounds = df.groupBy(*keys).agg(F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"))
    return bounds.withColumns(
        {
            "starts_late": F.col("first_date") > F.lit(start).cast("date"),
            "ends_early": F.col("last_date") < F.lit(end).cast("date"),
        }
    )


def _typed(df: DataFrame, name: str) -> Column:
    text = isinstance(df.schema[name].dataType, T.StringType)
    if name == DATE:
        return F.to_date(F.try_to_timestamp(DATE)) if text else F.to_date(DATE)
    return nan_to_null(F.col(name).try_cast("double") if text else F.col(name).cast("double"))


def convert_types(df: DataFrame, keys=SERIES) -> DataFrame:
    """Date and variables to their types; what cannot be read becomes null, NaN too."""
    return df.withColumns({c: _typed(df, c) for c in (DATE, *VARIABLES) if c in df.columns})


def _measured(df: DataFrame, keys) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _long(df: DataFrame, keys, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Wide aggregates ``<prefix><name>`` to one row per name; stays within one task per row."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("column_name"),
                *[F.col(f"{prefix}{n}").alias(alias) for prefix, alias in fields.items()],
            )
            for n in names
        ]
    )
    kept = [c for c in df.columns if not any(c == f"{p}{n}" for p in fields for n in names)]
    return df.select(*kept, F.inline(rows))


def quality_report(df: DataFrame, keys=SERIES) -> DataFrame:
    """Rows, cells and missing cells per series, and missing values per column."""
    names = _measured(df, keys)
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_missing_{c}") for c in names],
    )
    missing = total([F.col(f"_missing_{c}") for c in names])
    cells = F.col("total_rows") * len(names)
    wide = counts.withColumns(
        {
            "total_columns": F.lit(len(names)).cast("bigint"),
            "total_cells": cells,
            "missing_cells": missing,
            "missing_percentage": F.round(safe_divide(missing * 100.0, cells), 2),
        }
    )
    out = _long(wide, keys, names, {"_missing_": "missing"})
    share = safe_divide(F.col("missing") * 100.0, F.col("total_rows"))
    return out.withColumn("column_missing_percentage", F.round(share, 2))


def overall_status(report: DataFrame, limit: float = 5.0) -> Column:
    """PASS while fewer than ``limit`` percent of the cells are missing."""
    share = safe_divide(F.col("missing_cells") * 100.0, F.col("total_cells"))
    return F.when(share < limit, "PASS").otherwise("WARNING")


def column_profile(df: DataFrame, keys=SERIES) -> DataFrame:
    """Type, missing share, minimum, maximum and mean per column; one pass."""
    names = _measured(df, keys)
    numeric = set(numeric_columns(df, keys))
    types = dict(df.dtypes)
    aggs: list[Column] = [F.count("*").alias("total_rows")]
    for c in names:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"_missing_{c}"))
        for prefix, fn in (("_min_", F.min), ("_max_", F.max), ("_mean_", F.avg)):
            value = fn(F.col(c).cast("double")) if c in numeric else F.lit(None).cast("double")
            aggs.append(value.alias(f"{prefix}{c}"))
    wide = df.groupBy(*keys).agg(*aggs)
    fields = {"_missing_": "missing", "_min_": "min", "_max_": "max", "_mean_": "mean"}
    out = _long(wide, keys, names, fields)
    kinds = F.create_map(*[F.lit(v) for c in names for v in (c, types[c])])
    return out.withColumns(
        {
            "data_type": F.element_at(kinds, F.col("column_name")),
            "missing_percentage": safe_divide(F.col("missing") * 100.0, F.col("total_rows")),
        }
    )


def duplicate_rows(df: DataFrame, keys=SERIES) -> DataFrame:
    """Rows beyond the first of each group of equal rows; equal rows fold before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return groups.groupBy(*keys).agg(F.sum(F.col("_copies") - 1).alias("duplicate_rows"))


def outlier_counts(df: DataFrame, threshold: float = 3.0, keys=SERIES) -> DataFrame:
    """Readings with |z| above the threshold, per series and numeric column.

    The moments have one row per series; ``attach`` spreads the rows of a hot one.
    """
    names = numeric_columns(df, keys)
    moments = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in names],
        *[F.stddev_samp(c).alias(f"_std_{c}") for c in names],
    )

    def far(c: str) -> Column:
        z = F.abs(F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_std_{c}")))
        return F.count_if(z > threshold).alias(f"_outliers_{c}")

    wide = attach(df, moments, keys).groupBy(*keys).agg(
        F.count("*").alias("total_rows"), *[far(c) for c in names]
    )
    return _long(wide, keys, names, {"_outliers_": "outliers"})


def top_outlier_columns(df: DataFrame, k: int = 5, keys=SERIES) -> DataFrame:
    """The k columns with most outliers per series, at least one each."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc("outliers"), "column_name")
    return (
        outlier_counts(df, keys=keys)
        .withColumn("rank", F.row_number().over(ranked))
        .filter((F.col("rank") <= k) & (F.col("outliers") > 0))
        .withColumn("outlier_percentage", safe_divide(F.col("outliers") * 100.0, F.col("total_rows")))
    )


def quality_score(df: DataFrame, keys=SERIES, full_span_days: int = 3650) -> DataFrame:
    """Completeness, consistency, validity, coverage, accuracy and their weighted score."""
    names = _measured(df, keys)
    base = df.groupBy(*keys).agg(
        F.count("*").alias("total_rows"),
        total([F.count_if(F.col(c).isNull()) for c in names]).alias("missing_cells"),
        F.datediff(F.max(DATE), F.min(DATE)).alias("span_days"),
    )
    outliers = outlier_counts(df, keys=keys).groupBy(*keys).agg(F.sum("outliers").alias("outlier_cells"))
    rows = base.join(duplicate_rows(df, keys), list(keys)).join(outliers, list(keys))
    cells = F.col("total_rows") * len(names)

    def remaining(share: Column) -> Column:
        return F.greatest(F.lit(0.0), F.lit(100.0) - share)

    duplicates = safe_divide(F.col("duplicate_rows") * 100.0, F.col("total_rows"))
    measures = {
        "completeness": remaining(safe_divide(F.col("missing_cells") * 100.0, cells)),
        "consistency": remaining(duplicates * 10.0),
        "validity": remaining(safe_divide(F.col("outlier_cells") * 100.0, cells)),
        "temporal_coverage": F.least(F.lit(100.0), F.coalesce("span_days", F.lit(0)) * 100.0 / full_span_days),
    }
    scored = rows.withColumns(measures)
    accuracy = (F.col("completeness") + F.col("consistency") + F.col("validity")) / 3
    scored = scored.withColumn("accuracy", accuracy)
    # Weights of the five measures.
    weights = {
        "completeness": 0.30,
        "consistency": 0.20,
        "validity": 0.20,
        "temporal_coverage": 0.15,
        "accuracy": 0.15,
    }
    score = total([F.col(m) * w for m, w in weights.items()])
    scored = scored.withColumn("quality_score", F.round(score, 1))
    verdict = F.when(F.col("quality_score") >= 80, "PASS").otherwise("REVIEW REQUIRED")
    return scored.withColumn("assessment", verdict)


def engineered_columns(df: DataFrame) -> DataFrame:
    """Derived columns of the frame by kind, from their names (no job)."""
    found = []
    for c in df.columns:
        name = c.lower()
        if c in ("year", "month", "day_of_year", "season"):
            found.append(("temporal", c))
        if "_ma" in name and name.endswith(("7", "30", "365")):
            found.append(("rolling", c))
        if "lag" in name:
            found.append(("lag", c))
        if "anomaly" in name and "_ma" not in name:
            found.append(("anomaly", c))
    return df.sparkSession.createDataFrame(found, "kind string, column_name string")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Snake-case every column name."""
    def plain(name: str) -> str:
        return "".join("_" if ch in " -." else ch for ch in name.lower().strip())

    return df.withColumnsRenamed({c: plain(c) for c in df.columns})


def normalize_names(df: DataFrame, column: str, out: str) -> DataFrame:
    """The same rule for a column of names."""
    return df.withColumn(out, snake_case(F.col(column)))


def rejected_rows(df: DataFrame, keys=SERIES) -> DataFrame:
    """Rows per series, and how many of them have no date that can be read."""
    dated = convert_types(df.select(*keys, DATE))
    return dated.groupBy(*keys).agg(F.count("*").alias("total_rows"), F.count_if(F.col(DATE).isNull()).alias("rejected_rows"))


def rejected_cells(df: DataFrame) -> Column:
    """Array of (column_name, value, reason) of the cells that ``convert_types`` cannot read."""
    typed = {c: _typed(df, c) for c in (DATE, *VARIABLES) if c in df.columns}
    cells = []
    for c, value in typed.items():
        raw = F.col(c).cast("string")
        reason = F.when(F.trim(raw) == "", "empty").when(F.lower(F.trim(raw)) == "nan", "not a number")
        reason = reason.otherwise("no date" if c == DATE else "not numeric")
        cell = F.struct(F.lit(c).alias("column_name"), raw.alias("value"), reason.alias("reason"))
        cells.append(F.when(F.col(c).isNotNull() & value.isNull(), cell))
    return F.array_compact(F.array(*cells))


class Validated:
    """Outcome of ``load_and_validate``: typed rows, and what their one pass has measured.

    ``written`` runs that pass; the report, the bounds and the issues' cell counts are measured in it
    and cost no further scan. Where nothing has run yet, the first of them runs it without keeping rows.
    """

    def __init__(self, source: DataFrame, issues: list[tuple[str, str]], start: str, end: str, keys):
        self.source, self._issues, self.start, self.end, self.keys = source, issues, start, end, keys
        self._seen, self._ran = Observation(), False
        self.names = _measured(source, keys)
        typed = source.withColumn("_cells", rejected_cells(source))
        checked = [c for c in (DATE, *VARIABLES) if c in source.columns]
        rejected = [F.count_if(F.array_contains("_cells.column_name", c)).alias(f"rejected_{c}") for c in checked]
        missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in self.names]
        bounds = [F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date")] if DATE in source.columns else []
        typed = convert_types(typed).observe(self._seen, F.count(F.lit(1)).alias("total_rows"), *bounds, *rejected, *missing)
        self.rows = typed.drop("_cells")

    def written(self, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The rows, after ``shape``, as a table; running this once gives all measures."""
        if self._ran:  # an observation is filled once
            return materialize(shape(self.rows))
        out = materialize(shape(self.rows))
        self._ran = True
        return out

    @property
    def measures(self) -> dict:
        if not self._ran:
            self.rows.write.format("noop").mode("overwrite").save()
            self._ran = True
        return self._seen.get

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.source.sparkSession.createDataFrame(rows, schema)

    def issues(self) -> DataFrame:
        """Schema issues with the number of cells of the column that could not be read."""
        rows = []
        for kind, detail in self._issues:
            column = detail.split(":")[0]
            rows.append((kind, detail, column, self.measures.get(f"rejected_{column}") or 0))
        return self._frame(rows, "issue_type string, detail string, column_name string, rejected_cells long")

    def bounds(self) -> DataFrame:
        """First and last day of all rows, and whether they miss the wanted period."""
        first, last = (self.measures.get(f"{side}_date") for side in ("first", "last"))
        days = self._frame([(first, last)], "first_date date, last_date date")
        late, early = F.col("first_date") > F.lit(self.start).cast("date"), F.col("last_date") < F.lit(self.end).cast("date")
        return days.withColumns({"starts_late": late, "ends_early": early})

    def report(self) -> DataFrame:
        """Rows, cells and missing cells of the typed rows, and missing and rejected cells per column."""
        seen = self.measures
        total, missing = seen["total_rows"], sum(seen[f"missing_{c}"] for c in self.names)
        rows = [(c, total, len(self.names), missing, seen[f"missing_{c}"], seen.get(f"rejected_{c}", 0)) for c in self.names]
        schema = "column_name string, total_rows long, total_columns long, missing_cells long, missing long, rejected long"
        cells = F.col("total_rows") * F.col("total_columns")
        return self._frame(rows, schema).withColumns(
            {
                "total_cells": cells,
                "missing_percentage": F.round(safe_divide(F.col("missing_cells") * 100.0, cells), 2),
                "column_missing_percentage": F.round(safe_divide(F.col("missing") * 100.0, F.col("total_rows")), 2),
            }
        )

    def rejects(self) -> DataFrame:
        """A row for every cell that could not be read: series, raw row as JSON, column, value and reason."""
        raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.source.columns]))
        rows = self.source.select(*self.keys, raw.alias("raw"), rejected_cells(self.source).alias("_cells"))
        return rows.filter(F.size("_cells") > 0).select(*self.keys, "raw", F.inline("_cells"))


def load_and_validate(df: DataFrame, start: str = DEFAULTS.start_date, end: str = DEFAULTS.end_date, keys=SERIES) -> Validated:
    """Raise on missing required columns before any job, then coerce types and measure the rows on their way."""
    issues = schema_issues(df)
    missing = [detail for kind, detail in issues if kind == "missing_column"]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return Validated(df, issues, start, end, keys)
