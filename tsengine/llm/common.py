"""Table access, written intermediates and Arrow mapping shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.session import materialize

#: Rows and bytes of one Arrow batch to a Python worker. Texts may be long, so both bound it.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write the rows once as Parquet in the folder of ``spark.checkpoint.dir`` and read them back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation, and every branch sees the same
    rows. Where the setting is unset, the warehouse serves in local mode, and any other mode raises.
    """
    return materialize(df)


def name(column: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` has the name (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_texts(
    df: DataFrame,
    text: str | Column,
    fields: Sequence[T.StructField],
    build: Callable[[], Callable[[pa.Array], list]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` (default: all columns) plus ``fields`` computed from whole texts, a batch at a time.

    ``build`` runs once per task and returns a function from an Arrow string array to one array
    per field. Null texts arrive as null. A kept column with the name of a field gives way to it.
    """
    small_batches(df.sparkSession)
    mine = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in mine]
    text = name(text) if isinstance(text, str) else text
    source = df.select(*[name(c) for c in keep], text.alias("text of the row"))
    schema = T.StructType([source.schema.fields[i] for i in range(len(keep))] + list(fields))
    names, kinds = schema.names, [arrow_type(f.dataType) for f in fields]

    def run(batches):
        work = build()
        for batch in batches:
            made = work(batch.column(batch.num_columns - 1))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [a if isinstance(a, pa.Array) else pa.array(a, type=k) for a, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.FloatType(): pa.float32(),
        T.BooleanType(): pa.bool_(),
        T.StringType(): pa.string(),
        T.BinaryType(): pa.binary(),
    }
    return pa.list_(arrow_type(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[kind]


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text (null: of the empty text), which decides folds and samples."""
    return F.crc32(F.coalesce(name(column).cast("string"), F.lit("")).cast("binary"))


def word_count(text: str) -> Column:
    """Number of words: runs of characters other than space and U+0009 to U+000D (null: 0)."""
    return F.coalesce(F.regexp_count(name(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
