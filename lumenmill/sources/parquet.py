"""The Parquet source: scan, filter, cast, row ids.

Filters come first and reach the scan where they can; casts refuse values they
would change; the sample column is decoded later, in the kernel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import value_condition
from ..functions.ranks import row_index

TYPES = {"int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "bool": "boolean", "str": "string", "categorical": "string"}
KEYS = {"name", "type", "id_column", "load_batch_size", "filters", "sample_path", "transform", "storage", "decode", "image_shape"}


def validated(given: dict, fields: frozenset[str] = frozenset({"path"}), required: tuple[str, ...] = ("path",)) -> dict:
    """A loader entry with its defaults; unknown fields are refused."""
    if unknown := set(given) - KEYS - fields:
        raise ValueError(f"dataloaders: unknown fields: {', '.join(sorted(unknown))}")
    for k in ("name", *required, "sample_path"):
        if not given.get(k):
            raise ValueError(f"dataloaders: {k} is required")
    if given.get("decode", "img_bytes") != "img_bytes":
        raise ValueError(f"dataloaders: decode must be img_bytes, got {given['decode']!r}")
    samples = given["sample_path"]
    if len(samples) != 1 or "column" not in samples[0]:
        raise ValueError("dataloaders: sample_path takes exactly one {column, prefix}")
    for t in given.get("transform") or []:
        if t.get("to_type") not in TYPES:
            raise ValueError(f"dataloaders: unknown cast {t.get('to_type')!r}")
    return {"load_batch_size": 10_000, "filters": [], "transform": [], "id_column": None, "image_shape": None} | {k: v for k, v in given.items() if v is not None}


def filter_condition(filters: list[dict]) -> Column | None:
    """All columns' conditions together; of two entries for a column the last holds."""
    last = {f["column"]: f["values"] for f in filters}
    condition = None
    for column, values in last.items():
        one = value_condition(F.col(column), values)
        condition = one if condition is None else condition & one
    return condition


def exact_cast(column: Column, source: str, to: str) -> Column:
    """The cast value; a fraction that would be lost is an error (as are overflow and bad text)."""
    target = TYPES[to]
    out = column.cast(target)
    if target in ("int", "bigint") and source in ("float", "double"):
        lost = F.raise_error(F.concat(F.lit("cast loses the fraction of "), column.cast("string"))).cast(target)
        return F.when(column.isNotNull() & (out.cast("double") != column), lost).otherwise(out)
    return out


def cast_columns(df: DataFrame, transforms: list[dict]) -> DataFrame:
    """In place, or as a further column <name>_<type>; absent columns are skipped."""
    kinds = dict(df.dtypes)
    for t in transforms:
        if t["column"] in kinds:
            name = t["column"] if t.get("in_place") else f"{t['column']}_{t['to_type']}"
            df = df.withColumn(name, exact_cast(F.col(t["column"]), kinds[t["column"]], t["to_type"]))
    return df


def read(spark: SparkSession, loader: dict) -> DataFrame:
    """The files' rows with ``_file`` and ``_row``, their place."""
    return spark.read.parquet(loader["path"]).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def prepared(df: DataFrame, loader: dict) -> DataFrame:
    """Rows filtered and cast, with ``_id``: a column's value, or the row's number."""
    condition = filter_condition(loader["filters"])
    if condition is not None:
        df = df.filter(condition)
    df = cast_columns(df, loader["transform"])
    if loader["id_column"]:
        return df.withColumn("_id", F.col(loader["id_column"]).cast("string"))
    return row_index(df, "_file", "_row", "_n").withColumn("_id", F.col("_n").cast("string")).drop("_n")


def scan(spark: SparkSession, loader: dict) -> DataFrame:
    """The source's rows with ``_file`` and ``_row`` (their place) and ``_id``."""
    return prepared(read(spark, loader), loader)


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("_file", "_row", "_id")]
