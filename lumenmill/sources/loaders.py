"""The kinds of sources a job may name; Parquet is built in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parquet

GROUP = "lumenmill.dataloaders"


@dataclass(frozen=True)
class Loader:
    """``read(spark, loader)`` gives the source's rows; filters, casts and ids follow on them.

    Rows without ``_file`` and ``_row`` (their place, for row ids and order) need an
    ``id_column`` and are ordered by it. ``fields`` are a loader's own keys.
    """

    read: Callable[[SparkSession, dict], DataFrame]
    fields: frozenset[str] = frozenset()
    required: tuple[str, ...] = ()


LOADERS: dict[str, Loader] = {"parquet": Loader(parquet.read, frozenset({"path"}), ("path",))}


def register_loader(kind: str, loader: Loader) -> None:
    """Add a kind of source; names are unique."""
    if kind in known_loaders():
        raise ValueError(f"{kind!r} is registered already")
    LOADERS[kind] = loader


def known_loaders() -> dict[str, Loader]:
    return LOADERS | {e.name: e.load() for e in entry_points(group=GROUP)}


def validated(given: dict) -> dict:
    """A loader entry with its defaults; unknown fields and types are refused."""
    loader = known_loaders().get(given.get("type"))
    if loader is None:
        raise ValueError(f"unknown dataloader type {given.get('type')!r}")
    return parquet.validated(given, loader.fields, loader.required)


def scan(spark: SparkSession, given: dict) -> DataFrame:
    """The source's rows, filtered and cast, with ``_file`` and ``_row`` (their place) and ``_id``."""
    df = known_loaders()[given["type"]].read(spark, given)
    if "_file" not in df.columns:
        if not given["id_column"]:
            raise ValueError(f"{given['name']}: rows of {given['type']!r} have no place, so an id_column is needed")
        df = df.select("*", F.col(given["id_column"]).cast("string").alias("_file"), F.lit(0).cast("long").alias("_row"))
    return parquet.prepared(df, given)
