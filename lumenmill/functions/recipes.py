"""Recipes and the identity of what they make."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOLE = "\x00parent\x00"


@dataclass(frozen=True)
class Recipe:
    """What one ledger row says of how its sample was made, but for the parent."""

    algorithm: str
    family: str = "procedural"
    arity: str = "unary"
    reversible: bool = False
    params: dict[str, Any] = field(default_factory=dict)
    seed: int | None = None
    tool_model: str | None = None
    target_model: str | None = None

    @property
    def params_json(self) -> str:
        return json.dumps(self.params, sort_keys=True, default=str)

    def identity(self, parent_id: str) -> str:
        """12 hex digits of sha1 over the sorted JSON of all nine fields."""
        return hashlib.sha1(self._json(parent_id).encode()).hexdigest()[:12]

    def _json(self, parent_id: str) -> str:
        fields = {"parent_id": parent_id, "algorithm": self.algorithm, "family": self.family, "arity": self.arity, "reversible": self.reversible, "params": self.params, "seed": self.seed, "tool_model": self.tool_model, "target_model": self.target_model}
        return json.dumps(fields, sort_keys=True, default=str)

    def around(self) -> tuple[str, str]:
        """The identity's JSON before and after the parent's text."""
        before, after = self._json(HOLE).split(json.dumps(HOLE))
        return before, after

    def identity_column(self, parent: Column) -> Column:
        """The same as an expression."""
        before, after = self.around()
        return hashed(F.lit(before), json_text(parent), F.lit(after))

    def generator(self, parent_id: str) -> np.random.Generator | None:
        """Draws that depend on the seed, the parameters and the parent alone."""
        if self.seed is None:
            return None
        digest = hashlib.sha1(f"{parent_id}::{self.params_json}".encode()).digest()
        return np.random.default_rng([self.seed, int.from_bytes(digest[:8], "big")])

    def columns(self, parent: Column, selection: str, dataloader: str, content: Column | None = None) -> list[Column]:
        """The thirteen ledger columns as expressions; content: the sample's raw bytes."""
        own = self.identity_column(parent)
        name = F.concat(F.lit(f"{selection}__"), own, F.lit("__"), F.substring(F.sha1(content), 1, 6), F.lit(".png")) if content is not None else F.lit(None).cast("string")
        word = lambda v: F.lit(v).cast("string")
        return [
            word(selection).alias("selection"), word(dataloader).alias("dataloader"), parent.alias("parent_id"), own.alias("id"),
            word(self.algorithm).alias("algorithm"), word(self.family).alias("family"), word(self.arity).alias("arity"), F.lit(self.reversible).alias("reversible"),
            word(self.params_json).alias("params"), F.lit(self.seed).cast("long").alias("seed"), word(self.tool_model).alias("tool_model"), word(self.target_model).alias("target_model"), name.alias("artifact"),
        ]


def hashed(before: Column, text: Column, after: Column) -> Column:
    return F.substring(F.sha1(F.concat(before, text, after).cast("binary")), 1, 12)


FIELDS = {"algorithm": "string", "family": "string", "arity": "string", "reversible": "boolean", "params": "string", "seed": "long", "tool_model": "string", "target_model": "string"}


def identified(df: DataFrame, recipes: list[Recipe], parent: Column, fields=tuple(FIELDS), **more: list) -> DataFrame:
    """A row for every parent and recipe: ``parent_id``, ``id``, a recipe's ledger fields and ``more`` (a value for each recipe).

    The parent's JSON text is made once a row, not once a recipe.
    """
    made = []
    for k, r in enumerate(recipes):
        before, after = r.around()
        own = [F.lit(r.params_json if c == "params" else getattr(r, c)).cast(FIELDS[c]).alias(c) for c in fields]
        made.append(F.struct(hashed(F.lit(before), F.col("_text"), F.lit(after)).alias("id"), *own, *[F.lit(values[k]).alias(name) for name, values in more.items()]))
    rows = df.select(parent.cast("string").alias("parent_id")).withColumn("_text", json_text(F.col("parent_id")))
    return rows.select("parent_id", F.explode(F.array(*made)).alias("r")).select("parent_id", "r.*")


def json_text(value: Column) -> Column:
    """A string as the JSON text that Python writes: all but printable ASCII is escaped."""

    def escaped(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        unit = lambda at: F.concat(F.lit("\\u"), F.substring(units, at, 4))
        out = F.when(c.rlike(r"[ !#-\[\]-~]"), c)
        for raw, short in (('"', '"'), ("\\", "\\"), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
            out = out.when(c == raw, "\\" + short)
        return out.when(F.length(units) > 4, F.concat(unit(1), unit(5))).otherwise(unit(1))

    others = F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.concat(F.lit('"'), F.when(value.rlike(r"^[ !#-\[\]-~]*\z"), value).otherwise(others), F.lit('"'))


def artifact_name(selection: str, identity: str, pixels: np.ndarray) -> str:
    return f"{selection}__{identity}__{hashlib.sha1(np.ascontiguousarray(pixels).tobytes()).hexdigest()[:6]}.png"
