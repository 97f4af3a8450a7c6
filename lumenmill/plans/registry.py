"""Registered queries of the engine and the SQL they are held against.

Vectors of ``embeddings`` serve as one-dimensional samples (native expressions)
and, scaled to bytes, as 4 x 4 RGBA frames (kernels).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.matching import include_exclude
from ..functions.ranks import row_index
from ..functions.recipes import Recipe, identified
from ..operators.catalogue import CATALOGUE
from ..operators.transformations import Transformation, entries
from ..sources import parquet
from ..streaming.files import stream_ledger
from . import analytics, pixels
from .config import parse
from .job import LEDGER, RANGE, ledger_of, staged

QUERIES, ORACLES = {}, {}
FLIP = Recipe("horizontal_flip", reversible=True)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _text(a):
    """An array as text: components rounded, so both engines print alike."""
    return F.array_join(F.transform(a, lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")


def _sql_text(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',')"


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("x"))


X = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


def _recipe_sql(r: Recipe, parent: str = "CAST(vec_id AS VARCHAR)") -> str:
    before, after = r._json("@@").split('"@@"')
    return f"substr(sha1('{before}\"' || {parent} || '\"{after}'), 1, 12)"


def _identified(spark, sf_dir, r: Recipe) -> DataFrame:
    return _vectors(spark, sf_dir).select(r.identity_column(F.col("vec_id").cast("string")).alias("id"), F.col("vec_id").cast("string").alias("parent_id"), "x", "label")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Select vectors by label, flip them, and write their ledger rows beside them."""
    rows = _vectors(spark, sf_dir).filter(F.col("label").isin(1, 2))
    out = arrays.flip(F.col("x"))
    return rows.select(*FLIP.columns(F.col("vec_id").cast("string"), "embeddings", "embeddings"), _text(out).alias("sample"))


def _ledger_sql(r: Recipe, where: str = "") -> str:
    quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"""SELECT 'embeddings' AS selection, 'embeddings' AS dataloader, CAST(vec_id AS VARCHAR) AS parent_id, {_recipe_sql(r)} AS id,
        {quoted(r.algorithm)} AS algorithm, {quoted(r.family)} AS family, 'unary' AS arity, {str(r.reversible).lower()} AS reversible, {quoted(r.params_json)} AS params,
        CAST({'NULL' if r.seed is None else r.seed} AS BIGINT) AS seed, CAST(NULL AS VARCHAR) AS tool_model, CAST(NULL AS VARCHAR) AS target_model, CAST(NULL AS VARCHAR) AS artifact FROM embeddings {where}"""


ORACLES["flip_selected_vectors"] = f"SELECT l.*, s.sample FROM ({_ledger_sql(FLIP, 'WHERE label IN (1, 2)')}) l JOIN (SELECT CAST(vec_id AS VARCHAR) AS p, {_sql_text(f'list_reverse({X})')} AS sample FROM embeddings) s ON l.parent_id = s.p"
QUERIES["flip_selected_vectors"] = flagship


# --- scans, filters, projections, casts ---------------------------------------------


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr')")
def scan_filter_isin(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter(parquet.filter_condition([{"column": "lang", "values": ["de", "fr"]}])).select("doc_id", "lang", "source")


@query("SELECT doc_id, source FROM documents WHERE source GLOB 'src1*' OR source GLOB '*[57]'")
def scan_filter_wildcard(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter(parquet.filter_condition([{"column": "source", "values": ["src1*", "*[57]"]}])).select("doc_id", "source")


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 7")
def scan_filter_equal(spark, sf_dir):
    return _table(spark, sf_dir, "part").filter(parquet.filter_condition([{"column": "p_size", "values": 7}])).select("p_partkey", "p_size")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND source GLOB 'src?'")
def filter_conjunction(spark, sf_dir):
    filters = [{"column": "lang", "values": ["de"]}, {"column": "source", "values": ["src?"]}, {"column": "lang", "values": ["en", "es"]}]
    return _table(spark, sf_dir, "documents").filter(parquet.filter_condition(filters)).select("doc_id")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part")
def cast_in_place(spark, sf_dir):
    return parquet.cast_columns(_table(spark, sf_dir, "part"), [{"column": "p_size", "to_type": "int64", "in_place": True}]).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size, CAST(p_size AS VARCHAR) AS p_size_str, CAST(p_size AS DOUBLE) AS p_size_float64, CAST(p_size AS BOOLEAN) AS p_size_bool FROM part")
def cast_append(spark, sf_dir):
    casts = [{"column": "p_size", "to_type": t} for t in ("str", "float64", "bool")] + [{"column": "absent", "to_type": "str"}]
    return parquet.cast_columns(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), casts)


@query("SELECT p_partkey, p_type FROM part")
def include_exclude_columns(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.select(*include_exclude(["p_*"], ["p_name", "p_brand", "p_size", "p_ret*"], part.columns))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_index_id(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.lit("all").alias("_file"), F.col("o_orderkey").alias("_row"))
    return row_index(rows, "_file", "_row", "row_id", width=1000).select("o_orderkey", "row_id")


@query("SELECT count(*) AS n_rows, CAST(ceil(count(*) / 100.0) AS BIGINT) AS n_batches FROM documents")
def source_counts(spark, sf_dir):
    n = F.count("*")
    return _table(spark, sf_dir, "documents").agg(n.alias("n_rows"), F.ceil(n / 100).alias("n_batches"))


# --- identity, sweeps, ledger --------------------------------------------------------


CROP = Recipe("crop_resize", params={"fraction": 0.5, "top": 0, "left": 16})


@query(f"SELECT vec_id, {_recipe_sql(CROP)} AS id FROM embeddings")
def recipe_id(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", CROP.identity_column(F.col("vec_id").cast("string")).alias("id"))


def _swept(sweep: dict) -> list[Transformation]:
    return entries({"type": "crop_resize", "name": "grid", **sweep})


def _swept_ids(spark, sf_dir, sweep: dict) -> DataFrame:
    made = _swept(sweep)
    rows = identified(_table(spark, sf_dir, "embeddings"), [t.recipe for t in made], F.col("vec_id"), ["params"], name=[t.name for t in made])
    return rows.select(F.col("parent_id").cast("long").alias("vec_id"), "name", "params", "id")


def _swept_sql(fractions: list[float], lefts: list[int] | None = None) -> str:
    parts = []
    for f in fractions:
        for left in lefts or [None]:
            r = Recipe("crop_resize", params={"fraction": f, "top": 0, "left": left or 0})
            name = f"grid__{f}" + (f"_{left}" if left is not None else "")
            parts.append(f"SELECT vec_id, '{name}' AS name, '{r.params_json}' AS params, {_recipe_sql(r)} AS id FROM embeddings")
    return " UNION ALL ".join(parts)


@query(_swept_sql([0.2, 0.5, 0.8]))
def sweep_even(spark, sf_dir):
    return _swept_ids(spark, sf_dir, {"fraction": {"range": [0.2, 0.8], "samples": 3}})


@query(_swept_sql([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]))
def sweep_step(spark, sf_dir):
    return _swept_ids(spark, sf_dir, {"fraction": {"range": [0.1, 0.7], "step": 0.1}})


@query(_swept_sql([0.25, 0.5], [0, 8, 16]))
def sweep_cartesian(spark, sf_dir):
    return _swept_ids(spark, sf_dir, {"fraction": {"range": [0.25, 0.5], "samples": 2}, "left": {"range": [0, 16], "step": 8}})


# Four uniform draws of seed 42 over 0.2..0.9, rounded as a sweep's values are.
@query(_swept_sql([0.74, 0.51, 0.8, 0.69]))
def sweep_random(spark, sf_dir):
    return _swept_ids(spark, sf_dir, {"fraction": {"range": [0.2, 0.9], "samples": 4, "mode": "random"}})


@query(f"{_ledger_sql(FLIP)} UNION ALL {_ledger_sql(CROP)}")
def ledger_13_columns(spark, sf_dir):
    return stream_ledger(_table(spark, sf_dir, "embeddings"), [FLIP, CROP], "vec_id", "embeddings")


@query("SELECT vec_id, CAST(json_extract(p, '$.fraction') AS DOUBLE) AS fraction FROM (SELECT vec_id, '" + CROP.params_json + "' AS p FROM embeddings)")
def params_json_field(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.get_json_object(F.lit(CROP.params_json), "$.fraction").cast("double").alias("fraction"))


# --- array forms of transformations ----------------------------------------------------


def _mapped(spark, sf_dir, out) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _text(out(F.col("x"))).alias("sample"))


def _mapped_sql(expression: str) -> str:
    return f"SELECT vec_id, {_sql_text(expression)} AS sample FROM (SELECT vec_id, {X} AS x FROM embeddings)"


@query(_mapped_sql("list_reverse(x)"))
def flip_vector(spark, sf_dir):
    return _mapped(spark, sf_dir, arrays.flip)


@query(_mapped_sql("x"))
def flip_involution(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda x: arrays.flip(arrays.flip(x)))


@query(_mapped_sql("list_transform(range(len(x)), lambda i: x[i * greatest(1, CAST(floor(len(x) * 0.4) AS INT)) // len(x) + 9])"))
def crop_resize_vector(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda x: arrays.crop_resize(x, 0.4, left=8))


@query(_mapped_sql("list_transform(range(len(x)), lambda i: CASE WHEN i >= 8 AND i < 24 THEN 0.0 ELSE x[i + 1] END)"))
def inpaint_region_vector(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda x: arrays.mask_region(x, 8, 16))


@query(_mapped_sql("list_transform(range(len(x)), lambda i: greatest(-1.0, least(1.0, x[i + 1] + 0.1 * sign(list_reverse(x)[i + 1]))))"))
def fgsm_vector(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda x: arrays.signed_step(x, F.reverse(x), 0.1))


@query(_mapped_sql("list_transform(x, lambda v: 1.0 - v)"))
def invert_vector(spark, sf_dir):
    return _mapped(spark, sf_dir, arrays.invert)


@query(_mapped_sql("list_transform(x, lambda v: CASE WHEN v < 0.1 THEN v ELSE 1.0 - v END)"))
def solarize_vector(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda x: arrays.solarize(x, 0.1))


BYTES = "list_transform(x, lambda v: CAST(floor((v + 1.0) / 2.0 * 255 + 0.5) AS INT))"


@query(_mapped_sql(f"list_transform({BYTES}, lambda v: v & 240)"))
def posterize_vector(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda x: arrays.posterize(arrays.to_bytes(x), 4))


@query(_mapped_sql("list_transform(x, lambda v: pow((v + 1.0) / 2.0, 1.25))"))
def gamma_vector(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda x: arrays.gamma(F.transform(x, lambda v: (v + 1.0) / 2.0), 1.25))


@query(_mapped_sql("list_transform(x, lambda v: greatest(-1.0, least(1.0, v * 1.5 + 0.25)))"))
def brightness_contrast_vector(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda x: arrays.clip(arrays.brightness_contrast(x, 1.5, 0.25), -1.0, 1.0))


@query(f"SELECT vec_id, list_min(x) < -0.3 AS below, list_max(x) > 0.3 AS above FROM (SELECT vec_id, {X} AS x FROM embeddings)")
def range_violations(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", (F.array_min("x") < -0.3).alias("below"), (F.array_max("x") > 0.3).alias("above"))


# --- joins and aggregates over ledgers -----------------------------------------------------


@query(f"SELECT {_recipe_sql(CROP)} AS id, vec_id, label FROM embeddings WHERE label IS NOT NULL")
def lineage_join(spark, sf_dir):
    ledger, source = ledger_13_columns(spark, sf_dir).filter("algorithm = 'crop_resize'"), _table(spark, sf_dir, "embeddings").filter("label is not null")
    return analytics.lineage(ledger, source, "vec_id").select("id", "vec_id", "label")


@query("SELECT 'embeddings' AS selection, 2 * count(*) AS outputs, 2 * count(DISTINCT vec_id) AS ids, count(DISTINCT vec_id) AS parents FROM embeddings")
def job_summary(spark, sf_dir):
    return analytics.summary(ledger_13_columns(spark, sf_dir))


@query("SELECT a AS algorithm, count(*) AS n FROM embeddings, (VALUES ('horizontal_flip'), ('crop_resize')) t(a) GROUP BY a")
def rows_per_algorithm(spark, sf_dir):
    return ledger_13_columns(spark, sf_dir).groupBy("algorithm").agg(F.count("*").alias("n"))


@query("SELECT CAST(vec_id AS VARCHAR) AS parent_id, 2 AS outputs FROM embeddings")
def outputs_by_parent(spark, sf_dir):
    return ledger_13_columns(spark, sf_dir).groupBy("parent_id").agg(F.count("id").cast("int").alias("outputs"))


@query(f"SELECT count(*) AS common FROM (SELECT {_recipe_sql(FLIP)} AS id FROM embeddings WHERE label IN (1, 2)) a JOIN (SELECT {_recipe_sql(FLIP)} AS id FROM embeddings WHERE label IN (2, 3)) b USING (id)")
def common_ids(spark, sf_dir):
    one, two = (_identified(spark, sf_dir, FLIP).filter(F.col("label").isin(*k)) for k in ((1, 2), (2, 3)))
    return one.select("id").join(two.select("id"), "id").agg(F.count("*").alias("common"))


@query("SELECT count(*) AS total, count_if(n_chars < 500) AS failed, count_if(n_chars < 500) / count(*) AS rate FROM documents")
def failure_rate(spark, sf_dir):
    return analytics.failure_rate(_table(spark, sf_dir, "documents"), F.col("n_chars") < 500)


@query(f"""WITH d AS (SELECT vec_id, list_transform(range(len(x)), lambda i: list_reverse(x)[i + 1] - x[i + 1]) AS d FROM (SELECT vec_id, {X} AS x FROM embeddings)),
    m AS (SELECT vec_id, d, list_sum(list_transform(d, lambda v: v * v)) AS s FROM d)
    SELECT vec_id, round(list_max(list_transform(d, lambda v: abs(v))), 6) AS delta_max, round(sqrt(s), 6) AS delta_2, round(s / len(d), 6) AS mse, round(CASE WHEN s > 0 THEN 10 * log10(1.0 / (s / len(d))) END, 5) AS psnr FROM m""")
def displacement_metrics(spark, sf_dir):
    columns = analytics.displacement(F.col("x"), arrays.flip(F.col("x")))
    return _vectors(spark, sf_dir).select("vec_id", *[F.round(c, 5 if k == "psnr" else 6).alias(k) for k, c in columns.items()])


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
    SELECT event_type, n, round((s[(n - 1) // 2 + 1] + s[n // 2 + 1]) / 2, 6) AS median, round(s[3 * n // 4 + 1] - s[n // 4 + 1], 6) AS iqr, round(s[1], 6) AS least, round(s[n], 6) AS most FROM s""")
def timing_iqr(spark, sf_dir):
    out = analytics.spread(_table(spark, sf_dir, "events").filter("value is not null"), ["event_type"], "value")
    return out.select("event_type", F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("median", "iqr", "least", "most")])


@query(f"SELECT {_recipe_sql(FLIP)} AS id, CAST(vec_id AS VARCHAR) AS parent_id FROM embeddings ORDER BY 1 LIMIT 1")
def smallest_id(spark, sf_dir):
    return _identified(spark, sf_dir, FLIP).select("id", "parent_id").orderBy("id").limit(1)


@query("SELECT 'documents' AS selection, CAST(doc_id AS VARCHAR) AS parent_id FROM documents WHERE lang = 'de' UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 10")
def union_selections(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter("lang = 'de'").select(F.lit("documents").alias("selection"), F.col("doc_id").cast("string").alias("parent_id"))
    parts = _table(spark, sf_dir, "part").filter("p_size < 10").select(F.lit("part").alias("selection"), F.col("p_partkey").cast("string").alias("parent_id"))
    return docs.unionByName(parts)


# How many catalogue transformations each family has.
@query("SELECT f AS family, n * (SELECT count(*) FROM embeddings) AS outputs FROM (VALUES ('geometric', 21), ('color', 21), ('blur', 10), ('dropout', 7), ('noise', 6), ('weather', 6), ('dihedral', 3), ('compression', 2)) t(f, n)")
def family_counts(spark, sf_dir):
    families = spark.createDataFrame([(e.name, e.family) for e in CATALOGUE.values()], "algorithm string, family string")
    made = catalogue_ids(spark, sf_dir).groupBy("algorithm").agg(F.count("*").alias("n"))
    return made.join(F.broadcast(families), "algorithm").groupBy("family").agg(F.sum("n").alias("outputs"))


@query("""WITH s AS (SELECT o_orderpriority AS scenario, list_sort(list(o_totalprice)) AS s, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1)
    SELECT scenario, n, round((s[(n - 1) // 2 + 1] + s[n // 2 + 1]) / 2, 4) AS median, round(s[3 * n // 4 + 1] - s[n // 4 + 1], 4) AS iqr FROM s""")
def memory_iqr(spark, sf_dir):
    """Median and quartile range of a measure by scenario, as of peak memory."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scenario"), F.col("o_totalprice").cast("double").alias("v"))
    return analytics.spread(rows, ["scenario"], "v").select("scenario", F.col("n").cast("long").alias("n"), F.round("median", 4).alias("median"), F.round("iqr", 4).alias("iqr"))


# --- kernels over 4 x 4 frames ----------------------------------------------------------------


def framed(spark: SparkSession, sf_dir: str, transformations: list[Transformation], side: int = 4) -> DataFrame:
    """Ledger rows of all transformations of all vectors, taken as side x side RGBA frames."""
    import numpy as np

    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), arrays.to_bytes(arrays.doubles(F.col("embedding"))).alias("x"))

    def run(batches):
        from ..functions.recipes import artifact_name

        for b in batches:
            for start in range(0, b.num_rows, 64):
                out = []
                for parent, x in zip(b.column(0).slice(start, 64).to_pylist(), b.column(1).slice(start, 64).to_pylist(), strict=True):
                    image = np.array(x, np.uint8).reshape(side, side, 4)
                    for t in transformations:
                        r, own = t.recipe, t.recipe.identity(parent)
                        made = t.apply(image, parent, RANGE)
                        out.append(("embeddings", "embeddings", parent, own, r.algorithm, r.family, r.arity, r.reversible, r.params_json, r.seed, r.tool_model, r.target_model, artifact_name("embeddings", own, made)))
                yield pa.RecordBatch.from_pylist([dict(zip(LEDGER.names, row, strict=True)) for row in out], schema=pa.schema([(f.name, {"long": pa.int64(), "boolean": pa.bool_()}.get(f.dataType.typeName(), pa.string())) for f in LEDGER]))

    return rows.mapInArrow(run, LEDGER)


#: Values for the catalogue's required parameters on small frames.
SMALL = {"height": 3, "width": 3, "num_grid_xy": [2, 2], "magnitude": 1, "size": 3, "min_max_height": [2, 3]}


def small_entry(name: str, seed: int = 7) -> dict:
    given = {q.name: SMALL[q.name] for q in CATALOGUE[name].parameters if q.required}
    if name == "crop":
        given |= {"x_max": 3, "y_max": 3}
    if name == "pad_if_needed":
        given |= {"min_height": 6, "min_width": 6}
    return {"type": name, "seed": seed, **given}


def _byte_flip_sql() -> str:
    r = FLIP
    hexed = "array_to_string(list_transform(b, lambda v: printf('%02x', v)), '')"
    flipped = "list_transform(range(64), lambda i: b[(i // 16) * 16 + (3 - (i // 4) % 4) * 4 + i % 4 + 1])"
    return f"SELECT CAST(vec_id AS VARCHAR) AS parent_id, {_recipe_sql(r)} AS id, 'embeddings__' || {_recipe_sql(r)} || '__' || substr(sha1(unhex({hexed.replace('(b,', f'({flipped},')})), 1, 6) || '.png' AS artifact FROM (SELECT vec_id, {BYTES} AS b FROM (SELECT vec_id, {X} AS x FROM embeddings))"


@query(_byte_flip_sql())
def frame_flip_artifacts(spark, sf_dir):
    return framed(spark, sf_dir, entries({"type": "horizontal_flip"})).select("parent_id", "id", "artifact")


@query()
def catalogue_frames(spark, sf_dir):
    """Every catalogue transformation of every frame (stochastic: rows and replay are tested)."""
    return framed(spark, sf_dir, [t for name in sorted(CATALOGUE) for t in entries(small_entry(name))])


FRAMES = f"SELECT CAST(vec_id AS VARCHAR) AS parent_id, {BYTES} AS b FROM (SELECT vec_id, {X} AS x FROM embeddings)"


@query(pixels.sql(FRAMES))
def catalogue_pixels(spark, sf_dir):
    """Pixels of the catalogue with pinned parameters, every frame and case."""
    import numpy as np

    made = [(k, name, entries(pixels.entry(name, given))[0]) for k, (name, given, _) in enumerate(pixels.CASES)]
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string"), arrays.to_bytes(arrays.doubles(F.col("embedding"))).alias("x"))
    schema = pa.schema([("parent_id", pa.string()), ("number", pa.int32()), ("algorithm", pa.string()), ("pixels", pa.string())])

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 64):
                out = []
                for parent, x in zip(b.column(0).slice(start, 64).to_pylist(), b.column(1).slice(start, 64).to_pylist(), strict=True):
                    frame = np.array(x, np.uint8).reshape(4, 4, 4)
                    out += [(parent, k, name, ",".join(map(str, t.apply(frame, parent, RANGE).ravel().tolist()))) for k, name, t in made]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "parent_id string, number int, algorithm string, pixels string")


# --- a whole job ------------------------------------------------------------------------------


class Middle:
    """A target model whose loss grows away from mid-grey."""

    name = "middle"

    def grad(self, xs):
        return xs - 0.5


JOB = {
    "dataloaders": {"loaders": [{"type": "parquet", "name": "frames", "path": "-", "id_column": "vec_id", "sample_path": [{"column": "img"}], "image_shape": [4, 4], "filters": [{"column": "label", "values": [1, 2, 3]}], "transform": [{"column": "label", "to_type": "str"}]}]},
    "models": {"fill": {"type": "border_fill"}, "mid": {"type": "python", "module": "lumenmill.plans.registry", "export": "Middle"}},
    "operations": {
        "outputs": {"path": "-", "samples_dir": "-", "write_samples": False, "include": ["label*"]},
        "transformations": [
            {"type": "horizontal_flip"},
            {"type": "crop_resize", "fraction": 0.5, "left": 1},
            {"type": "inpaint", "tool_model": "fill", "top": 1, "left": 1, "height": 2, "width": 2},
            {"type": "fgsm", "target_model": "mid", "epsilon": 0.1},
        ],
    },
}
RING = pixels.total([pixels.at(str(y), str(x)) for y in range(4) for x in range(4) if y in (0, 3) or x in (0, 3)])
#: recipe and pixels of each transformation of the job
MADE = [
    (FLIP, pixels.at(x="3 - x")),
    (Recipe("crop_resize", params={"fraction": 0.5, "top": 0, "left": 1}), pixels.at("y // 2", "1 + x // 2")),
    (Recipe("inpaint", "generative", params={"top": 1, "left": 1, "height": 2, "width": 2}, tool_model="border_fill"), f"CASE WHEN x IN (1, 2) AND y IN (1, 2) AND c < 3 THEN {pixels.near(RING + ' / 12e0')} ELSE {pixels.V} END"),
    (Recipe("fgsm", "adversarial", params={"epsilon": 0.1}, target_model="middle"), pixels.near(f"255 * greatest(0e0, least(1e0, {pixels.V} / 255e0 + 0.1e0 * sign({pixels.V} / 255e0 - 0.5e0)))")),
]


def _job_sql() -> str:
    quoted = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"
    parts = []
    for r, value in MADE:
        own, content = _recipe_sql(r, "parent_id"), f"unhex(array_to_string(list_transform({pixels.placed(value)}, lambda v: printf('%02x', v)), ''))"
        parts.append(f"""SELECT 'frames' AS selection, 'frames' AS dataloader, parent_id, {own} AS id, {quoted(r.algorithm)} AS algorithm, {quoted(r.family)} AS family, 'unary' AS arity,
            {str(r.reversible).lower()} AS reversible, {quoted(r.params_json)} AS params, CAST(NULL AS BIGINT) AS seed, {quoted(r.tool_model)} AS tool_model, {quoted(r.target_model)} AS target_model,
            'frames__' || {own} || '__' || substr(sha1({content}), 1, 6) || '.png' AS artifact, label, CAST(label AS VARCHAR) AS label_str FROM frames""")
    return f"WITH frames AS (SELECT CAST(vec_id AS VARCHAR) AS parent_id, label, {BYTES} AS b FROM (SELECT vec_id, label, {X} AS x FROM embeddings WHERE label IN (1, 2, 3))) " + " UNION ALL ".join(parts)


def _packed(b):
    """Numbers 0..255 as binary."""
    return F.unhex(F.array_join(F.transform(b, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


@query(_job_sql())
def job_ledger(spark, sf_dir):
    """A job from its configuration to its ledger: filter, cast, decode, every role of model, pass-through."""
    job = parse(JOB)
    loader = job.loaders[0]
    source = _table(spark, sf_dir, "embeddings").select("vec_id", "label", _packed(arrays.to_bytes(arrays.doubles(F.col("embedding")))).alias("img"), F.lit("embeddings").alias("_file"), F.col("vec_id").cast("long").alias("_row"))
    return ledger_of(*staged(spark, job, loader, source=parquet.prepared(source, loader)))


def _payload_sql() -> str:
    content = f"unhex(array_to_string(list_transform({pixels.placed(pixels.at(x='3 - x'))}, lambda v: printf('%02x', v)), ''))"
    return f"WITH frames AS ({FRAMES}) SELECT {_recipe_sql(FLIP, 'parent_id')} AS id, parent_id, sha256({content}) AS payload_sha256 FROM frames"


@query(_payload_sql())
def payload_join(spark, sf_dir):
    """Each ledger row with its payload, met by the artifact's name."""
    b = arrays.to_bytes(arrays.doubles(F.col("embedding")))
    flipped = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(F.col("b"), i + 12 - 8 * F.floor(i / 4).cast("int") % 32))
    parent = F.col("vec_id").cast("string")
    payload = _table(spark, sf_dir, "embeddings").select(parent.alias("p"), FLIP.identity_column(parent).alias("own"), b.alias("b")).select("own", _packed(flipped).alias("content"))
    payload = payload.select(F.concat(F.lit("embeddings__"), "own", F.lit("__"), F.substring(F.sha1("content"), 1, 6), F.lit(".png")).alias("artifact"), "content")
    return frame_flip_artifacts(spark, sf_dir).join(payload, "artifact").select("id", "parent_id", F.sha2("content", 256).alias("payload_sha256"))


def _catalogue_ids_sql() -> str:
    parts = [f"SELECT CAST(vec_id AS VARCHAR) AS parent_id, '{name}' AS algorithm, {_recipe_sql(entries(small_entry(name))[0].recipe)} AS id FROM embeddings" for name in sorted(CATALOGUE)]
    return " UNION ALL ".join(parts)


@query(_catalogue_ids_sql())
def catalogue_ids(spark, sf_dir):
    recipes = [entries(small_entry(name))[0].recipe for name in sorted(CATALOGUE)]
    return identified(_table(spark, sf_dir, "embeddings"), recipes, F.col("vec_id"), ["algorithm"])


def parameters_table() -> list[tuple[str, str]]:
    return [(name, json.dumps(entries(small_entry(name))[0].recipe.params, sort_keys=True)) for name in sorted(CATALOGUE)]
