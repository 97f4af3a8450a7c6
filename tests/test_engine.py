import hashlib
import json
import os

import numpy as np
import pytest

from lumenmill.functions import sweeps
from lumenmill.functions.codec import decode_png, encode_png
from lumenmill.functions.matching import include_exclude, resolve_patterns
from lumenmill.functions.recipes import Recipe
from lumenmill.operators import models
from lumenmill.operators.catalogue import CATALOGUE
from lumenmill.operators.transformations import Algorithm, Batch, entries, fgsm_step, register_transformation, resize_back, run_batch
from lumenmill.plans.config import merged_errors, parse
from lumenmill.plans.job import LEDGER, payload_table, run_job
from lumenmill.plans.registry import SMALL, small_entry

from .conftest import job


def one(entry, **more):
    return entries(entry, **more)[0]


# --- identity ------------------------------------------------------------------


def test_identity_is_sha1_of_sorted_json():
    r = Recipe("crop_resize", params={"fraction": 0.5, "left": 0, "top": 0})
    fields = {"parent_id": "a", "algorithm": "crop_resize", "family": "procedural", "arity": "unary", "reversible": False, "params": r.params, "seed": None, "tool_model": None, "target_model": None}
    assert r.identity("a") == hashlib.sha1(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:12]


@pytest.mark.parametrize("parent", ["7", 'qu"ote', "back\\slash", "tab\there", ""])
def test_identity_column_equals_python(spark, parent):
    from pyspark.sql import functions as F

    r = Recipe("gaussian_blur", params={"p": 1.0, "sigma_limit": [0.5, 1e-05]}, seed=3)
    assert spark.createDataFrame([(parent,)], "p string").select(r.identity_column(F.col("p"))).first()[0] == r.identity(parent)


def test_generator_depends_on_seed_params_and_parent():
    r = Recipe("x", params={"a": 1}, seed=1)
    draw = lambda r, k: r.generator(k).random()
    assert draw(r, "a") == draw(r, "a") != draw(r, "b")
    assert draw(Recipe("x", params={"a": 2}, seed=1), "a") != draw(r, "a")
    assert Recipe("x").generator("a") is None


# --- sweeps ----------------------------------------------------------------------


def test_sweep_values():
    value = lambda **k: sweeps.Sweep.parse(k).values(42)
    assert value(range=[0.2, 0.8], samples=3) == [0.2, 0.5, 0.8]
    assert value(range=[0.1, 0.7], step=0.1) == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
    assert value(range=[0, 0.3], step=0.1) == [0.0, 0.1, 0.2]
    assert value(range=[0, 1], samples=2, mode="random") == [round(v, 2) for v in np.random.default_rng(42).uniform(0, 1, 2)]


@pytest.mark.parametrize("bad", [{"range": [0, 1]}, {"range": [1, 0], "samples": 2}, {"range": [0, 1], "samples": 2, "step": 0.1}, {"range": [0, 1], "samples": 2, "mode": "odd"}])
def test_sweep_refusals(bad):
    with pytest.raises(ValueError):
        sweeps.Sweep.parse(bad)


def test_sweep_expands_in_field_order_and_keeps_whole_numbers_whole():
    out = entries({"type": "crop_resize", "name": "grid", "fraction": {"range": [0.25, 0.5], "samples": 2}, "left": {"range": [0, 8], "step": 8}})
    assert [t.name for t in out] == ["grid__0.25_0", "grid__0.25_8", "grid__0.5_0", "grid__0.5_8"]
    assert out[1].recipe.params == {"fraction": 0.25, "left": 8, "top": 0}
    swept = entries({"type": "elastic_transform", "seed": 1, "alpha": {"range": [0.1, 2.5], "samples": 2}})
    assert [t.recipe.params["alpha"] for t in swept] == [0, 2]


# --- validation --------------------------------------------------------------------


@pytest.mark.parametrize(
    "bad",
    [
        {"type": "nothing"},
        {"type": "horizontal_flip", "angle": 3},
        {"type": "crop_resize"},
        {"type": "crop_resize", "fraction": 0},
        {"type": "crop_resize", "fraction": 1.5},
        {"type": "crop_resize", "fraction": {"range": [0, 0.5], "samples": 2}},
        {"type": "gaussian_blur"},
        {"type": "gaussian_blur", "seed": 1, "sigma_limit": [2, 1]},
        {"type": "gaussian_blur", "seed": 1, "p": 1.5},
        {"type": "rotate", "seed": 1, "interpolation": "best"},
        {"type": "rotate", "seed": 1, "fill": {"range": [0, 1], "samples": 2}},
        {"type": "fgsm", "epsilon": 0.1},
        {"type": "fgsm", "epsilon": 0, "target_model": "m"},
    ],
)
def test_entries_refuse(bad):
    with pytest.raises(ValueError):
        entries(bad)


def test_numbers_keep_their_kind():
    p = one({"type": "elastic_transform", "seed": 1}).recipe.params
    assert (type(p["alpha"]), type(p["sigma"])) == (int, int)
    assert one({"type": "rotate", "seed": 1, "limit": 30}).recipe.params["limit"] == 30.0
    assert one({"type": "gaussian_blur", "seed": 1, "sigma_limit": [1, 2]}).recipe.params_json == '{"p": 1.0, "sigma_limit": [1.0, 2.0]}'


def test_config_refusals(tmp_path):
    good = job("x", tmp_path)
    parse(good)
    for change in ({"other": 1}, {"storage": {"type": "s3"}}, {"dataloaders": {"loaders": []}}, {"dataloaders": {"loaders": [{"type": "csv", "name": "a", "path": "b", "sample_path": [{"column": "c"}]}]}}):
        with pytest.raises(ValueError):
            parse(good | change)


def test_section_errors_override_only_what_they_set():
    out = merged_errors({"max_failure_rate": 0.5, "images": {"on_decode_failure": "fail_fast"}}, {"default": "silent_fail"})
    assert (out["max_failure_rate"], out["default"], out["images"]["on_decode_failure"]) == (0.5, "silent_fail", "fail_fast")


@pytest.mark.parametrize("errors", [{"default": "skip"}, {"images": {"on_decode_failure": "fail"}}, {"images": {"other": "fail_fast"}}, {"tabular": {"on_missing": "fail_fast"}}, {"tabular": {"on_missing_column": "nonsense"}}])
def test_error_rules_are_closed(errors):
    with pytest.raises(ValueError):
        merged_errors(errors, None)


@pytest.mark.parametrize("rule", ["silent_fail", "fail_fast"])
def test_a_null_sample_under_each_rule(spark, sources, tmp_path, rule):
    raw = spark.read.parquet(str(sources / "raw.parquet"))
    rows = raw.unionByName(raw.limit(1).selectExpr("'none' AS id", "height", "width", "source", "CAST(NULL AS BINARY) AS img"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    given = job(tmp_path / "in", tmp_path / "out") | {"errors": {"default": rule, "max_failure_rate": 0.5}}
    if rule == "fail_fast":
        with pytest.raises(Exception, match="the sample is null"):
            run_job(spark, given)
    else:
        assert run_job(spark, given) == {"synthetic": 16}


def test_identity_as_an_expression_beyond_ascii(spark):
    from pyspark.sql import functions as F

    from lumenmill.functions.recipes import Recipe

    recipe = Recipe("horizontal_flip", params={"a": "é"}, seed=3)
    names = ["a", "é", "中文 x", "🙂", 'quote " \\ / \n', "\x7f\u2028", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", recipe.identity_column(F.col("n")).alias("i")).collect()
    assert {r.n: r.i for r in got} == {n: recipe.identity(n) for n in names}


def test_patterns():
    assert resolve_patterns(["b*", "zz", "bar"], ["foo", "bar", "baz"]) == ["bar", "baz", "zz"]
    assert include_exclude([], ["a"], ["a", "b"]) == ["b"]
    assert include_exclude(["*"], ["b?"], ["a", "bb", "c"]) == ["a", "c"]


# --- kernels -------------------------------------------------------------------------


def test_png_round_trip_and_filters(tmp_path):
    x = np.random.default_rng(0).integers(0, 256, (13, 7, 4), dtype=np.uint8)
    assert (decode_png(encode_png(x)) == x).all()
    assert (decode_png(encode_png(np.ascontiguousarray(x[..., :3])))[..., 3] == 255).all()
    with pytest.raises(ValueError):
        encode_png(x[..., :2])


def test_flip_and_crop_exact():
    x = np.arange(4 * 4 * 4, dtype=np.uint8).reshape(1, 4, 4, 4)
    batch = Batch(["a"], x, (0, 255))
    (row,) = run_batch(batch, one({"type": "horizontal_flip"}))
    assert (row["x"] == x[0, :, ::-1]).all() and row["reversible"]
    (row,) = run_batch(batch, one({"type": "crop_resize", "fraction": 0.5, "top": 1, "left": 2}))
    assert (row["x"] == x[0][[1, 1, 2, 2]][:, [2, 2, 3, 3]]).all()
    with pytest.raises(ValueError):
        run_batch(batch, one({"type": "crop_resize", "fraction": 0.9, "top": 2}))


def test_flip_takes_any_sample():
    x = np.linspace(0, 1, 24).reshape(3, 8)[:, None]
    assert (run_batch(Batch(["a", "b", "c"], x, (0, 1)), one({"type": "horizontal_flip"}))[1]["x"] == x[1, :, ::-1]).all()


class Target:
    name = "stub"

    def grad(self, xs):
        out = np.zeros_like(xs)
        out[..., 0] = xs[..., 1:3].mean(axis=-1) < 0.5
        return out


class Tool:
    name, channels = "stub", 3

    def inpaint(self, xs, masks):
        out = xs.copy()
        out[..., :3][masks] = 0
        return out


def test_fgsm_step_is_exact():
    x = np.array([[[0, 100, 250]]], np.uint8)
    out = fgsm_step(x, np.array([[[-1.0, 2.0, 3.0]]]), 0.1)
    assert out.tolist() == [[[0, round(100 + 25.5), 255]]]
    with pytest.raises(ValueError):
        fgsm_step(x.astype(float), x, 0.1)


def test_model_roles(frames):
    x = np.stack(list(frames.values()))
    batch = Batch(list(frames), x, (0, 255))
    t = one({"type": "fgsm", "epsilon": 0.1, "target_model": "m"}, instances={"m": Target()})
    rows = run_batch(batch, t)
    assert rows[0]["family"] == "adversarial" and rows[0]["target_model"] == "stub" and (rows[0]["x"][..., 1:] == x[0][..., 1:]).all()
    t = one({"type": "inpaint", "top": 8, "left": 12, "height": 16, "width": 8, "tool_model": "m"}, instances={"m": Tool()})
    out = run_batch(batch, t)[0]["x"]
    assert (out[8:24, 12:20, :3] == 0).all() and (out[..., 3] == 255).all() and (out[:8] == x[0][:8]).all()
    with pytest.raises(ValueError):
        one({"type": "inpaint", "height": 1, "width": 1, "tool_model": "m"}, instances={"m": Target()})


def test_border_fill_changes_only_the_mask():
    x = np.full((1, 8, 8, 4), 9, np.uint8)
    x[0, 2:4, 2:4] = 200
    mask = np.zeros((1, 8, 8), bool)
    mask[0, 2:4, 2:4] = True
    out = models.BorderFill().inpaint(x, mask)
    assert (out[..., :3] == 9).all() and (out[0, 2:4, 2:4, 3] == 200).all()


def test_python_models(tmp_path):
    (tmp_path / "mine.py").write_text("class M:\n    def __init__(self, k=1):\n        self.k, self.name = k, 'mine'\n    def grad(self, xs):\n        return xs * 0 + self.k\n")
    refs = models.normalised({"m": {"type": "python", "path": str(tmp_path / "mine.py"), "k": 3}})
    t = one({"type": "fgsm", "epsilon": 0.1, "target_model": "m"}, references=refs)
    assert t.recipe.target_model == "mine" and models.build("m", refs["m"]).k == 3
    for bad in ({"m": {"type": "python"}}, {"m": {"type": "lost"}}, {"m": {}}, {"m": {"type": "border_fill", "margin": 1, "params": {"margin": 2}}}):
        with pytest.raises(ValueError):
            models.normalised(bad)


def test_model_output_is_checked():
    with pytest.raises(ValueError):
        models.check_output("a", np.zeros(3), (4,))
    with pytest.raises(ValueError):
        models.check_output("a", np.array([np.nan]), (1,))


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_catalogue(name):
    entry = CATALOGUE[name]
    x = np.random.default_rng(0).integers(0, 256, (3, 8, 8, 4), dtype=np.uint8)
    batch, t = Batch(["r0", "r1", "r2"], x, (0, 255)), one(small_entry(name))
    assert set(t.recipe.params) == {"p", *(q.name for q in entry.parameters)}
    rows = run_batch(batch, t)
    for row, before in zip(rows, x, strict=True):
        assert row["x"].shape == before.shape and row["x"].dtype == np.uint8
        if not entry.dual:
            assert (row["x"][..., 3] == before[..., 3]).all()
    again = run_batch(batch, one(small_entry(name)))
    assert all((a["x"] == b["x"]).all() and a["id"] == b["id"] for a, b in zip(rows, again, strict=True))
    alone = run_batch(Batch(["r1"], x[1:2], (0, 255)), t)
    assert (alone[0]["x"] == rows[1]["x"]).all()
    never = run_batch(batch, one(small_entry(name) | {"p": 0}))
    assert all((row["x"] == before).all() for row, before in zip(never, x, strict=True))
    assert run_batch(batch, one(small_entry(name, seed=8)))[0]["id"] != rows[0]["id"]


def test_seed_changes_stochastic_pixels():
    x = np.random.default_rng(0).integers(0, 256, (1, 16, 16, 4), dtype=np.uint8)
    make = lambda seed: run_batch(Batch(["a"], x, (0, 255)), one({"type": "gauss_noise", "seed": seed}))[0]["x"]
    assert (make(1) != make(2)).any()


def test_webp_is_refused_and_shapes_return():
    x = np.zeros((1, 8, 8, 4), np.uint8)
    with pytest.raises(ValueError):
        run_batch(Batch(["a"], x), one({"type": "image_compression", "seed": 1, "compression_type": "webp"}))
    assert resize_back(np.arange(4).reshape(2, 2, 1), 4, 4)[:, :, 0].tolist() == [[0, 0, 1, 1], [0, 0, 1, 1], [2, 2, 3, 3], [2, 2, 3, 3]]
    assert SMALL["height"] == 3


def test_custom_transformation_and_range():
    register_transformation(Algorithm("double_it", lambda x, rng, p, model: x * 2.0))
    batch = Batch(["a"], np.full((1, 3), 0.4), (0, 1))
    assert run_batch(batch, one({"type": "double_it"}))[0]["x"].tolist() == [0.8] * 3
    with pytest.raises(ValueError):
        run_batch(Batch(["a"], np.full((1, 3), 0.9), (0, 1)), one({"type": "double_it"}))
    with pytest.raises(ValueError):
        register_transformation(Algorithm("double_it", lambda x, rng, p, model: x))


# --- jobs ------------------------------------------------------------------------------


def read(spark, out):
    return spark.read.parquet(f"{out}/synthetic/ledger")


def test_job(spark, sources, frames, tmp_path):
    assert run_job(spark, job(sources / "raw.parquet", tmp_path, include=["*"], exclude=["source", "img"])) == {"synthetic": 16}
    ledger = read(spark, tmp_path)
    assert ledger.columns == [*LEDGER.names, "height", "width"]
    rows = ledger.collect()
    assert len({r.id for r in rows}) == 16 and [r.parent_id for r in rows[:4]] == ["syn_0000"] * 2 + ["syn_0001"] * 2
    assert {r.params for r in rows} == {"{}", '{"fraction": 0.5, "left": 0, "top": 0}'} and {r.seed for r in rows} == {None}
    files = set(os.listdir(tmp_path / "synthetic/payload"))
    assert files == {r.artifact for r in rows}
    flip = next(r for r in rows if r.algorithm == "horizontal_flip" and r.parent_id == "syn_0003")
    assert (decode_png((tmp_path / "synthetic/payload" / flip.artifact).read_bytes()) == frames["syn_0003"][:, ::-1]).all()


def test_three_column_forms_agree(spark, sources, tmp_path):
    made = []
    for name, column, prefix in (("raw", "img", None), ("relative", "path", str(sources)), ("absolute", "path", None)):
        run_job(spark, job(sources / f"{name}.parquet", tmp_path / name, column, prefix))
        made.append(sorted((r.id, r.artifact) for r in read(spark, tmp_path / name).collect()))
    assert made[0] == made[1] == made[2]


def test_results_do_not_depend_on_partitions(spark, sources, tmp_path):
    entry = [{"type": "gaussian_blur", "seed": 11}, {"type": "coarse_dropout", "seed": 5, "p": 0.5}]
    made = []
    for n in (1, 2, 8):
        path = tmp_path / f"in{n}"
        spark.read.parquet(str(sources / "raw.parquet")).repartition(n).write.parquet(str(path))
        run_job(spark, job(path, tmp_path / f"out{n}", transformations=entry), ordered=n != 2)
        made.append(sorted(map(tuple, read(spark, tmp_path / f"out{n}").collect())))
    assert made[0] == made[1] == made[2] and len(made[0]) == 16


def test_trace_only_and_empty(spark, sources, tmp_path):
    run_job(spark, job(sources / "raw.parquet", tmp_path, write_samples=False))
    assert read(spark, tmp_path).count() == 16 and not (tmp_path / "synthetic/payload").exists()
    assert run_job(spark, job(sources / "raw.parquet", tmp_path / "none", transformations=[])) == {"synthetic": 0}
    assert not (tmp_path / "none").exists()


def test_row_ids_filters_and_casts(spark, sources, tmp_path):
    loader = {"id_column": None, "filters": [{"column": "id", "values": ["syn_000[1-3]"]}], "transform": [{"column": "height", "to_type": "float64"}]}
    run_job(spark, job(sources / "raw.parquet", tmp_path, loader=loader, include=["height*"], transformations=[{"type": "horizontal_flip"}]))
    rows = read(spark, tmp_path).collect()
    assert [r.parent_id for r in rows] == ["0", "1", "2"] and rows[0].height_float64 == 32.0


def test_casts_refuse_lost_fractions(spark):
    from pyspark.errors import PySparkException

    from lumenmill.sources.parquet import cast_columns

    df = spark.createDataFrame([(1.5,)], "x double")
    with pytest.raises(PySparkException):
        cast_columns(df, [{"column": "x", "to_type": "int32", "in_place": True}]).collect()


def test_failures_are_counted_and_gated(spark, frames, tmp_path):
    rows = [(k, 32, 32, bytearray(x.tobytes())) for k, x in frames.items()] + [("null", 32, 32, None), ("short", 32, 32, bytearray(b"abc"))]
    path = str(tmp_path / "bad.parquet")
    spark.createDataFrame(rows, "id string, height int, width int, img binary").write.parquet(path)
    with pytest.raises(RuntimeError):
        run_job(spark, job(path, tmp_path / "a"))
    assert not (tmp_path / "a/synthetic/ledger").exists()
    given = job(path, tmp_path / "b", include=["id"])
    given["errors"] = {"max_failure_rate": 0.5}
    assert run_job(spark, given) == {"synthetic": 16}
    assert all(r.id is not None for r in read(spark, tmp_path / "b").collect())


def test_payload_table(spark, sources, tmp_path):
    rows = payload_table(spark, job(sources / "raw.parquet", tmp_path)).collect()
    assert len(rows) == 16 and all(decode_png(bytes(r.png)).shape == (32, 32, 4) for r in rows)


def test_stream(spark, sources, tmp_path):
    from lumenmill.streaming.files import start

    schema = spark.read.parquet(str(sources / "raw.parquet")).schema
    start(spark, job(sources / "raw.parquet", tmp_path, write_samples=False), schema, str(tmp_path / "state")).awaitTermination()
    run_job(spark, job(sources / "raw.parquet", tmp_path / "batch", write_samples=False))
    ids = lambda p: {r.id for r in spark.read.parquet(p).collect()}
    assert ids(f"{tmp_path}/synthetic/ledger") == ids(f"{tmp_path}/batch/synthetic/ledger")


def test_cli(spark, sources, tmp_path, capsys):
    from lumenmill.cli import main

    assert main(["version"]) == 0 and main(["list"]) == 0 and main([]) == 2
    assert "gaussian_blur" in capsys.readouterr().out
    assert main(["process", "-p", str(tmp_path / "missing.yaml")]) == 1
    (tmp_path / "job.json").write_text(json.dumps(job(sources / "raw.parquet", tmp_path / "cli")))
    assert main(["process", "-p", str(tmp_path / "job.json"), "--save-config", str(tmp_path / "saved.json")]) == 0
    assert "synthetic: 16" in capsys.readouterr().out and json.loads((tmp_path / "saved.json").read_text())


# --- registered queries -------------------------------------------------------------------


def registered():
    from lumenmill.plans.registry import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", registered())
def test_query_equals_sql(spark, name):
    import duckdb

    from lumenmill.plans.registry import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}'")
    rel = con.sql(ORACLES[name])
    names = sorted(rel.columns)
    tidy = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted((tuple(tidy(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall()), key=str)
    df = QUERIES[name](spark, folder)
    got = sorted((tuple(tidy(r[c]) for c in names) for r in df.collect()), key=str)
    assert sorted(df.columns) == names and got == want
