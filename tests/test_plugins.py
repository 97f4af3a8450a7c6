"""Sources, writers and tools of a user's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmill.functions.codec import decode_png
from lumenmill.functions.sizes import memory_bytes
from lumenmill.operators.transformations import entries
from lumenmill.operators.windowed import WindowedNet, torch_script
from lumenmill.plans import writers
from lumenmill.plans.config import parse
from lumenmill.plans.job import run_job
from lumenmill.sources import loaders

from .conftest import job


def test_memory_sizes():
    assert [memory_bytes(t) for t in ("2GB", " 500Mb ", "1KB", "128B", "0.5GB", "1024", "4Gi")] == [2 << 30, 500 << 20, 1024, 128, 1 << 29, 1024, 4 << 30]
    for bad in ("", "GB", "-1GB", "2 TBs", "nan"):
        with pytest.raises(ValueError):
            memory_bytes(bad)


def test_compute_and_flush_sizes_are_checked(tmp_path):
    given = job(tmp_path, tmp_path)
    assert parse(given | {"compute": {"max_memory": "4Gi"}}).compute["max_memory"] == "4Gi"
    with pytest.raises(ValueError):
        parse(given | {"compute": {"max_memory": "much"}})
    with pytest.raises(ValueError):
        parse(job(tmp_path, tmp_path, flush_batch_size=0))


# --- a network behind a window ------------------------------------------------------


def halves(seen=None):
    def net(pixels, holes):
        if seen is not None:
            seen.append((pixels.copy(), holes.copy()))
        return np.full_like(pixels, 0.5)

    return net


def test_windowed_net_changes_only_the_holes():
    seen, rng = [], np.random.default_rng(3)
    xs, masks = rng.integers(0, 256, (2, 20, 30, 4)).astype(np.uint8), np.zeros((2, 20, 30), bool)
    masks[0, 5:7, 9], masks[1, 11, 12:14] = True, True
    before = xs.copy()
    out = WindowedNet(halves(seen), margin=2).inpaint(xs, masks)
    assert (xs == before).all() and (out[~masks] == xs[~masks]).all() and (out[..., 3] == xs[..., 3]).all()
    assert (out[masks][:, :3] == 127).all()  # bytes are cut
    (pixels, holes), = seen
    # rows 3..13 and columns 7..15 with the margin, mirrored up to 16 x 16
    assert pixels.shape == (2, 3, 16, 16) and holes.shape == (2, 1, 16, 16) and pixels.dtype == np.float32
    assert np.allclose(pixels[:, :, :11, :9], np.moveaxis(xs[:, 3:14, 7:16, :3], 3, 1) / 255)
    assert np.allclose(pixels[:, :, 11, :], pixels[:, :, 10, :]) and (holes.sum(axis=(1, 2, 3)) > 0).all()


def test_windowed_net_borders_and_refusals():
    xs, masks, seen = np.zeros((1, 5, 6, 4), np.uint8), np.zeros((1, 5, 6), bool), []
    assert (WindowedNet(halves(seen)).inpaint(xs, masks) == xs).all() and not seen
    masks[0, 0, 0] = True
    assert WindowedNet(halves(seen)).inpaint(xs, masks)[0, 0, 0].tolist() == [127, 127, 127, 0] and seen[0][0].shape == (1, 3, 8, 8)
    with pytest.raises(ValueError):
        WindowedNet(halves()).inpaint(xs[..., :2], masks)
    with pytest.raises(ValueError):
        WindowedNet(lambda p, h: p[:, :, 1:], name="short").inpaint(xs, masks)


def test_windowed_net_in_a_job(frames):
    references = {"mid": {"type": "windowed", "params": {"net": "tests.test_plugins:grey", "margin": 1}}}
    t = entries({"type": "inpaint", "tool_model": "mid", "height": 4, "width": 4}, references=references)[0]
    x = frames["syn_0001"]
    out = t.apply(x, "a", (0.0, 255.0))
    assert (out[:4, :4, :3] == 127).all() and (out[4:] == x[4:]).all() and t.recipe.tool_model == "grey"


def grey(pixels, holes):
    return np.full_like(pixels, 0.5)


def test_weights_need_torch():
    pytest.importorskip("numpy")
    try:
        import torch  # noqa: F401
    except ImportError:
        with pytest.raises(ValueError, match="torch"):
            torch_script("none.pt")


# --- sources and writers ----------------------------------------------------------------


def test_a_loader_of_ones_own(spark, sources, tmp_path):
    def read(spark, loader):
        return spark.read.parquet(f"{loader['folder']}/raw.parquet")

    loaders.register_loader("folder", loaders.Loader(read, frozenset({"folder"}), ("folder",)))
    try:
        with pytest.raises(ValueError):
            loaders.register_loader("folder", loaders.Loader(read))
        given = job("-", tmp_path / "own")
        entry = given["dataloaders"]["loaders"][0]
        del entry["path"]
        entry |= {"type": "folder", "folder": str(sources), "filters": [{"column": "id", "values": ["syn_000[0-4]"]}]}
        assert run_job(spark, given) == {"synthetic": 10}
        rows = spark.read.parquet(f"{tmp_path}/own/synthetic/ledger").collect()
        assert [r.parent_id for r in rows] == sorted(r.parent_id for r in rows)
        entry["id_column"] = None
        with pytest.raises(ValueError):
            run_job(spark, given)
        del entry["folder"]
        with pytest.raises(ValueError):
            parse(given)
    finally:
        del loaders.LOADERS["folder"]
    with pytest.raises(ValueError):
        loaders.validated({"type": "folder", "name": "a", "sample_path": [{"column": "x"}]})


class Shouting(writers.LedgerWriter):
    def add_rows(self, selection, rows):
        super().add_rows(selection, rows.withColumn("algorithm", F.upper("algorithm")))


def test_a_writer_of_ones_own_and_none(spark, sources, tmp_path, caplog, monkeypatch):
    monkeypatch.setitem(writers.WRITERS, "parquet", Shouting)
    run_job(spark, job(sources / "raw.parquet", tmp_path / "loud"))
    assert {r.algorithm for r in spark.read.parquet(f"{tmp_path}/loud/synthetic/ledger").collect()} == {"HORIZONTAL_FLIP", "CROP_RESIZE"}
    monkeypatch.delitem(writers.WRITERS, "parquet")
    monkeypatch.delitem(writers.WRITERS, "images")
    assert run_job(spark, job(sources / "raw.parquet", tmp_path / "none")) == {"synthetic": 16}
    assert not (tmp_path / "none/synthetic/ledger").exists() and not (tmp_path / "none/synthetic/payload").exists()
    assert "ledger" in caplog.text and "images" in caplog.text


def test_payload_and_samples_by_uri(spark, sources, frames, tmp_path):
    given = job(sources / "relative.parquet", tmp_path, "path", f"file://{sources}", samples_dir=f"file://{tmp_path}/{{selection}}/payload", flush_batch_size=3)
    assert run_job(spark, given) == {"synthetic": 16}
    made = list((tmp_path / "synthetic/payload").iterdir())
    ledger = {r.artifact: r.parent_id for r in spark.read.parquet(f"{tmp_path}/synthetic/ledger").filter("algorithm = 'horizontal_flip'").collect()}
    assert len(made) == 16 and all((decode_png(p.read_bytes()) == frames[ledger[p.name]][:, ::-1]).all() for p in made if p.name in ledger)
    again = {p.name: p.stat().st_mtime_ns for p in made}
    run_job(spark, given)
    assert again == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "synthetic/payload").iterdir()}


def test_all_loaders_stream_through_the_gate(spark, sources, frames, tmp_path):
    from lumenmill.streaming.files import start, start_all

    spark.createDataFrame([("null", 32, 32, "s", None), ("good", 32, 32, "s", bytearray(frames["syn_0000"].tobytes()))], "id string, height int, width int, source string, img binary").write.parquet(str(tmp_path / "bad.parquet"))
    given = job(sources / "raw.parquet", tmp_path, write_samples=False)
    given["dataloaders"]["loaders"].append(given["dataloaders"]["loaders"][0] | {"name": "second", "path": str(tmp_path / "bad.parquet")})
    schema = spark.read.parquet(str(sources / "raw.parquet")).schema
    with pytest.raises(ValueError):
        start_all(spark, given, {"synthetic": schema}, str(tmp_path / "state"))
    queries = start_all(spark, given, {"synthetic": schema, "second": schema}, str(tmp_path / "state"))
    queries["synthetic"].awaitTermination()
    with pytest.raises(Exception, match="could not be decoded"):
        queries["second"].awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/synthetic/ledger").count() == 16 and not (tmp_path / "second/ledger").exists()
    with pytest.raises(ValueError):
        start(spark, given, schema, str(tmp_path / "x"), selection="third")


def test_threads_change_nothing(frames):
    import pyarrow as pa

    from lumenmill.operators.transformations import entries as made
    from lumenmill.plans.config import merged_errors
    from lumenmill.plans.job import kernel

    big = np.random.default_rng(1).integers(0, 256, (600, 500, 4)).astype(np.uint8)
    given = [made({"type": n, "seed": 3})[0] for n in ("gaussian_blur", "d4", "random_fog", "elastic_transform", "posterize")]
    given += made({"type": "inpaint", "tool_model": "fill", "height": 4, "width": 4}, references={"fill": {"type": "border_fill", "params": {}}})
    loader = {"name": "a", "sample_path": [{"column": "img"}], "image_shape": None}
    rows = pa.RecordBatch.from_pylist([{"_id": str(k), "_sample": x.tobytes(), "_height": x.shape[0], "_width": x.shape[1], "_file": "f", "_row": k} for k, x in enumerate((big, frames["syn_0000"], big[::-1]))])
    out = [[b.to_pylist() for b in kernel("a", loader, given, writers.OutputWriter("none"), merged_errors(None, None), True, n)([rows])] for n in (1, 3)]
    assert out[0] == out[1] and len(out[0][0]) == 3 * (len(given) + 1)
    errors = merged_errors({"images": {"on_transform_error": "silent_fail"}}, None)
    wrong = [made({"type": "crop_resize", "fraction": 0.5, "top": 550})[0], *given[:2]]
    out = [[b.to_pylist() for b in kernel("a", loader, wrong, writers.OutputWriter("none"), errors, True, n)([rows])] for n in (1, 3)]
    assert out[0] == out[1] and [r["_t"] for r in out[0][0]].count(-2) == 3
    with pytest.raises(ValueError):
        list(kernel("a", loader, wrong, writers.OutputWriter("none"), merged_errors(None, None), True, 3)([rows]))


@pytest.mark.parametrize("shape", [(5, 7, 3), (40, 30, 3), (3, 3, 1), (90, 40, 2), (1, 1, 4)])
@pytest.mark.parametrize("n", [1, 3, 4, 7, 21])
@pytest.mark.parametrize("axis", [0, 1])
def test_band_products_equal_sums(shape, n, axis):
    from lumenmill.operators.kernels import along

    rng = np.random.default_rng(n)
    x, taps = rng.integers(0, 256, shape).astype(np.uint8), rng.random(n)
    mode = "reflect" if min(shape[:2]) > n // 2 else "symmetric"
    pad = [(0, 0)] * 3
    pad[axis] = (n // 2, (n - 1) // 2)
    around = np.pad(x.astype(float), pad, mode=mode)
    want = sum(w * np.take(around, np.arange(k, k + shape[axis]), axis) for k, w in enumerate(taps))
    assert np.allclose(along(x, taps, axis), want)
