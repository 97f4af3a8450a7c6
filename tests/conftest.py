import os
import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frames():
    """8 synthetic 32 x 32 RGBA frames of four patterns, ids syn_0000.. ."""
    rng = np.random.default_rng(42)
    y, x = np.mgrid[:32, :32]
    patterns = [(x < 16) * 200, ((x // 8 + y // 8) % 2) * 200, (x + y) * 4, (x < 16) * 100 + (y < 16) * 100]
    out = {}
    for i in range(8):
        plane = np.clip(np.asarray(patterns[i % 4])[..., None] + rng.integers(-10, 11, 3), 0, 255)
        out[f"syn_{i:04d}"] = np.dstack([plane, np.full((32, 32), 255)]).astype(np.uint8)
    return out


@pytest.fixture(scope="session")
def sources(spark, frames, tmp_path_factory):
    """The frames as raw bytes, relative paths and absolute paths."""
    from lumenmill.functions.codec import encode_png

    root = tmp_path_factory.mktemp("frames")
    (root / "imgs").mkdir()
    raw, relative, absolute = [], [], []
    for i, (k, x) in enumerate(frames.items()):
        (root / f"imgs/img_{i:02d}.png").write_bytes(encode_png(x))
        raw.append((k, 32, 32, "synthetic", bytearray(x.tobytes())))
        relative.append((k, 32, 32, "synthetic", f"imgs/img_{i:02d}.png"))
        absolute.append((k, 32, 32, "synthetic", str(root / f"imgs/img_{i:02d}.png")))
    base = "id string, height int, width int, source string, "
    spark.createDataFrame(raw, base + "img binary").coalesce(1).write.parquet(str(root / "raw.parquet"))
    for name, rows in (("relative", relative), ("absolute", absolute)):
        spark.createDataFrame(rows, base + "path string").coalesce(1).write.parquet(str(root / f"{name}.parquet"))
    return root


def job(source, out, column="img", prefix=None, transformations=None, loader=None, models=None, **outputs):
    sample = {"column": column} | ({"prefix": prefix} if prefix else {})
    given = {
        "compute": {"seed": 42, "progress_bar": False},
        "dataloaders": {"loaders": [{"type": "parquet", "name": "synthetic", "path": str(source), "id_column": "id", "sample_path": [sample]} | (loader or {})]},
        "operations": {
            "outputs": {"path": f"{out}/{{selection}}/ledger", "samples_dir": f"{out}/{{selection}}/payload", **outputs},
            "transformations": transformations if transformations is not None else [{"name": "flip", "type": "horizontal_flip"}, {"name": "crop", "type": "crop_resize", "fraction": 0.5}],
        },
    }
    return given | ({"models": models} if models else {})
