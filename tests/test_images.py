"""Image files as another implementation (the JVM's) writes and reads them."""

import numpy as np
import pytest

from lumenmill.functions.codec import decode_image
from lumenmill.functions.formats import UnsupportedFormat
from lumenmill.plans.job import decode


def picture(h, w, planes=3, noisy=False):
    y, x = np.mgrid[:h, :w]
    smooth = np.stack([127 + 100 * np.sin(x / 9 + k) * np.cos(y / 7 - k) for k in range(planes)], 2)
    out = smooth + np.random.default_rng(1).normal(0, 30, smooth.shape) if noisy else smooth
    return np.clip(out, 0, 255).astype(np.uint8)


def java_image(jvm, x, kind):
    h, w = x.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    for r in range(h):
        for c in range(w):
            p = [int(v) for v in x[r, c]]
            p = p * 3 if len(p) == 1 else p
            rgb = (255 << 24) | (p[0] << 16) | (p[1] << 8) | p[2]
            image.setRGB(c, r, rgb - (1 << 32))
    return image


def written(jvm, image, kind, progressive=False, quality=None):
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    if quality is not None:
        param.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
        param.setCompressionQuality(quality)
    stream = jvm.javax.imageio.stream.MemoryCacheImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    return bytes(out.toByteArray())


def read_back(jvm, data):
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    h, w = image.getHeight(), image.getWidth()
    rgb = np.array([[image.getRGB(c, r) & 0xFFFFFFFF for c in range(w)] for r in range(h)], np.uint32)
    return np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255, rgb >> 24], 2).astype(np.uint8)


@pytest.mark.parametrize("size", [(16, 16), (19, 37), (8, 1)])
@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("quality", [0.3, 0.95])
@pytest.mark.parametrize("noisy", [False, True])
def test_jpeg_equals_the_jvm(spark, size, progressive, quality, noisy):
    jvm = spark.sparkContext._jvm
    data = written(jvm, java_image(jvm, picture(*size, noisy=noisy), 1), "jpg", progressive, quality)
    got, want = decode_image(data), read_back(jvm, data)
    assert got.shape == want.shape
    apart = np.abs(got.astype(int) - want)
    assert apart.max() <= 6 and apart.mean() < 1.0  # transforms and upsampling may round apart


@pytest.mark.parametrize("progressive", [False, True])
def test_gray_jpeg_equals_the_jvm(spark, progressive):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(21, 13, 10)
    for r, row in enumerate(picture(13, 21, 1, True)[..., 0].tolist()):
        for c, v in enumerate(row):
            image.getRaster().setSample(c, r, 0, v)
    data = written(jvm, image, "jpg", progressive, 0.8)
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data)).getRaster()
    want = np.array([[raster.getSample(c, r, 0) for c in range(21)] for r in range(13)])
    got = decode_image(data)
    assert np.abs(got[..., 0].astype(int) - want).max() <= 1 and (got[..., 0] == got[..., 2]).all() and (got[..., 3] == 255).all()


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("kind", [1, 10, 11, 12, 13])  # colours, gray, 16-bit gray, one bit, palette
@pytest.mark.parametrize("size", [(1, 1), (5, 3), (13, 21)])
def test_png_equals_the_jvm(spark, size, kind, interlaced):
    jvm = spark.sparkContext._jvm
    image = java_image(jvm, picture(*size, noisy=True), kind)
    data = written(jvm, image, "png", interlaced)
    got = decode_image(data)
    raster, h, w = image.getRaster(), *size
    if kind in (10, 11):  # the JVM's colours of grays are not linear; samples are
        want = np.array([[raster.getSample(c, r, 0) for c in range(w)] for r in range(h)]) >> (8 if kind == 11 else 0)
        assert (got[..., :3] == want[..., None]).all() and (got[..., 3] == 255).all()
    else:
        assert (got == read_back(jvm, data)).all()


@pytest.mark.parametrize("kind", [1, 5, 12, 13])
def test_bmp_equals_the_jvm(spark, kind):
    jvm = spark.sparkContext._jvm
    data = written(jvm, java_image(jvm, picture(13, 21, noisy=True), kind), "bmp")
    assert (decode_image(data) == read_back(jvm, data)).all()


def test_files_by_path_and_refusals(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    data = written(jvm, java_image(jvm, picture(9, 9), 1), "jpg")
    (tmp_path / "a.jpg").write_bytes(data)
    assert decode("a.jpg", None, None, None, str(tmp_path)).shape == (9, 9, 4)
    for bad in (b"", b"RIFF0000WEBPVP8 ", b"GIF89a"):
        with pytest.raises(UnsupportedFormat):
            decode_image(bad)
    for cut in range(2, len(data) - 2, 7):  # a file cut anywhere is an error or an image, never a hang
        try:
            decode_image(data[:cut])
        except Exception as e:
            assert not isinstance(e, (MemoryError, RecursionError))
