"""Operations over many images at once give what they give image by image."""

import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery.functions import raster, rle, stacks
from gleanery.functions.color import hue_thresholds
from gleanery.plans import rasters
from gleanery.plans import recipes as r
from gleanery.sources import files

CHAINS = {
    "none": [], "islands": [r.remove_islands()], "some_islands": [r.remove_islands(0.3)], "erode": [r.erode(px=1)], "erode_share": [r.erode()], "crop": [r.crop("left")], "crop_box": [r.crop(x=3, y=2, width=40, height=9)], "inside": [r.crop_inside_mask()],
    "quarter": [r.rotate(90)], "rotate": [r.rotate(33)], "orient": [r.orient(axis_strategy="longer")], "orient_skew": [r.orient()], "larger": [r.resize(scale=2)], "smaller": [r.resize(width=11)], "background": [r.remove_background()], "many": [r.remove_islands(), r.orient(), r.crop_inside_mask(), r.resize(scale=3)],
}
METRICS = [
    r.mask_area(), r.bounding_box(), r.body_length(), r.max_width(), r.n_islands(), r.centroid(), r.relative_position(), r.image_bounds(), r.bilateral_asymmetry(), r.edge_fraction(), r.mask_fraction(), r.elongation(),
    r.mean_lightness(), r.mean_color(), r.mean_color(space="lab", name="lab"), r.white_balanced_color(), r.background_color(), r.threshold_fractions(hue_thresholds(), unmatched=True), r.red_fraction(), r.black_fraction(),
]


def some_masks():
    rng, out = np.random.default_rng(1), []
    for k in range(40):
        m = rng.random((24, 32)) < rng.choice([0.02, 0.2, 0.5, 0.97])
        if k % 2:
            m[:] = False
            y, x = rng.integers(0, 12, 2)
            m[y : y + rng.integers(2, 12), x : x + rng.integers(2, 18)] = True
            m[20:22, 26:28] = k % 4 == 1
        out.append(m)
    return np.stack(out)


def close(a, b):
    if isinstance(a, dict):
        assert set(a) == set(b)
        for k in a:
            close(a[k], b[k])
    else:
        assert a == b or (isinstance(a, float) and abs(a - b) <= 1e-9 * max(1, abs(a)))


@pytest.mark.parametrize("name", CHAINS)
@pytest.mark.parametrize("shape", [(), (3,)])
def test_stacks_against_single_images(name, shape):
    chain, masks = CHAINS[name], some_masks()
    images = np.random.default_rng(2).integers(0, 256, (len(masks), 24, 32, *shape), dtype=np.uint8)
    metrics = [o for o in METRICS if o.name != "background_color"] if name in ("inside", "many") else METRICS
    recipe, labels = r.Recipe("metric", "x", [*chain, *metrics]), [o.name for o in chain]
    assert r.stackable(recipe)
    want = {}
    for k, (image, mask) in enumerate(zip(images, masks, strict=True)):
        s, out = raster.Segment(image, mask), {}
        try:
            for o in chain:
                s, out[o.name] = o(s)
            want[k] = out | {o.metric_name or o.name: o(s) for o in metrics}
        except ValueError:
            continue
    able, got = list(want), {}
    assert len(able) > 15
    for at, made in r._together(stacks.Stack.of(images[able], masks[able]), recipe, chain, labels):
        for k, text in zip(at, made["value_json"], strict=True):
            got.setdefault(able[k], {})[made["metric_name"]] = json.loads(text)
    assert set(got) == set(want)
    for k in want:
        close(json.loads(r.canonical_json(want[k])), got[k])


def test_masks_of_many_as_of_one():
    rng = np.random.default_rng(0)
    for h, w in ((24, 32), (1, 1), (3, 1), (1, 7), (90, 70)):
        masks = np.stack([rng.random((h, w)) < q for q in (0, 1, 0.5, 0.1, 0.02, 0.999)])
        counts = rle.encode_all(masks)
        assert counts == [rle.encode(m)[0] for m in masks] and (rle.decode_all(counts, h, w) == masks).all()
        with pytest.raises(ValueError):
            rle.decode_all(counts, h + 1, w)


def test_rows_that_fit_no_stack_are_done_alone(spark):
    """Frames of two shapes, blank images, damaged and foreign masks: each has its own result, whatever its neighbours."""
    light = np.full((4, 6, 3), 10, np.uint8)
    light[1:3, 1:4] = 200
    blank, grey = np.full((4, 6, 3), 10, np.uint8), light[..., 0].T.copy()
    counts = rle.encode(light[..., 0] > 100)[0]
    rows = [("a", 4, 6, light.tobytes(), counts, 4, 6), ("b", 4, 6, blank.tobytes(), b"", 4, 6), ("c", 6, 4, grey.tobytes(), rle.encode(grey > 100)[0], 6, 4), ("d", 4, 6, light.tobytes(), counts, 5, 6), ("e", None, None, None, counts, 4, 6)]
    df = spark.createDataFrame(rows, "occurrence_id string, height int, width int, data binary, rle_counts binary, rle_height int, rle_width int").coalesce(1)
    found = {x.occurrence_id: x for x in r.execute(df.drop(*r.MASK), r.Recipe("segment", "s", [r.segment(r.BrightnessModel())]), ["height", "data"]).collect()}
    assert found["a"].area == 6 and found["c"].area == 6 and bytes(found["a"].rle_counts) == counts and (found["a"].height, bytes(found["a"].data)) == (4, light.tobytes())
    assert found["b"].status == "failed" and "found nothing" in found["b"].error and found["e"].status == "no_input"
    got = {x.occurrence_id: x for x in r.execute(df, r.Recipe("metric", "m", [r.mask_area()])).collect()}
    assert [got[k].value_json for k in "ace"] == ["6"] * 3 and got["b"].status == got["d"].status == "failed"


def test_images_of_a_folder_as_spark_reads_them(spark, tmp_path):
    """Plain PNGs are listed and read by tasks (no file of theirs is the driver's), others by Spark; the rows are the same."""
    rng, inner = np.random.default_rng(0), tmp_path / "in"
    inner.mkdir()
    for name, shape in (("grey.png", (3, 4)), ("a.b.png", (3, 4, 3)), ("clear.PNG", (2, 5, 4)), ("in/deep.png", (2, 2, 3))):
        (tmp_path / name).write_bytes(raster.png_bytes(rng.integers(0, 256, shape, dtype=np.uint8)))
    for name in ("not.png", "_hidden.png", "cut.png", "text.txt"):
        (tmp_path / name).write_bytes((tmp_path / "a.b.png").read_bytes()[: {"not.png": 5, "cut.png": 45}.get(name, 10_000)])
    read = lambda df: sorted((x.occurrence_id, x.path, x.bytes, x.modified, x.height, x.width, x.channels, bytes(x.data)) for x in df.collect())
    for recursive in (False, True):
        whole, want = files.images(spark, f"file://{tmp_path}", recursive=recursive), files._images_by_spark(spark, f"file://{tmp_path}", "*.{png,PNG,jpg}", recursive)
        assert read(whole) == read(want) and len(read(whole)) == 3 + recursive
    (tmp_path / "not.png").unlink()
    assert not any(f.lower().endswith(".png") for f in files.images(spark, str(tmp_path)).inputFiles())
    with open(tmp_path / "pal.png", "wb") as f:  # a palette of two colours
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 3, 0, 0, 0)) + chunk(b"PLTE", bytes([9, 8, 7, 1, 2, 3])) + chunk(b"IDAT", zlib.compress(b"\0\0\1")) + chunk(b"IEND", b""))
    found = {x.occurrence_id: x for x in files.images(spark, str(tmp_path)).collect()}
    assert bytes(found["pal"].data) == bytes([7, 8, 9, 3, 2, 1]) and set(found) == {"grey", "a.b", "clear", "pal"}


def test_keys_are_dealt_to_tasks(spark, tmp_path):
    """A small file of many keys is work for many tasks."""
    spark.range(60_000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert rasters.drawn(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() == 6
    assert isinstance(rasters.drawn(spark, str(tmp_path)).limit(1).toPandas(), pd.DataFrame)
