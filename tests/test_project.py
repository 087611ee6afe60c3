"""One project from images to an export, with the drawn specimens of FIXTURES.md."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import raster
from gleanery.functions.color import convert
from gleanery.functions.raster import png_bytes
from gleanery.operators import groupfit
from gleanery.plans import recipes as r
from gleanery.plans.project import ID, Project
from gleanery.sources import tables


def specimen(k, legs=False):
    y, x = np.mgrid[0:220, 0:280].astype(float)
    angle = np.radians(15 + 12 * k)
    dx, dy = x - 140, y - 110
    u, v = dx * np.cos(angle) + dy * np.sin(angle), -dx * np.sin(angle) + dy * np.cos(angle)
    image = np.full((220, 280, 3), 40, np.uint8)
    image[(u / 20) ** 2 + (v / 60) ** 2 <= 1] = (200, 180, 150)
    return image


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "images").mkdir()
    for k in range(4):
        (root / f"images/specimen{k}.png").write_bytes(png_bytes(specimen(k)))
    p = Project(spark, str(root / "p"))
    meta = spark.createDataFrame([(f"specimen{k}", "boxA" if k % 2 == 0 else "boxB", "lydia" if k % 3 == 0 else "junius") for k in range(4)], f"{ID} string, device string, species string")
    p.ingest_images(str(root / "images"), meta)
    return p


METRICS = [r.body_length(), r.max_width(), r.mask_area(), r.mean_lightness(), r.blur_variance(), r.bilateral_asymmetry(), r.edge_fraction(), r.centroid()]


def test_pipeline(project, spark, tmp_path):
    p = project
    assert p.summarize()["occurrences"] == 4
    first = p.run_segments([r.segment(r.BrightnessModel())], "organisms")
    assert first["done"] == 4
    assert p.run_segments([r.segment(r.BrightnessModel())], "organisms").get("done", 0) == 0
    measured = p.run_metrics(METRICS, "traits", [r.remove_appendages(), r.orient(axis_strategy="longer")])
    assert measured["done"] == 4
    assert p.run_metrics(METRICS, "traits", [r.remove_appendages(), r.orient(axis_strategy="longer")]).get("done", 0) == 0
    copied = p.run_metrics(METRICS, "again", [r.remove_appendages(), r.orient(axis_strategy="longer")])
    assert copied["copied"] == 4 and copied.get("done", 0) == 0
    flat = p.metrics_wide(["traits"])
    assert "traits__organism__orient__skew_pc0" not in flat.columns and "traits__organism__centroid__x" in flat.columns
    p.declare_scale(2.0, "device", "boxA")
    p.declare_scale(4.0, "device", "boxB")
    out = p.export_metrics(str(tmp_path / "csv"), ["traits"], units="mm", filters={"traits__organism__body_length_mm": (">", 40), "species": ("!=", "none")})
    rows = {x[ID]: x for x in out.collect()}
    assert set(rows) == {"specimen0", "specimen2"}
    assert abs(rows["specimen0"]["traits__organism__body_length_mm"] - 121 / 2) < 2
    assert p.load_exports()[-1]["n_rows"] == 2
    assert p.export_units(["traits"])["traits__organism__body_length"] == "px"
    with pytest.raises(ValueError):
        p.run_metrics([r.body_length()], "traits")
    p.run_metrics([r.body_length()], "traits", force=True)
    now = p.metrics_wide(["traits"]).columns
    assert "traits__organism__max_width" not in now and "traits__organism__body_length" in now
    assert p.ids_completed("traits").count() == 4
    assert p.describe_run(name="traits", kind="metric")["recipe"]["part"] == "organism"


def test_resegmenting_hides_stale_values(project):
    p = project
    p.run_segments([r.segment(r.BrightnessModel(0.4))], "organisms", subset=None, force=True)
    assert p.metrics_wide(["again"]).count() == 0
    assert p.metrics_wide(["again"], current_only=False).count() == 4
    assert p.run_metrics([r.mask_fraction()], "third")["done"] == 4


def test_derived_part_and_masks_round_trip(project, tmp_path):
    p = project
    p.run_segments([r.erode(px=3)], "core", part="core", from_part="organism")
    areas = {x["part"]: x["a"] for x in p.load_masks().groupBy("part").agg(F.avg("area").alias("a")).collect()}
    assert areas["core"] < areas["organism"]
    assert p.export_masks(str(tmp_path / "m"), ["organism"]) == 4
    assert p.import_masks(str(tmp_path / "m"), reference=True) == 4
    assert p.import_masks(str(tmp_path / "m"), reference=True) == 0
    assert all(x["score"] == 1.0 for x in p.validate_masks().collect())


def test_subsets_labels_and_filters(project, spark):
    p = project
    p.define_subset("lydia", column="species", values=["lydia"])
    p.define_subset("boxA", query="device == 'boxA' and species != 'x'")
    assert sorted(x[0] for x in p.select_ids("lydia").collect()) == ["specimen0", "specimen3"]
    assert p.select_ids("boxA").count() == 2
    p.grow_subset("grown", 3)
    small = {x[0] for x in p.select_ids("grown").collect()}
    p.grow_subset("grown", 4)
    assert small < {x[0] for x in p.select_ids("grown").collect()}
    values = spark.createDataFrame([(f"specimen{k}", float(k)) for k in range(4)], f"{ID} string, value double")
    labels = spark.createDataFrame([(f"specimen{k}", "bad" if k < 2 else "good") for k in range(4)], f"{ID} string, value string")
    p.store_values(values, "scores", "s")
    p.store_values(labels, "labels", "usable", kind="metric")
    rules = p.get_validated_filters({"scores__organism__s": "below"}, "labels", "usable", bad_labels=["bad"], max_fpr=0.1)
    assert rules == {"scores__organism__s": (">=", 2.0)}
    audit = p.audit_filters(rules, "labels", "usable", bad_labels=["bad"])
    assert (audit["n_kept"], audit["n_kept_bad"], audit["bad_caught"], audit["enough"]) == (2, 0, 1.0, False)
    assert [x[0] for x in p.ids_matching("labels", {"usable": "bad"}).collect()] == ["specimen0", "specimen1"]
    assert p.ids_passing({"scores__organism__s": (">=", 1)}, ["scores"]).count() == 3
    assert p.compare_metrics("scores", "scores", "s")["bias"] == 0


def test_fitted_metrics_and_products(project, tmp_path):
    p = project
    p.run_metrics([r.mask_area(), r.mean_lightness()], "base")
    assert p.fit_metric("cluster", ["area_px", "mean_lightness"], "base", "clusters", n_clusters=2).count() == 4
    assert p.fit_metric("outlier", ["area_px"], "base", "outliers", group_col="device", min_group_size=10).where("value.group is null").count() == 4
    flat = p.metrics_wide(["clusters", "outliers"])
    assert {"clusters__organism__cluster__cluster_id", "outliers__organism__outlier__is_outlier"} <= set(flat.columns)
    assert p.pixel_metric("color_clusters", "palette", n_colors=2).count() == 4
    assert p.pixel_metric("inductive_color_thresholds", "hues").count() == 4
    assert p.metrics_wide(["palette"]).where(F.try_variant_get("palette__organism__color_clusters__color_0", "$", "double") <= 1).count() == 4
    assert p.render_segments(str(tmp_path / "cut"), [r.crop_to_mask()]) == 4 and p.render_segments(str(tmp_path / "cut"), [r.crop_to_mask()]) == 0
    assert p.export_training_data(str(tmp_path / "train"), "species").count() == 4
    assert "metrics" in p.archive(str(tmp_path / "deposit"))
    p.register_model("m", task="segment")
    assert "m" in p.list_models()
    assert p.exemplars_per_group("base", "device", "area_px", normalize=False).count() == 2


def test_hue_ranges_are_scored_on_every_masked_pixel(spark, tmp_path):
    (tmp_path / "images").mkdir()
    for k in range(2):
        image = specimen(k)
        inside = image[..., 0] > 100
        rows = np.arange(220)[:, None] * np.ones((1, 280))
        image[inside & (rows < 100 + k)] = (200, 120, 60)
        image[inside & (rows >= 100 + k)] = (90, 120, 220)
        image[inside] += np.random.default_rng(k).integers(0, 30, (int(inside.sum()), 3)).astype(np.uint8)
        (tmp_path / f"images/s{k}.png").write_bytes(png_bytes(image))
    p = Project(spark, str(tmp_path / "p"))
    p.ingest_images(str(tmp_path / "images"), spark.createDataFrame([("s0",), ("s1",)], f"{ID} string"))
    p.run_segments([r.segment(r.BrightnessModel())], "organisms")
    full = {x[ID]: np.frombuffer(x["pixels"], np.uint8).reshape(-1, 3) for x in p.pooled_pixels(per_occurrence=None).collect()}
    assert all(len(px) > groupfit.PIXELS for px in full.values())
    scored = p.pixel_metric("inductive_color_thresholds", "hues").collect()
    model = p.describe_run(name="hues")["recipe"]["operations"][0]["parameters"]["models"][groupfit.POPULATION]
    for x in scored:
        px, got = full[x[ID]], json.loads(x["value_json"])
        want = raster.threshold_fractions(raster.Segment(px[None], np.ones((1, len(px)), bool)), model["thresholds"])
        assert {k: got[k] for k in want} == want and any(0 < v < 1 for v in want.values())


def test_fits_pool_every_occurrence(spark, tmp_path, monkeypatch):
    p = Project(spark, str(tmp_path / "pool"))
    px = np.random.default_rng(3).integers(0, 256, (600, 3)).astype(np.uint8)
    pool = spark.createDataFrame([(f"o{k}", None, px[k].tobytes()) for k in range(600)], f"{ID} string, group string, pixels binary")
    monkeypatch.setattr(p, "pooled_pixels", lambda *_: pool)
    assert p.pixel_metric("color_clusters", "palette", n_colors=1).count() == 600
    models = p.describe_run(name="palette")["recipe"]["operations"][0]["parameters"]["models"]
    assert np.allclose(models[groupfit.POPULATION]["centres"][0], convert(px, "lab").astype(float).mean(0))
    repeated, counts = np.repeat(px, np.arange(600) % 7 + 1, axis=0), np.arange(600) % 7 + 1
    one, many = groupfit.hue_definition(px, counts=counts), groupfit.hue_definition(repeated)
    assert np.allclose(one["gate"], many["gate"]) and np.allclose(one["hue_ranges"], many["hue_ranges"])


def test_downloads_remember_failures(spark, tmp_path):
    p = Project(spark, str(tmp_path / "d"))
    p.save_occurrences(spark.createDataFrame([("a", "mem://1"), ("b", "mem://bad"), ("c", None), ("d", "mem://text")], f"{ID} string, image_url string"))
    good = png_bytes(specimen(0)[:20, :30])

    def fetch(url):
        if url == "mem://bad":
            raise OSError("gone")
        return good if url == "mem://1" else b"not an image"

    assert p.download_images(fetch=fetch) == {"attempted": 3, "stored": 1, "failed": 2}
    assert p.download_images(fetch=fetch)["attempted"] == 0
    assert p.download_images(fetch=fetch, retry_failed=True)["attempted"] == 2
    assert [(r[ID], r.height, r.width) for r in p.images().collect()] == [("a", 20, 30)]


def test_one_bad_image_fails_alone(spark, tmp_path):
    p = Project(spark, str(tmp_path / "f"))
    (tmp_path / "i").mkdir()
    (tmp_path / "i/ok.png").write_bytes(png_bytes(specimen(1)))
    (tmp_path / "i/flat.png").write_bytes(png_bytes(np.zeros((9, 9, 3), np.uint8)))
    p.ingest_images(str(tmp_path / "i"))
    first = p.run_segments([r.segment(r.BrightnessModel())], "organisms")
    assert (first["done"], first["failed"]) == (1, 1)
    again = p.run_segments([r.segment(r.BrightnessModel())], "organisms")
    assert again.get("failed", 0) == 0 and again["skipped"] == 2
    assert p.run_segments([r.segment(r.BrightnessModel())], "organisms", retry_failed=True)["failed"] == 1


def test_csv_ingest_is_idempotent(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("id,kind,lat,n\n" + "\n".join(f"a{k},{'x' if k % 2 else 'NA'},{k // 2}.001,{k}d" for k in range(8)) + "\n")
    p = Project(spark, str(tmp_path / "q"))
    df = p.ingest_occurrences(str(source), id_col="id", numeric_cols=["lat", "n"], drop={ID: "a0"}, dedupe_key_cols=["lat"], dedupe_precision={"lat": 1}, group_col="kind", max_per_group=2)
    n = df.count()
    assert 2 <= n <= 4 and df.where("n is not null").count() == 0 and df.where("kind = 'NA'").count() > 0
    assert p.ingest_occurrences(str(source), id_col="id", numeric_cols=["lat", "n"], drop={ID: "a0"}, dedupe_key_cols=["lat"], dedupe_precision={"lat": 1}, group_col="kind", max_per_group=2).count() == n
    assert len(p.load_imports()) == 1
    with pytest.raises(ValueError):
        p.save_occurrences(spark.createDataFrame([("a",), ("a",)], f"{ID} string"))


def test_upsert_checks(spark):
    old = spark.createDataFrame([("a", "p", 1), ("b", "p", 2)], f"{ID} string, part string, value int")
    new = spark.createDataFrame([("a", "p", 9), ("c", "p", 3)], f"{ID} string, part string, value int")
    assert sorted((x[0], x[2]) for x in tables.upserted(old, new, [ID, "part"]).collect()) == [("a", 9), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError):
        tables.upserted(old, spark.createDataFrame([(None, "p", 1)], old.schema), [ID, "part"])
    with pytest.raises(TypeError):
        tables.upserted(old, new.withColumn(ID, F.lit(1)), [ID, "part"])
    with pytest.raises(KeyError):
        tables.upserted(old, new.drop("part"), [ID, "part"])
