"""Properties and hand-computed answers of the operators that SQL alone doesn't settle."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import raster, rle
from gleanery.functions.color import CHANNELS, ColorRule, convert, hue_thresholds, in_arc, to_bgr
from gleanery.functions.identity import canonical_json, combined_source, derivation_hash, hash_spec
from gleanery.operators import collage, filters, groupfit, selection, spans, validate, wide
from gleanery.plans import recipes
from gleanery.sources import files, tables
from gleanery.streaming import events

masks = st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**81 - 1)).map(lambda t: np.array([t[2] >> k & 1 for k in range(t[0] * t[1])], dtype=bool).reshape(t[:2]))


def test_pinned_digests():
    assert hash_spec({"a": 1, "b": [2, 3]}) == "efbd0040190fb087" and canonical_json({"b": [2, 3], "a": 1}) == '{"a":1,"b":[2,3]}'
    assert derivation_hash("a" * 16, "b" * 16) == "b710b93cc6715f34" and derivation_hash("a" * 16) == "a" * 16
    assert recipes.Recipe("metric", "traits", [recipes.body_length()]).hash == "d03ec33defb22ec2"

    class Frozen:
        def identity(self):
            return {"class": "FrozenModel", "checkpoint": "frozen-v1"}

    assert recipes.Recipe("segment", "organisms", [recipes.segment(Frozen())]).hash == "cdcefe5567bb1c27"
    assert combined_source({"a": "x"}) == "x" and combined_source({"a": "x", "b": "y"}) == hash_spec({"a": "x", "b": "y"})


@given(masks)
@settings(max_examples=150, deadline=None)
def test_run_lengths_round_trip(mask):
    counts, h, w = rle.encode(mask)
    assert (rle.decode(counts, h, w) == mask).all()
    labels, many = raster.components(mask)
    assert (labels > 0).sum() == mask.sum() and labels.max(initial=0) == many
    if mask.any():
        box = raster.inscribed_rectangle(mask)
        assert mask[box["y"] : box["y"] + box["height"], box["x"] : box["x"] + box["width"]].all()
        outside = np.argwhere(~np.pad(mask, 1)) - 1
        far = raster.edge_distance(mask)
        for y, x in np.argwhere(mask):
            assert abs(far[y, x] - np.sqrt(((outside - [y, x]) ** 2).sum(1)).min()) < 1e-9


def test_known_run_lengths():
    assert rle.compress(np.array([6, 1, 40, 4, 5, 4, 5, 4, 21])) == b"61X13mN000`0"


def test_masks_and_frames():
    assert raster.iou(np.zeros((2, 2)), np.zeros((3, 3))) == 1 and raster.coverage(np.ones((2, 2)), np.zeros((3, 3))) == 1
    assert raster.iou(np.ones((2, 2)), np.ones((4, 2))) == 0.5
    y, x = np.mgrid[0:200, 0:300]
    ellipse = ((x - 220) / 30) ** 2 + ((y - 80) / 18) ** 2 <= 1
    image = np.full((200, 300, 3), 30, np.uint8)
    image[ellipse] = (20, 40, 220)
    s = raster.Segment(image, ellipse)
    assert raster.bounds(ellipse) == {"x": 190, "y": 62, "width": 61, "height": 37}
    assert (raster.body_length(s), raster.max_width(s), raster.mask_area(s)) == (37, 61, int(ellipse.sum()))
    assert abs(raster.elongation(s) - 30 / 18) < 0.02
    turned, _ = raster.orient(s, axis_strategy="longer")
    assert abs(raster.body_length(turned) - 61) <= 1 and abs(raster.max_width(turned) - 37) <= 1
    assert raster.iou(turned.original_mask(), ellipse) > 0.95 and abs(raster.centroid(turned)["x"] - 220) < 0.5
    cut, info = raster.crop_to_mask(s, 0.0)
    assert cut.frame == (37, 61) and info["x"] == 190 and (cut.original_mask() == ellipse).all()
    small, _ = raster.resize(s, scale=0.5)
    assert small.frame == (100, 150) and abs(small.mask.sum() * 4 / ellipse.sum() - 1) < 0.05
    legged = ellipse.copy()
    legged[80, 150:190] = True
    clean, info = raster.remove_appendages(raster.Segment(image, legged))
    assert raster.iou(clean.mask, ellipse) > 0.98 and info["removed_fraction"] > 0
    island = ellipse.copy()
    island[10:13, 10:13] = True
    assert raster.n_islands(raster.Segment(image, island)) == 1 and (raster.remove_islands(raster.Segment(image, island))[0].mask == ellipse).all()
    assert raster.threshold_fractions(s, [t.spec() for t in hue_thresholds()], True)["red"] == 1.0
    with pytest.raises(ValueError):
        raster.crop(s, x=500, y=0, width=10, height=10)
    with pytest.raises(raster.NothingToMeasure):
        raster.mask_area(raster.Segment(image))
    assert (raster.read_png(raster.png_bytes(image)) == image).all()


def test_colours():
    pixels = np.random.default_rng(0).integers(0, 256, (300, 3)).astype(np.uint8)
    for space in CHANNELS:
        assert np.abs(to_bgr(convert(pixels, space), space).astype(int) - pixels).max() <= 1
    assert in_arc(np.array([350, 10, 22, 340]), 340, 22).tolist() == [True, True, False, True] and not in_arc(np.array([5]), 5, 5).any()
    assert ColorRule("dark", lab_l=(None, 20)).spec() == {"name": "dark", "conditions": {"lab": {"l": [None, 20]}}}
    for bad in ({"hsv_h": (None, 5)}, {"hsv_x": (0, 1)}, {}):
        with pytest.raises(ValueError):
            ColorRule("x", **bad)


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "b", float("nan")), (4, "c", None)], "id int, k string, v double")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(filters.apply_filters(df, {"k": ("!=", "a")})) == [3, 4] and ids(filters.apply_filters(df, {"v": ("not in", [2.0, None])})) == [1]
    assert ids(filters.rows_matching(df, {"k": "a", "v": [2.0, float("nan")]})) == [1, 2]
    assert ids(df.where(filters.query_column(df, "k == 'a' or not v < 2"))) == [1, 2, 3, 4] and ids(df.where(filters.query_column(df, "k != 'a'"))) == [2, 3, 4]
    for bad in (lambda: filters.passing(df, {"x": ("<", 1)}), lambda: filters.rows_matching(df, {"x": 1})):
        with pytest.raises(KeyError):
            bad()
    for bad in (lambda: filters.passing(df, {"v": ("~", 1)}), lambda: filters.query_column(df, "v == @x"), lambda: filters.query_column(df, "abs(v) == 1")):
        with pytest.raises(ValueError):
            bad()


def test_selection_is_stable_and_additive(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("g"))
    ids = lambda d: {r.id for r in d.collect()}
    assert ids(selection.sample(df, 20, "id")) == ids(selection.sample(df.repartition(9), 20, "id"))
    assert ids(selection.sample(df, 20, "id")) < ids(selection.sample(df, 40, "id"))
    small = selection.cap_per_group(df, "g", 3, "id")
    assert ids(small) < ids(selection.cap_per_group(df, "g", 5, "id", keep=small.select("id")))
    shards = [ids(selection.shard(df, "id", k, 3)) for k in range(3)]
    assert set.union(*shards) == ids(df) and sum(map(len, shards)) == 200 and max(map(len, shards)) - min(map(len, shards)) <= 1
    sides = selection.split(df, "id", group_col="g")
    assert sides.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert selection.thin_ranks(100, 5) == [0, 25, 50, 74, 99] and len(selection.thin_ranks(100, 5, keep=[7])) <= 5
    ranked = selection.global_rank(df, ["id"], "r").orderBy("r").collect()
    assert [r.r for r in ranked] == list(range(200)) and [r.id for r in ranked] == sorted(r.id for r in ranked)


LABELLED = [(f"occ{k}", float(v), u) for k, (v, u) in enumerate(zip([5, 8, 12, 20, 30, 40, 50, 60, 70, 80], ["not_an_organism", "cut_off", "cut_off", *["usable"] * 7], strict=True))]


def test_sweeps_by_hand(spark):
    df = spark.createDataFrame(LABELLED, "occurrence_id string, blur double, label string")
    bad = ["not_an_organism", "cut_off"]
    sweep = {r.threshold: r for r in validate.sweep_thresholds(df, "blur", "below", "label", bad).collect()}
    assert len(sweep) == 10
    at = sweep[20.0]
    assert (at.n_flagged, at.precision, at.recall, at.fpr, at.n_bad, at.n_clean, at.recall_cut_off, at.n_cut_off) == (3, 1.0, 1.0, 0.0, 3, 7, 1.0, 2)
    assert sweep[5.0].precision is None and sweep[80.0].n_flagged == 9
    above = validate.sweep_thresholds(df, "blur", "above", "label", bad).where("threshold = 70").first()
    assert (above.n_flagged, above.recall) == (1, 0.0)
    assert validate.validated_filters(df, {"blur": "below"}, "label", bad_labels=bad) == {"blur": (">=", 20.0)}
    assert validate.validated_filters(df, {"blur": "above"}, "label", bad_labels=bad) == {}
    assert validate.bad_values(df, "label", None, ["usable"]) == ["cut_off", "not_an_organism"]
    low, high = validate.wilson_interval(3, 3)
    score = validate.score_filters(df, {"blur": (">=", 20.0)}, "label", bad).first()
    assert abs(score.bad_caught_low - low) < 1e-12 and abs(score.bad_caught_high - high) < 1e-12 and score.n_kept == 7
    with pytest.raises(ValueError):
        validate.bad_values(df, "label", ["a"], ["b"])


def test_newest_wins_per_key(spark):
    rows = [("a", 1, '{"x": 1, "y": 2}'), ("a", 2, '{"x": 3}'), ("b", 3, "5"), ("b", 4, "null"), ("c", 5, "[1, 2]")]
    long = spark.createDataFrame(rows, "occurrence_id string, metric_id long, j string").select("occurrence_id", "metric_id", F.lit("r").alias("run_name"), F.lit("p").alias("part"), F.lit("m").alias("metric_name"), F.lit(None).cast("string").alias("unit"), F.parse_json("j").alias("value"))
    flat = wide.wide(long)
    assert flat.columns == ["occurrence_id", "r__p__m", "r__p__m__x", "r__p__m__y"]
    got = {r[0]: r[1:] for r in flat.select("occurrence_id", *[wide.typed(F.col(c), "double").alias(c) for c in flat.columns[1:]]).collect()}
    assert got["a"] == (None, 3.0, 2.0) and got["b"] == (None, None, None)


def test_group_models(spark):
    rng = np.random.default_rng(1)
    rows = [(f"a{k}", "g1", *map(float, rng.normal([0, 0] if k % 2 else [9, 9], 0.5))) for k in range(80)] + [(f"b{k}", "g2", float(k), 0.0) for k in range(3)] + [("n", None, 9.0, 9.0), ("bad", "g1", None, 1.0)]
    df = spark.createDataFrame(rows, "id string, g string, x double, y double")
    got = {r.id: r for r in groupfit.cluster(df, ["x", "y"], "id", "g", 2, min_group_size=10).collect()}
    assert "bad" not in got and got["n"].group is None and got["b0"].group is None and got["a0"].group == "g1"
    assert len({got[f"a{k}"].cluster_id for k in range(0, 80, 2)}) == 1 and got["a0"].cluster_id != got["a1"].cluster_id
    far = df.union(spark.createDataFrame([("far", "g1", 60.0, -60.0)], df.schema))
    scores = {r.id: r.anomaly_score for r in groupfit.outlier(far, ["x", "y"], "id").collect()}
    assert min(scores, key=scores.get) == "far"
    labels = spark.createDataFrame([(f"a{k}", "bad" if k % 2 else "good") for k in range(60)], "id string, label string")
    scored, area = groupfit.label_score(df, ["x", "y"], "id", labels, "label", ["bad"])
    assert area > 0.99 and scored.where("out_of_fold").count() == 60
    with pytest.raises(ValueError):
        groupfit.label_score(df, ["x", "y"], "id", labels.where("label = 'bad'"), "label", ["bad"])
    pixels = np.repeat(np.array([[200, 60, 40], [40, 60, 200], [90, 90, 90]], np.uint8), 400, axis=0)
    assert abs(groupfit.palette_shares(pixels, groupfit.palette(pixels, 3))["color_0"] - 1 / 3) < 1e-9
    assert len(groupfit.hue_ranges(np.concatenate((rng.normal(60, 5, 500), rng.normal(200, 5, 500))) % 360)) == 2


def keyed(df, id_col, *cols):
    """Values and keys of a frame in the order of the fits."""
    got = df.select(F.xxhash64(F.col(id_col).cast("string")).alias("key"), *cols).toPandas()
    x, keys = got[list(cols)].to_numpy(dtype=float), got["key"].to_numpy()
    order = np.lexsort((*x.T[::-1], keys))
    return x[order], keys[order]


@pytest.mark.parametrize("values", [[], [3.0], [2.0, 1.0], [5.0] * 40 + [1.0], [1.0] * 20 + [2.0] * 20, [float(k * 7919 % 1001) / 3 for k in range(1000)]])
def test_median_by_ranges(spark, values):
    """The exact median without an aggregate that holds every distinct value in one task."""
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    want = float(np.median(values)) if values else None
    assert validate.median(df, "v") == want
    r = 1.0 + F.monotonically_increasing_id() % 3
    pairs = df.where("v is not null").withColumn("r", r).select((F.col("r") * (1 + F.col("v") / 100)).alias("p"), "r")
    got = validate.agreement(pairs, "p", "r")
    assert "percentile" not in got._jdf.queryExecution().toString().lower() and "median(" not in got._jdf.queryExecution().toString().lower()
    assert got.first()["median_pct_diff"] == (None if want is None else pytest.approx(want))


def test_pairs_of_masks_are_not_broadcast(spark):
    """Tables that grow with the masks look small, and a broadcast would hold them whole in the driver and in every task."""
    one = spark.createDataFrame([(1, 0, 0, 3), (2, 0, 1, 5)], "mask_id long, x long, y0 long, y1 long")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    got = spans.overlap(pairs, one, one)
    row = got.first()
    assert (row.intersection, row.iou, row.coverage) == (2, 0.4, 0.5)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and "Broadcast" not in tables.shuffled(pairs).join(one, pairs["a"] == one["mask_id"])._jdf.queryExecution().executedPlan().toString()


def test_passes_with_idle_tasks_and_distances_beside_a_centre(spark):
    """A large group whose rows lie in one of several tasks; distances far below the size of the coordinates."""
    rows = spark.createDataFrame([("a", 2, np.array([1, 2]).tobytes(), np.array([3.0, 4.0]).tobytes())], "g string, n long, keys binary, v binary").repartition(4)
    assert groupfit._look(rows, {"a": None}, lambda _, x, keys: float(x.sum()) + float(keys.sum()), lambda a, b: a + b) == {"a": 10.0}
    assert groupfit._look(rows, {"b": None}, lambda *_: 1, lambda a, b: a + b) == {}
    x = np.array([[200.5, -99.4]])
    assert np.isclose(groupfit._nearest(x, x + [[1e-6, 0.0]])[1][0], 1e-6, rtol=1e-3)
    kept = spark.createDataFrame([(k, "a", [1.0]) for k in range(20)], "key long, g string, v array<double>").repartition(20)
    assert groupfit._rivals(kept, {"a": 1e-6}, 0).count() == 0


def test_label_score_takes_all_labels(spark):
    """25,000 labelled rows: all are scored out of fold, by the regression of the rows that each fold leaves; the AUC is that of all pairs."""
    n = 25_000
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), *[(F.randn(k) * (k + 1) + (F.col("id") % 2)).alias(f"f{k}") for k in range(2)]).localCheckpoint()
    labels = df.select("id", F.when(F.col("id").cast("long") % 2 == 1, "bad").otherwise("good").alias("label"))
    scored, area = groupfit.label_score(df, ["f0", "f1"], "id", labels, "label", ["bad"])
    got = scored.toPandas().merge(df.toPandas(), on="id")
    assert len(got) == n and got["out_of_fold"].all()
    y, s = got["id"].astype(int).to_numpy() % 2, got["score"].to_numpy()
    order = np.argsort(s, kind="stable")
    assert len(np.unique(s)) == n and abs(area - (np.flatnonzero(y[order]).sum() - (y.sum() - 1) * y.sum() / 2) / (y.sum() * (n - y.sum()))) < 1e-12
    fold = np.zeros(n, dtype=int)
    digest = np.array([hashlib.sha256(i.encode()).hexdigest() for i in got["id"]])
    for kind in (0, 1):
        at = np.flatnonzero(y == kind)
        fold[at[np.argsort(digest[at])]] = np.arange(len(at)) % 5
    x, keep = got[["f0", "f1"]].to_numpy(), fold != 3
    z, how = groupfit._scaled(x[keep], 2)
    z, w = np.column_stack((z, np.ones(len(z)))), np.zeros(3)
    ridge, weight = np.diag([1.0, 1.0, 1e-9]), [len(z) / (2 * (y[keep] == k).sum()) for k in (0, 1)]
    for _ in range(20):
        gradient, curve = groupfit._newton(z, y[keep], w, weight)
        w = w - np.linalg.solve(curve + ridge, gradient + ridge @ w)
    want = 1 / (1 + np.exp(-(groupfit._reduced(x[~keep], how) @ w[:-1] + w[-1])))
    assert np.abs(s[~keep] - want).max() < 1e-6


def test_clusters_and_outliers_are_fitted_on_all_rows(spark):
    """25,000 rows, one group: the centres are a fixed point of all of them, and the forest is that of all of them."""
    n = 25_000
    df = spark.range(n).select("id", F.lit("a").alias("g"), *[(F.randn(k) * (k + 1) + (F.col("id") % 3) * 4).alias(f"f{k}") for k in range(3)]).localCheckpoint()
    names = ["f0", "f1", "f2"]
    x, keys = keyed(df, "id", *names)
    got = groupfit.cluster(df, names, "id", "g", 3).toPandas().merge(df.toPandas(), on="id")
    assert len(got) == n and set(got["group"]) == {"a"}
    means = got.groupby("cluster_id")[names].mean().to_numpy()
    assert np.allclose(got["centroid_distance"], np.sqrt(((got[names].to_numpy() - means[got["cluster_id"]]) ** 2).sum(1)), atol=1e-3)
    want = groupfit.kmeans(x, 3, keys=keys)
    assert np.allclose(got.groupby("cluster_id")[names].mean().to_numpy(), want, atol=1e-3)
    assert np.allclose(got["centroid_distance"], np.sqrt(((got[names].to_numpy() - want[got["cluster_id"]]) ** 2).sum(1)), atol=1e-9)
    z, how = groupfit._scaled(x, 2)
    reduced = groupfit.cluster(df, names, "id", "g", 3, n_components=2).toPandas().merge(df.toPandas(), on="id")
    want = groupfit.kmeans(z, 3, keys=keys)
    assert np.allclose(reduced["centroid_distance"], groupfit._nearest(groupfit._reduced(reduced[names].to_numpy(), how), want)[1], atol=1e-6)
    forest = groupfit.isolation_forest(x, keys=keys)
    odd = groupfit.outlier(df, names, "id", "g").toPandas().merge(df.toPandas(), on="id")
    assert len(odd) == n and np.allclose(odd["anomaly_score"], groupfit.isolation_score(odd[names].to_numpy(), forest)["anomaly_score"], atol=1e-12)


def test_collage():
    assert len(collage.rings(20)) == 20 and len(collage.spiral(9)) == 9 and len(collage.phyllotaxis(7)) == 7
    cost = np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])
    assert cost[range(3), collage.optimal_match(cost)].sum() == 5
    circles = collage.pack_circles(np.array([1.0, 1.0, 0.5, 2.0, 1.5]))
    xy, r = circles[["x", "y"]].to_numpy(), circles["scale"].to_numpy()
    assert all(np.hypot(*(xy[i] - xy[j])) >= r[i] + r[j] - 1e-6 for i in range(5) for j in range(i))
    path = collage.path_order(np.array([[0.0, 0], [2, 0], [1, 0], [4, 0], [3, 0]]), 2)
    assert {path[0], path[-1]} == {0, 3}


def test_assign_reuses_only_where_asked():
    items, slots = np.array([[0.0], [1.0]]), np.array([[0.1], [0.2], [0.9]])
    assert collage.assign(items, slots).tolist() == [0, -1, 1] and collage.assign(items, slots, reuse=True).tolist() == [0, 0, 1]
    assert sorted(collage.assign(np.arange(4.0)[:, None], np.zeros((3, 1))).tolist()) == [0, 1, 2]
    for reuse in (False, True):
        with pytest.raises(ValueError):
            collage.assign(np.zeros((3, 1)), np.zeros((2, 1)), reuse, max_items=2)
    with pytest.raises(ValueError):
        collage.assign(np.zeros((3001, 1)), np.zeros((1, 1)))


def test_archives_and_logs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/Occurrence.txt").write_text("gbifID\toccurrenceStatus\tscientificName\n1\tPRESENT\tNA\n2\tPRESENT\t\n3\tABSENT\tx\n4\tbroken\n")
    (tmp_path / "d/multimedia.txt").write_text("gbifID\ttype\tidentifier\tcreator\n1\tStillImage\thttps://static.inaturalist.org/photos/7/medium.jpeg?9\ta\n2\tSound\ts\tb\n2\tStillImage\ti2\tb\n2\tStillImage\ti3\tb\n")
    found = files.locate_archive(str(tmp_path / "d"), str(tmp_path))
    records = files.read_tsv(spark, found["occurrence"])
    assert records.count() == 3 and records.where("scientificName is null").first().gbifID == "2" and records.where("scientificName = 'NA'").count() == 1
    media = files.select_media(files.read_tsv(spark, found["multimedia"]))
    assert {r.gbifID: r.identifier for r in media.collect()}["2"] == "i2"
    merged = files.merge_media(records, media)
    assert {r.gbifID for r in merged.collect()} == {"1", "2"}
    assert merged.where("gbifID = '1'").select(files.photo_size(F.col("media_identifier"), "large")).first()[0] == "https://static.inaturalist.org/photos/7/large.jpeg?9"
    url = "https://x.org/detections/199/2026-06-11/bronzeBobcat_2026_06_11__01_15_20_HDR0_detection_2121474.jpg"
    sheet = files.sheet_columns(spark.createDataFrame([(url,), (None,), ("https://x.org/a.jpg",)], "image_url string")).collect()
    assert (sheet[0].sheet_image_id, sheet[0].session_path) == ("bronzeBobcat/2026-06-11/bronzeBobcat_2026_06_11__01_15_20_HDR0.jpg", "bronzeBobcat/2026-06-11") and sheet[1].session_path is None and sheet[2].sheet_image_id is None
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1}\n{"a": 2}\nbroken')
    assert [r["a"] for r in tables.read_log(str(log))] == [1, 2] and tables.read_jsonl(spark, f"file://{log}").count() == 2
    for k in range(3):
        tables.append_jsonl(f"{tmp_path}/log", {"a": k})
    assert [r["a"] for r in tables.read_log(f"{tmp_path}/log")] == [0, 1, 2] and tables.read_jsonl(spark, f"file://{tmp_path}/log").count() == 3 and tables.read_log(f"{tmp_path}/none") == []
    tables.write_json(f"file://{tmp_path}/x.json", {"a": [1]})
    tables.write_json(f"file://{tmp_path}/x.json", {"a": [2]})
    assert tables.read_json(f"file://{tmp_path}/x.json") == {"a": [2]} and tables.read_json(f"{tmp_path}/none.json", 7) == 7 and tables.claim(f"{tmp_path}/c/1") and not tables.claim(f"{tmp_path}/c/1")
    paged = {"u?limit=2": {"results": [1, 2], "next": "v"}, "v": {"results": [3], "next": "v"}}
    assert list(files.pages("u", 2, fetch=paged.get)) == [1, 2, 3]
    with pytest.raises(ValueError):
        files.check_names(["a", "A"])


def test_snapshots_and_streams(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for k in range(3):
        tables.write_table(spark.createDataFrame([(k, "x")], "k long, v string") if k == 0 else tables.load_table(spark, path).union(spark.createDataFrame([(k, "x")], "k long, v string")), path)
    assert tables.load_table(spark, path, ["k"], filters=[("k", ">", 0)]).count() == 2 and tables.table_columns(spark, path) == ["k", "v"]
    assert tables.load_table(spark, f"{path}-no", missing_ok=True, schema=tables.load_table(spark, path).schema).count() == 0
    source = f"{tmp_path}/in"
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, n long")
    rows.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        events.upsert_stream(stream, f"{path}-s", ["k"], f"{tmp_path}/cp", "n").awaitTermination()
    assert sorted((r.k, r.v) for r in tables.load_table(spark, f"{path}-s").collect()) == [(1, "b"), (2, "c")]
    stream = spark.readStream.schema(rows.schema).parquet(source)
    events.append_once(stream, f"{path}-a", f"{tmp_path}/cp2").awaitTermination()
    assert tables.load_table(spark, f"{path}-a").count() == 3


def test_upserts_rewrite_only_the_buckets_of_their_keys(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda ids, value: spark.createDataFrame([(str(k), "a", value) for k in ids], "id string, part string, value long")
    tables.upsert_table(rows(range(500), 0), path, ["id", "part"])
    before = tables._buckets(tables._current(spark, path))["folders"]
    tables.upsert_table(rows([3, 900], 1), path, ["id", "part"])
    after = tables._buckets(tables._current(spark, path))["folders"]
    assert 1 <= sum(before.get(k) != f for k, f in after.items()) <= 2 and len(before) == tables.BUCKETS
    got = {r.id: r.value for r in tables.load_table(spark, path).collect()}
    assert got == {str(k): int(k == 3) for k in range(500)} | {"900": 1}
    tables.upsert_table(rows([], 2), path, ["id", "part"])
    assert tables.load_table(spark, path, ["id"], filters=[("value", "=", 1)]).count() == 2
    for k in range(4):
        tables.upsert_table(rows([k], 5 + k), path, ["id", "part"])
    assert len(list((tmp_path / "t").glob("v=*"))) == 2 and tables.load_table(spark, path).count() == 501
    wider = rows([7], 9).withColumn("note", F.lit("x"))
    tables.upsert_table(wider, path, ["id", "part"])
    assert {r.note for r in tables.load_table(spark, path).where("id in ('7', '8')").collect()} == {"x", None}
    with pytest.raises(ValueError):
        tables.upsert_table(spark.createDataFrame([(None, "a", 1)], "id string, part string, value long"), path, ["id", "part"])
    with pytest.raises(TypeError):
        tables.upsert_table(spark.createDataFrame([(1, "a", 1)], "id long, part string, value long"), path, ["id", "part"])
    tables.append_table(rows([1000], 1), path)
    assert tables.load_table(spark, path).count() == 502
    tables.upsert_table(rows([1000], 2), path, ["id", "part"])
    assert tables.load_table(spark, path).where("value = 2").count() == 1
