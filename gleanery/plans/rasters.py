"""Queries over drawn images: segmentation, transforms and metrics run by recipes, held against pixel counts in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.color import hue_thresholds
from gleanery.functions.rle import decode, mask_digest
from gleanery.plans import recipes as r
from gleanery.plans.recipes import ID, Operation, Recipe, execute
from gleanery.plans.relational import query, table
from gleanery.sources import tables

HEIGHT, WIDTH = 24, 32
#: RGB of the bodies by part key, and of the ground.
BODIES, GROUND = ((200, 60, 60), (60, 200, 60), (60, 60, 200), (200, 200, 60)), 40
# One image for each part: a body of a size and place by its key, and an island of four pixels on every third.
_BODY = "b AS (SELECT p_partkey AS k, 2 + p_partkey % 5 AS x0, 3 + p_partkey % 4 AS y0, 6 + p_partkey % 7 AS w, 5 + p_partkey % 6 AS h, p_partkey % 3 = 0 AS island, p_partkey % 4 AS c FROM part)"
_PIXELS = (
    f"{_BODY}, g AS (SELECT * FROM (SELECT unnest(range({WIDTH})) AS x), (SELECT unnest(range({HEIGHT})) AS y)), "
    "a AS (SELECT k, w, h, x0, y0, c, x, y, (x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h) AS body, (x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h) OR (island AND x IN (26, 27) AND y IN (20, 21)) AS m FROM b, g), "
    "px AS (SELECT * FROM a WHERE m)"
)
_RGB = "CASE c " + " ".join(f"WHEN {k} THEN [{', '.join(map(str, rgb))}]" for k, rgb in enumerate(BODIES)) + " END"


def drawn(spark, sf_dir: str) -> DataFrame:
    """(occurrence_id, height, width, data): the images, BGR."""

    def draw(frames):
        for pdf in frames:
            out = []
            for k in pdf["k"].tolist():
                image = np.full((HEIGHT, WIDTH, 3), GROUND, np.uint8)
                colour = BODIES[k % 4][::-1]
                y, x = 3 + k % 4, 2 + k % 5
                image[y : y + 5 + k % 6, x : x + 6 + k % 7] = colour
                if k % 3 == 0:
                    image[20:22, 26:28] = colour
                out.append((str(k), HEIGHT, WIDTH, image.tobytes()))
            yield pd.DataFrame(out, columns=[ID, "height", "width", "data"]).astype({"height": "int32", "width": "int32"})

    return tables.spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k").mapInPandas(draw, f"{ID} string, height int, width int, data binary")


def segmented(work: DataFrame, *kept: str) -> DataFrame:
    """The masks that the brightness model finds in ``work``, with columns ``kept`` of it."""
    return execute(work, Recipe("segment", "bodies", [r.segment(r.BrightnessModel())]), kept).where("status = 'done'")


def measured(spark, sf_dir: str, operations: list[Operation]) -> DataFrame:
    """(k, metric_name, value_json) of a recipe over the segmented images, each with its mask from one pass to the next; what transforms recorded is there too."""
    work = segmented(drawn(spark, sf_dir), "height", "width", "data").select(ID, "height", "width", "data", *r.MASK)
    found = execute(work, Recipe("metric", "traits", operations)).where("status = 'done'")
    return found.select(F.col(ID).cast("long").alias("k"), "metric_name", "value_json")


def one_row(rows: DataFrame, **columns: tuple[str, str | None, str]) -> DataFrame:
    """One row per k; each column is (metric, key of its object or None, type), doubles rounded."""
    made = []
    for name, (metric, key, kind) in columns.items():
        value = F.get_json_object("value_json", f"$.{key}") if key else F.col("value_json")
        value = F.max(F.when(F.col("metric_name") == metric, value)).cast(kind)
        made.append((F.round(value, 6) if kind == "double" else value).alias(name))
    return rows.groupBy("k").agg(*made)


@query(f"WITH {_PIXELS} SELECT k, count(*) AS area, round(count(*) / {HEIGHT * WIDTH}.0::DOUBLE, 6) AS score, {HEIGHT} AS rle_height, {WIDTH} AS rle_width FROM px GROUP BY k")
def raster_segment(spark, sf_dir):
    """A segmenter run over images: area, score and frame of each mask."""
    found = segmented(drawn(spark, sf_dir))
    return found.select(F.col(ID).cast("long").alias("k"), F.col("area").cast("long").alias("area"), F.round("score", 6).alias("score"), "rle_height", "rle_width")


@query(f"WITH {_PIXELS}, s AS (SELECT k, list((x, y) ORDER BY x, y) AS pixels FROM px GROUP BY k) SELECT min(k) AS first, count(*) AS same, any_value(len(pixels)) AS area FROM s GROUP BY pixels")
def mask_digests(spark, sf_dir):
    """Masks decoded from their stored runs, and which of them are the same by digest."""

    @F.pandas_udf("digest string, area long")
    def read(counts: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        masks = [decode(bytes(c), a, b) for c, a, b in zip(counts, h, w, strict=True)]
        return pd.DataFrame({"digest": [mask_digest(m) for m in masks], "area": [int(m.sum()) for m in masks]})

    found = segmented(drawn(spark, sf_dir)).select(F.col(ID).cast("long").alias("k"), read("rle_counts", "rle_height", "rle_width").alias("m"))
    return found.groupBy("m.digest").agg(F.min("k").alias("first"), F.count("*").alias("same"), F.max("m.area").alias("area")).drop("digest")


@query(f"WITH {_PIXELS}, s AS (SELECT k, y, max(x) - min(x) + 1 AS across FROM px GROUP BY k, y) SELECT k, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, max(y) - min(y) + 1 AS body_length, max(across) AS max_width FROM px JOIN s USING (k, y) GROUP BY k")
def raster_box(spark, sf_dir):
    """Area, bounding box, length and width of masks."""
    rows = measured(spark, sf_dir, [r.mask_area(), r.bounding_box(), r.body_length(), r.max_width()])
    box = {c: ("bounding_box", c, "long") for c in ("x", "y", "width", "height")}
    return one_row(rows, area=("area_px", None, "long"), body_length=("body_length", None, "long"), max_width=("max_width", None, "long"), **box)


@query(
    f"""WITH {_PIXELS}, m AS (SELECT k, avg(x) AS cx, avg(y) AS cy, var_pop(x) + 1 / 12.0 AS vx, var_pop(y) + 1 / 12.0 AS vy, covar_pop(x, y) AS vxy, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM px GROUP BY k)
SELECT k, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(cx / {WIDTH}, 6) AS relative_x, round(cy / {HEIGHT}, 6) AS relative_y, x, y, width, height,
  round(sqrt(((vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + vxy * vxy)) / ((vx + vy) / 2 - sqrt(pow((vx - vy) / 2, 2) + vxy * vxy))), 6) AS elongation FROM m"""
)
def raster_position(spark, sf_dir):
    """Centroid, relative position, bounds in the frame and elongation of masks."""
    rows = measured(spark, sf_dir, [r.centroid(), r.relative_position(), r.image_bounds(), r.elongation()])
    box = {c: ("image_bounds", c, "long") for c in ("x", "y", "width", "height")}
    points = {f"{name}_{c}": (metric, c, "double") for name, metric in (("centroid", "centroid"), ("relative", "relative_position")) for c in "xy"}
    return one_row(rows, elongation=("elongation", None, "double"), **points, **box)


@query(
    f"""WITH {_PIXELS}, i AS (SELECT k, count(*) FILTER (NOT body) > 0 AS island FROM px GROUP BY k), c AS (SELECT k, 2 * avg(x) AS twice FROM px GROUP BY k),
f AS (SELECT k, count(*) AS n, count(*) FILTER (x >= 0 AND x < {WIDTH}) AS mirrored, count(q.k) AS matched FROM (SELECT px.k, px.y, round_even(twice - px.x, 0)::BIGINT AS x FROM px JOIN c USING (k)) t LEFT JOIN (SELECT k, x, y FROM px) q USING (k, x, y) GROUP BY k)
SELECT k, island::BIGINT AS n_islands, round(n / {HEIGHT * WIDTH}.0::DOUBLE, 6) AS mask_fraction, 0.0::DOUBLE AS edge_fraction, round(1 - matched / (n + mirrored - matched)::DOUBLE, 6) AS asymmetry FROM i JOIN f USING (k)"""
)
def raster_quality(spark, sf_dir):
    """Islands, share of the frame, share on its edge and asymmetry of masks."""
    rows = measured(spark, sf_dir, [r.n_islands(), r.mask_fraction(), r.edge_fraction(), r.bilateral_asymmetry()])
    return one_row(rows, n_islands=("n_islands", None, "long"), mask_fraction=("mask_fraction", None, "double"), edge_fraction=("edge_fraction", None, "double"), asymmetry=("bilateral_asymmetry", None, "double"))


@query(f"WITH {_PIXELS}, n AS (SELECT k, count(*) AS was, count(*) FILTER (body) AS area FROM px GROUP BY k) SELECT k, area, was - area > 0 AS dropped, round(1 - area / was::DOUBLE, 6) AS removed_fraction FROM n")
def raster_remove_islands(spark, sf_dir):
    """The largest component alone, and what went."""
    rows = measured(spark, sf_dir, [r.remove_islands(), r.mask_area()])
    found = one_row(rows, area=("area_px", None, "long"), n=("remove_islands", "n_removed", "long"), removed_fraction=("remove_islands", "removed_fraction", "double"))
    return found.select("k", "area", (F.col("n") > 0).alias("dropped"), "removed_fraction")


@query(f"WITH {_PIXELS}, q AS (SELECT k, x, y FROM px), n AS (SELECT p.k, p.x, p.y FROM q p JOIN q o ON o.k = p.k AND abs(o.x - p.x) + abs(o.y - p.y) = 1 GROUP BY ALL HAVING count(*) = 4) SELECT k, count(*) AS area FROM n GROUP BY k")
def raster_erode(spark, sf_dir):
    """Masks without their outermost pixels."""
    return one_row(measured(spark, sf_dir, [r.erode(px=1), r.mask_area()]), area=("area_px", None, "long"))


@query(f"WITH {_PIXELS} SELECT k, count(*) FILTER (x < {WIDTH // 2}) AS area, {WIDTH // 2}::BIGINT AS width, {HEIGHT}::BIGINT AS height FROM px GROUP BY k")
def raster_crop(spark, sf_dir):
    """The left half of the frame: the crop's box, and the mask in it."""
    rows = measured(spark, sf_dir, [r.crop("left"), r.mask_area()])
    return one_row(rows, area=("area_px", None, "long"), width=("crop", "width", "long"), height=("crop", "height", "long"))


@query(f"WITH {_BODY} SELECT k, x0 AS x, y0 AS y, w AS width, h AS height, 1.0::DOUBLE AS mask_fraction FROM b")
def raster_inscribed(spark, sf_dir):
    """The largest box inside the largest component."""
    rows = measured(spark, sf_dir, [r.remove_islands(), r.crop_inside_mask(), r.mask_fraction()])
    box = {c: ("crop_inside_mask", c, "long") for c in ("x", "y", "width", "height")}
    return one_row(rows, mask_fraction=("crop_inside_mask", "mask_fraction", "double"), **box)


@query(f"WITH {_BODY} SELECT k, h AS width, w AS height, w * h AS area, greatest(w, h) AS oriented FROM b")
def raster_turn(spark, sf_dir):
    """A quarter turn swaps the box's sides; orienting puts the longer one upright."""
    turned = one_row(measured(spark, sf_dir, [r.remove_islands(), r.rotate(90), r.bounding_box(), r.mask_area()]), width=("bounding_box", "width", "long"), height=("bounding_box", "height", "long"), area=("area_px", None, "long"))
    upright = one_row(measured(spark, sf_dir, [r.remove_islands(), r.orient(axis_strategy="longer"), r.body_length()]), oriented=("body_length", None, "long"))
    return turned.join(upright, "k")


@query(f"WITH {_PIXELS} SELECT k, 4 * count(*) AS area, 2 * min(x) AS x, 2 * (max(y) - min(y) + 1) AS height, {2 * WIDTH}::BIGINT AS frame FROM px GROUP BY k")
def raster_resize(spark, sf_dir):
    """Twice the size."""
    rows = measured(spark, sf_dir, [r.resize(scale=2), r.mask_area(), r.bounding_box()])
    return one_row(rows, area=("area_px", None, "long"), x=("bounding_box", "x", "long"), height=("bounding_box", "height", "long"), frame=("resize", "width", "long"))


_MEANS = f"s AS (SELECT k, {_RGB} AS rgb, count(*) AS n FROM px GROUP BY k, c)"


@query(
    f"""WITH {_PIXELS}, {_MEANS}, w AS (SELECT k, rgb, list_transform(rgb, lambda v: (v * n + {GROUND} * ({HEIGHT * WIDTH} - n)) / {HEIGHT * WIDTH}.0::DOUBLE) AS frame FROM s)
SELECT k, round(rgb[1] / 255.0::DOUBLE, 6) AS r, round(rgb[2] / 255.0::DOUBLE, 6) AS g, round(rgb[3] / 255.0::DOUBLE, 6) AS b, round({GROUND} / 255.0::DOUBLE, 6) AS ground,
  round(least(255, rgb[1] * list_avg(frame) / frame[1]) / 255, 6) AS balanced_r, round(least(255, rgb[3] * list_avg(frame) / frame[3]) / 255, 6) AS balanced_b FROM w"""
)
def raster_colors(spark, sf_dir):
    """Mean colour under the mask, as it is and after white balance, and of the ground."""
    rows = measured(spark, sf_dir, [r.mean_color(), r.background_color(), r.white_balanced_color()])
    means = {c: ("mean_color", c, "double") for c in "rgb"} | {f"balanced_{c}": ("white_balanced_color", c, "double") for c in "rb"}
    return one_row(rows, ground=("background_color", "g", "double"), **means)


@query(
    f"WITH {_BODY} SELECT k, (c = 0)::INT::DOUBLE AS red, (c = 1)::INT::DOUBLE AS green, (c = 2)::INT::DOUBLE AS blue, (c = 3)::INT::DOUBLE AS yellow, 0.0::DOUBLE AS purple, 0.0::DOUBLE AS unmatched, (c = 0)::INT::DOUBLE AS red_fraction, 0.0::DOUBLE AS black_fraction FROM b"
)
def raster_thresholds(spark, sf_dir):
    """Shares of the masked pixels by hue band, of none, and of dark ones."""
    rows = measured(spark, sf_dir, [r.threshold_fractions(hue_thresholds(), unmatched=True), r.red_fraction(), r.black_fraction()])
    bands = {c: ("threshold_fractions", c, "double") for c in ("red", "green", "blue", "yellow", "purple", "unmatched")}
    return one_row(rows, red_fraction=("red_fraction", None, "double"), black_fraction=("black_fraction", None, "double"), **bands)


@query(f"WITH {_PIXELS} SELECT k, 0.0::DOUBLE AS ground, round(1 - count(*) / {HEIGHT * WIDTH}.0::DOUBLE, 6) AS background_fraction, any_value({_RGB})[1] / 255.0::DOUBLE >= 0 AS kept FROM px GROUP BY k, c")
def raster_remove_background(spark, sf_dir):
    """The ground set to black; the body stays."""
    rows = measured(spark, sf_dir, [r.remove_background(), r.background_color(), r.mean_color()])
    found = one_row(rows, ground=("background_color", "r", "double"), background_fraction=("remove_background", "background_fraction", "double"), red=("mean_color", "r", "double"))
    return found.select("k", "ground", "background_fraction", (F.col("red") > 0.2).alias("kept"))
