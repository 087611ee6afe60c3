"""Mask arithmetic as relational algebra over spans: (mask, x, y0, y1) with y1 exclusive, one row per vertical run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.sources.tables import shuffled


def spans_of_runs(masks: DataFrame, key: str = "mask_id") -> DataFrame:
    """Spans of masks given by ``runs`` (array of column-major run lengths, background first) and ``height``.

    A run that reaches over the bottom of a column is cut at each column.
    """
    ends = F.transform("runs", lambda _, k: F.aggregate(F.slice("runs", 1, k + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    held = masks.select(key, F.col("height").cast("long").alias("height"), "runs", ends.alias("ends"))
    runs = held.select(key, "height", F.posexplode("runs").alias("k", "n"), "ends").where("k % 2 = 1 and n > 0")
    flat = runs.select(key, "height", (F.get("ends", F.col("k")) - F.col("n")).alias("a"), F.get("ends", F.col("k")).alias("b"))
    first, last = F.floor(F.col("a") / F.col("height")), F.floor((F.col("b") - 1) / F.col("height"))
    columns = flat.select(key, "height", "a", "b", F.explode(F.sequence(first, last)).alias("x"))
    low, high = F.greatest("a", F.col("x") * F.col("height")), F.least("b", (F.col("x") + 1) * F.col("height"))
    return columns.select(key, "x", (low - F.col("x") * F.col("height")).alias("y0"), (high - F.col("x") * F.col("height")).alias("y1"))


def _n() -> Column:
    return F.col("y1") - F.col("y0")


def shape(spans: DataFrame, key: str = "mask_id") -> DataFrame:
    """Per mask area, x, y, width, height, body_length, centroid_x, centroid_y and elongation, in one partial aggregation.

    Sums of coordinates of a span have closed forms, so no pixel is expanded. elongation is the root of the ratio of
    the principal variances, each with a pixel's own 1/12.
    """
    n, y0, y1, x = _n(), F.col("y0"), F.col("y1"), F.col("x")
    sy = (y0 + y1 - 1) * n / 2
    syy = (y1 - 1) * y1 * (2 * y1 - 1) / 6 - (y0 - 1) * y0 * (2 * y0 - 1) / 6
    sums = spans.groupBy(key).agg(
        F.sum(n).alias("area"), F.min("x").alias("x"), F.min("y0").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y1") - F.min("y0")).alias("height"),
        F.sum(x * n).cast("double").alias("_sx"), F.sum(sy).cast("double").alias("_sy"), F.sum(x * x * n).cast("double").alias("_sxx"), F.sum(syy).cast("double").alias("_syy"), F.sum(x * sy).cast("double").alias("_sxy"),
    )
    a = F.col("area")
    mx, my = F.col("_sx") / a, F.col("_sy") / a
    vx, vy, vxy = F.col("_sxx") / a - mx * mx + 1 / 12, F.col("_syy") / a - my * my + 1 / 12, F.col("_sxy") / a - mx * my
    middle, apart = (vx + vy) / 2, F.sqrt(F.pow((vx - vy) / 2, F.lit(2)) + vxy * vxy)
    return sums.select(key, "area", "x", "y", "width", "height", F.col("height").alias("body_length"), mx.alias("centroid_x"), my.alias("centroid_y"), F.sqrt((middle + apart) / (middle - apart)).alias("elongation"))


def max_width(spans: DataFrame, key: str = "mask_id") -> DataFrame:
    """Per mask the widest row, from its first to its last pixel, gaps included."""
    rows = spans.select(key, "x", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    extents = rows.groupBy(key, "y").agg((F.max("x") - F.min("x") + 1).alias("extent"))
    return extents.groupBy(key).agg(F.max("extent").alias("max_width"))


def overlap(pairs: DataFrame, spans: DataFrame, others: DataFrame, key: str = "mask_id") -> DataFrame:
    """(a, b, intersection, iou, coverage) for pairs (a, b) of masks; two empty masks have IoU 1, an empty b coverage 1.

    Spans meet by an equi-join on the pair and the column, so masks are never expanded to pixels.
    """
    left = shuffled(pairs).join(spans.withColumnRenamed(key, "a"), "a").select("a", "b", "x", F.col("y0").alias("p0"), F.col("y1").alias("p1"))
    right = others.select(F.col(key).alias("b"), "x", "y0", "y1")
    met = left.join(shuffled(right), ["b", "x"]).where("p0 < y1 and y0 < p1")
    both = met.groupBy("a", "b").agg(F.sum(F.least("p1", "y1") - F.greatest("p0", "y0")).alias("i"))
    na, nb = (df.groupBy(F.col(key).alias(name)).agg(F.sum(_n()).alias(f"n{name}")) for df, name in ((spans, "a"), (others, "b")))
    out = pairs.join(shuffled(both), ["a", "b"], "left").join(shuffled(na), "a", "left").join(shuffled(nb), "b", "left").fillna(0, ["i", "na", "nb"])
    union = F.col("na") + F.col("nb") - F.col("i")
    return out.select("a", "b", F.col("i").alias("intersection"), F.when(union == 0, 1.0).otherwise(F.col("i") / union).alias("iou"), F.when(F.col("nb") == 0, 1.0).otherwise(F.col("i") / F.col("nb")).alias("coverage"))


def union_of_parts(spans: DataFrame, key: str, part: str, needed: list[str]) -> DataFrame:
    """Spans of the union of several parts for the keys that have them all: touching and overlapping spans of a column are merged."""
    whole = spans.where(F.col(part).isin(needed)).groupBy(key).agg(F.count_distinct(part).alias("_n")).where(F.col("_n") == len(needed)).select(key)
    held = spans.where(F.col(part).isin(needed)).join(whole, key, "left_semi")
    start = F.array().cast("array<struct<y0:bigint,y1:bigint>>")
    wide = lambda a, s: F.struct(a["y0"].cast("long").alias("y0"), F.greatest(a["y1"], s["y1"]).cast("long").alias("y1"))
    whole_span = lambda s: F.struct(s["y0"].cast("long").alias("y0"), s["y1"].cast("long").alias("y1"))

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wide(last, s)))
        return F.when(F.size(acc) == 0, F.array(whole_span(s))).when(last["y1"] >= s["y0"], joined).otherwise(F.concat(acc, F.array(whole_span(s))))

    columns = held.groupBy(key, "x").agg(F.array_sort(F.collect_list(F.struct("y0", "y1"))).alias("s"))
    return columns.select(key, "x", F.explode(F.aggregate("s", start, merge)).alias("m")).select(key, "x", "m.y0", "m.y1")
