"""Queries over masks as spans, colours, stored values, fitted models, events, arrangements and tolerant sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.color import HUE_BANDS, hsv_columns, hue_threshold, in_arc, lab_columns
from gleanery.operators import collage, spans, stored
from gleanery.operators.wide import ID, long_values
from gleanery.plans.relational import query, table
from gleanery.sources import files, tables
from gleanery.streaming import events as streams

# Masks made from part keys: columns 0..p % 7, each a run that starts at (p + x) % 5 and is 1 + (p * (x + 1)) % 4 long.
_SPANS = "sp AS (SELECT p_partkey AS mask_id, x, (p_partkey + x) % 5 AS y0, (p_partkey + x) % 5 + 1 + (p_partkey * (x + 1)) % 4 AS y1 FROM (SELECT p_partkey, unnest(range(0, p_partkey % 7 + 1)) AS x FROM part)), px AS (SELECT mask_id, x, unnest(range(y0, y1)) AS y FROM sp)"


def part_spans(spark, sf_dir):
    p = tables.spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("mask_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 7)).alias("x"))
    y0 = (F.col("mask_id") + F.col("x")) % 5
    return p.select("mask_id", "x", y0.alias("y0"), (y0 + 1 + (F.col("mask_id") * (F.col("x") + 1)) % 4).alias("y1"))


@query(
    f"""WITH {_SPANS}, m AS (SELECT mask_id, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, avg(x) AS cx, avg(y) AS cy, var_pop(x) + 1 / 12.0 AS vx, var_pop(y) + 1 / 12.0 AS vy, covar_pop(x, y) AS vxy FROM px GROUP BY mask_id)
SELECT mask_id, area, x, y, width, height, height AS body_length, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(sqrt(((vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + vxy * vxy)) / ((vx + vy) / 2 - sqrt(pow((vx - vy) / 2, 2) + vxy * vxy))), 6) AS elongation FROM m"""
)
def span_shape(spark, sf_dir):
    """Area, box, centroid and elongation of masks, by closed forms over spans."""
    df = spans.shape(part_spans(spark, sf_dir))
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long") for c, t in df.dtypes])


@query(f"WITH {_SPANS} SELECT mask_id, max(w) AS max_width FROM (SELECT mask_id, y, max(x) - min(x) + 1 AS w FROM px GROUP BY mask_id, y) GROUP BY mask_id")
def span_max_width(spark, sf_dir):
    """The widest row of each mask, gaps included."""
    return spans.max_width(part_spans(spark, sf_dir))


@query(
    f"""WITH {_SPANS}, pairs AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey % 2 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)),
i AS (SELECT a, b, count(*) AS n FROM pairs JOIN px p ON p.mask_id = a JOIN px q ON q.mask_id = b AND p.x = q.x AND p.y = q.y GROUP BY a, b), s AS (SELECT mask_id, count(*) AS n FROM px GROUP BY mask_id)
SELECT a, b, coalesce(i.n, 0) AS intersection, round(coalesce(i.n, 0) / (s.n + t.n - coalesce(i.n, 0))::DOUBLE, 9) AS iou, round(coalesce(i.n, 0) / t.n::DOUBLE, 9) AS coverage FROM pairs LEFT JOIN i USING (a, b) JOIN s ON s.mask_id = a JOIN s t ON t.mask_id = b"""
)
def span_overlap(spark, sf_dir):
    """Intersection over union and coverage of pairs of masks, without expanding a pixel."""
    s = part_spans(spark, sf_dir)
    keys = table(spark, sf_dir, "part").select("p_partkey")
    pairs = keys.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")).join(tables.shuffled(keys), F.col("b") == F.col("p_partkey"), "left_semi")
    return spans.overlap(pairs, s, s).select("a", "b", "intersection", F.round("iou", 9).alias("iou"), F.round("coverage", 9).alias("coverage"))


@query(f"WITH {_SPANS}, u AS (SELECT mask_id // 2 AS body, count(DISTINCT mask_id) AS n FROM sp GROUP BY body) SELECT body, count(DISTINCT (x, y)) AS area FROM px p JOIN u ON u.body = p.mask_id // 2 AND u.n = 2 GROUP BY body")
def span_union(spark, sf_dir):
    """Union of the parts of a body, for bodies that have them all."""
    s = part_spans(spark, sf_dir).select(F.floor(F.col("mask_id") / 2).alias("body"), (F.col("mask_id") % 2).cast("string").alias("part"), "x", "y0", "y1")
    return spans.union_of_parts(s, "body", "part", ["0", "1"]).groupBy("body").agg(F.sum(F.col("y1") - F.col("y0")).alias("area"))


@query("SELECT p_partkey AS mask_id, (3 + p_partkey % 5) + 2 AS area, 1 + (p_partkey % 3 + 3 + p_partkey % 5 - 1) // 10 - (p_partkey % 3) // 10 + 0 AS n_spans_first FROM part")
def rle_spans(spark, sf_dir):
    """Spans of run-length masks: a run of background, one of mask, background up to the third column, and two pixels of mask."""
    p = table(spark, sf_dir, "part")
    first, run = F.col("p_partkey") % 3, 3 + F.col("p_partkey") % 5
    masks = p.select(F.col("p_partkey").alias("mask_id"), F.lit(10).alias("height"), F.array(first, run, 20 - first - run, F.lit(2).cast("long"), F.lit(8).cast("long")).alias("runs"))
    s = spans.spans_of_runs(masks)
    return s.groupBy("mask_id").agg(F.sum(F.col("y1") - F.col("y0")).alias("area"), F.count_if(F.col("x") < 2).alias("n_spans_first"))


_RGB = "c AS (SELECT p_partkey, p_brand, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 53) % 256 AS b FROM part)"
_HSV = f"{_RGB}, n AS (SELECT *, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z FROM c), m AS (SELECT *, greatest(x, y, z) AS v, greatest(x, y, z) - least(x, y, z) AS d FROM n), hsv AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (60 * CASE WHEN v = x THEN (y - z) / d WHEN v = y THEN 2 + (z - x) / d ELSE 4 + (x - y) / d END + 360) % 360 END AS h, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s FROM m)"
_LIN = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
_LAB = f"{_HSV}, lin AS (SELECT p_partkey, p_brand, {_LIN.format('x')} AS lr, {_LIN.format('y')} AS lg, {_LIN.format('z')} AS lb FROM m), xyz AS (SELECT p_partkey, p_brand, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS x, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS y, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS z FROM lin), f AS (SELECT *, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16 / 116.0 END AS fx, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16 / 116.0 END AS fy, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16 / 116.0 END AS fz FROM xyz), lab AS (SELECT p_partkey, p_brand, CASE WHEN y > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * y END AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f)"


def _rgb(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", (k * 37 % 256).alias("r"), (k * 91 % 256).alias("g"), (k * 53 % 256).alias("b"))


@query(f"WITH {_LAB} SELECT p_partkey, round(hsv.h, 4) AS h, round(hsv.s, 6) AS s, round(hsv.v, 6) AS v, round(lab.l, 4) AS l, round(lab.a, 4) AS a, round(lab.b, 4) AS bb FROM hsv JOIN lab USING (p_partkey)")
def color_spaces(spark, sf_dir):
    """8-bit colours in HSV and Lab, in the JVM."""
    hsv, lab = (make(F.col("r"), F.col("g"), F.col("b")) for make in (hsv_columns, lab_columns))
    return _rgb(spark, sf_dir).select("p_partkey", F.round(hsv["h"], 4).alias("h"), F.round(hsv["s"], 6).alias("s"), F.round(hsv["v"], 6).alias("v"), F.round(lab["l"], 4).alias("l"), F.round(lab["a"], 4).alias("a"), F.round(lab["b"], 4).alias("bb"))


@query(
    f"WITH {_LAB} SELECT hsv.p_brand, round(avg(CASE WHEN (h >= 340 OR h < 22) AND s >= 0.25 AND v >= 0.15 THEN 1.0 ELSE 0.0 END), 9) AS red_fraction, round(avg(CASE WHEN h >= 72 AND h < 172 AND s >= 0.25 AND v >= 0.15 THEN 1.0 ELSE 0.0 END), 9) AS green_fraction, round(avg(CASE WHEN l < 20 THEN 1.0 ELSE 0.0 END), 9) AS black_fraction FROM hsv JOIN lab USING (p_partkey) GROUP BY hsv.p_brand"
)
def hue_fractions(spark, sf_dir):
    """Shares of pixels in hue bands that wrap, and of dark ones."""
    hsv, lab = (make(F.col("r"), F.col("g"), F.col("b")) for make in (hsv_columns, lab_columns))
    share = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 9)
    return _rgb(spark, sf_dir).groupBy("p_brand").agg(share(hue_threshold("red").holds(lambda _, c: hsv[c])).alias("red_fraction"), share(hue_threshold("green").holds(lambda _, c: hsv[c])).alias("green_fraction"), share(lab["l"] < 20).alias("black_fraction"))


@query(f"WITH {_HSV} SELECT p_partkey, CASE WHEN h >= 340 OR h < 22 THEN 'red' WHEN h < 42 THEN 'orange' WHEN h < 72 THEN 'yellow' WHEN h < 172 THEN 'green' WHEN h < 262 THEN 'blue' WHEN h < 322 THEN 'purple' END AS band FROM hsv")
def hue_bands(spark, sf_dir):
    """The named hue band of each colour."""
    hsv = hsv_columns(F.col("r"), F.col("g"), F.col("b"))
    band = F.lit(None).cast("string")
    for name, (a, b) in HUE_BANDS.items():
        band = F.when(in_arc(hsv["h"], a, b), name).otherwise(band)
    return _rgb(spark, sf_dir).select("p_partkey", band.alias("band"))


@query(
    """WITH s AS (SELECT p_partkey, (p_partkey % 10) / 20.0::DOUBLE AS red, (p_partkey % 7) / 14.0::DOUBLE AS green, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 3) / 10.0::DOUBLE END AS blue FROM part),
r AS (SELECT *, list_sort([{'s': -red, 'k': 0, 'n': 'red'}, {'s': -green, 'k': 1, 'n': 'green'}, {'s': -coalesce(blue, 0), 'k': 2, 'n': 'blue'}]) AS l FROM s), f AS (SELECT *, list_filter(l, lambda x: -x.s >= 0.1) AS p FROM r)
SELECT p_partkey, red >= 0.1 AS present_red, green >= 0.1 AS present_green, coalesce(blue >= 0.1, false) AS present_blue, len(p) AS n_present, p[1].n AS color_1, p[2].n AS color_2 FROM f"""
)
def color_presence(spark, sf_dir):
    """Which colours are there, how many, and the two largest."""
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select("p_partkey", ((k % 10) / 20).alias("red"), ((k % 7) / 14).alias("green"), F.when(k % 4 > 0, (k % 3) / 10).alias("blue"))
    return stored.color_presence(s, ["red", "green", "blue"]).drop("red", "green", "blue")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract(props, '$.k')::DOUBLE WHEN event_id % 3 = 1 THEN value ELSE NULL END AS v0 FROM events")
def feature_vectors(spark, sf_dir):
    """Stored values as feature vectors: objects by key, numbers alone, texts not at all."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("props")).when(k == 1, F.col("value").cast("string")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    return e.select("event_id", F.get(stored.feature_vector(F.parse_json(text)), 0).alias("v0"))


@query(
    """WITH d AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier), g AS (SELECT s_nationkey, count(*) AS n, avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM d GROUP BY s_nationkey HAVING count(*) >= 4), a AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM d)
SELECT s_suppkey, g.s_nationkey AS fit_group, round((s_acctbal - coalesce(g.m, a.m)) / coalesce(g.s, a.s), 6) AS z_s_acctbal FROM d LEFT JOIN g USING (s_nationkey), a"""
)
def group_zscores(spark, sf_dir):
    """Standard scores against the row's group, small groups against the population."""
    z = stored.group_zscores(table(spark, sf_dir, "supplier"), ["s_acctbal"], "s_nationkey", 4)
    return z.select("s_suppkey", "fit_group", F.round("z_s_acctbal", 6).alias("z_s_acctbal"))


@query("SELECT event_type, count(*) AS n_values, count(DISTINCT user_id) AS n_occurrences FROM events GROUP BY event_type")
def summary(spark, sf_dir):
    return stored.summary(table(spark, sf_dir, "events"), ["event_type"], "user_id")


@query("SELECT s_suppkey, round(CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal / (1 + s_nationkey) END, 6) AS ratio FROM supplier")
def derived_metric(spark, sf_dir):
    """A value from stored ones, only where all are there."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal")).alias("bal"))
    return stored.derived(s, "ratio", "bal / (1 + s_nationkey)", ["bal", "s_nationkey"]).select("s_suppkey", F.round("ratio", 6).alias("ratio"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Events per day and type; the same plan runs on a stream with a watermark."""
    w = streams.windowed(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"])
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 1 HOUR)::TIMESTAMP AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, sf_dir):
    """Sessions of a user: events without a pause of an hour."""
    s = streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "1 hour")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS slot, ceil(sqrt(count(*) OVER ()))::BIGINT AS c FROM part WHERE p_retailprice IS NOT NULL) SELECT p_partkey, slot, (slot % c)::DOUBLE AS x, (slot // c)::DOUBLE AS y FROM p")
def collage_grid(spark, sf_dir):
    """Items by value on a grid."""
    items = collage.sort_by(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")
    return collage.placements(items, collage.grid, id_col="p_partkey").select("p_partkey", "slot", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("WITH g AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS group_order FROM part GROUP BY p_brand) SELECT p_partkey, p_brand AS \"group\", group_order FROM part JOIN g USING (p_brand)")
def collage_groups(spark, sf_dir):
    """Groups of items, the largest first."""
    return collage.group_by(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "size").select("p_partkey", "group", F.col("group_order").cast("long").alias("group_order"))


@query("SELECT count(*) AS records, count(*) FILTER (page_id % 5 = 0) AS fifths FROM pages WHERE page_id % 7 > 0")
def jsonl_scan(spark, sf_dir):
    """A JSON lines log with broken lines: those are left out."""
    pages = table(spark, sf_dir, "pages")
    path = f"{tables.shared_folder(spark)}/gleanery/jsonl-{spark.sparkContext.applicationId}"
    broken = F.when(F.col("page_id") % 7 == 0, F.lit('{"page_id": ')).otherwise(F.concat(F.lit('{"page_id": '), F.col("page_id").cast("string"), F.lit("}")))
    pages.select(broken.alias("value")).write.mode("overwrite").text(path)
    read = tables.read_jsonl(spark, path).select(F.variant_get("record", "$.page_id", "bigint").alias("id"))
    return read.agg(F.count("*").alias("records"), F.count_if(F.col("id") % 5 == 0).alias("fifths"))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_partkey % 6 > 0")
def malformed_tsv(spark, sf_dir):
    """A tab-separated table with rows of a wrong width: those are left out."""
    p = table(spark, sf_dir, "part")
    path = f"{tables.shared_folder(spark)}/gleanery/tsv-{spark.sparkContext.applicationId}"
    line = F.when(F.col("p_partkey") % 6 == 0, F.col("p_name")).otherwise(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name"))
    head = spark.createDataFrame([(-1, "id\tname")], "k long, value string")
    rows = head.union(p.select("p_partkey", line)).coalesce(1).sortWithinPartitions("k").select("value")
    rows.write.mode("overwrite").text(path)
    return files.read_tsv(spark, path).select("id", "name")


@query("SELECT DISTINCT user_id::VARCHAR AS occurrence_id FROM events WHERE value > 50")
def ids_with_value(spark, sf_dir):
    """Occurrences that have a stored value passing a test."""
    long = long_values(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), "events", F.lit("user"), "value", F.col("value"))
    return long.where(F.try_variant_get("value", "$", "double") > 50).select(ID).distinct()
