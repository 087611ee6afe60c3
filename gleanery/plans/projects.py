"""Queries over whole projects: values stored as runs, currency, selections, exports, ingest and resumable work, held against SQL over the tables that fed them."""

from __future__ import annotations

import sqlite3
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.identity import canonical_json, hash_spec, ids_fingerprint
from gleanery.functions.naming import repeated_labels
from gleanery.operators import collage, groupfit, selection, stored, validate
from gleanery.plans import rasters
from gleanery.plans import recipes as r
from gleanery.plans.project import ID, Project
from gleanery.plans.relational import query, table
from gleanery.sources import files, tables
from gleanery.streaming import events as streams


def folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_folder(spark)}/gleanery/{name}-{uuid.uuid4().hex}"


def customers(spark, sf_dir: str, images: bool = False) -> Project:
    """A project of customers: their segment and nation, and a run ``traits`` of balance (px) and, for even keys, weight (a dict)."""
    p = Project(spark, folder(spark, "project"))
    c = table(spark, sf_dir, "customer")
    p.ingest_occurrences(c.select(F.col("c_custkey").cast("string").alias(ID), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_custkey").alias("k")))
    p.store_values(c.select(F.col("c_custkey").alias(ID), F.col("c_acctbal").alias("value")), "traits", "balance", unit="px")
    return p


def number(name: str, metric: str):
    return F.round(F.try_variant_get(F.col(f"`{metric}`"), "$", "double"), 6).alias(name)


@query(
    "SELECT c_custkey::VARCHAR AS occurrence_id, run AS run_name, 'organism' AS part, metric AS metric_name, unit, round(v, 6) AS v FROM (SELECT c_custkey, 'traits' AS run, 'balance' AS metric, 'px' AS unit, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'checks', 'nation', NULL, c_nationkey FROM customer WHERE c_custkey % 2 = 0)"
)
def project_metrics(spark, sf_dir):
    """Stored values joined to their runs."""
    p = customers(spark, sf_dir)
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    p.store_values(c.select(F.col("c_custkey").alias(ID), F.col("c_nationkey").alias("value")), "checks", "nation")
    return p.load_metrics(["traits", "checks"]).select(ID, "run_name", "part", "metric_name", "unit", F.round(F.try_variant_get("value", "$", "double"), 6).alias("v"))


@query(
    "SELECT c_custkey::VARCHAR AS occurrence_id, c_mktsegment AS segment, round(c_acctbal, 6) AS balance FROM customer WHERE c_custkey % 3 > 0 AND c_acctbal > 100 AND c_nationkey % 5 < 3"
)
def project_filtered_wide(spark, sf_dir):
    """Occurrences joined to one run's values, filtered by a column of another run that is read for that only."""
    p = customers(spark, sf_dir)
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0")
    p.store_values(c.select(F.col("c_custkey").alias(ID), (F.col("c_nationkey") % 5).alias("value")), "checks", "rest")
    made = p.filtered_wide(["traits"], filters={"traits__organism__balance": (">", 100), "checks__organism__rest": ("<", 3)}, occurrence_columns=["segment"])
    assert made.hidden == ["checks__organism__rest"] and made.metric_columns == ["traits__organism__balance"]
    return made.df.select(ID, "segment", F.round("traits__organism__balance", 6).alias("balance"))


@query(
    """WITH w AS (SELECT c_custkey AS k, c_mktsegment, round(c_acctbal / 4, 6) AS b, round(c_nationkey / 4.0::DOUBLE, 6) AS n FROM customer)
SELECT k::VARCHAR AS occurrence_id, c_mktsegment AS market, CASE WHEN b >= 0 THEN b END AS balance_mm, n AS nation_mm FROM w WHERE n > 1"""
)
def project_export(spark, sf_dir):
    """An export read back: millimetres by a declared scale, filtered, failing parts blanked, renamed, written as CSV."""
    p = customers(spark, sf_dir)
    p.store_values(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ID), F.col("c_nationkey").alias("value")), "traits", "nation", part="home", unit="px")
    p.declare_scale(4.0, "segment")
    path = folder(spark, "export")
    names = {"segment": "market", "traits__organism__balance_mm": "balance_mm", "traits__home__nation_mm": "nation_mm"}
    p.export_metrics(path, ["traits"], units="mm", filters={"traits__home__nation_mm": (">", 1)}, part_filters={"organism": {"traits__organism__balance_mm": (">=", 0)}}, occurrence_columns=["segment"], rename=names)
    back = files.read_csv(spark, path)
    return back.select(ID, "market", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("balance_mm", "nation_mm")])


@query("SELECT count(*) AS n_rows, 'px' AS unit, 1 AS filters, 1 AS columns FROM customer WHERE c_acctbal > 500")
def project_manifest(spark, sf_dir):
    """What the record of an export says of it, and the units of its columns."""
    p = customers(spark, sf_dir)
    p.export_metrics(folder(spark, "export"), ["traits"], filters={"traits__organism__balance": (">", 500)})
    last, units = p.load_exports()[-1], p.export_units(["traits"])
    return spark.createDataFrame([(last["n_rows"], units["traits__organism__balance"], len(last["filters"]), len(last["columns"]))], "n_rows long, unit string, filters int, columns int")


@query(
    "SELECT 'passing' AS kind, c_custkey::VARCHAR AS occurrence_id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'matching', c_custkey::VARCHAR FROM customer WHERE c_nationkey IN (3, 4) UNION ALL SELECT 'completed', c_custkey::VARCHAR FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT 'selected', c_custkey::VARCHAR FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'queried', c_custkey::VARCHAR FROM customer WHERE c_custkey > 50 AND c_mktsegment <> 'BUILDING' UNION ALL SELECT 'frozen', c_custkey::VARCHAR FROM customer WHERE c_custkey % 10 = 7"
)
def project_ids(spark, sf_dir):
    """Ids that pass filters, match stored values, are completed, or belong to a subset by values, by query or by ids."""
    p = customers(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias(ID), F.col("c_nationkey").alias("value"), F.col("c_custkey").alias("k"))
    p.store_values(c.select(ID, "value"), "homes", "nation")
    p.store_values(c.where("k % 4 = 1").select(ID, "value"), "some", "nation")
    p.define_subset("chosen", column="segment", values=["BUILDING", "MACHINERY"])
    p.define_subset("asked", query="k > 50 and segment != 'BUILDING'")
    p.define_subset("held", ids=c.where("k % 10 = 7"))
    found = {"passing": p.ids_passing({"traits__organism__balance": (">", 5000)}, ["traits"]), "matching": p.ids_matching("homes", {"nation": [3, 4]}), "completed": p.ids_completed("some"), "selected": p.select_ids("chosen"), "queried": p.select_ids("asked"), "frozen": p.select_ids("held")}
    out = None
    for kind, ids in found.items():
        part = ids.select(F.lit(kind).alias("kind"), ID)
        out = part if out is None else out.union(part)
    return out


@query("SELECT c_custkey::VARCHAR AS occurrence_id, (CASE c_mktsegment WHEN 'BUILDING' THEN 8 ELSE 2 END)::DOUBLE AS px_per_mm FROM customer WHERE c_custkey % 9 > 0 UNION ALL SELECT c_custkey::VARCHAR, 5.0 FROM customer WHERE c_custkey % 9 = 0")
def project_scales(spark, sf_dir):
    """Scales declared for every value of a column, for one value, and for single occurrences: the narrowest wins."""
    p = customers(spark, sf_dir)
    p.declare_scale(2.0, "segment")
    p.declare_scale(8.0, "segment", "BUILDING")
    own = table(spark, sf_dir, "customer").where("c_custkey % 9 = 0").select(F.col("c_custkey").cast("string")).collect()  # a person's list
    p.save_calibrations([(ID, x[0], {"px_per_mm": 5.0}) for x in own])
    return p.scale_for_occurrences()


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, round(c_acctbal, -3) ORDER BY c_custkey) AS k FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'read' AS stage, count(*) AS n FROM customer UNION ALL SELECT 'kept', count(*) FROM s UNION ALL SELECT 'deduplicated', count(*) FROM s WHERE k = 1 UNION ALL SELECT 'stored', count(*) FROM s WHERE k = 1"""
)
def ingest_stages(spark, sf_dir):
    """An ingest that drops rows and keeps one of each key: what each stage left."""
    p = Project(spark, folder(spark, "project"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), F.round("c_acctbal", -3).cast("string").alias("bin"))
    p.ingest_occurrences(c, id_col="key", drop={"segment": ["BUILDING"]}, dedupe_key_cols=["nation", "bin"])
    stages = p.load_imports()[-1]["stages"] | {"stored": p.occurrences().count()}
    return spark.createDataFrame([(k, stages[k]) for k in ("read", "kept", "deduplicated", "stored")], "stage string, n long")


def blanked(images: DataFrame) -> DataFrame:
    """The images, every seventh without anything on it, so that a segmenter fails there."""
    blank = F.expr(f"unhex(repeat('{rasters.GROUND:02x}', {rasters.HEIGHT * rasters.WIDTH * 3}))")
    return images.withColumn("data", F.when(F.col(ID).cast("long") % 7 == 6, blank).otherwise(F.col("data")))


@query(
    "SELECT k AS step, CASE k WHEN 0 THEN n // 2 WHEN 1 THEN n - n // 2 - bad ELSE 0 END AS done, CASE k WHEN 0 THEN 0 WHEN 1 THEN bad ELSE 0 END AS failed, CASE k WHEN 0 THEN 0 WHEN 1 THEN n // 2 ELSE n END AS skipped FROM (SELECT count(*) AS n, count(*) FILTER (p_partkey % 7 = 6) AS bad FROM part), (SELECT unnest(range(3)) AS k)"
)
def segment_runs(spark, sf_dir):
    """Segmentation in three runs: half of the images, the rest with images that fail, and nothing left."""
    p = Project(spark, folder(spark, "project"))
    images = rasters.drawn(spark, sf_dir)
    broken = F.col(ID).cast("long") % 7 == 6
    tables.write_table(blanked(images), p.at("images"))
    p.ingest_occurrences(images.select(ID, (~broken).cast("int").alias("good")))
    p.define_subset("half", ids=selection.global_rank(images.select(ID).withColumn("b", broken.cast("int")), ["b", ID], "at").where(F.col("at") < images.count() // 2).select(ID))
    steps = [p.run_segments([r.segment(r.BrightnessModel())], "bodies", subset=subset) for subset in ("half", None, None)]
    return spark.createDataFrame([(k, x.get("done", 0), x.get("failed", 0), x["skipped"]) for k, x in enumerate(steps)], "step long, done long, failed long, skipped long")


@query(
    f"""WITH {rasters._PIXELS}, n AS (SELECT k, count(*) AS area FROM px GROUP BY k) SELECT kind, k, area FROM (SELECT 'traits' AS kind, k, area FROM n UNION ALL SELECT 'again', k, area FROM n UNION ALL SELECT 'mask', k, area FROM n WHERE k % 2 = 0 UNION ALL SELECT 'info', k, 1 FROM n UNION ALL SELECT 'imaged', k, 1 FROM n)"""
)
def measured_runs(spark, sf_dir):
    """Metrics of a run, copied under another name without measuring again; masks by part and ids, what a segmenter recorded, ids with images."""
    p = Project(spark, folder(spark, "project"))
    images = tables.written(rasters.drawn(spark, sf_dir))
    tables.write_table(images, p.at("images"))
    p.ingest_occurrences(images.select(ID))
    p.run_segments([r.segment(r.BrightnessModel())], "bodies")
    first = p.run_metrics([r.mask_area()], "traits")
    second = p.run_metrics([r.mask_area()], "again")
    assert second["copied"] == first["done"] and not second.get("done")
    k = F.col(ID).cast("long").alias("k")
    values = p.load_metrics(["traits", "again"], metric_names=["area_px"], current_only=True).select(F.col("run_name").alias("kind"), k, F.try_variant_get("value", "$", "long").alias("area"))
    even = p.select_ids().where(F.col(ID).cast("long") % 2 == 0)
    masks = p.load_masks(["organism"], even).select(F.lit("mask").alias("kind"), k, F.col("area").cast("long"))
    info = stored.mask_info(p.load_masks()).where("name like '%cut'").select(F.lit("info").alias("kind"), k, F.lit(1).cast("long"))
    imaged = p.ids_with_image().join(tables.shuffled(p.ids_with_mask()), ID, "left_semi").select(F.lit("imaged").alias("kind"), k, F.lit(1).cast("long"))
    return values.union(masks).union(info).union(imaged)


@query("SELECT p_partkey::VARCHAR AS occurrence_id, 'segment' AS stage FROM part WHERE p_partkey % 7 = 6")
def failed_keys(spark, sf_dir):
    """Work that failed, remembered by its context; it is not tried again unless asked."""
    p = Project(spark, folder(spark, "project"))
    images = rasters.drawn(spark, sf_dir)
    tables.write_table(blanked(images), p.at("images"))
    p.ingest_occurrences(images.select(ID))
    p.run_segments([r.segment(r.BrightnessModel())], "bodies")
    assert not p.run_segments([r.segment(r.BrightnessModel())], "bodies").get("failed")
    assert p.run_segments([r.segment(r.BrightnessModel())], "bodies", retry_failed=True)["failed"] > 0
    return tables.load_table(spark, p.at("failures")).select(ID, "stage")


@query(
    "SELECT p_partkey::VARCHAR AS occurrence_id, p_name AS name, 'https://x.org/' || p_partkey || '/b.jpg' AS image_url FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 5 > 0"
)
def darwincore_archive(spark, sf_dir):
    """An occurrence archive: present records with the first still image of their media."""
    path = folder(spark, "archive")
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    head = lambda *names: spark.createDataFrame([(-1, "\t".join(names))], "k long, value string")
    records = head("gbifID", "occurrenceStatus", "name").union(part.select("p_partkey", F.concat_ws("\t", k, F.when(F.col("p_partkey") % 3 == 0, "ABSENT").otherwise("PRESENT"), "p_name")))
    sound = F.concat_ws("\t", k, F.lit("Sound"), F.concat(F.lit("https://x.org/"), k, F.lit("/a.mp3")))
    photo = lambda name: F.concat_ws("\t", k, F.lit("StillImage"), F.concat(F.lit("https://x.org/"), k, F.lit(f"/{name}.jpg")))
    listed = F.when(F.col("p_partkey") % 5 == 0, F.array(sound)).otherwise(F.array(sound, photo("b"), photo("c")))
    media = head("gbifID", "type", "identifier").union(part.select("p_partkey", F.explode(listed)))
    written = {}
    for name, rows in (("occurrence", records), ("multimedia", media)):
        rows.coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{path}/{name}")
        written[name] = files.read_tsv(spark, f"{path}/{name}")
    present = written["occurrence"].where("occurrenceStatus <> 'ABSENT'")
    merged = files.merge_media(present, files.select_media(written["multimedia"]))
    return merged.select(F.col("gbifID").alias(ID), "name", F.col("media_identifier").alias("image_url"))


@query("SELECT p_partkey::VARCHAR AS occurrence_id, p_retailprice AS price, CASE WHEN p_partkey % 4 > 0 THEN p_size::DOUBLE END AS size, p_name AS name FROM part")
def csv_scan(spark, sf_dir):
    """A CSV with a header: text as it is, named columns as numbers, what is no number NULL."""
    path = folder(spark, "csv")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size").cast("string")).otherwise("n/a").alias("size"), F.col("p_name").alias("name"))
    part.write.option("header", True).csv(path)
    return files.normalize(files.read_csv(spark, path), "id", numeric_cols=["price", "size"]).select(ID, "price", "size", "name")


@query("SELECT s_suppkey AS metric_id, s_name AS name, s_acctbal AS value FROM supplier WHERE s_nationkey > 3")
def sqlite_scan(spark, sf_dir):
    """A SQLite table read in ranges of its key."""
    place = folder(spark, "sqlite").removeprefix("file://")
    if "://" in place:
        raise ValueError("a SQLite file lies on a mounted file system")
    import os

    os.makedirs(os.path.dirname(place), exist_ok=True)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey").toPandas()
    with sqlite3.connect(f"{place}.db") as db:
        rows.to_sql("metrics", db, index=False)
    return files.sqlite_table(spark, f"{place}.db", "SELECT s_suppkey AS metric_id, s_name AS name, s_acctbal AS value FROM metrics WHERE s_nationkey > 3", "metric_id long, name string, value double", "metric_id", 4)


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def parquet_scan(spark, sf_dir):
    """A versioned table: the newest of three snapshots, two columns of it, a filter on a third."""
    path = folder(spark, "table")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    for extra in (nation.limit(0), nation.where("k < 3"), nation):
        tables.write_table(extra, path)
    assert tables.table_columns(spark, path) == ["k", "name", "region"] and tables.table_columns(spark, path + "x") == []
    return tables.load_table(spark, path, ["k", "name"], filters=[("region", "=", 2), ("k", ">", 5)])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'https://static.inaturalist.org/photos/' || p_partkey || '/large.jpeg?9' WHEN p_partkey % 3 = 1 THEN 'https://example.org/photos/' || p_partkey || '/medium.jpeg' END AS url FROM part")
def photo_sizes(spark, sf_dir):
    """Addresses of photos in another size, where the host names the size."""
    k = F.col("p_partkey").cast("string")
    url = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://static.inaturalist.org/photos/"), k, F.lit("/medium.jpeg?9"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://example.org/photos/"), k, F.lit("/medium.jpeg")))
    return table(spark, sf_dir, "part").select("p_partkey", files.photo_size(url, "large").alias("url"))


@query("""SELECT r_regionkey AS k, substr(sha256('{"a":[' || r_regionkey || ',null],"b":{"name":"' || r_name || '"}}'), 1, 16) AS hash, '{"a":[' || r_regionkey || ',null],"b":{"name":"' || r_name || '"}}' AS json FROM region""")
def spec_hashes(spark, sf_dir):
    """Canonical JSON and digests of specifications, whatever the order of their keys."""
    specs = [(x.r_regionkey, {"b": {"name": x.r_name}, "a": [x.r_regionkey, None]}) for x in table(spark, sf_dir, "region").collect()]
    return spark.createDataFrame([(k, hash_spec(s), canonical_json(s)) for k, s in specs], "k int, hash string, json string")


@query("SELECT unnest(['erode', 'crop', 'erode_2', 'crop_2', 'erode_3']) AS label, unnest(range(5)) AS place")
def operation_labels(spark, sf_dir):
    """Labels of repeated operations."""
    return spark.createDataFrame(list(zip(repeated_labels(["erode", "crop", "erode", "crop", "erode"]), range(5), strict=True)), "label string, place long")


@query("SELECT vec_id, embedding[1]::DOUBLE AS emb_0, embedding[2]::DOUBLE AS emb_1, embedding[3]::DOUBLE AS emb_2 FROM embeddings")
def feature_columns(spark, sf_dir):
    """Components of a vector as columns."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return stored.feature_columns(e, "v", "emb", 3).select("vec_id", "emb_0", "emb_1", "emb_2")


@query("SELECT true AS same_ids, false AS other_ids, false AS overlapping, true AS apart, (SELECT count(*) FROM customer) AS n")
def id_sets(spark, sf_dir):
    """Whether two sets of ids are the same population, and whether two are disjoint."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias(ID))
    same = lambda a, b: ids_fingerprint(a, ID).first() == ids_fingerprint(b, ID).first()
    even, odd = (c.where(F.col(ID).cast("long") % 2 == k) for k in (0, 1))
    checked = files.validate_ids(c)
    return spark.createDataFrame([(same(c, c.union(c).repartition(5)), same(c, even), validate.disjoint(c, odd, ID), validate.disjoint(even, odd, ID), checked.count())], "same_ids boolean, other_ids boolean, overlapping boolean, apart boolean, n long")


@query("SELECT user_id, max(ts)::TIMESTAMP AS ts, arg_max(value, event_id) AS value FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_id = last GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    """A stream of events upserted by user in micro-batches: the last event of each."""
    source, path = folder(spark, "source"), folder(spark, "stream")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    events.repartition(4, "user_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    streams.upsert_stream(stream, path, ["user_id"], f"{path}-checkpoint", "event_id").awaitTermination()
    return tables.load_table(spark, path).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_append(spark, sf_dir):
    """A stream appended once: replaying its batches adds nothing."""
    source, path = folder(spark, "source"), folder(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_type", "value")
    events.repartition(4).write.parquet(source)
    for attempt in range(2):  # another checkpoint replays every batch
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        streams.append_once(stream, path, f"{path}-checkpoint-{attempt}").awaitTermination()
    return tables.load_table(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# Planted groups: three heaps per brand, far apart, of which one row in fifty lies far from all.
_HEAPS = "p AS (SELECT p_partkey AS k, p_brand AS g, p_partkey % 3 AS heap, (p_partkey % 3) * 100 + (p_partkey * 7 % 11) / 10.0::DOUBLE AS x, (p_partkey % 3) * -50 + (p_partkey * 5 % 13) / 10.0::DOUBLE AS y FROM part)"


def heaps(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.col("p_brand").alias("g"), ((k % 3) * 100 + (k * 7 % 11) / 10).alias("x"), ((k % 3) * -50 + (k * 5 % 13) / 10).alias("y"))


@query(
    f"""WITH {_HEAPS}, c AS (SELECT heap, min(k) AS first, count(*) AS members, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY heap)
SELECT k, first, members, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 6) AS distance FROM p JOIN c USING (heap)"""
)
def cluster_kmeans(spark, sf_dir):
    """K-means over heaps planted apart: each row's cluster by its first member, its size, and the distance to its centre."""
    rows = heaps(spark, sf_dir)
    found = tables.written(groupfit.cluster(rows, ["x", "y"], "k", n_clusters=3))
    heads = found.groupBy("cluster_id").agg(F.min("k").alias("first"), F.count("*").alias("members"))
    return found.join(heads, "cluster_id").select("k", "first", "members", F.round("centroid_distance", 6).alias("distance"))


@query(
    f"""WITH {_HEAPS}, c AS (SELECT g, heap, min(k) AS first, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY g, heap), n AS (SELECT g FROM c GROUP BY g HAVING count(*) = 3)
SELECT k, g AS "group", first, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 6) AS distance FROM p JOIN c USING (g, heap) WHERE g IN (SELECT g FROM n)"""
)
def cluster_groups(spark, sf_dir):
    """K-means of each brand by itself, for brands that hold all three heaps."""
    rows = heaps(spark, sf_dir)
    whole = rows.groupBy("g").agg(F.count_distinct(F.round(F.col("x") / 100)).alias("n")).where("n = 3").select("g")
    found = tables.written(groupfit.cluster(rows.join(whole, "g", "left_semi"), ["x", "y"], "k", "g", 3))
    heads = found.groupBy("group", "cluster_id").agg(F.min("k").alias("first"))
    return found.join(heads, ["group", "cluster_id"]).select("k", "group", "first", F.round("centroid_distance", 6).alias("distance"))


@query("SELECT p_partkey AS k, p_partkey % 50 = 0 AS outlier FROM part")
def outlier_forest(spark, sf_dir):
    """An isolation forest over one heap with rows planted far out: the lowest scores are theirs."""
    k = F.col("p_partkey")
    far = k % 50 == 0
    side = F.when((k / 50).cast("int") % 2 == 0, 1).otherwise(-1)
    rows = table(spark, sf_dir, "part").select(k.alias("k"), ((k * 7 % 11) / 10 + F.when(far, side * (40 + k * 3 % 17)).otherwise(0)).alias("x"), ((k * 5 % 13) / 10 + F.when(far, side * (-30 - k * 7 % 19)).otherwise(0)).alias("y"))
    found = tables.written(groupfit.outlier(rows, ["x", "y"], "k"))
    lowest = selection.worst(found, "anomaly_score", found.where(F.col("k") % 50 == 0).count(), "k").select("k", F.lit(True).alias("outlier"))
    return found.select("k").join(lowest, "k", "left").select("k", F.coalesce("outlier", F.lit(False)).alias("outlier"))


@query("SELECT doc_id::VARCHAR AS doc_id, doc_id IN (SELECT doc_id FROM labels) AS out_of_fold, doc_id % 7 >= 4 AS bad, 1.0::DOUBLE AS auc FROM documents")
def label_score(spark, sf_dir):
    """Probability of a planted bad label for every document, labelled ones out of fold: above a half just for the bad ones."""
    k = F.col("doc_id") % 7
    d = table(spark, sf_dir, "documents").select("doc_id", k.cast("double").alias("n"), (F.col("doc_id") * 3 % 5).cast("double").alias("noise"))
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(k >= 4, "bad").otherwise("good").alias("mark")).distinct()
    scored, auc = groupfit.label_score(d, ["n", "noise"], "doc_id", marks, "mark", ["bad"])
    return scored.select("doc_id", "out_of_fold", (F.col("score") > 0.5).alias("bad"), F.lit(float(auc)).alias("auc"))


@query(f"WITH {rasters._BODY} SELECT k, 1.0::DOUBLE AS own, c AS colour FROM b")
def pixel_palette(spark, sf_dir):
    """A palette shared by all bodies: each body is wholly of one of its colours, the same for bodies of one colour."""
    p = Project(spark, folder(spark, "project"))
    images = tables.written(rasters.drawn(spark, sf_dir))
    tables.write_table(images, p.at("images"))
    p.ingest_occurrences(images.select(ID))
    p.run_segments([r.segment(r.BrightnessModel())], "bodies")
    found = p.pixel_metric("color_clusters", "palette", n_colors=4).select(F.col(ID).cast("long").alias("k"), F.get_json_object("value_json", "$.dominant").alias("dominant"), F.from_json("value_json", "color_0 double, color_1 double, color_2 double, color_3 double").alias("s"))
    found = tables.written(found)
    names = found.groupBy("dominant").agg(F.min(F.col("k") % 4).alias("colour"), F.count_distinct(F.col("k") % 4).alias("colours"))
    return found.join(names, "dominant").select("k", F.greatest("s.color_0", "s.color_1", "s.color_2", "s.color_3").alias("own"), F.when(F.col("colours") == 1, F.col("colour")).alias("colour"))


_ORDERED = "o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)"


def _placed(spark, sf_dir, layout) -> DataFrame:
    items = collage.sort_by(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")
    return collage.placements(items, layout, id_col="p_partkey").select("p_partkey", F.round(F.col("x").cast("double"), 5).alias("x"), F.round(F.col("y").cast("double"), 5).alias("y"))


@query(f"WITH {_ORDERED} SELECT p_partkey, round(0.62 * sqrt(i + 0.5) * cos(radians(i * {collage.GOLDEN!r}::DOUBLE)), 5) AS x, round(0.62 * sqrt(i + 0.5) * sin(radians(i * {collage.GOLDEN!r}::DOUBLE)), 5) AS y FROM o")
def collage_phyllotaxis(spark, sf_dir):
    """Items by value in sunflower order."""
    return _placed(spark, sf_dir, collage.phyllotaxis)


@query(f"WITH {_ORDERED}, c AS (SELECT *, ceil(sqrt(n))::BIGINT AS c FROM o) SELECT p_partkey, round(i % c + (i // c) % 2 / 2.0::DOUBLE, 5) AS x, round((i // c) * sqrt(3.0::DOUBLE) / 2, 5) AS y FROM c")
def collage_hexgrid(spark, sf_dir):
    """Items by value on a hexagonal grid."""
    return _placed(spark, sf_dir, lambda n: collage.grid(n, hexagonal=True))


@query(f"WITH {_ORDERED}, c AS (SELECT *, ceil(sqrt(n / 2.0))::BIGINT AS c, i // 2 AS pair FROM o) SELECT p_partkey, round((pair % c + 0.5) * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END, 5)::DOUBLE AS x, (pair // c)::DOUBLE AS y FROM c")
def collage_mirrored(spark, sf_dir):
    """Items by value in pairs around an axis."""
    return _placed(spark, sf_dir, collage.mirrored)


_RINGS = "r AS (SELECT 0 AS ring, 1 AS many UNION ALL SELECT k, floor(2 * pi() * k)::BIGINT FROM (SELECT unnest(range(1, 200)) AS k)), s AS (SELECT ring, many, sum(many) OVER (ORDER BY ring) - many AS first FROM r)"


@query(f"WITH {_ORDERED}, {_RINGS} SELECT p_partkey, round(ring * cos(2 * pi() * (i - first) / many), 5) + 0.0 AS x, round(ring * sin(2 * pi() * (i - first) / many), 5) + 0.0 AS y FROM o JOIN s ON i >= first AND i < first + many")
def collage_rings(spark, sf_dir):
    """Items by value on rings around a centre."""
    return _placed(spark, sf_dir, collage.rings)


@query("SELECT n_nationkey AS k, (n_nationkey * 7 % 25) AS slot FROM nation")
def collage_assign(spark, sf_dir):
    """Items given to the slots they lie nearest to, each once, by least total distance."""
    import numpy as np

    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey").toPandas()["n_nationkey"].to_numpy()
    slots = np.stack((np.arange(25) % 5, np.arange(25) // 5), axis=1).astype(float)
    items = slots[rows * 7 % 25] + 0.2
    found = collage.assign(items, slots)
    return spark.createDataFrame([(int(rows[item]), slot) for slot, item in enumerate(found.tolist())], "k int, slot long")


def _imaged(spark, sf_dir: str) -> Project:
    """A project of drawn images with their masks and a colour class."""
    p = Project(spark, folder(spark, "project"))
    images = tables.written(rasters.drawn(spark, sf_dir))
    tables.write_table(images, p.at("images"))
    k = F.col(ID).cast("long")
    p.ingest_occurrences(images.select(ID, F.when(k % 4 == 0, "red one").when(k % 4 == 1, "green").alias("colour")))
    p.run_segments([r.segment(r.BrightnessModel())], "bodies")
    return p


@query("SELECT p_partkey AS k, 1.0::DOUBLE AS score, (SELECT count(*) FROM part) AS imported, 0::BIGINT AS again FROM part")
def mask_round_trip(spark, sf_dir):
    """Masks written as images, read back as reference masks, held against the stored ones; reading them twice imports nothing."""
    p = _imaged(spark, sf_dir)
    path = folder(spark, "masks").removeprefix("file://")
    p.export_masks(path)
    imported, again = (p.import_masks(f"file://{path}", reference=True) for _ in range(2))
    return p.validate_masks().select(F.col(ID).cast("long").alias("k"), "score", F.lit(imported).cast("long").alias("imported"), F.lit(again).cast("long").alias("again"))


@query("SELECT p_partkey::VARCHAR AS occurrence_id, 'all' AS split, CASE p_partkey % 4 WHEN 0 THEN 'red one' ELSE 'green' END AS colour, 'all/' || CASE p_partkey % 4 WHEN 0 THEN 'red_one' ELSE 'green' END || '/' || p_partkey AS file, 24 AS height FROM part WHERE p_partkey % 4 < 2")
def training_export(spark, sf_dir):
    """Images written by split and class with a manifest; those without a class stay out; the written images are read back."""
    p = _imaged(spark, sf_dir)
    path = folder(spark, "training").removeprefix("file://")
    manifest = p.export_training_data(path, "colour")
    back = files.images(spark, f"file://{path}", recursive=True).select(ID, F.col("height").cast("long").alias("height"))
    return tables.shuffled(manifest).join(back, ID)


@query("SELECT unnest(['traits', 'checks']) AS name, 'metric' AS kind, 'finished' AS status, unnest([(SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0)]) AS n_processed")
def run_ledger(spark, sf_dir):
    """The last state of every run."""
    p = customers(spark, sf_dir)
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    p.store_values(c.select(F.col("c_custkey").alias(ID), F.col("c_nationkey").alias("value")), "checks", "nation")
    return p.load_runs().select("name", "kind", "status", "n_processed")


@query("SELECT r_regionkey AS k, r_name AS name, 'models/' || r_name AS path FROM region")
def json_records(spark, sf_dir):
    """Records appended to a log and read back in order, and a registry kept as one document."""
    p = Project(spark, folder(spark, "project"))
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    for x in rows:
        tables.append_jsonl(p.log("notes.jsonl"), {"k": x.r_regionkey, "name": x.r_name})
        p.register_model(x.r_name, path=f"models/{x.r_name}", fingerprint=False)
    p.register_model("gone")
    p.unregister_model("gone")
    assert len(p.list_models()) == len(rows)
    return spark.createDataFrame([(x["k"], x["name"], p.load_model(x["name"])["path"]) for x in tables.read_log(p.log("notes.jsonl"))], "k int, name string, path string")


@query("SELECT 'metrics' AS name, count(*) AS n FROM customer UNION ALL SELECT 'occurrences', count(*) FROM customer UNION ALL SELECT 'runs', 2")
def project_archive(spark, sf_dir):
    """A copy of a project's tables and logs to deposit."""
    p = customers(spark, sf_dir)
    dest = folder(spark, "deposit")
    copied = p.archive(dest)
    assert "runs.jsonl" in copied and len(tables.read_bytes(f"{dest}/runs.jsonl").splitlines()) == 1
    names = ["metrics", "occurrences", "runs"]
    return spark.createDataFrame([(n, spark.read.parquet(f"{dest}/{n}").count()) for n in names], "name string, n long")
