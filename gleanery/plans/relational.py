"""Queries over the given tables for selection, filters, joins and long-to-wide operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.identity import derivation, ids_digest
from gleanery.functions.nulls import to_number
from gleanery.operators import filters, selection, wide
from gleanery.operators.wide import ID
from gleanery.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SEED = selection.SEED


# Measurements: a line is a part (its return flag) of its order (the occurrence).
LINE_ID = "(l_linenumber * 100000000000000000 + l_partkey * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT))"
_LONG_SQL = f"""l AS (SELECT l_orderkey::VARCHAR AS occurrence_id, {LINE_ID}::BIGINT AS metric_id, l_returnflag AS part, l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem),
newest AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY occurrence_id, part ORDER BY metric_id DESC) = 1),
newest_tax AS (SELECT * FROM l WHERE l_tax > 0.02 QUALIFY row_number() OVER (PARTITION BY occurrence_id, part ORDER BY metric_id DESC) = 1)"""


def lines_as_long(spark: SparkSession, sf_dir: str, metrics: Sequence[str] = ("length", "area", "rates")) -> DataFrame:
    """length (px) and area (px2) of every line, and a dict rates whose key tax is left out where it is low; or some of them."""
    line = table(spark, sf_dir, "lineitem").withColumn("_id", F.expr(LINE_ID))
    base = line.select(F.col("l_orderkey").cast("string").alias(ID), F.col("_id").cast("long").alias("metric_id"), F.lit("traits").alias("run_name"), F.col("l_returnflag").alias("part"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rates = F.struct(F.col("l_discount").alias("discount"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("tax"))
    one = lambda name, unit, value: F.struct(F.lit(name).alias("metric_name"), F.lit(unit).alias("unit"), value.alias("value"))
    every = {"length": one("length", "px", F.col("l_quantity").cast("variant")), "area": one("area", "px2", F.col("l_extendedprice").cast("variant")), "rates": one("rates", "fraction", F.parse_json(F.to_json(rates)))}
    return base.select(ID, "metric_id", "run_name", "part", F.explode(F.array(*[every[m] for m in metrics])).alias("m")).select(ID, "metric_id", "run_name", "part", "m.metric_name", "m.unit", "m.value")


_WIDE = ("area", "length", "rates__discount", "rates__tax")


@query(
    f"""WITH {_LONG_SQL},
t AS (SELECT o.occurrence_id, o.part, o.l_quantity AS length, o.l_extendedprice AS area, o.l_discount AS discount, x.l_tax AS tax FROM newest o LEFT JOIN newest_tax x USING (occurrence_id, part))
SELECT occurrence_id, """
    + ", ".join(f"max({m.replace('rates__', '')}) FILTER (part = '{p}') AS traits__{p}__{m}" for p in "ANR" for m in _WIDE)
    + " FROM t GROUP BY occurrence_id"
)
def wide_newest_wins(spark, sf_dir):
    """Long to wide: per column the newest value, so that a key missing from a newer dict keeps its older value."""
    columns = [f"traits__{p}__{m}" for p in "ANR" for m in _WIDE]
    return wide.wide(lines_as_long(spark, sf_dir), columns=columns, kinds=dict.fromkeys(columns, "double"))


def _scales(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as occurrences, and scales declared for every seventh order and for two order statuses."""
    occurrences = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias(ID), F.col("o_orderstatus").alias("device"), F.col("o_orderpriority").alias("priority"))
    own = occurrences.where(F.col(ID).cast("long") % 7 == 0).select(F.lit(ID).alias("scope"), F.col(ID).alias("scope_value"), (10 + F.col(ID).cast("long") % 5).cast("double").alias("parameters"))
    wide_ = spark.createDataFrame([("device", "F", 8.0), ("device", "O", 16.0), ("priority", "1-URGENT", 4.0)], "scope string, scope_value string, parameters double")
    return occurrences, own.union(wide_)


_SCALE_SQL = """occ AS (SELECT o_orderkey::VARCHAR AS occurrence_id, o_orderkey, o_orderstatus AS device, o_orderpriority AS priority FROM orders),
broad AS (SELECT count(*) / count(DISTINCT device) AS d, count(*) / count(DISTINCT priority) AS p FROM occ),
own AS (SELECT occurrence_id, CASE WHEN o_orderkey % 7 = 0 THEN (10 + o_orderkey % 5)::DOUBLE END AS a,
  CASE device WHEN 'F' THEN 8.0 WHEN 'O' THEN 16.0 END::DOUBLE AS b, CASE priority WHEN '1-URGENT' THEN 4.0 END::DOUBLE AS c FROM occ),
scale AS (SELECT occurrence_id, CASE WHEN a IS NOT NULL THEN a WHEN p < d THEN coalesce(c, b) ELSE coalesce(b, c) END AS px_per_mm,
  CASE WHEN a IS NOT NULL THEN 'occurrence_id' WHEN p < d THEN CASE WHEN c IS NOT NULL THEN 'priority' WHEN b IS NOT NULL THEN 'device' END
    ELSE CASE WHEN b IS NOT NULL THEN 'device' WHEN c IS NOT NULL THEN 'priority' END END AS scope FROM own, broad)"""


@query(f"WITH {_SCALE_SQL} SELECT occurrence_id, px_per_mm, scope FROM scale")
def scope_resolution(spark, sf_dir):
    """Which calibration applies: that of the occurrence itself, else of the narrowest scope."""
    return wide.resolve_scope(*_scales(spark, sf_dir)).withColumnRenamed("parameters", "px_per_mm")


_EXPORT_SQL = f"""WITH {_LONG_SQL}, {_SCALE_SQL},
t AS (SELECT occurrence_id, max(l_quantity) FILTER (part = 'N') AS n_len, max(l_extendedprice) FILTER (part = 'N') AS n_area, max(l_quantity) FILTER (part = 'R') AS r_len, max(l_extendedprice) FILTER (part = 'R') AS r_area FROM newest GROUP BY occurrence_id)
SELECT occurrence_id, occ.device, occ.priority, n_len / px_per_mm AS traits__N__length_mm, n_area / (px_per_mm * px_per_mm) AS traits__N__area_mm2,
  r_len / px_per_mm AS traits__R__length_mm, r_area / (px_per_mm * px_per_mm) AS traits__R__area_mm2, px_per_mm
FROM t JOIN occ USING (occurrence_id) JOIN scale USING (occurrence_id)
WHERE n_len / px_per_mm >= 1 AND occ.priority NOT IN ('5-LOW') AND occ.priority IS NOT NULL"""


@query(_EXPORT_SQL)
def filtered_export(spark, sf_dir):
    """The flagship: one row per occurrence, newest values, millimetres by the narrowest scale, filters that missing values fail."""
    occurrences, scales = _scales(spark, sf_dir)
    long = lines_as_long(spark, sf_dir, ("length", "area")).where("part in ('N', 'R')")
    names = [f"traits__{p}__{m}" for p in "NR" for m in ("length", "area")]
    units = {c: "px" if c.endswith("length") else "px2" for c in names}
    flat = wide.wide(long, columns=names, kinds=dict.fromkeys(names, "double"))
    scale = wide.resolve_scope(occurrences, scales).select(ID, F.col("parameters").alias("_scale"))
    rows = wide.to_millimetres(occurrences.join(flat, ID).join(scale, ID), units, F.col("_scale")).drop("_scale")
    return filters.apply_filters(rows, {"traits__N__length_mm": (">=", 1.0), "priority": ("not in", ["5-LOW", None])})


@query(
    """WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 > 0 THEN p_size END AS len, CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS area FROM part)
SELECT p_partkey, CASE WHEN coalesce(len >= 20, len IS NULL AND area IS NULL) THEN len END AS wing__len, CASE WHEN coalesce(len >= 20, false) THEN area END AS wing__area, area AS body__area,
  count(*) FILTER ((len IS NOT NULL OR area IS NOT NULL) AND coalesce(len >= 20, false)) OVER () AS wing__kept,
  count(*) FILTER ((len IS NOT NULL OR area IS NOT NULL) AND NOT coalesce(len >= 20, false)) OVER () AS wing__filtered_out,
  count(*) FILTER (len IS NULL AND area IS NULL) OVER () AS wing__not_measured FROM p"""
)
def part_filters(spark, sf_dir):
    """Columns of a part that was measured and fails its filters are blanked; the counts ride along."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("wing__len"), F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice")).alias("wing__area"))
    df = p.withColumn("body__area", F.col("wing__area"))
    blanked, counts = wide.blank_failing_parts(df, {"wing": {"wing__len": (">=", 20)}}, {"wing": ["wing__len", "wing__area"]})
    one = counts.first()
    return blanked.withColumns({name: F.lit(one[name]).cast("long") for name in counts.columns})


@query(
    """WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE substr(sha256('mask:' || (o_orderkey % 11)), 1, 16) END AS up, substr(sha256('seg:' || (o_orderkey % 3)), 1, 16) AS recipe FROM orders WHERE o_orderkey % 4 > 0),
h AS (SELECT id, CASE WHEN up IS NULL THEN recipe ELSE substr(sha256('{"from":"' || up || '","recipe":"' || recipe || '"}'), 1, 16) END AS dh FROM m),
v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN (SELECT dh FROM h WHERE h.id = o.o_orderkey LIMIT 1) ELSE 'stale' END AS src,
  CASE WHEN o_orderkey % 3 = 0 THEN 'r1' ELSE 'r2' END AS recipe, o_orderstatus AS part FROM orders o)
SELECT v.id::VARCHAR AS occurrence_id, v.part, v.recipe AS recipe_hash FROM v
WHERE (src IS NULL OR EXISTS (SELECT 1 FROM h WHERE h.id = v.id AND h.dh = v.src)) AND (v.part = 'P' OR v.recipe = CASE v.part WHEN 'F' THEN 'r1' ELSE 'r2' END)"""
)
def currency_join(spark, sf_dir):
    """Values whose source mask and recipe are still the current ones; what can't be judged stays."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    short = lambda name, mod: F.substring(F.sha2(F.concat(F.lit(f"{name}:"), (key % mod).cast("string")), 256), 1, 16)
    masks = orders.where(key % 4 > 0).select(key.cast("string").alias(ID), F.col("o_orderstatus").alias("part"), short("seg", 3).alias("recipe_hash"), F.when(key % 5 != 0, short("mask", 11)).alias("source_mask_hash"))
    now = F.when(key % 4 > 0, derivation(short("seg", 3), F.when(key % 5 != 0, short("mask", 11))))
    source = F.when(key % 6 == 0, F.lit(None).cast("string")).when(key % 2 == 0, now).otherwise("stale")
    long = orders.select(key.cast("string").alias(ID), F.lit("traits").alias("run_name"), F.col("o_orderstatus").alias("part"), F.when(key % 3 == 0, "r1").otherwise("r2").alias("recipe_hash"), source.alias("source_mask_hash"))
    pointers = spark.createDataFrame([("traits", "F", "r1"), ("traits", "O", "r2")], "name string, part string, recipe_hash string")
    return wide.current_rows(long, masks, pointers).select(ID, "part", "recipe_hash")


@query("SELECT user_id::VARCHAR AS occurrence_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY user_id")
def latest_values(spark, sf_dir):
    """The newest stored value of one metric per occurrence."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    long = wide.long_values(e, F.col("user_id"), F.col("event_id"), "events", F.lit("user"), "click", F.col("value"))
    return wide.latest_values(long).select(ID, wide.typed(F.col("value"), "double").alias("value"))


@query("SELECT DISTINCT user_id::VARCHAR AS occurrence_id, event_type AS part, 'r' || (user_id % 2) AS recipe_hash, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'm' END AS source_mask_hash, 'events' AS run_name FROM events")
def result_keys(spark, sf_dir):
    """Which results exist, without their values."""
    user = F.col("user_id")
    e = table(spark, sf_dir, "events").select(user.cast("string").alias(ID), F.col("event_type").alias("part"), F.concat(F.lit("r"), (user % 2).cast("string")).alias("recipe_hash"), F.when(user % 3 != 0, "m").alias("source_mask_hash"), F.lit("events").alias("run_name"), F.col("value"))
    return wide.result_keys(e)


@query(
    """SELECT user_id::VARCHAR AS occurrence_id, max(CASE WHEN rn = 1 THEN k END) AS k, max(CASE WHEN rn = 1 THEN kind END) AS kind FROM
(SELECT user_id, event_type AS kind, json_extract(props, '$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) GROUP BY user_id"""
)
def wide_dict_explode(spark, sf_dir):
    """A dict metric becomes one column per key."""
    e = table(spark, sf_dir, "events")
    value = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'))
    long = wide.long_values(e, F.col("user_id"), F.col("event_id"), "events", F.lit("user"), "props", value)
    flat = wide.wide(long)
    return flat.select(ID, wide.typed(F.col("events__user__props__k"), "bigint").alias("k"), wide.typed(F.col("events__user__props__kind"), "string").alias("kind"))


@query("SELECT 'events__' || event_type || '__value' AS column, 'events' AS run_name, event_type AS part, 'value' AS metric_name, NULL::VARCHAR AS key, arg_max(CASE WHEN event_id % 2 = 0 THEN 'px' ELSE 'px2' END, event_id) AS unit FROM events GROUP BY event_type")
def column_units(spark, sf_dir):
    """What each wide column holds, with the newest unit."""
    e = table(spark, sf_dir, "events")
    long = wide.long_values(e, F.col("user_id"), F.col("event_id"), "events", F.col("event_type"), "value", F.col("value")).withColumn("unit", F.when(F.col("metric_id") % 2 == 0, "px").otherwise("px2"))
    return wide.column_provenance(wide.cells(long))


@query("SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING') OR c_nationkey IN (1, 2, 3)")
def rules_any(spark, sf_dir):
    """Rows that any membership rule picks."""
    return filters.rows_matching(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": [1, 2, 3, None]})


@query("WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS seg, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS bal FROM customer) SELECT * FROM c WHERE seg NOT IN ('BUILDING', 'MACHINERY') AND bal > 100 AND bal <> 500")
def filters_all(spark, sf_dir):
    """Rows that pass every filter; NULL and NaN pass none, and a NULL in a list doesn't poison NOT IN."""
    key = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(key, F.when(key % 7 > 0, F.col("c_mktsegment")).alias("seg"), F.when(key % 5 > 0, F.col("c_acctbal")).otherwise(F.when(key % 2 == 0, F.lit(float("nan")))).alias("bal"))
    kept = filters.apply_filters(df, {"seg": ("not in", ["BUILDING", None, "MACHINERY"]), "bal": (">", 100)})
    return filters.apply_filters(kept, {"bal": lambda c: c != 500})


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND NOT o_totalprice < 1000) OR o_orderpriority IN ('1-URGENT')")
def subset_query(spark, sf_dir):
    """A named subset's query string as a predicate."""
    o = table(spark, sf_dir, "orders")
    return o.where(filters.query_column(o, "(o_orderstatus == 'F' and not o_totalprice < 1000) or o_orderpriority in ['1-URGENT']")).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT DISTINCT c_custkey::VARCHAR AS c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def require_present(spark, sf_dir):
    """Ids that all named sets hold."""
    o = table(spark, sf_dir, "orders")
    return selection.present_in_all(table(spark, sf_dir, "customer"), "c_custkey", ordered=o.select("o_custkey"), pending=o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT DISTINCT c_custkey::VARCHAR AS c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey <> 3")
def exclude_present(spark, sf_dir):
    """Ids that no named set holds."""
    c = table(spark, sf_dir, "customer")
    return selection.present_in_none(c, "c_custkey", pending=table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"), nation=c.where("c_nationkey = 3").select("c_custkey"))


def _cap_sql(order: str, tier: str = "0", cap: int = 5) -> str:
    return f"SELECT p_partkey, p_brand FROM part WHERE p_brand IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {tier}, {order}, p_partkey) <= {cap}"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")


@query(_cap_sql(f"sha256('{SEED}:' || p_partkey)"))
def cap_random(spark, sf_dir):
    """At most five rows per group, drawn by hash."""
    return selection.cap_per_group(_parts(spark, sf_dir), "p_brand", 5, "p_partkey").select("p_partkey", "p_brand")


@query(_cap_sql("p_partkey"))
def cap_first(spark, sf_dir):
    return selection.cap_per_group(_parts(spark, sf_dir), "p_brand", 5, "p_partkey", "first").select("p_partkey", "p_brand")


@query(_cap_sql("p_partkey DESC"))
def cap_last(spark, sf_dir):
    return selection.cap_per_group(_parts(spark, sf_dir), "p_brand", 5, "p_partkey", "last").select("p_partkey", "p_brand")


@query(_cap_sql(f"sha256('{SEED}:' || p_partkey)", "CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 2 END + CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 1 END"))
def cap_prefer_keep(spark, sf_dir):
    """Preferred rows first, then those of an earlier selection."""
    p = _parts(spark, sf_dir)
    return selection.cap_per_group(p, "p_brand", 5, "p_partkey", keep=p.where("p_partkey % 10 = 0").select("p_partkey"), prefer={"p_type": "ECONOMY"}).select("p_partkey", "p_brand")


@query(
    f"""WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 9 > 0 THEN CAST(s_acctbal / 1000 AS BIGINT) END AS k FROM supplier)
SELECT s_suppkey FROM s WHERE k IS NULL UNION ALL SELECT s_suppkey FROM (SELECT * FROM s WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_nationkey, k ORDER BY sha256('{SEED}:' || s_suppkey), s_suppkey) = 1)"""
)
def dedupe_rounded(spark, sf_dir):
    """One row per (nation, balance rounded); rows that lack a key stay."""
    s = table(spark, sf_dir, "supplier").withColumn("k", F.when(F.col("s_suppkey") % 9 > 0, F.col("s_acctbal") / 1000))
    return selection.dedupe_by(s, ["s_nationkey", "k"], "s_suppkey", precision={"k": 0}).select("s_suppkey")


@query(
    f"""WITH p AS (SELECT p_partkey, p_brand, p_size, p_type FROM part), pref AS (SELECT * FROM p WHERE p_type = 'ECONOMY'),
rest AS (SELECT * FROM p WHERE p_type <> 'ECONOMY' AND (p_brand, p_size) NOT IN (SELECT p_brand, p_size FROM pref))
SELECT p_partkey FROM pref UNION ALL SELECT p_partkey FROM (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY sha256('{SEED}:' || p_partkey), p_partkey) = 1)"""
)
def dedupe_prefer(spark, sf_dir):
    """Preferred rows all stay and displace the others of their key."""
    return selection.dedupe_by(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey", prefer={"p_type": "ECONOMY"}).select("p_partkey")


@query(f"SELECT o_orderkey FROM orders ORDER BY sha256('{SEED}:' || o_orderkey), o_orderkey LIMIT 100")
def sample_ids(spark, sf_dir):
    return selection.sample(table(spark, sf_dir, "orders"), 100, "o_orderkey").select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey < 60 THEN 0 ELSE 1 END, sha256('{SEED}:' || o_orderkey), o_orderkey LIMIT 150")
def grow_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return selection.grow(o, 150, "o_orderkey", o.where("o_orderkey < 60").select("o_orderkey")).select("o_orderkey")


@query(
    f"""WITH RECURSIVE g AS (SELECT lang, n, row_number() OVER (ORDER BY n, lang) AS k, count(*) OVER () AS total FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)),
t AS (SELECT k, lang, least(n, ceil(200 / total::DOUBLE)::BIGINT) AS take, 200 - least(n, ceil(200 / total::DOUBLE)::BIGINT) AS rest FROM g WHERE k = 1
  UNION ALL SELECT g.k, g.lang, least(g.n, ceil(t.rest / (g.total - t.k)::DOUBLE)::BIGINT), t.rest - least(g.n, ceil(t.rest / (g.total - t.k)::DOUBLE)::BIGINT) FROM t JOIN g ON g.k = t.k + 1)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS rn FROM documents) JOIN t USING (lang) WHERE rn <= take"""
)
def sample_per_group(spark, sf_dir):
    """A sample spread over groups, small groups whole first."""
    return selection.sample_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 200, "doc_id")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey::VARCHAR) - 1 AS k FROM orders) WHERE k % 4 = 1")
def shard_ids(spark, sf_dir):
    return selection.shard(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1, 4)


@query(
    """WITH g AS (SELECT source, min(lang) AS lang FROM documents GROUP BY source),
r AS (SELECT source, (row_number() OVER (PARTITION BY lang ORDER BY sha256('0:' || source), source) - 1 + 0.5) / count(*) OVER (PARTITION BY lang) AS p FROM g)
SELECT doc_id, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split FROM documents JOIN r USING (source)"""
)
def split_stratified_grouped(spark, sf_dir):
    """Train, validation and test sides: sources stay whole, languages are divided evenly."""
    return selection.split(table(spark, sf_dir, "documents"), "doc_id", group_col="source", stratify_col="lang").select("doc_id", "split")


@query("SELECT split, count(*) AS n, count(DISTINCT source) AS groups FROM (WITH g AS (SELECT source, min(lang) AS lang FROM documents GROUP BY source), r AS (SELECT source, (row_number() OVER (PARTITION BY lang ORDER BY sha256('0:' || source), source) - 1 + 0.5) / count(*) OVER (PARTITION BY lang) AS p FROM g) SELECT source, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split FROM documents JOIN r USING (source)) GROUP BY split")
def split_summary(spark, sf_dir):
    """Rows and groups of each side."""
    done = selection.split(table(spark, sf_dir, "documents"), "doc_id", group_col="source", stratify_col="lang")
    return done.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("source").alias("groups"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def worst_n(spark, sf_dir):
    return selection.worst(table(spark, sf_dir, "orders"), "o_totalprice", 25, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
t AS (SELECT a.label, a.vec_id, sum(list_distance(a.v, b.v)) AS total FROM e a JOIN e b ON a.label = b.label GROUP BY a.label, a.vec_id)
SELECT label, vec_id, round(total, 4) AS total FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(total, 9), vec_id) <= 3"""
)
def exemplars_medoid(spark, sf_dir):
    """The three most central vectors of each group."""
    return selection.medoids(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 3).withColumn("total", F.round("total", 4))


@query("SELECT conv_id, arg_min(text, turn) AS media_text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")
def select_media(spark, sf_dir):
    """The first item of the wanted type per record, and how many there were."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("media_text"), F.count("*").alias("n"))


@query("SELECT o.o_orderkey, m.l_partkey AS media_l_partkey FROM orders o JOIN (SELECT l_orderkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = o.o_orderkey WHERE m.l_partkey IS NOT NULL")
def merge_media(spark, sf_dir):
    """Occurrences with their media row, prefixed; those without go."""
    media = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_partkey").alias("l_partkey"))
    prefixed = media.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("media_l_partkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(prefixed, "o_orderkey", "left").where("media_l_partkey is not null")


@query("SELECT * FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT c_custkey, c_name || '*', c_nationkey, c_acctbal + 1, c_mktsegment FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 100 = 0")
def upsert(spark, sf_dir):
    """New rows replace those of their key."""
    c = table(spark, sf_dir, "customer")
    changed = c.where("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit("*"))).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    added = c.where("c_custkey % 100 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000)
    return tables.upserted(c, changed.union(added), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'third' WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS shard FROM customer")
def merge_shards(spark, sf_dir):
    """Staged shards in order, the last row of each key."""
    c = table(spark, sf_dir, "customer")
    shards = [c.where(test).select("c_custkey", F.lit(name).alias("shard")) for test, name in (("true", "first"), ("c_custkey % 2 = 0", "second"), ("c_custkey % 3 = 0", "third"))]
    return tables.last_per_key(shards, ["c_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0 AND NOT (o_orderkey % 7 = 0 AND o_orderstatus = 'F')")
def incremental_todo(spark, sf_dir):
    """Work that is neither done by this recipe nor failed in this context."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    done = o.where("o_orderkey % 5 = 0").select("o_orderkey")
    failed = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("F").alias("context"))
    return o.join(done, "o_orderkey", "left_anti").join(failed, (o["o_orderkey"] == failed["o_orderkey"]) & (o["o_orderstatus"] == failed["context"]), "left_anti").select("o_orderkey")


@query("""SELECT count(DISTINCT o_orderkey) AS count, substr(sha256('["' || string_agg(DISTINCT o_orderkey::VARCHAR, '","' ORDER BY o_orderkey::VARCHAR) || '"]'), 1, 16) AS ids_hash FROM orders""")
def ids_hash(spark, sf_dir):
    """Digest of a set of ids."""
    return ids_digest(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS value FROM customer")
def normalize_numbers(spark, sf_dir):
    """Text to numbers, what is none to NULL."""
    c = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.col("c_acctbal").cast("string"), F.lit("d"))).otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", to_number(text).alias("value"))


@query("SELECT DISTINCT c.c_mktsegment AS scope_value FROM customer c WHERE c.c_mktsegment NOT IN ('BUILDING', 'MACHINERY') ORDER BY 1 LIMIT 2")
def pending_scopes(spark, sf_dir):
    """Scope values that still lack a calibration."""
    done = spark.createDataFrame([("c_mktsegment", "BUILDING"), ("c_mktsegment", "MACHINERY"), ("other", "X")], "scope string, scope_value string")
    return wide.pending_scope_values(table(spark, sf_dir, "customer"), done, "c_mktsegment", 2)
