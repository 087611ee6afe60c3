"""Long measurements to wide rows: currency, newest-wins pivot, scales, unit conversion, part blanking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.identity import derivation
from gleanery.functions.naming import CONVERTED, converted_name, wide_name_column
from gleanery.functions.nulls import present
from gleanery.operators.filters import passing

ID = "occurrence_id"
#: Unit of what transforms recorded; hidden unless asked for.
TRANSFORM_INFO = "transform_info"
SCALE = "px_per_mm"


def current_rows(long: DataFrame, masks: DataFrame | None, pointers: DataFrame | None) -> DataFrame:
    """The values that the masks and recipes of now still support.

    A value stays if there are no masks at all, or it names no source, or its source is a derivation hash of a mask of
    its (occurrence, part), canonical or reference; and if its (run, part) has no recipe pointer or its recipe is the
    pointer's. ``masks``: occurrence_id, part, recipe_hash, source_mask_hash of both kinds together. ``pointers``: name,
    part, recipe_hash of metric runs.
    """
    out = long
    if masks is not None and not masks.isEmpty():
        held = masks.select(F.col(ID).alias("_id"), F.col("part").alias("_part"), derivation(F.col("recipe_hash"), F.col("source_mask_hash")).alias("_hash")).distinct()
        source = F.col("source_mask_hash")
        fresh = out.join(held.hint("shuffle_merge"), (out[ID] == held["_id"]) & (out["part"] == held["_part"]) & (source == held["_hash"]), "left_semi")
        out = out.where(source.isNull()).unionByName(fresh)
    if pointers is not None:
        now = pointers.select(F.col("name").alias("_name"), F.col("part").alias("_part"), F.col("recipe_hash").alias("_now"))
        out = out.join(now, (out["run_name"] == now["_name"]) & (out["part"] == now["_part"]), "left").where("_now is null or _now = recipe_hash").drop("_name", "_part", "_now")
    return out


def cells(long: DataFrame) -> DataFrame:
    """(occurrence_id, metric_id, column, run_name, part, metric_name, key, unit, value): object values one row per key, others one row."""
    kept = long.select(ID, "metric_id", "run_name", "part", "metric_name", "unit", "value")
    held = kept.withColumn("_object", F.when(F.schema_of_variant("value").startswith("OBJECT"), F.col("value")))
    # One pass: what is no object has one row without a key, an empty object none.
    each = long.sparkSession.sql("SELECT l.*, e.key, e.value AS _value FROM {l} l, LATERAL variant_explode_outer(l._object) e", l=held).where("_object IS NULL OR key IS NOT NULL")
    every = each.select(ID, "metric_id", "run_name", "part", "metric_name", "key", "unit", F.when(F.col("_object").isNull(), F.col("value")).otherwise(F.col("_value")).alias("value"))
    return every.withColumn("column", wide_name_column(F.col("run_name"), F.col("part"), F.col("metric_name"), F.col("key")))


def column_provenance(cells_: DataFrame) -> DataFrame:
    """One row per wide column: run_name, part, metric_name, key and the newest unit."""
    newest = F.max_by(F.struct("run_name", "part", "metric_name", "key", "unit"), "metric_id").alias("p")
    return cells_.groupBy("column").agg(newest).select("column", "p.*")


#: Records of a scope that are broadcast.
BROADCAST_ROWS = 100_000
#: Columns up to which one conditional aggregation makes the wide row.
CONDITIONAL = 64


def pivot_cells(cells_: DataFrame, columns: Sequence[str], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """One row per occurrence, one column per name; of several values of a cell the newest wins, also where it is JSON null.

    Columns are VARIANT, or of the type ``kinds`` names: those are read out before the aggregation, which for numbers
    is then a hash aggregation with partial results; VARIANTs need a sort.
    """
    kinds = kinds or {}
    if len(columns) <= CONDITIONAL:
        if not columns:
            return cells_.select(ID).distinct()
        plain = sorted(set(kinds.values()))
        read = cells_.select(ID, "metric_id", "column", *([] if all(c in kinds for c in columns) else ["value"]), *[typed(F.col("value"), k).alias(f"_{k}") for k in plain])
        newest = [F.max_by(F.when(F.col("column") == c, F.col(f"_{kinds[c]}" if c in kinds else "value")), F.when(F.col("column") == c, F.col("metric_id"))).alias(c) for c in columns]
        return read.groupBy(ID).agg(*newest)
    newest = cells_.groupBy(ID, "column").agg(F.max_by("value", "metric_id").alias("value"))
    flat = newest.groupBy(ID).pivot("column", list(columns)).agg(F.first("value"))
    return flat.select(ID, *[typed(F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in columns])


def typed(column: Column, kind: str) -> Column:
    """A VARIANT cell as a plain type; what doesn't fit is NULL."""
    return F.try_variant_get(column, "$", kind)


def wide(long: DataFrame, transform_info: bool = False, columns: Sequence[str] | None = None, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """One row per occurrence and columns run__part__metric[__key], sorted by name, VARIANT or as ``kinds`` says; the names come from a first pass unless given."""
    if not transform_info:
        long = long.where(F.col("unit").isNull() | (F.col("unit") != TRANSFORM_INFO))
    every = cells(long)
    if columns is None:
        columns = sorted(r[0] for r in every.select("column").distinct().collect())
    return pivot_cells(every, columns, kinds)


def resolve_scope(occurrences: DataFrame, calibrations: DataFrame, id_col: str = ID) -> DataFrame:
    """(id, parameters, scope) for every occurrence: the record of its own id, else of the scope that covers fewest occurrences per value.

    ``calibrations``: scope (a column of the occurrences), scope_value, parameters. Scopes that the occurrences lack
    apply to nothing. Each scope's records are joined once: broadcast where they are counted to be few, as one value of
    a broad scope may hold a third of the occurrences, else by a shuffle.
    """
    records = {r["scope"]: r["count"] for r in calibrations.groupBy("scope").count().collect() if r["scope"] in occurrences.columns}
    scopes = sorted(records)
    text = {s: F.coalesce(F.col(f"`{s}`").cast("string"), F.lit("nan")) for s in scopes}
    if not scopes:
        kind = calibrations.schema["parameters"].dataType
        return occurrences.select(F.col(id_col).cast("string").alias(id_col), F.lit(None).cast(kind).alias("parameters"), F.lit(None).cast("string").alias("scope"))
    sizes = occurrences.agg(*[(F.count("*") / F.count_distinct(text[s])).alias(f"n{k}") for k, s in enumerate(scopes)]).first()
    order = sorted(range(len(scopes)), key=lambda k: (scopes[k] != id_col, sizes[k] or 0, scopes[k]))
    out = occurrences.select(F.col(id_col).cast("string").alias("_id"), *[F.col(f"`{s}`").cast("string").alias(f"_s{k}") for k, s in enumerate(scopes)])
    for k, s in enumerate(scopes):
        own = calibrations.where(F.col("scope") == s).select(F.col("scope_value").cast("string").alias(f"_s{k}"), F.struct("parameters", "scope").alias(f"_p{k}"))
        out = out.join(F.broadcast(own) if records[s] <= BROADCAST_ROWS else own, f"_s{k}", "left")
    best = F.coalesce(*[F.col(f"_p{k}") for k in order])
    return out.select(F.col("_id").alias(id_col), best["parameters"].alias("parameters"), best["scope"].alias("scope"))


def pending_scope_values(occurrences: DataFrame, calibrations: DataFrame, scope: str, max_new: int | None = None) -> DataFrame:
    """Values of a scope column without a calibration; the cap counts after those that have one are out."""
    if scope not in occurrences.columns:
        raise KeyError(scope)
    done = calibrations.where(F.col("scope") == scope).select(F.col("scope_value").cast("string").alias("scope_value"))
    values = occurrences.where(present(occurrences, scope)).select(F.col(scope).cast("string").alias("scope_value")).distinct()
    pending = values.join(done, "scope_value", "left_anti")
    return pending if max_new is None else pending.orderBy("scope_value").limit(max_new)


def to_millimetres(df: DataFrame, units: Mapping[str, str], scale: Column) -> DataFrame:
    """Pixel columns divided by the scale (areas by its square), renamed with _mm or _mm2; other columns stay, px_per_mm is added.

    A missing, zero or NaN scale gives NULL.
    """
    good = F.when((scale != 0) & ~F.isnan(scale), scale)
    out = []
    for c in df.columns:
        kind = CONVERTED.get(units.get(c, ""))
        value = F.col(f"`{c}`")
        if kind:
            number = typed(value, "double") if isinstance(df.schema[c].dataType, T.VariantType) else value.cast("double")
            value = (number / F.pow(good, F.lit(kind[1]))).alias(converted_name(c, units[c]))
        out.append(value)
    return df.select(*[c for c, name in zip(out, df.columns, strict=True) if name != SCALE], good.alias(SCALE))


def blank_failing_parts(df: DataFrame, part_filters: Mapping[str, Mapping[str, Any]], part_columns: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the columns of a part NULL where the part was measured and fails its filters, and counts per part.

    All parts are judged on the values before any blanking. Counts (one row): <part>__kept, <part>__filtered_out,
    <part>__not_measured.
    """
    judged = df
    for k, (part, filters) in enumerate(part_filters.items()):
        seen = reduce(or_, [present(df, c) for c in part_columns[part]], F.lit(False))
        judged = judged.withColumn(f"_seen{k}", seen).withColumn(f"_good{k}", passing(df, filters))
    blank = {}
    for k, part in enumerate(part_filters):
        for c in part_columns[part]:
            drop = F.col(f"_seen{k}") & ~F.col(f"_good{k}")
            blank[c] = F.when(~drop, F.col(f"`{c}`"))
    counts = []
    for k, part in enumerate(part_filters):
        seen, good = F.col(f"_seen{k}"), F.col(f"_good{k}")
        counts += [F.count_if(seen & good).alias(f"{part}__kept"), F.count_if(seen & ~good).alias(f"{part}__filtered_out"), F.count_if(~seen).alias(f"{part}__not_measured")]
    return judged.withColumns(blank).select(*df.columns), judged.agg(*counts)


@dataclass
class Export:
    """What ``filtered_wide`` makes: the rows, what each metric column holds, and the columns read for filters only."""

    df: DataFrame
    provenance: dict[str, dict]
    metric_columns: list[str]
    hidden: list[str]


def filtered_wide(occurrences: DataFrame, long: DataFrame, filters: Mapping[str, Any] | None = None, filter_long: DataFrame | None = None, scale: DataFrame | None = None, drop_empty: bool = True, transform_info: bool = False, types: Mapping[str, str] | None = None) -> Export:
    """Occurrences joined to their wide values, converted, then filtered.

    ``long`` holds the selected current values, ``filter_long`` further ones that only filters read. Rows without a
    selected value go (unless ``drop_empty`` is off, then all occurrences stay) before conversion and filters. With
    ``scale`` (occurrence_id, px_per_mm) pixel columns become millimetres, so thresholds are in millimetres. ``types``
    gives plain types to columns by name; others that a filter compares with a number are DOUBLE, with text STRING.
    """
    every = cells(long)
    found = {r["column"]: r.asDict() for r in column_provenance(every).collect()}
    extra: dict[str, dict] = {}
    if filter_long is not None:
        more = cells(filter_long)
        extra = {r["column"]: r.asDict() for r in column_provenance(more).collect() if r["column"] not in found}
        every = every.unionByName(more.where(F.col("column").isin(list(extra))))
    hidden = sorted(extra) + sorted(c for c, p in found.items() if p["unit"] == TRANSFORM_INFO and not transform_info)
    shown = sorted(c for c in found if c not in hidden)
    both = {**found, **extra}
    units = {c: p["unit"] or "" for c, p in both.items()}
    kinds = dict(types or {})
    for c in sorted(both):
        name = converted_name(c, units[c]) if scale is not None else c
        condition = (filters or {}).get(name)
        if c not in kinds and condition is not None and not callable(condition):
            sample = condition[1]
            sample = next(iter(sample), None) if isinstance(sample, list | tuple | set | frozenset) else sample
            kinds[c] = "string" if isinstance(sample, str) else "boolean" if isinstance(sample, bool) else "double"
    flat = pivot_cells(every, sorted(both), kinds)
    df = occurrences.join(flat, ID, "inner" if drop_empty else "left")
    if drop_empty and shown:
        df = df.where(reduce(or_, [present(df, c) for c in shown]))
    if scale is not None:
        df = df.join(scale.select(F.col(ID), F.col(SCALE).cast("double").alias("_scale")), ID, "left")
        df = to_millimetres(df.drop(SCALE), units, F.col("_scale")).drop("_scale")
        shown, hidden = ([converted_name(c, units[c]) for c in names] for names in (shown, hidden))
    if filters:
        df = df.where(passing(df, filters))
    return Export(df, found, shown, hidden)


def long_values(df: DataFrame, ids: Column, metric_id: Column, run: str, part: Column, metric: str, value: Column, unit: str | None = None) -> DataFrame:
    """Rows of a table as long measurements; ``value`` is JSON text or a struct."""
    kind = df.select(value.alias("v")).schema[0].dataType
    text = F.to_json(value) if isinstance(kind, T.StructType | T.MapType | T.ArrayType) else value.cast("string") if not isinstance(kind, T.StringType) else value
    return df.select(ids.cast("string").alias(ID), metric_id.cast("long").alias("metric_id"), F.lit(run).alias("run_name"), part.alias("part"), F.lit(metric).alias("metric_name"), F.lit(unit).alias("unit"), F.parse_json(text).alias("value"))


def latest_values(long: DataFrame) -> DataFrame:
    """The newest value of each occurrence (of one run, part and metric)."""
    return long.groupBy(ID).agg(F.max_by("value", "metric_id").alias("value"))


def result_keys(long: DataFrame) -> DataFrame:
    """Which results exist, without reading the values."""
    return long.select(ID, "part", "recipe_hash", "source_mask_hash", "run_name").distinct()


