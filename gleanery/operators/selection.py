"""Deterministic selection: samples, caps, dedupe, shards, splits, top-k and medoids. Random picks order ids by a seeded hash."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.nulls import clean, missing, present, to_number
from gleanery.operators.filters import matching
from gleanery.sources.tables import written

SEED = 20250101
DEFAULT_FRACTIONS = {"train": 0.7, "val": 0.15, "test": 0.15}


def draw(id_: Column, seed: int = SEED) -> Column:
    """Order of a random pick: the same for an id and seed wherever the row is."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), id_.cast("string")), 256)


def present_in_all(ids: DataFrame, id_col: str, **sets: DataFrame) -> DataFrame:
    """Distinct ids that every named set holds, as STRING."""
    out = ids.select(F.col(id_col).cast("string").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    for held in sets.values():
        out = out.join(held.select(F.col(held.columns[0]).cast("string").alias(id_col)), id_col, "left_semi")
    return out


def present_in_none(ids: DataFrame, id_col: str, **sets: DataFrame) -> DataFrame:
    """Distinct ids that no named set holds, as STRING."""
    out = ids.select(F.col(id_col).cast("string").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    for held in sets.values():
        out = out.join(held.select(F.col(held.columns[0]).cast("string").alias(id_col)), id_col, "left_anti")
    return out


def sample(df: DataFrame, count: int | None, id_col: str, seed: int = SEED) -> DataFrame:
    """``count`` rows (all where there are fewer or count is None), whatever their order; a top-k, so each task sends count rows at most."""
    return df if count is None else df.orderBy(draw(F.col(id_col), seed), F.col(id_col).cast("string")).limit(max(0, count))


def grow(df: DataFrame, target: int, id_col: str, keep: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """A sample of ``target`` that keeps earlier members first: raising target only adds, lowering it trims."""
    held = F.lit(None).cast("boolean")
    if keep is not None:
        mark = keep.select(F.col(keep.columns[0]).alias(id_col)).distinct().withColumn("_held", F.lit(True))
        df, held = df.join(mark, id_col, "left"), F.col("_held")
    ordered = df.orderBy(F.coalesce(held, F.lit(False)).desc(), draw(F.col(id_col), seed), F.col(id_col).cast("string"))
    return ordered.limit(max(0, target)).drop("_held")


def sample_per_group(df: DataFrame, group_col: str, count: int, id_col: str, seed: int = SEED) -> DataFrame:
    """About ``count`` rows over the groups, small groups taken whole before large ones; rows without a group are left out.

    Groups are visited by size (then name); each gets the ceiling of what is left over the groups left.
    """
    known = df.where(present(df, group_col))
    if count <= 0:
        return known.limit(0)
    sizes = known.groupBy(F.col(group_col).alias("_g")).agg(F.count("*").alias("_n"))
    # Groups of one size are one step: sizes are few beside groups. From the first size above the fair share on, all get that share, the first of them one more.
    steps = sizes.groupBy("_n").agg(F.count("*").alias("_k"))
    start = F.struct(F.lit(count).cast("long").alias("left"), F.sum("_k").alias("groups"), F.lit(None).cast("long").alias("cut"))

    def visit(state: Column, x: Column) -> Column:
        whole = state["cut"].isNull() & (x["_n"] * state["groups"] <= state["left"])
        cut = F.when(~whole, F.coalesce(state["cut"], x["_n"]))
        return F.struct((state["left"] - F.when(whole, x["_n"] * x["_k"]).otherwise(0)).alias("left"), (state["groups"] - F.when(whole, x["_k"]).otherwise(0)).alias("groups"), cut.alias("cut"))

    end = steps.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_n", "_k"))), start, visit).alias("end")).select("end.*").first()
    if end["cut"] is None:
        takes = sizes.select("_g", F.col("_n").alias("_take"))
    else:
        share, more = divmod(end["left"], end["groups"])
        large = global_rank(sizes.where(F.col("_n") >= end["cut"]), ["_n", "_g"], "_at")
        takes = sizes.where(F.col("_n") < end["cut"]).select("_g", F.col("_n").alias("_take")).union(large.select("_g", F.lit(share) + (F.col("_at") < more).cast("long")))
    order = Window.partitionBy(group_col).orderBy(draw(F.col(id_col), seed), F.col(id_col).cast("string"))
    ranked = known.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count)
    return ranked.join(takes, ranked[group_col] == takes["_g"]).where("_rank <= _take").drop("_rank", "_g", "_take")


def cap_per_group(df: DataFrame, group_col: str, max_count: int, order_col: str, rule: str = "random", seed: int = SEED, keep: DataFrame | None = None, prefer: Mapping | None = None) -> DataFrame:
    """At most ``max_count`` rows of each group: preferred and kept ones first, then preferred, then kept, then the rest.

    Inside a tier the rule decides: random (by hash of ``order_col``), first or last (by ``order_col``, the source
    order or id). Rows without a group are never removed. Spark cuts each task's groups to ``max_count`` rows before
    the shuffle, so one large group doesn't move.
    """
    if rule not in ("random", "first", "last"):
        raise ValueError(f"unknown rule {rule!r}: random, first or last")
    if group_col not in df.columns:
        raise KeyError(group_col)
    held = F.lit(False)
    work = df
    if keep is not None:
        work = df.join(keep.select(F.col(keep.columns[0]).alias(order_col)).distinct().withColumn("_held", F.lit(True)), order_col, "left")
        held = F.coalesce("_held", F.lit(False))
    tier = F.when(matching(work, prefer), 0).otherwise(2) if prefer else F.lit(0)
    work = work.withColumn("_tier", tier + F.when(held, 0).otherwise(1))
    inner = {"random": draw(F.col(order_col), seed).asc(), "first": F.col(order_col).asc(), "last": F.col(order_col).desc()}[rule]
    absent = missing(work, group_col)
    ranked = work.where(~absent).withColumn("_rank", F.row_number().over(Window.partitionBy(group_col).orderBy("_tier", inner, F.col(order_col)))).where(F.col("_rank") <= max_count).drop("_rank")
    return ranked.unionByName(work.where(absent)).select(*df.columns)


def dedupe_by(df: DataFrame, key_cols: Sequence[str], order_col: str, precision: Mapping[str, int] | None = None, rule: str = "random", seed: int = SEED, keep: DataFrame | None = None, prefer: Mapping | None = None) -> DataFrame:
    """One row per combination of keys; rows that lack a key stay.

    Keys named in ``precision`` are numbers rounded half to even. Preferred rows all stay and displace others of
    their combination; which other row stays is ``cap_per_group``'s choice of one.
    """
    work, keys = df, []
    for name in key_cols:
        if name not in df.columns:
            raise KeyError(name)
        value = F.col(name)
        if precision and name in precision:
            value = F.bround(to_number(value), precision[name]) + F.lit(0.0)
        elif df.schema[name].dataType.typeName() in ("double", "float"):
            value = clean(value)
        work = work.withColumn(f"_key_{name}", value)
        keys.append(f"_key_{name}")
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    work = work.withColumn("_combination", F.when(whole, F.struct(*keys))).drop(*keys)
    protected = None
    if prefer:
        is_preferred = matching(df, prefer)
        protected = work.where(is_preferred)
        claimed = protected.where("_combination is not null").select("_combination").distinct()
        work = work.where(~is_preferred).join(claimed, "_combination", "left_anti")
    out = cap_per_group(work, "_combination", 1, order_col, rule, seed, keep)
    return (out if protected is None else protected.unionByName(out)).select(*df.columns)


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 0) in a total order, without gathering the rows: ranges are sorted apart and offset by the counts before them."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_before") + inside).drop("_part", "_place", "_before")


def shard(df: DataFrame, id_col: str, index: int, total: int) -> DataFrame:
    """Every ``total``-th row by sorted id from ``index`` on: shards are disjoint and differ by one row at most."""
    if total < 1 or not 0 <= index < total:
        raise ValueError(f"no shard {index} of {total}")
    return global_rank(df.withColumn("_text", F.col(id_col).cast("string")), ["_text"], "_at").where(F.col("_at") % total == index).drop("_at", "_text")


def worst(df: DataFrame, value_col: str, count: int, id_col: str, ascending: bool = True) -> DataFrame:
    """The ``count`` rows of lowest (or highest) value; missing values are left out, ties go to the smaller id."""
    value = F.col(value_col).asc() if ascending else F.col(value_col).desc()
    return df.where(present(df, value_col)).orderBy(value, F.col(id_col)).limit(max(0, count))


def split(df: DataFrame, id_col: str, fractions: Mapping[str, float] | None = None, group_col: str | None = None, stratify_col: str | None = None, seed: int = 0) -> DataFrame:
    """``df`` with a column split: groups go whole to one side, each stratum is divided in the fractions.

    A group belongs to the first stratum (by name) that has it; rows without a stratum are one of their own, rows
    without a group have no split. Inside a stratum groups are shuffled by hash and cut where (place + 0.5) / groups
    passes the cumulated fractions; a place on a bound goes to the next side.
    """
    fractions = dict(fractions or DEFAULT_FRACTIONS)
    total = sum(fractions.values())
    if total <= 0:
        raise ValueError("fractions must sum to something positive")
    group = F.col(group_col or id_col)
    stratum = F.coalesce(F.col(stratify_col).cast("string"), F.lit("__unlabelled__")) if stratify_col else F.lit("__all__")
    groups = df.select(group.alias("_group"), stratum.alias("_stratum")).where("_group is not null").groupBy("_group").agg(F.min("_stratum").alias("_stratum"))
    ranked = global_rank(groups.withColumn("_draw", draw(F.col("_group"), seed)), ["_stratum", "_draw", "_group"], "_at")
    strata = ranked.groupBy("_stratum").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    position = (F.col("_at") - F.col("_first") + 0.5) / F.col("_n")
    side, bound = F.lit(list(fractions)[-1]), np.cumsum([v / total for v in fractions.values()])
    for name, upper in list(zip(fractions, bound, strict=True))[-2::-1]:
        side = F.when(position < float(upper), name).otherwise(side)
    sides = ranked.join(strata, "_stratum").select("_group", side.alias("split"))
    return df.join(sides, group == F.col("_group"), "left").drop("_group")


def thin_ranks(count: int, cap: int, keep: Sequence[int] = ()) -> list[int]:
    """At most ``cap`` ranks of ``count``, evenly spread, forced ones included."""
    if count <= cap:
        return list(range(count))
    forced = sorted({k for k in keep if 0 <= k < count})[:cap]
    spread = np.linspace(0, count - 1, max(0, cap - len(forced))).round().astype(int).tolist()
    return sorted({*forced, *spread})


#: Rows of one block of the pairwise distances inside a group.
MEDOID_ROWS = 1024


def medoids(df: DataFrame, id_col: str, vector_col: str, group_col: str, count: int = 1, normalize: bool = False) -> DataFrame:
    """Per group the ``count`` rows of smallest summed Euclidean distance to the group: (group, id, total).

    Rows without a group, vector or with a missing component are left out; ties go to the smaller id. Groups are dealt
    into blocks by hash and pairs of blocks are compared in numpy, so no task holds a group; the work is quadratic in
    a group's size.
    """
    v = F.col(vector_col).cast("array<double>")
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    unit = F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))
    rows = df.where(present(df, group_col)).where(whole).select(F.col(group_col).alias("_g"), F.col(id_col).alias("_id"), (unit if normalize else v).alias("_v"))
    sizes = rows.groupBy("_g").agg(F.ceil(F.count("*") / MEDOID_ROWS).alias("_blocks"))
    dealt = rows.join(sizes, "_g").withColumn("_block", F.expr("pmod(xxhash64(_id), _blocks)"))
    sides = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    left = sides.select("_g", F.col("_block").alias("_i"), F.col("_other").alias("_j"), "_id", "_v")
    right = sides.select(F.col("_g").alias("_h"), F.col("_other").alias("_k"), F.col("_block").alias("_l"), F.col("_id").alias("_id2"), F.col("_v").alias("_w"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"_g": [], "_id": [], "total": []})
        x, y = np.stack(a["_v"].to_numpy()), np.stack(b["_w"].to_numpy())
        apart = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
        apart[a["_id"].to_numpy()[:, None] == b["_id2"].to_numpy()[None, :]] = 0
        return pd.DataFrame({"_g": a["_g"], "_id": a["_id"], "total": apart.sum(1)})

    schema = rows.select("_g", "_id").withColumn("total", F.lit(0.0)).schema
    partial = left.groupBy("_g", "_i", "_j").cogroup(right.groupBy("_h", "_k", "_l")).applyInPandas(sums, schema)
    totals = partial.groupBy("_g", "_id").agg(F.sum("total").alias("total"))
    order = Window.partitionBy("_g").orderBy(F.round("total", 9), "_id")
    best = totals.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count)
    return best.select(F.col("_g").alias(group_col), F.col("_id").alias(id_col), "total")
