"""Functions of stored values: feature vectors and columns, presence of colours, recorded diagnostics, standard scores with a population fallback."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.nulls import clean, missing


def feature_vector(value: Column) -> Column:
    """A VARIANT as array<double>: a list as it is, a number alone, an object's numbers by key; anything else, booleans too, is NULL."""
    kind = F.schema_of_variant(value)
    numbers = F.try_variant_get(value, "$", "map<string,variant>")
    held = F.map_filter(numbers, lambda _, v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"))
    entries = F.array_sort(F.map_entries(F.transform_values(held, lambda _, v: F.try_variant_get(v, "$", "double"))))
    listed = F.try_variant_get(value, "$", "array<double>")
    alone = F.array(F.try_variant_get(value, "$", "double"))
    return F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), F.when(F.size(entries) > 0, F.transform(entries, lambda e: e["value"]))).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), alone)


def same_length(df: DataFrame, vector_col: str) -> DataFrame:
    """``df`` with vectors of another than the commonest length (of equally common ones the shorter) NULL."""
    best = df.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return df if best is None else df.withColumn(vector_col, F.when(F.size(vector_col) == best["n"], F.col(vector_col)))


def feature_columns(df: DataFrame, vector_col: str, name: str, width: int) -> DataFrame:
    """One DOUBLE column <name>_<i> per component."""
    return df.select(*[c for c in df.columns if c != vector_col], *[F.get(vector_col, k).alias(f"{name}_{k}") for k in range(width)])


def color_presence(df: DataFrame, fractions: Sequence[str], min_fraction: float = 0.1, ranked: int = 2) -> DataFrame:
    """``df`` with present_<colour>, n_present and color_1.. (the largest present shares, ties in the order given)."""
    shares = F.array(*[F.struct((-F.coalesce(clean(F.col(c).cast("double")), F.lit(0.0))).alias("s"), F.lit(k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(fractions)])
    there = F.filter(F.array_sort(shares), lambda x: -x["s"] >= min_fraction)
    flags = {f"present_{c}": F.coalesce(clean(F.col(c).cast("double")) >= min_fraction, F.lit(False)) for c in fractions}
    return df.withColumns(flags | {"n_present": F.size(there).cast("long")} | {f"color_{k + 1}": F.get(there, k)["name"] for k in range(ranked)})


def mask_info(masks: DataFrame, key: str = "occurrence_id") -> DataFrame:
    """(key, name, value): what operations recorded, flattened to <operation>__<key>; masks without any are left out."""
    each = masks.where("info is not null").select(key, F.explode(F.from_json("info", "map<string,map<string,string>>")).alias("label", "held"))
    return each.select(key, "label", F.explode("held").alias("k", "value")).select(key, F.concat_ws("__", "label", "k").alias("name"), "value")


def derived(df: DataFrame, name: str, expression: str, features: Sequence[str]) -> DataFrame:
    """``df`` with a column by a SQL expression over features; NULL unless all of them are there."""
    known = F.lit(True)
    for f in features:
        known = known & ~missing(df, f)
    return df.withColumn(name, F.when(known, F.expr(expression)))


def group_zscores(df: DataFrame, features: Sequence[str], group_col: str, min_group_size: int = 1) -> DataFrame:
    """``df`` with z_<feature> against the row's group, or the population where the group is missing or too small; ``fit_group`` says which (NULL: population).

    Rows that lack a feature take no part. Statistics are two small aggregations joined back.
    """
    good = df
    for f in features:
        good = good.where(~missing(df, f))
    stats = lambda: [x for f in features for x in (F.avg(F.col(f)).alias(f"_m_{f}"), F.stddev_pop(F.col(f)).alias(f"_s_{f}"))]
    groups = good.where(~missing(df, group_col)).groupBy(F.col(group_col).alias("fit_group")).agg(F.count("*").alias("_n"), *stats()).where(F.col("_n") >= min_group_size)
    every = good.agg(*stats()).first()
    joined = good.join(groups, good[group_col] == groups["fit_group"], "left")
    of = lambda f, k: F.when(F.col("fit_group").isNotNull(), F.col(f"_{k}_{f}")).otherwise(F.lit(every[f"_{k}_{f}"]))
    z = {f"z_{f}": F.when(of(f, "s") > 0, (F.col(f) - of(f, "m")) / of(f, "s")).otherwise(0.0) for f in features}
    return joined.withColumns(z).select(*df.columns, "fit_group", *z)


def summary(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Counts of rows and of distinct occurrences per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_values"), F.count_distinct(id_col).alias("n_occurrences"))


def pick_by_rules(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """``df`` with label: that of the first expression that holds."""
    out = F.lit(None).cast("string")
    for label, test in reversed(list(labels.items())):
        out = F.when(F.coalesce(F.expr(test), F.lit(False)), label).otherwise(out)
    return df.withColumn("label", out)
