"""Against human labels: threshold and category sweeps, constrained choice, audits with intervals, redundancy, trade-offs, agreement."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.nulls import clean, present, to_number
from gleanery.operators.filters import passing
from gleanery.sources.tables import written

#: Rows and bad rows below which an audit's intervals support no claim.
AUDIT_ROWS, AUDIT_BAD = 50, 10
MIN_LABELLED = 10
MAX_FPR = 0.02
#: Constraints that a trade-off table tries.
GRID_FPR = (0.01, 0.02, 0.05, 0.10, 0.20, 0.30, None)
GRID_PRECISION = (None, 0.5, 0.6, 0.7, 0.8, 0.9)
KEEP = {"above": "<=", "below": ">="}


def running_sums(df: DataFrame, order: Sequence[Column], sums: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``df`` with the sums of all rows before each one in a total order; ranges are summed apart and offset, so no task holds all rows."""
    keyed = df.withColumn("_order", F.struct(*order))
    placed = written(keyed.repartitionByRange("_order").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = placed.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums})
    joined = inside.join(F.broadcast(offsets), "_part")
    return joined.withColumns({n: F.col(f"_o_{s}") + F.col(f"_i_{s}") for s, n in zip(sums, names, strict=True)}).select(*df.columns, *names)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _rates(df: DataFrame, n_bad: int, n_clean: int) -> DataFrame:
    flagged = F.col("_bad") + F.col("_clean")
    return df.withColumns({"n_flagged": flagged, "precision": _ratio(F.col("_bad"), flagged), "recall": _ratio(F.col("_bad"), F.lit(n_bad)), "fpr": _ratio(F.col("_clean"), F.lit(n_clean)), "n_bad": F.lit(n_bad).cast("long"), "n_clean": F.lit(n_clean).cast("long")})


def sweep_thresholds(df: DataFrame, metric: str, flag_when: str, label: str, bad_labels: Sequence[Any]) -> DataFrame:
    """Every observed value as a threshold: rows strictly below (above) it are flagged; NULL where a denominator is zero.

    Columns threshold, n_flagged, precision, recall, fpr, n_bad, n_clean and for each bad label recall_<label> and
    n_<label>. Rows without a number or a label are left out.
    """
    if flag_when not in KEEP:
        raise ValueError("flag_when is 'below' or 'above'")
    for c in (metric, label):
        if c not in df.columns:
            raise KeyError(c)
    rows = df.where(present(df, label)).select(clean(to_number(F.col(metric))).alias("threshold"), F.col(label).alias("_l")).where("threshold is not null")
    bad = F.col("_l").isin(list(bad_labels))
    per = rows.groupBy("threshold").agg(F.count_if(bad).alias("_b"), F.count_if(~bad).alias("_c"), *[F.count_if(F.col("_l") == x).alias(f"_k{k}") for k, x in enumerate(bad_labels)])
    names = ["_b", "_c", *[f"_k{k}" for k in range(len(bad_labels))]]
    flagged = ["_bad", "_clean", *[f"_f{k}" for k in range(len(bad_labels))]]
    order = F.col("threshold") if flag_when == "below" else -F.col("threshold")
    per = written(per)
    totals = per.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    swept = _rates(running_sums(per, [order], names, flagged), totals["_b"], totals["_c"])
    extra = []
    for k, x in enumerate(bad_labels):
        extra += [_ratio(F.col(f"_f{k}"), F.lit(totals[f"_k{k}"])).alias(f"recall_{x}"), F.lit(totals[f"_k{k}"]).cast("long").alias(f"n_{x}")]
    return swept.select("threshold", "n_flagged", "precision", "recall", "fpr", "n_bad", "n_clean", *extra)


def category_table(df: DataFrame, metric: str, label: str, bad_labels: Sequence[Any], min_labelled: int = MIN_LABELLED) -> DataFrame:
    """Per category n, n_bad, bad_rate and whether it has enough labels to be dropped."""
    rows = df.where(present(df, metric)).where(present(df, label))
    per = rows.groupBy(F.col(metric).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col(label).isin(list(bad_labels))).alias("n_bad"))
    return per.withColumn("bad_rate", F.col("n_bad") / F.col("n")).withColumn("enough_labels", F.col("n") >= min_labelled)


def sweep_categories(df: DataFrame, metric: str, label: str, bad_labels: Sequence[Any], min_labelled: int = MIN_LABELLED) -> DataFrame:
    """Dropping the worst k categories, for every k from 0: threshold is k, category the k-th worst (NULL for 0).

    Worst first by bad rate, then by number of bad labels, then by name; categories with too few labels are never
    dropped. The rates count all labelled rows.
    """
    table = written(category_table(df, metric, label, bad_labels, min_labelled))
    total = table.agg(F.coalesce(F.sum("n_bad"), F.lit(0)).alias("b"), F.coalesce(F.sum(F.col("n") - F.col("n_bad")), F.lit(0)).alias("c")).first()
    per = table.where("enough_labels").select(F.col("category").cast("string").alias("category"), "bad_rate", F.col("n_bad").alias("_b"), (F.col("n") - F.col("n_bad")).alias("_c"), F.lit(1).cast("long").alias("_one"))
    summed = running_sums(per, [-F.col("bad_rate"), -F.col("_b"), F.col("category")], ["_one", "_b", "_c"], ["_k", "_pb", "_pc"])
    dropped = summed.select((F.col("_k") + 1).alias("threshold"), "category", (F.col("_pb") + F.col("_b")).alias("_bad"), (F.col("_pc") + F.col("_c")).alias("_clean"))
    none = table.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    swept = _rates(dropped.union(none), total["b"], total["c"])
    return swept.select("threshold", "category", "n_flagged", "precision", "recall", "fpr", "n_bad", "n_clean")


def suggest(sweep: DataFrame, min_precision: float | None = None, max_fpr: float | None = None) -> DataFrame:
    """The row of highest recall within the constraints, of several the lowest threshold; no row where none satisfies or no bad label exists."""
    kept = sweep.where("recall is not null")
    if min_precision is not None:
        kept = kept.where(F.col("precision") >= min_precision)
    if max_fpr is not None:
        kept = kept.where(F.col("fpr") <= max_fpr)
    return kept.orderBy(F.desc("recall"), F.asc("threshold")).limit(1)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval; NULL where n is zero."""
    n, p = n.cast("double"), successes / F.when(n != 0, n)
    below = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / below
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / below
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def wilson_interval(successes: int, n: int, z: float = 1.96) -> tuple[float, float]:
    if not n:
        return math.nan, math.nan
    p, below = successes / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / below, z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / below
    return max(0.0, centre - half), min(1.0, centre + half)


def _judged(labelled: DataFrame, filters: Mapping[str, Any], label: str, bad_labels: Sequence[Any]) -> DataFrame:
    """Per combination of passed filters and badness how many rows: at most 2 to the number of filters and one rows."""
    rows = labelled.where(present(labelled, label))
    marks = [passing(labelled, {c: rule}).alias(f"p{k}") for k, (c, rule) in enumerate(filters.items())]
    return rows.select(*marks, F.coalesce(F.col(label).isin(list(bad_labels)), F.lit(False)).alias("bad")).groupBy(*[f"p{k}" for k in range(len(filters))], "bad").count()


def score_filters(labelled: DataFrame, filters: Mapping[str, Any], label: str, bad_labels: Sequence[Any]) -> DataFrame:
    """One row: n, n_bad, n_kept, n_kept_bad, and coverage, bad_rate_before, bad_rate_after, good_retained, bad_caught each with _low and _high, and recall_<label>, n_<label>."""
    rows = labelled.where(present(labelled, label))
    bad, kept = F.coalesce(F.col(label).isin(list(bad_labels)), F.lit(False)), passing(labelled, filters)
    per = [x for k, v in enumerate(bad_labels) for x in (F.count_if(F.col(label) == v).alias(f"_n{k}"), F.count_if((F.col(label) == v) & ~kept).alias(f"_r{k}"))]
    one = rows.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"), F.count_if(kept).alias("n_kept"), F.count_if(kept & bad).alias("n_kept_bad"), *per)
    c = F.col
    pairs = {"coverage": (c("n_kept"), c("n")), "bad_rate_before": (c("n_bad"), c("n")), "bad_rate_after": (c("n_kept_bad"), c("n_kept")), "good_retained": (c("n_kept") - c("n_kept_bad"), c("n") - c("n_bad")), "bad_caught": (c("n_bad") - c("n_kept_bad"), c("n_bad"))}
    out = ["n", "n_bad", "n_kept", "n_kept_bad"]
    for name, (a, b) in pairs.items():
        low, high = wilson(a, b)
        out += [_ratio(a, b).alias(name), low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    for k, v in enumerate(bad_labels):
        out += [_ratio(c(f"_r{k}"), c(f"_n{k}")).alias(f"recall_{v}"), c(f"_n{k}").alias(f"n_{v}")]
    return one.select(*out)


def filter_shares(labelled: DataFrame, filters: Mapping[str, Any], label: str, bad_labels: Sequence[Any]) -> DataFrame:
    """Per filter what it removes (removed, _bad, _good) and what it alone removes (removed_only_here, only_here_bad, only_here_good)."""
    judged = _judged(labelled, filters, label, bad_labels)
    parts = []
    for k, name in enumerate(filters):
        failed = ~F.col(f"p{k}")
        alone = reduce(and_, [F.col(f"p{j}") for j in range(len(filters)) if j != k], failed)
        add = lambda test: F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0)).cast("long")
        bad = F.col("bad")
        parts.append(judged.agg(F.lit(name).alias("filter"), add(failed).alias("removed"), add(failed & bad).alias("removed_bad"), add(failed & ~bad).alias("removed_good"), add(alone).alias("removed_only_here"), add(alone & bad).alias("only_here_bad"), add(alone & ~bad).alias("only_here_good")))
    return reduce(DataFrame.unionByName, parts)


def drop_redundant(labelled: DataFrame, filters: Mapping[str, Any], label: str, bad_labels: Sequence[Any]) -> dict[str, Any]:
    """Filters without those that catch no bad row alone, dropped one at a time, the costliest first.

    One pass counts the combinations of passed filters; the greedy steps run on that small table on the driver.
    """
    counts = [(tuple(r[k] for k in range(len(filters))), r["bad"], r["count"]) for r in _judged(labelled, filters, label, bad_labels).collect()]
    kept = dict(enumerate(filters))
    while len(kept) > 1:
        costs = []
        for k, name in kept.items():
            alone = [(bad, n) for passed, bad, n in counts if not passed[k] and all(passed[j] for j in kept if j != k)]
            if not any(bad for bad, _ in alone):
                removed = sum(n for passed, bad, n in counts if not passed[k] and not bad)
                costs.append((-sum(n for _, n in alone), -removed, name, k))
        if not costs:
            break
        del kept[min(costs)[3]]
    return {name: filters[name] for name in kept.values()}


def tradeoffs(df: DataFrame, metric: str, flag_when: str, label: str, bad_labels: Sequence[Any]) -> DataFrame:
    """Per pair of constraints the threshold chosen and its outcome, and whether another outcome dominates it.

    Columns max_fpr, min_precision (NULL: none), threshold, recall, fpr, n_flagged, dominated. Dominated: some other
    row has no lower recall and no higher fpr, and is better in one.
    """
    sweep = written(sweep_thresholds(df, metric, flag_when, label, bad_labels))
    spark = sweep.sparkSession
    grid = spark.createDataFrame([(f, p) for f in GRID_FPR for p in GRID_PRECISION], "max_fpr double, min_precision double")
    able = grid.join(sweep.where("recall is not null"), F.coalesce(F.col("fpr") <= F.col("max_fpr"), F.col("max_fpr").isNull()) & F.coalesce(F.col("precision") >= F.col("min_precision"), F.col("min_precision").isNull()))
    best = able.groupBy("max_fpr", "min_precision").agg(F.max_by(F.struct("threshold", "recall", "fpr", "n_flagged"), F.struct("recall", -F.col("threshold"))).alias("b")).select("max_fpr", "min_precision", "b.*").where("recall > 0")
    best = written(best)
    other = best.select(F.col("recall").alias("_r"), F.col("fpr").alias("_f")).distinct()
    beaten = (other["_r"] >= best["recall"]) & (other["_f"] <= best["fpr"]) & ((other["_r"] > best["recall"]) | (other["_f"] < best["fpr"]))
    lost = best.join(F.broadcast(other), beaten, "left_semi").select("threshold").distinct().withColumn("dominated", F.lit(True))
    return best.join(lost, "threshold", "left").select("max_fpr", "min_precision", "threshold", "recall", "fpr", "n_flagged", F.coalesce("dominated", F.lit(False)).alias("dominated"))


def choose_rule(df: DataFrame, metric: str, direction: str, label: str, bad_labels: Sequence[Any], max_fpr: float | None = MAX_FPR, min_precision: float | None = None, default: float | None = None, min_labelled: int = MIN_LABELLED) -> tuple | None:
    """The export filter one metric gets: (">=" or "<=", threshold) or ("not in", categories); None where nothing bad is caught.

    Without a threshold inside the constraints the default is taken, if there is one.
    """
    if direction == "category":
        sweep = written(sweep_categories(df, metric, label, bad_labels, min_labelled))
        row = suggest(sweep, min_precision, max_fpr).first()
        if row is None or not row["recall"]:
            return None
        kind = df.schema[metric].dataType
        dropped = sweep.where(F.col("threshold").between(1, row["threshold"])).select(F.col("category").cast(kind).alias("c")).collect()
        return "not in", [r["c"] for r in dropped]
    row = suggest(sweep_thresholds(df, metric, direction, label, bad_labels), min_precision, max_fpr).first()
    if row is None:
        return None if default is None else (KEEP[direction], float(default))
    return (KEEP[direction], row["threshold"]) if row["recall"] > 0 else None


def validated_filters(df: DataFrame, specs: Mapping[str, str], label: str, bad_labels: Sequence[Any] | None = None, good_labels: Sequence[Any] | None = None, max_fpr: float | None = MAX_FPR, min_precision: float | None = None, defaults: Mapping[str, float] | None = None, redundant: bool = True, min_labelled: int = MIN_LABELLED) -> dict[str, tuple]:
    """Filters {metric: rule} calibrated against labels, ready for an export; with ``redundant`` off, superfluous ones are dropped."""
    bad = bad_values(df, label, bad_labels, good_labels)
    rules = {m: choose_rule(df, m, d, label, bad, max_fpr, min_precision, (defaults or {}).get(m), min_labelled) for m, d in specs.items()}
    rules = {m: r for m, r in rules.items() if r is not None}
    return rules if redundant or len(rules) < 2 else drop_redundant(df, rules, label, bad)


def bad_values(df: DataFrame, label: str, bad_labels: Sequence[Any] | None, good_labels: Sequence[Any] | None) -> list:
    """The labels that count as bad: those given, or all but the good ones."""
    if (bad_labels is None) == (good_labels is None):
        raise ValueError("give either the bad labels or the good ones")
    if bad_labels is not None:
        return list(bad_labels)
    good = {str(x) for x in good_labels}
    return sorted(r[0] for r in df.where(present(df, label)).select(F.col(label)).distinct().collect() if str(r[0]) not in good)


def disjoint(a: DataFrame, b: DataFrame, id_col: str) -> bool:
    """Whether two sets of rows share no id, as a calibration and its audit must."""
    return a.select(id_col).join(b.select(id_col), id_col, "left_semi").isEmpty()


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of a column's numbers, None without any: values are dealt by ranges, and only the ranges that hold the middle are looked into, so no task holds all distinct values."""
    placed = written(df.select(F.col(column).cast("double").alias("v")).where("v is not null").repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    parts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in parts)
    found = []
    for rank in {(total - 1) // 2, total // 2} if total else ():
        before = 0
        for part, n in parts:
            if rank < before + n:
                break
            before += n
        values = placed.where(F.col("_part") == part).groupBy("v").agg(F.count("*").alias("n"))
        reached = values.withColumn("_to", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        found.append(reached.where(F.col("_to") > rank - before).agg(F.min("v")).first()[0])
    return sum(found) / len(found) if found else None


def agreement(pairs: DataFrame, predicted: str, reference: str) -> DataFrame:
    """One row: n, mean_abs_diff, mean_pct_diff and median_pct_diff (reference 0 left out), bias, r (NULL below two pairs)."""
    both = pairs.select(clean(F.col(predicted).cast("double")).alias("p"), clean(F.col(reference).cast("double")).alias("r")).where("p is not null and r is not null")
    apart = F.abs(F.col("p") - F.col("r"))
    both = written(both.withColumns({"apart": apart, "share": F.when(F.col("r") != 0, 100 * apart / F.abs("r"))}))
    middle = F.lit(median(both, "share")).cast("double")
    return both.agg(F.count("*").alias("n"), F.avg("apart").alias("mean_abs_diff"), F.avg("share").alias("mean_pct_diff"), middle.alias("median_pct_diff"), F.avg(F.col("p") - F.col("r")).alias("bias"), F.when(F.count("*") > 1, F.corr("p", "r")).alias("r"))
