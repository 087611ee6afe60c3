"""Queries that hold values against labels: sweeps, choices, audits, trade-offs, agreement; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import validate
from gleanery.plans.relational import query, table

_LABELLED = "d AS (SELECT doc_id, n_chars, source, lang, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null")


def _rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" and c not in names else F.col(c) for c, kind in df.dtypes])


_SWEEP = f"""{_LABELLED}, g AS (SELECT n_chars::DOUBLE AS threshold, count(*) FILTER (quality = 0) AS b, count(*) FILTER (quality <> 0) AS c FROM d GROUP BY n_chars),
s AS (SELECT threshold, coalesce(sum(b) OVER w, 0)::BIGINT AS b, coalesce(sum(c) OVER w, 0)::BIGINT AS c, sum(b) OVER ()::BIGINT AS nb, sum(c) OVER ()::BIGINT AS nc FROM g WINDOW w AS (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sweep AS (SELECT threshold, b + c AS n_flagged, b / nullif(b + c, 0)::DOUBLE AS precision, b / nullif(nb, 0)::DOUBLE AS recall, c / nullif(nc, 0)::DOUBLE AS fpr, nb AS n_bad, nc AS n_clean FROM s)"""


@query(f'WITH {_SWEEP} SELECT threshold, n_flagged, round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr, n_bad, n_clean, round(recall, 9) AS recall_0, n_bad AS n_0 FROM sweep')
def sweep_thresholds(spark, sf_dir):
    """Every document length as a threshold for low quality."""
    return _rounded(validate.sweep_thresholds(_labelled(spark, sf_dir), "n_chars", "below", "quality", [0]), "threshold")


@query(f"WITH {_SWEEP} SELECT threshold, n_flagged, round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr, n_bad, n_clean FROM sweep WHERE fpr <= 0.1 AND recall IS NOT NULL ORDER BY sweep.recall DESC, threshold LIMIT 1")
def suggest_threshold(spark, sf_dir):
    """The threshold of highest recall that flags a tenth of the good documents at most."""
    sweep = validate.sweep_thresholds(_labelled(spark, sf_dir), "n_chars", "below", "quality", [0])
    return _rounded(validate.suggest(sweep, max_fpr=0.1).drop("recall_0", "n_0"), "threshold")


@query(
    f"""WITH {_LABELLED}, t AS (SELECT source AS category, count(*) AS n, count(*) FILTER (toxic = 1) AS b FROM d WHERE toxic IS NOT NULL GROUP BY source),
tot AS (SELECT sum(b)::BIGINT AS nb, sum(n - b)::BIGINT AS nc FROM t),
k AS (SELECT row_number() OVER w AS threshold, category, sum(b) OVER w::BIGINT AS b, sum(n - b) OVER w::BIGINT AS c FROM t WHERE n >= 10 WINDOW w AS (ORDER BY b / n::DOUBLE DESC, b DESC, category)
  UNION ALL SELECT 0, NULL, 0, 0)
SELECT threshold, category, b + c AS n_flagged, round(b / nullif(b + c, 0)::DOUBLE, 9) AS precision, round(b / nullif(nb, 0)::DOUBLE, 9) AS recall, round(c / nullif(nc, 0)::DOUBLE, 9) AS fpr, nb AS n_bad, nc AS n_clean FROM k, tot"""
)
def sweep_categories(spark, sf_dir):
    """Dropping the worst sources, for every number of them."""
    return _rounded(validate.sweep_categories(_labelled(spark, sf_dir), "source", "toxic", [1]))


def _wilson_sql(a: str, n: str, name: str) -> str:
    p, z = f"({a} / nullif({n}, 0)::DOUBLE)", 1.96
    centre, below = f"({p} + {z * z} / (2 * nullif({n}, 0)))", f"(1 + {z * z} / nullif({n}, 0))"
    half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}))"
    return f"round({p}, 9) AS {name}, round(greatest(0.0, ({centre} - {half}) / {below}), 9) AS {name}_low, round(least(1.0, ({centre} + {half}) / {below}), 9) AS {name}_high"


_RULES = {"n_chars": (">=", 300), "lang": ("not in", ["de"])}
_AUDIT = f"{_LABELLED}, a AS (SELECT count(*) AS n, count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (n_chars >= 300 AND lang <> 'de') AS n_kept, count(*) FILTER (n_chars >= 300 AND lang <> 'de' AND quality = 0) AS n_kept_bad FROM d)"


@query(
    f"WITH {_AUDIT} SELECT n, n_bad, n_kept, n_kept_bad, {_wilson_sql('n_kept', 'n', 'coverage')}, {_wilson_sql('n_bad', 'n', 'bad_rate_before')}, {_wilson_sql('n_kept_bad', 'n_kept', 'bad_rate_after')}, {_wilson_sql('(n_kept - n_kept_bad)', '(n - n_bad)', 'good_retained')}, {_wilson_sql('(n_bad - n_kept_bad)', 'n_bad', 'bad_caught')}, round((n_bad - n_kept_bad) / n_bad::DOUBLE, 9) AS recall_0, n_bad AS n_0 FROM a"
)
def audit_filters(spark, sf_dir):
    """What a filter set keeps and removes among labelled documents, with 95 percent intervals."""
    return _rounded(validate.score_filters(_labelled(spark, sf_dir), _RULES, "quality", [0]))


@query(
    f"""WITH {_LABELLED}, p AS (SELECT n_chars >= 300 AS a, lang <> 'de' AS b, quality = 0 AS bad FROM d)
SELECT 'n_chars' AS filter, count(*) FILTER (NOT a) AS removed, count(*) FILTER (NOT a AND bad) AS removed_bad, count(*) FILTER (NOT a AND NOT bad) AS removed_good, count(*) FILTER (NOT a AND b) AS removed_only_here, count(*) FILTER (NOT a AND b AND bad) AS only_here_bad, count(*) FILTER (NOT a AND b AND NOT bad) AS only_here_good FROM p
UNION ALL SELECT 'lang', count(*) FILTER (NOT b), count(*) FILTER (NOT b AND bad), count(*) FILTER (NOT b AND NOT bad), count(*) FILTER (NOT b AND a), count(*) FILTER (NOT b AND a AND bad), count(*) FILTER (NOT b AND a AND NOT bad) FROM p"""
)
def filter_shares(spark, sf_dir):
    """What each filter removes, and what it alone removes."""
    return validate.filter_shares(_labelled(spark, sf_dir), _RULES, "quality", [0])


@query("SELECT 'n_chars' AS filter")
def drop_redundant(spark, sf_dir):
    """Filters that catch no bad row alone go, the costliest first: a looser threshold on the same column adds nothing."""
    labelled = _labelled(spark, sf_dir).withColumn("again", F.col("n_chars"))
    left = validate.drop_redundant(labelled, {"n_chars": (">=", 100000000), "again": (">=", 100)}, "quality", [0])
    return spark.createDataFrame([(name,) for name in left], "filter string")


_GRID = ", ".join(f"({'NULL' if f is None else f}::DOUBLE, {'NULL' if p is None else p}::DOUBLE)" for f in validate.GRID_FPR for p in validate.GRID_PRECISION)


@query(
    f"""WITH {_SWEEP}, cons AS (SELECT * FROM (VALUES {_GRID}) t(max_fpr, min_precision)),
b AS (SELECT max_fpr, min_precision, threshold, recall, fpr, n_flagged FROM cons JOIN sweep ON recall IS NOT NULL AND (max_fpr IS NULL OR fpr <= max_fpr) AND (min_precision IS NULL OR precision >= min_precision)
  QUALIFY row_number() OVER (PARTITION BY max_fpr, min_precision ORDER BY recall DESC, threshold) = 1)
SELECT max_fpr, min_precision, threshold, round(recall, 9) AS recall, round(fpr, 9) AS fpr, n_flagged,
  EXISTS (SELECT 1 FROM b o WHERE o.recall > 0 AND o.recall >= b.recall AND o.fpr <= b.fpr AND (o.recall > b.recall OR o.fpr < b.fpr)) AS dominated FROM b WHERE recall > 0"""
)
def tradeoff_frontier(spark, sf_dir):
    """The outcome of every pair of constraints, and which outcomes another one dominates."""
    return _rounded(validate.tradeoffs(_labelled(spark, sf_dir), "n_chars", "below", "quality", [0]), "threshold", "max_fpr", "min_precision")


@query(
    """WITH p AS (SELECT l_extendedprice AS a, l_quantity * p_retailprice AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mean_abs_diff, round(avg(CASE WHEN b <> 0 THEN 100 * abs(a - b) / abs(b) END), 6) AS mean_pct_diff, round(median(CASE WHEN b <> 0 THEN 100 * abs(a - b) / abs(b) END), 6) AS median_pct_diff, round(avg(a - b), 6) AS bias, round(corr(a, b), 6) AS r FROM p"""
)
def compare_metrics(spark, sf_dir):
    """How two measurements of the same things agree."""
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_extendedprice", (F.col("l_quantity") * F.col("p_retailprice")).alias("expected"))
    out = validate.agreement(pairs, "l_extendedprice", "expected")
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    f"""WITH {_SWEEP}, best AS (SELECT * FROM sweep WHERE recall IS NOT NULL AND fpr <= 0.1 ORDER BY recall DESC, threshold LIMIT 1)
SELECT 'n_chars' AS metric, '>=' AS op, threshold FROM best WHERE recall > 0"""
)
def validated_filters(spark, sf_dir):
    """Filters calibrated on labels, ready for an export."""
    rules = validate.validated_filters(_labelled(spark, sf_dir), {"n_chars": "below"}, "quality", bad_labels=[0], max_fpr=0.1)
    return spark.createDataFrame([(m, r[0], float(r[1])) for m, r in rules.items()], "metric string, op string, threshold double")
