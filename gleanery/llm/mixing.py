"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import fresh, materialize, release

#: What a null in a raked column counts as.
NONE = "(none)"
#: Rounds at most, rounds after which the plan is cut and the fit looked at, and the gap at which it has converged.
ROUNDS, CUT, TOLERANCE = 20, 5, 1e-12
#: Cells that are raked in one task.
TOGETHER = 200_000
SEED = "mix"
#: Marginals of the registered query: each share is the observed one to this power, scaled to sum to 1.
POWERS = {"source": 0.8, "lang": 0.9, "topic": 1.0}
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A plain rule: texts that speak of a licence, that hold an address, that hold a digit, others."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.lower(whole).contains("licen"), "licence").when(whole.contains("@"), "address").when(whole.rlike("[0-9]"), "figures").otherwise("prose")


def _cell(docs: DataFrame, dims: dict[str, Column], keys: list[str]) -> DataFrame:
    return docs.withColumns({key: F.coalesce(column.cast("string"), F.lit(NONE)) for key, column in zip(keys, dims.values(), strict=True)})


def calibrate(docs: DataFrame, dims: dict[str, Column], powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per cell (one value of every dimension, in columns ``__`` and its name): tokens, documents, and the probability ``__p`` of its documents.

    Targets of a dimension come from ``targets[name]`` with columns value and share (values it lacks keep their
    observed share of the tokens, the others split the rest), else from ``powers[name]``. Each half-step multiplies
    the cells of a value by target over current weight. After every ``CUT`` rounds the largest gap between a
    marginal and its target is measured; at ``TOLERANCE`` of all tokens the fit has converged and ends, at the latest
    after ``rounds`` rounds (targets that contradict each other or the empty cells never meet). Column gap of the
    result is the largest gap left, as a share of the tokens. Probabilities are the resulting factors over the
    largest one of a cell with tokens, so all are 1 at most and expected tokens are in the fitted proportions. Cells
    without tokens take the factor of their values. No documents: no cells. Texts of any length count whole.

    Up to ``TOGETHER`` cells are raked in one task, by window functions that spill; more stay spread.
    """
    names = list(dims)
    keys = [f"__{name}" for name in names]
    held = docs.select(*[F.coalesce(column.cast("string"), F.lit(NONE)).alias(key) for key, column in zip(keys, dims.values(), strict=True)], F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    cells = materialize(held.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "cells")
    size = cells.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("cells")).first()
    total = float(size.tokens or 0)
    near = lambda df: df.coalesce(1) if size.cells <= TOGETHER else df
    everywhere = Window.partitionBy()
    fitted = near(cells).withColumn("f", F.lit(1.0))
    for name, key in zip(names, keys, strict=True):
        value = Window.partitionBy(key)
        fitted = fitted.withColumns({"n": F.sum("tokens").over(value).cast("double"), "k": F.count("*").over(value)})
        if targets and name in targets:
            fitted = near(fitted.join(targets[name].select(F.col("value").cast("string").alias(key), F.col("share").cast("double").alias("share")), key, "left"))
            named = F.coalesce(F.sum(F.col("share") / F.col("k")).over(everywhere), F.lit(1.0))
            rest = F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("tokens"))).over(everywhere), F.lit(0))
            goal = F.when(F.col("share").isNull(), F.col("n")).otherwise(F.col("share") / named * (total - rest))
        else:
            powered = F.pow(F.col("n"), F.lit(float((powers or {}).get(name, 1.0))))
            goal = powered / F.sum(powered / F.col("k")).over(everywhere) * total
        fitted = fitted.withColumn(f"goal{key}", goal).drop("n", "k", "share")
    fitted = materialize(fitted, "goals")
    now = {key: F.sum(F.col("tokens") * F.col("f")).over(Window.partitionBy(key)) for key in keys}
    gap, most = F.greatest(F.lit(0.0), *(F.abs(now[key] - F.col(f"goal{key}")) for key in keys)), 1.0
    for turn in range(0, rounds, CUT):
        fitted = near(fitted)
        for _ in range(min(CUT, rounds - turn)):
            for key in keys:
                fitted = fitted.withColumn("f", F.col("f") * F.when(now[key] > 0, F.col(f"goal{key}") / now[key]).otherwise(1.0))
        before, fitted = fitted, materialize(fitted.withColumn("gap", gap), "fitted")
        release(before)
        reached = fitted.agg(F.max("gap").alias("gap"), F.max(F.when(F.col("tokens") > 0, F.col("f"))).alias("most")).first()
        most = reached.most or 1.0
        if (reached.gap or 0.0) <= TOLERANCE * total:
            break
        if turn + CUT < rounds:
            fitted = fitted.drop("gap")
    return fitted.select(*keys, "tokens", "documents", F.least(F.lit(1.0), F.col("f") / most).alias("__p"), (F.col("gap") / (total or 1.0)).alias("gap"))


def chance(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the seed and the id decide (the text, for rows without an id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample(docs: DataFrame, dims: dict[str, Column], **fit) -> DataFrame:
    """The sampled rows of ``docs`` with their cell (``__`` and the dimension) and probability ``__p``; where ``docs`` has a column of such a name, the added one gets underscores at its end.

    Null values are a value of their own; null and empty texts hold no tokens. Repeated ids are kept or left
    together. The cells are few beside the documents; the join broadcasts them only where Spark finds the written
    table small, else it is a shuffle with plain sides that are split when skewed.
    """
    cells = calibrate(docs, dims, **fit)
    keys = [fresh(docs, name) for name in dims]
    p = fresh(docs, "p")
    renamed = cells.select(*[F.col(f"__{name}").alias(key) for name, key in zip(dims, keys, strict=True)], F.col("__p").alias(p))
    met = _cell(docs, dims, keys).join(renamed, keys)
    return met.where(chance(F.col("doc_id"), F.col("text")) < F.col(p))


def default_dims() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The sampled documents with their cell and probability."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = sample(docs, default_dims(), powers=POWERS)
    return kept.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.round("__p", 6).alias("probability"))


def _mix_sql() -> str:
    names = list(POWERS)
    steps = [rf"""WITH d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t,
  CASE WHEN lower(coalesce(text, '')) LIKE '%licen%' THEN 'licence' WHEN text LIKE '%@%' THEN 'address' WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic FROM documents),
c AS (SELECT source, lang, topic, sum(len(regexp_extract_all(t, '{WORD}'))) AS tokens FROM d GROUP BY ALL)"""]
    for name in names:
        steps.append(f"g_{name} AS (SELECT {name}, pow(n, {POWERS[name]}) / sum(pow(n, {POWERS[name]})) OVER () * sum(n) OVER () AS goal_{name} FROM (SELECT {name}, sum(tokens)::DOUBLE AS n FROM c GROUP BY {name}))")
    steps.append("f0 AS (SELECT *, 1.0::DOUBLE AS f FROM c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))")
    last = "f0"
    for turn in range(ROUNDS):
        for name in names:
            steps.append(f"f{turn}{name} AS (SELECT * REPLACE (f * CASE WHEN sum(tokens * f) OVER w > 0 THEN goal_{name} / sum(tokens * f) OVER w ELSE 1 END AS f) FROM {last} WINDOW w AS (PARTITION BY {name}))")
            last = f"f{turn}{name}"
    steps.append(f"p AS (SELECT source, lang, topic, least(1.0, f / (max(f) FILTER (tokens > 0) OVER ())) AS p FROM {last})")
    return ",\n".join(steps) + f"""
SELECT doc_id, source, lang, topic, round(p, 6) AS probability FROM d JOIN p USING (source, lang, topic)
WHERE ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE / {1 << 52} < p"""


OP7_SQL = _mix_sql()
