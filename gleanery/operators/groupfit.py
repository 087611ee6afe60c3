"""Models fitted per group with a fallback for the whole population: clusters, outliers, scores from labels, palettes, hue ranges.

Clusters are fitted on all rows: small groups in parallel by Arrow group tasks, large ones in rounds of partial sums
over all tasks. Each tree of a forest draws from its whole group. The fits are a small table that every row of any size
is then scored against. Whole-population clustering uses pyspark.ml.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.color import ColorRule, convert
from gleanery.functions.nulls import missing
from gleanery.operators.selection import global_rank
from gleanery.operators.validate import running_sums
from gleanery.sources.tables import written

#: Rows of a group that one task fits by itself.
FIT_ROWS = 20_000
POPULATION = "\0all"


def group_rows(df: DataFrame, features: Sequence[str], group_col: str | None, id_col: str, min_group_size: int = 1) -> tuple[DataFrame, dict[str, int]]:
    """(key, g, v) of the rows of every large enough group and again of all rows as POPULATION, and the groups' sizes.

    Only rows with every feature count; ``key`` is a hash of the id. The sizes come to the driver.
    """
    good = df
    for f in features:
        good = good.where(~missing(df, f))
    values = F.array(*[F.col(f).cast("double") for f in features])
    rows = written(good.select(F.xxhash64(F.col(id_col).cast("string")).alias("key"), (F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")).alias("g"), values.alias("v")))
    counted = rows.where("g is not null").groupBy("g").count().where(F.col("count") >= min_group_size)
    sizes = {r["g"]: r["count"] for r in counted.collect()} if group_col else {}
    every = rows.select("key", F.lit(POPULATION).alias("g"), "v")
    if sizes:
        every = rows.join(counted.select("g"), "g", "left_semi").select("key", "g", "v").union(every)
    n = rows.count()
    return every, sizes | ({POPULATION: n} if n else {})


def fit_groups(rows: DataFrame, fit: Callable[[np.ndarray, np.ndarray, str], Any]) -> dict[str, Any]:
    """{group: model} of all given rows, a task a group: ``fit`` takes their values, their keys and the group and returns something JSON can hold."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, x = _arrays(pdf)
        order = np.lexsort((*x.T[::-1], keys))
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "model": [json.dumps(fit(x[order], keys[order], pdf["g"].iloc[0]))]})

    return {r["g"]: json.loads(r["model"]) for r in rows.groupBy("g").applyInPandas(one, "g string, model string").collect()}


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["key"].to_numpy(), np.stack(pdf["v"].to_numpy())


def _packed(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(g, n, keys, v) with many rows of a group as bytes in one, so that passes over them don't unpack rows; a task of a pass has about FIT_ROWS rows or more."""

    def run(frames):
        for pdf in frames:
            for g, some in pdf.groupby("g", sort=False):
                keys, x = _arrays(some)
                yield pd.DataFrame({"g": [g], "n": [len(x)], "keys": [keys.tobytes()], "v": [x.tobytes()]})

    return written(rows.where(F.col("g").isin(list(sizes))).mapInPandas(run, "g string, n long, keys binary, v binary")).coalesce(math.ceil(sum(sizes.values()) / FIT_ROWS))


def _look(packed: DataFrame, states: dict[str, Any], part: Callable[[Any, np.ndarray, np.ndarray], Any], merge: Callable[[Any, Any], Any]) -> dict[str, Any]:
    """{group: what all its rows come to} in one pass: ``part`` sees a state and some rows, a task sends one small record a group."""
    shared = packed.sparkSession.sparkContext.broadcast(states)

    def run(frames):
        seen = {}
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.g in shared.value:
                    got = part(shared.value[r.g], np.frombuffer(r.v).reshape(r.n, -1), np.frombuffer(r.keys, np.int64))
                    seen[r.g] = merge(seen[r.g], got) if r.g in seen else got
        if seen:  # a task without rows sends no frame: Arrow makes no columns of an empty one
            yield pd.DataFrame({"g": list(seen), "seen": [pickle.dumps(v) for v in seen.values()]})

    out: dict[str, Any] = {}
    for r in packed.mapInPandas(run, "g string, seen binary").collect():
        got = pickle.loads(r["seen"])
        out[r["g"]] = merge(out[r["g"]], got) if r["g"] in out else got
    shared.unpersist()
    return out


def _uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A number between 0 and 1 for each key, by the key and the salt alone."""
    x = keys.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for s in (*salt, 0):
            x = x + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def score_groups(df: DataFrame, features: Sequence[str], group_col: str | None, id_col: str, models: dict[str, Any], score: Callable[[np.ndarray, Any], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(id, group, scores) of every row with all features; ``group`` is NULL where the population's model was used."""
    good = df
    for f in features:
        good = good.where(~missing(df, f))
    rows = good.select(F.col(id_col), (F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")).alias("group"), F.array(*[F.col(f).cast("double") for f in features]).alias("_v"))
    shared = df.sparkSession.sparkContext.broadcast(models)
    kind = df.schema[id_col].dataType.simpleString()
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(frames):
        for pdf in frames:
            held = pdf["group"].where(pdf["group"].isin(shared.value.keys()), None)
            out = []
            for key, part in pdf.groupby(held.fillna(POPULATION), sort=False):
                if key not in shared.value:
                    continue
                got = score(np.stack(part["_v"].to_numpy()), shared.value[key])
                out.append(pd.DataFrame({id_col: part[id_col].to_numpy(), "group": None if key == POPULATION else key, **got}))
            if out:
                yield pd.concat(out)[[id_col, "group", *names]]

    return rows.mapInPandas(run, f"`{id_col}` {kind}, group string, {schema}")


# K-means ------------------------------------------------------------------------------------------


class KMeans:
    """Lloyd's rounds from several k-means++ starts at once, over rows in any number of parts: ``part`` looks at some of the rows, ``update`` takes what all parts come to.

    The next centre is drawn by a race: each row's time is exponential with its weighted squared distance as the
    rate, by a hash of its key, and the first row wins, so that the parts don't matter.
    """

    def __init__(self, k: int, seed: int = 0, starts: int = 10, steps: int = 100):
        self.k, self.seed, self.steps, self.round = k, seed, steps, 0
        self.centres: list[list | np.ndarray] = [[] for _ in range(starts)]
        self.cost: dict[int, float] = {}

    def open(self) -> list[int]:
        return [s for s in range(len(self.centres)) if s not in self.cost]

    def part(self, x: np.ndarray, keys: np.ndarray, w: np.ndarray | None = None) -> dict[int, tuple | None]:
        w = np.ones(len(x)) if w is None else w
        return {s: self._first(s, x, keys, w) if self.round < self.k else self._sums(s, x, w) for s in self.open()}

    def _first(self, s, x, keys, w):
        near = np.ones(len(x))
        for j, c in enumerate(self.centres[s]):
            square = ((x - c) ** 2).sum(1)
            near = np.minimum(near, square) if j else square
        with np.errstate(divide="ignore"):
            time = -np.log(_uniform(keys, self.seed, s, self.round)) / (w * near)
        at = time.argmin()
        return (float(time[at]), tuple(x[at].tolist())) if np.isfinite(time[at]) else None

    def _sums(self, s, x, w):
        label, distance = _nearest(x, self.centres[s])
        n = len(self.centres[s])
        return np.bincount(label, w, n), np.column_stack([np.bincount(label, w * v, n) for v in x.T]), float((w * distance**2).sum())

    @staticmethod
    def merge(a: dict, b: dict) -> dict:
        def two(p, q):
            if p is None or q is None:
                return p if q is None else q
            return min(p, q) if len(p) == 2 else tuple(v + u for v, u in zip(p, q, strict=True))

        return {s: two(a[s], b[s]) for s in a}

    def update(self, seen: dict[int, tuple | None]) -> None:
        for s, got in seen.items():
            if self.round < self.k:
                if got is not None:
                    self.centres[s].append(np.array(got[1]))
                continue
            counts, sums, cost = got
            moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1e-300)[:, None], self.centres[s])
            if self.round == self.k + self.steps or np.allclose(moved, self.centres[s]):
                self.cost[s] = cost
            else:
                self.centres[s] = moved
        self.round += 1
        if self.round == self.k:
            self.centres = [np.array(c) for c in self.centres]

    def best(self) -> np.ndarray:
        """Sorted, so that equal data give equal numbers."""
        lowest = None
        for s in range(len(self.centres)):
            if lowest is None or self.cost[s] < self.cost[lowest] - 1e-9:
                lowest = s
        centres = self.centres[lowest]
        return centres[np.lexsort(centres.T[::-1])]


def kmeans(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, steps: int = 100, counts: np.ndarray | None = None, keys: np.ndarray | None = None) -> np.ndarray:
    """Centres of the best of several starts. A row counts as often as ``counts`` says; ``keys`` decide the draws."""
    model = KMeans(k, seed, starts, steps)
    keys = np.arange(len(x)) if keys is None else keys
    while model.open():
        model.update(model.part(x, keys, None if counts is None else counts.astype(np.float64)))
    return model.best()


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T
    label = square.argmin(1)
    return label, np.sqrt(((x - centres[label]) ** 2).sum(1))  # by differences: the squares above cancel beside a centre


def _scaled(x: np.ndarray, components: int | None) -> tuple[np.ndarray, dict]:
    """Standardised and reduced by PCA, and what repeats that."""
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1
    z = (x - mean) / spread
    _, _, axes = np.linalg.svd(z - z.mean(0), full_matrices=False)
    axes = _turned(axes[:components])
    return z @ axes.T, {"mean": mean.tolist(), "spread": spread.tolist(), "axes": axes.tolist()}


def _turned(axes: np.ndarray) -> np.ndarray:
    return axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]


def _scaled_rows(packed: DataFrame, sizes: dict[str, int], components: int | None) -> dict[str, dict]:
    """What ``_scaled`` returns second, for large groups: sums over all rows, then products of what is left."""
    sums = _look(packed, dict.fromkeys(sizes), lambda _, x, __: x.sum(0), np.add)
    means = {g: v / sizes[g] for g, v in sums.items()}
    products = _look(packed, means, lambda mean, x, _: (x - mean).T @ (x - mean), np.add)
    out = {}
    for g, p in products.items():
        spread = np.sqrt(np.diag(p) / sizes[g])
        spread[spread == 0] = 1
        axes = _turned(np.linalg.eigh(p / np.outer(spread, spread))[1].T[::-1][:components])
        out[g] = {"mean": means[g].tolist(), "spread": spread.tolist(), "axes": axes.tolist()}
    return out


def _reduced(x: np.ndarray, how: dict | None) -> np.ndarray:
    return x if how is None else (x - np.array(how["mean"])) / np.array(how["spread"]) @ np.array(how["axes"]).T


def cluster(df: DataFrame, features: Sequence[str], id_col: str, group_col: str | None = None, n_clusters: int = 3, min_group_size: int = 1, n_components: int | None = None, seed: int = 0) -> DataFrame:
    """(id, group, cluster_id, centroid_distance): k-means per group over all its rows, optionally after standardising and PCA.

    Groups of up to FIT_ROWS rows are fitted in a task each, larger ones in rounds over all tasks, by the same steps.
    """

    def fit(x, keys, _):
        how = None
        if n_components:
            x, how = _scaled(x, n_components)
        return {"centres": kmeans(x, n_clusters, seed, keys=keys).tolist(), "how": how}

    def score(x, model):
        label, distance = _nearest(_reduced(x, model["how"]), np.array(model["centres"]))
        return {"cluster_id": label.astype(np.int32), "centroid_distance": distance}

    rows, sizes = group_rows(df, features, group_col, id_col, min_group_size)
    large = {g: n for g, n in sizes.items() if n > FIT_ROWS}
    models = fit_groups(rows.where(~F.col("g").isin(list(large))) if large else rows, fit)
    if large:
        packed = _packed(rows, large)
        how = _scaled_rows(packed, large, n_components) if n_components else dict.fromkeys(large)
        rounds = {g: KMeans(n_clusters, seed) for g in large}
        while still := {g: (m, how[g]) for g, m in rounds.items() if m.open()}:
            for g, seen in _look(packed, still, lambda held, x, keys: held[0].part(_reduced(x, held[1]), keys), KMeans.merge).items():
                rounds[g].update(seen)
        models |= {g: {"centres": m.best().tolist(), "how": how[g]} for g, m in rounds.items()}
    return score_groups(df, features, group_col, id_col, models, score, "cluster_id int, centroid_distance double")


def cluster_distributed(df: DataFrame, vector_col: str, k: int, seed: int = 0) -> DataFrame:
    """``df`` with cluster_id from pyspark.ml k-means over all rows: no sample, any size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_features", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster_id").fit(ready)
    return model.transform(ready).drop("_features")


def mixture(df: DataFrame, vector_col: str, k: int, probability_threshold: float | None = None, seed: int = 0) -> DataFrame:
    """``df`` with cluster_id and probability from a Gaussian mixture; below the threshold the cluster is -1."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("_features", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = GaussianMixture(k=k, seed=seed, featuresCol="_features", predictionCol="cluster_id", probabilityCol="_p").fit(ready)
    out = model.transform(ready).withColumn("probability", F.array_max(vector_to_array("_p"))).drop("_features", "_p")
    return out if probability_threshold is None else out.withColumn("cluster_id", F.when(F.col("probability") < probability_threshold, -1).otherwise(F.col("cluster_id")))


# Isolation forest ---------------------------------------------------------------------------------


def _depth_of(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


#: Trees of a forest and the rows that each draws.
TREES, TREE_ROWS = 100, 256
#: Rows of a group that are expected to compete for a tree's places; with fewer than TREE_ROWS, all do.
RIVALS = 400


def isolation_forest(x: np.ndarray, trees: int = TREES, sample: int = TREE_ROWS, seed: int = 0, keys: np.ndarray | None = None) -> dict:
    """Random trees that isolate rows, as flat arrays. Each takes the rows whose keys hash lowest for it."""
    keys = np.arange(len(x)) if keys is None else keys
    rng, grown = np.random.default_rng(seed), []
    size = min(sample, len(x))
    limit = math.ceil(math.log2(max(2, size)))
    for tree in range(trees):
        nodes: list[list] = []

        def grow(rows: np.ndarray, depth: int, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + _depth_of(len(rows))])
            spread = np.flatnonzero(x[rows].max(0) > x[rows].min(0)) if len(rows) > 1 else []
            if depth < limit and len(spread):
                f = int(rng.choice(spread))
                cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
                left = x[rows, f] < cut
                if left.any() and not left.all():
                    nodes[at][:2] = [f, cut]
                    nodes[at][2] = grow(rows[left], depth + 1)
                    nodes[at][3] = grow(rows[~left], depth + 1)
            return at

        grow(np.argsort(_uniform(keys, seed, tree), kind="stable")[:size], 0)
        grown.append(nodes)
    return {"trees": grown, "size": size}


def isolation_score(x: np.ndarray, model: dict) -> dict[str, np.ndarray]:
    """anomaly_score (0.5 less the isolation score: lower is odder, negative an outlier) and is_outlier."""
    total = np.zeros(len(x))
    for nodes in model["trees"]:
        table = np.array(nodes)
        at = np.zeros(len(x), dtype=int)
        while True:
            f = table[at, 0].astype(int)
            inner = f >= 0
            if not inner.any():
                break
            left = x[np.arange(len(x)), np.maximum(f, 0)] < table[at, 1]
            at = np.where(inner, np.where(left, table[at, 2], table[at, 3]).astype(int), at)
        total += table[at, 4]
    score = 0.5 - 2.0 ** (-total / len(model["trees"]) / max(_depth_of(model["size"]), 1e-9))
    return {"anomaly_score": score, "is_outlier": score < 0}


def _rivals(rows: DataFrame, shares: dict[str, float], seed: int) -> DataFrame:
    """The rows whose keys hash below their group's share for some tree: all that a tree can take, and a bounded number a group."""
    shared = rows.sparkSession.sparkContext.broadcast(shares)

    def run(frames):
        for pdf in frames:
            share, keys = pdf["g"].map(shared.value).to_numpy(dtype=np.float64), pdf["key"].to_numpy()
            keep = share >= 1
            for tree in range(TREES):
                keep |= _uniform(keys, seed, tree) < share
            if keep.any():
                yield pdf[keep]

    return rows.where(F.col("g").isin(list(shares))).mapInPandas(run, rows.schema)


def outlier(df: DataFrame, features: Sequence[str], id_col: str, group_col: str | None = None, min_group_size: int = 1, seed: int = 0) -> DataFrame:
    """(id, group, anomaly_score, is_outlier) by an isolation forest per group, each tree's rows drawn from the whole group."""
    rows, sizes = group_rows(df, features, group_col, id_col, min_group_size)
    models: dict[str, Any] = {}
    for rivals in (RIVALS, math.inf):
        shares = {g: min(1.0, rivals / n) for g, n in sizes.items() if g not in models}

        def fit(x, keys, g, shares=shares):
            short = shares[g] < 1 and any((_uniform(keys, seed, tree) < shares[g]).sum() < TREE_ROWS for tree in range(TREES))
            return None if short else isolation_forest(x, seed=seed, keys=keys)

        if shares:
            models |= {g: m for g, m in fit_groups(_rivals(rows, shares, seed), fit).items() if m}
    return score_groups(df, features, group_col, id_col, models, isolation_score, "anomaly_score double, is_outlier boolean")


# Scores from labels -------------------------------------------------------------------------------

MIN_PER_CLASS = 3


def _newton(z: np.ndarray, y: np.ndarray, w: np.ndarray, weight: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """What some rows (last column 1) add to the gradient and the curvature of a logistic regression, each row weighed by its class."""
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    each = np.where(y > 0, weight[1], weight[0])
    return z.T @ (each * (p - y)), (z * (each * p * (1 - p))[:, None]).T @ z


def _add(a: dict, b: dict) -> dict:
    return {k: tuple(u + v for u, v in zip(a[k], b[k], strict=True)) for k in a}


def _fold_models(packed: DataFrame, folds: int, n_components: int, steps: int = 100) -> dict[int, dict]:
    """A class-balanced logistic regression with unit ridge over standardised principal components, without each fold and (as ``folds``) of all, by Newton's method: sums over all rows in each pass, all models at once.

    Rows are packed by fold, the last column is the label.
    """
    held = {str(f): None for f in range(folds)}

    def whole(seen: dict[str, dict], m: int) -> tuple:
        """What the rows of a model come to: those of all folds but its own."""
        parts = [got[m] for f, got in seen.items() if f != str(m) and m in got]
        return tuple(sum(column) for column in zip(*parts, strict=True))

    first = _look(packed, held, lambda _, x, __: {0: (len(x), x.sum(0))}, _add)
    middle = sum(v[0][1] for v in first.values())[:-1] / sum(v[0][0] for v in first.values())

    def products(mean, x, _):
        d = x[:, :-1] - mean
        return {0: (len(x), x[:, -1].sum(), d.sum(0), d.T @ d)}

    second = {f: dict.fromkeys(range(folds + 1), got[0]) for f, got in _look(packed, dict.fromkeys(held, middle), products, _add).items()}
    models, weights = {}, {}
    for m in range(folds + 1):
        n, bad, sums, square = whole(second, m)
        cov = square / n - np.outer(sums / n, sums / n)
        spread = np.sqrt(np.maximum(np.diag(cov), 0))
        spread[spread <= 1e-12 * np.abs(middle)] = 1
        axes = _turned(np.linalg.eigh(cov / np.outer(spread, spread))[1].T[::-1][:n_components])
        models[m] = {"how": {"mean": (middle + sums / n).tolist(), "spread": spread.tolist(), "axes": axes.tolist()}, "w": np.zeros(len(axes) + 1)}
        weights[m] = (n / (2 * max(1, n - bad)), n / (2 * max(1, bad)))
    ridge = lambda w: np.diag([1.0] * (len(w) - 1) + [1e-9])
    still = set(models)

    def slopes(state, x, _):
        return {m: _newton(np.column_stack((_reduced(x[:, :-1], how), np.ones(len(x)))), x[:, -1], w, weight) for m, (how, w, weight) in state.items()}

    for _ in range(steps):
        states = {f: {m: (models[m]["how"], models[m]["w"], weights[m]) for m in still if f != str(m)} for f in held}
        seen = _look(packed, states, slopes, _add)
        for m in list(still):
            gradient, curve = whole(seen, m)
            w = models[m]["w"]
            step = np.linalg.solve(curve + ridge(w), gradient + ridge(w) @ w)
            models[m]["w"] = w - step
            if np.abs(step).max() < 1e-8:
                still.remove(m)
        if not still:
            break
    return models


def auc(scored: DataFrame, score: str, y: str) -> float:
    """Area under the ROC curve of a 0/1 column, ties counted half; NaN with one class. Ranks are those of ranges, so no task holds all rows."""
    per = written(scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) > 0).alias("a"), F.count_if(F.col(y) == 0).alias("b")))
    ranked = running_sums(per, [F.col("s")], ["b"], ["before"])
    one = ranked.agg(F.sum(F.col("a") * (2 * F.col("before") + F.col("b"))).alias("won"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return one["won"] / (2 * one["a"] * one["b"]) if one["a"] and one["b"] else math.nan


def label_score(df: DataFrame, features: Sequence[str], id_col: str, labelled: DataFrame, label_col: str, bad_labels: Sequence[Any], folds: int = 5, n_components: int = 16) -> tuple[DataFrame, float]:
    """((id, score, out_of_fold), AUC): probability of a bad label for every row with all features.

    Labelled rows get the score of a model that didn't see them, others that of the model of all labels. The fits take
    all labelled rows, in passes over all tasks; each class needs three. Folds go round the rows of a class in the
    order of a hash of their id.
    """
    good = df
    for f in features:
        good = good.where(~missing(df, f))
    rows = good.select(F.col(id_col).cast("string").alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    marks = labelled.where(~missing(labelled, label_col)).select(F.col(id_col).cast("string").alias("id"), F.col(label_col).isin(list(bad_labels)).cast("int").alias("y"))
    seen = written(rows.join(marks, "id").withColumn("_h", F.sha2("id", 256)))
    many = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}
    if min(many.get(0, 0), many.get(1, 0)) < MIN_PER_CLASS:
        raise ValueError(f"a class has fewer than {MIN_PER_CLASS} labelled rows")
    placed = global_rank(seen, ["y", "_h", "id"], "_at")
    placed = written(placed.select("id", "v", "y", ((F.col("_at") - F.col("y") * many[0]) % folds).cast("int").alias("fold")))
    keyed = placed.select(F.xxhash64("id").alias("key"), F.col("fold").cast("string").alias("g"), F.concat("v", F.array(F.col("y").cast("double"))).alias("v"))
    sizes = {r["g"]: r["count"] for r in keyed.groupBy("g").count().collect()}
    shared = df.sparkSession.sparkContext.broadcast(_fold_models(_packed(keyed, sizes), folds, min(n_components, len(features))))

    def run(frames):
        for pdf in frames:
            x, model = np.stack(pdf["v"].to_numpy()), pdf["fold"].to_numpy()
            score = np.zeros(len(pdf))
            for m in np.unique(model):
                w = shared.value[m]["w"]
                score[model == m] = 1 / (1 + np.exp(-np.clip(_reduced(x[model == m], shared.value[m]["how"]) @ w[:-1] + w[-1], -30, 30)))
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "score": score})

    met = rows.join(placed.select("id", "y", "fold"), "id", "left").select("id", "v", F.coalesce("y", F.lit(-1)).alias("y"), F.coalesce("fold", F.lit(folds)).alias("fold"))
    scored = written(met.mapInPandas(run, "id string, y int, score double"))
    out = scored.select(F.col("id").alias(id_col), "score", (F.col("y") >= 0).alias("out_of_fold"))
    return out, auc(scored.where("y >= 0"), "score", "y")


# Pooled pixels ------------------------------------------------------------------------------------

PIXELS = 2000


def palette(pixels: np.ndarray, n_colors: int = 5, space: str = "lab", seed: int = 0, counts: np.ndarray | None = None) -> dict:
    """Shared palette of pooled BGR pixels, each counted as often as ``counts`` says; hsv is scaled to 0..1 so that hue doesn't outweigh the rest."""
    return {"space": space, "centres": kmeans(_in_space(pixels, space), n_colors, seed, starts=4, counts=counts).tolist()}


def _in_space(pixels: np.ndarray, space: str) -> np.ndarray:
    values = convert(pixels.astype(np.uint8), space).astype(np.float64)
    return values / np.array([360, 1, 1]) if space == "hsv" else values


def palette_shares(pixels: np.ndarray, model: dict) -> dict[str, Any]:
    """Share of the pixels nearest to each colour, and the dominant one."""
    counts = np.bincount(_nearest(_in_space(pixels, model["space"]), np.array(model["centres"]))[0], minlength=len(model["centres"]))
    return {f"color_{k}": float(c / counts.sum()) for k, c in enumerate(counts)} | {"dominant": int(counts.argmax())}


def pooled_colours(pixels: DataFrame, group_col: str, pixels_col: str) -> DataFrame:
    """(group, colour, n): how often a group's pixels have a BGR colour, so that a pool of any size is at most 2**24 rows."""

    def distinct(frames):
        for pdf in frames:
            for group, part in pdf.groupby(group_col, dropna=False):
                px = np.frombuffer(b"".join(part[pixels_col]), np.uint8).reshape(-1, 3).astype(np.int32)
                colour, n = np.unique(px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2], return_counts=True)
                yield pd.DataFrame({"group": group, "colour": colour, "n": n})

    return pixels.select(group_col, pixels_col).mapInPandas(distinct, "group string, colour int, n long").groupBy("group", "colour").agg(F.sum("n").alias("n"))


def colour_pixels(colour: np.ndarray) -> np.ndarray:
    """The BGR pixel of each colour of ``pooled_colours``."""
    return np.column_stack((colour >> 16, colour >> 8 & 255, colour & 255)).astype(np.uint8)


def _quantiles(x: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """np.quantile of each value repeated as often as its count."""
    order = np.argsort(x, kind="stable")
    ends = np.cumsum(counts[order])
    at = shares * (ends[-1] - 1)
    low, high = (x[order][np.searchsorted(ends, k, side="right")].astype(np.float64) for k in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def chroma_gate(chroma: np.ndarray, hue: np.ndarray, bins: int = 20, least: int = 50, counts: np.ndarray | None = None) -> float:
    """The chroma from which hue is settled, 0 where it never is or there are no pixels.

    Pixels are counted, and their hues added as unit vectors, per equally filled bin of chroma. Of the bins with
    ``least`` pixels, one is settled if neither its scatter (one less the mean vector's length) nor that of any bin
    above exceeds 1.5 times the median of the last quarter.
    """
    if not len(chroma):
        return 0.0
    weight = np.ones(len(chroma)) if counts is None else np.asarray(counts, dtype=np.float64)
    edges = _quantiles(chroma, weight, np.linspace(0, 1, bins + 1))
    vector = np.exp(1j * np.radians(hue)) * weight
    place = np.searchsorted(edges[1:-1], chroma, side="right")
    n, x, y = (np.bincount(place, w, minlength=bins) for w in (weight, vector.real, vector.imag))
    full = n >= least
    if not full.any():
        return 0.0
    scatter = 1 - np.hypot(x[full], y[full]) / n[full]
    worst_above = np.maximum.accumulate(scatter[::-1])[::-1]
    settled = worst_above <= 1.5 * np.median(scatter[-max(1, len(scatter) // 4) :])
    return float(edges[:-1][full][settled.argmax()]) if settled.any() else 0.0


def hue_ranges(hue: np.ndarray, bandwidth: float = 10.0, relative_height: float = 0.5, most: int = 8, counts: np.ndarray | None = None) -> list[tuple[float, float]]:
    """Arcs between the valleys of the wrapped kernel density of hues; a valley counts up to a share of the peak, the deepest are kept. One arc is the whole circle."""
    full = np.bincount(np.floor(hue).astype(int) % 360, counts, minlength=360).astype(np.float64)
    apart = np.minimum(np.arange(360), 360 - np.arange(360))
    kernel = np.exp(-0.5 * (apart / bandwidth) ** 2)
    density = np.fft.irfft(np.fft.rfft(full) * np.fft.rfft(kernel), 360)
    density = np.maximum(density, 0)
    change = np.flatnonzero(~np.isclose(density, np.roll(density, 1), rtol=1e-9, atol=1e-12 * density.max()))
    valleys = []
    for k, begin in enumerate(change):
        end = change[(k + 1) % len(change)]
        flat = (end - begin) % 360 or 360
        before, after, own = density[begin - 1], density[end % 360], density[begin]
        if own < before and own < after and own <= relative_height * density.max():
            valleys.append((own, (begin + (flat - 1) / 2) % 360))
    valleys = sorted(v[1] for v in sorted(valleys)[:most])
    if len(valleys) < 2:
        return [(0.0, 360.0)]
    return list(zip(valleys, valleys[1:] + valleys[:1], strict=True))


def hue_definition(pixels: np.ndarray, bins: int = 20, least: int = 50, bandwidth: float = 10.0, relative_height: float = 0.5, most: int = 8, counts: np.ndarray | None = None) -> dict:
    """Thresholds that a group's own pixels, each counted as often as ``counts`` says, suggest: achromatic below the gate, hue_<k> arcs above it."""
    lch = convert(pixels.astype(np.uint8), "lch").astype(np.float64)
    gate = chroma_gate(lch[:, 1], lch[:, 2], bins, least, counts)
    above = lch[:, 1] >= gate
    colourful = lch[above]
    arcs = hue_ranges(colourful[:, 2], bandwidth, relative_height, most, None if counts is None else counts[above]) if len(colourful) else []
    rules = [ColorRule("achromatic", lch_c=(None, gate))] + [ColorRule(f"hue_{k}", lch_c=(gate, None), lch_h=arc) for k, arc in enumerate(arcs)]
    return {"gate": gate, "hue_ranges": arcs, "thresholds": [r.spec() for r in rules]}
