"""Arrangements: items of a table ordered, grouped, assigned to slots of a layout, as a placements table (x, y, scale, angle, flip, z)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.nulls import present
from gleanery.operators.selection import global_rank

GOLDEN = 180.0 * (3.0 - math.sqrt(5.0))
UNKNOWN = "unknown"
#: Items up to which slots are matched optimally, and circles are packed.
OPTIMAL, CIRCLES = 3000, 1000


# Arranging ---------------------------------------------------------------------------------------


def sort_by(df: DataFrame, column: str, id_col: str, descending: bool = False, circular: bool = False, start: float = 0.0, period: float = 360.0) -> DataFrame:
    """``df`` with order (0..): by value (ties by id), on a circle from ``start`` on; rows without a value are left out."""
    kept = df.where(present(df, column))
    key = F.pmod(F.col(column).cast("double") - start, F.lit(float(period))) if circular else F.col(column)
    key = -key if descending and dict(df.dtypes)[column] not in ("string",) else key
    if descending and dict(df.dtypes)[column] == "string":
        ranked = kept.withColumn("_d", F.dense_rank().over(Window.orderBy(F.desc(column))))
        return global_rank(ranked, ["_d", id_col], "order").drop("_d")
    return global_rank(kept.withColumn("_k", key), ["_k", id_col], "order").drop("_k")


def group_by(df: DataFrame, column: str, by: str = "name") -> DataFrame:
    """``df`` with group and group_order: groups by name, by first appearance (smallest order) or by size; a missing group is "unknown" and comes last."""
    named = df.withColumn("group", F.coalesce(F.when(present(df, column), F.col(column).cast("string")), F.lit(UNKNOWN)))
    sizes = named.groupBy("group").agg(F.count("*").alias("n"), *([F.min("order").alias("first")] if "order" in df.columns else []))
    key = {"name": [F.col("group")], "size": [F.desc("n"), F.col("group")], "first": [F.col("first") if "order" in df.columns else F.col("group")]}[by]
    ranked = sizes.withColumn("group_order", F.row_number().over(Window.orderBy((F.col("group") == UNKNOWN).cast("int"), *key)) - 1)
    return named.join(ranked.select("group", "group_order"), "group")


def scale_by(df: DataFrame, column: str, name: str = "scale") -> DataFrame:
    """``df`` with each value over the median of all."""
    middle = df.where(present(df, column)).agg(F.median(F.col(column).cast("double"))).first()[0]
    return df.withColumn(name, F.col(column).cast("double") / F.lit(middle or 1.0))


def polar_position(df: DataFrame, angle: str, radius: str | None = None) -> DataFrame:
    """``df`` with target_x, target_y of an angle in degrees and a radius (1 without)."""
    r = F.col(radius).cast("double") if radius else F.lit(1.0)
    return df.withColumns({"target_x": r * F.cos(F.radians(angle)), "target_y": r * F.sin(F.radians(angle))})


def project(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with target_x, target_y: the first two principal components of the standardised features, signs fixed by their largest weight.

    Means and products are one partial aggregation; only the matrix of the features comes to the driver.
    """
    for f in features:
        df = df.where(present(df, f))
    x = [F.col(f).cast("double") for f in features]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    spread = [math.sqrt(row[f"c{k}_{k}"] or 0) or 1.0 for k in range(len(x))]
    matrix = np.zeros((len(x), len(x)))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = (row[f"c{i}_{j}"] or 0) / spread[i] / spread[j]
    axes = np.linalg.eigh(matrix)[1][:, ::-1][:, :2]
    axes *= np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    z = [(c - (row[f"m{k}"] or 0)) / spread[k] for k, c in enumerate(x)]
    along = lambda k: sum((z[i] * float(axes[i, k]) for i in range(len(z))), F.lit(0.0)) if k < axes.shape[1] else F.lit(0.0)
    return df.withColumns({"target_x": along(0), "target_y": along(1)})


def path_order(points: np.ndarray, neighbours: int = 8) -> np.ndarray:
    """Indices along the shortest path through the nearest-neighbour graph between the two points furthest apart on it."""
    n = len(points)
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    graph = np.full((n, n), np.inf)
    near = np.argsort(apart, axis=1)[:, : neighbours + 1]
    for i in range(n):
        graph[i, near[i]] = graph[near[i], i] = apart[i, near[i]]

    def distances(start: int) -> tuple[np.ndarray, np.ndarray]:
        best, before, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        best[start] = 0
        for _ in range(n):
            k = int(np.where(done, np.inf, best).argmin())
            if not np.isfinite(best[k]):
                break
            done[k] = True
            through = best[k] + graph[k]
            better = through < best
            best[better], before[better] = through[better], k
        return best, before

    reach = distances(0)[0]
    first = int(np.where(np.isfinite(reach), reach, -1).argmax())
    best, before = distances(first)
    at = int(np.where(np.isfinite(best), best, -1).argmax())
    out = [at]
    while before[at] >= 0:
        at = int(before[at])
        out.append(at)
    return np.array(out[::-1])


# Layouts: number of items (and their targets) -> slots --------------------------------------------


def grid(n: int, columns: int | None = None, pitch: float = 1.0, hexagonal: bool = False) -> pd.DataFrame:
    """Rows of equal columns (about the root of n); hexagonal ones shift odd rows by half."""
    columns = columns or max(1, math.ceil(math.sqrt(n)))
    k = np.arange(n)
    row, column = k // columns, k % columns
    x = column * pitch + (row % 2) * pitch / 2 * hexagonal
    return _slots(x, row * pitch * (math.sqrt(3) / 2 if hexagonal else 1))


def spiral(n: int, pitch: float = 1.0, coil: float = 1.0, rotate: str = "tangent") -> pd.DataFrame:
    """Archimedean spiral with about equal steps along the curve."""
    b, theta, turns = coil * pitch / (2 * math.pi), 0.0, []
    for _ in range(n):
        turns.append(theta)
        theta += pitch / math.hypot(b * theta, b)
    t = np.array(turns)
    out = _slots(b * t * np.cos(t), b * t * np.sin(t))
    out["angle"] = np.degrees(t) + (90 if rotate == "tangent" else 0) if rotate != "none" else 0.0
    return out


def phyllotaxis(n: int, pitch: float = 1.0) -> pd.DataFrame:
    """Sunflower order: each next slot a golden angle on."""
    k = np.arange(n)
    r, angle = 0.62 * pitch * np.sqrt(k + 0.5), np.radians(k * GOLDEN)
    return _slots(r * np.cos(angle), r * np.sin(angle))


def rings(n: int, pitch: float = 1.0, center: bool = True, rotate: str = "radial") -> pd.DataFrame:
    """Rings around a centre; ring r holds as many slots as its length has pitches."""
    xs, ys, angles, ring = [], [], [], 0 if center else 1
    while len(xs) < n:
        many = 1 if ring == 0 else max(1, int(2 * math.pi * ring))
        for k in range(min(many, n - len(xs))):
            a = 2 * math.pi * k / many
            xs.append(ring * pitch * math.cos(a))
            ys.append(ring * pitch * math.sin(a))
            angles.append(math.degrees(a) + 90 if rotate == "radial" and ring else 0.0)
        ring += 1
    out = _slots(np.array(xs), np.array(ys))
    out["angle"] = angles
    return out


def scatter(targets: np.ndarray, pitch: float = 1.0, density: float = 1.5) -> pd.DataFrame:
    """Targets scaled into an area of n * density * pitch squared."""
    low, high = targets.min(0), targets.max(0)
    side = math.sqrt(len(targets) * density) * pitch
    scaled = (targets - low) / np.where(high > low, high - low, 1) * side
    return _slots(scaled[:, 0], scaled[:, 1])


def beeswarm(values: np.ndarray, pitch: float = 1.0, width: float | None = None) -> pd.DataFrame:
    """Values along x, each item at the nearest free offset from the axis."""
    low, high = values.min(), values.max()
    x = (values - low) / (high - low or 1) * (width or math.sqrt(len(values)) * 2 * pitch)
    order, y, placed = np.argsort(x, kind="stable"), np.zeros(len(x)), []
    for k in order:
        near = [(px, py) for px, py in placed if x[k] - px < pitch]
        tries = sorted({0.0, *[py + s * math.sqrt(max(0.0, pitch**2 - (x[k] - px) ** 2)) for px, py in near for s in (-1, 1)]}, key=lambda v: (abs(v), v))
        y[k] = next(t for t in tries if all((x[k] - px) ** 2 + (t - py) ** 2 >= pitch**2 - 1e-9 for px, py in near))
        placed.append((x[k], y[k]))
    return _slots(x, y)


def mosaic(image: np.ndarray, columns: int = 40) -> pd.DataFrame:
    """One slot per block of a target image, with the block's mean colour."""
    size = max(1, image.shape[1] // columns)
    rows = max(1, image.shape[0] // size)
    blocks = image[: rows * size, : columns * size].reshape(rows, size, -1, size, 3).mean((1, 3))
    y, x = np.mgrid[0:rows, 0 : blocks.shape[1]]
    out = _slots(x.ravel().astype(float), y.ravel().astype(float))
    out[["b", "g", "r"]] = blocks.reshape(-1, 3)
    return out


def within(inside: np.ndarray, n: int) -> pd.DataFrame:
    """A hexagonal lattice inside a shape, its step shrunk until it holds n slots."""
    step = math.sqrt(inside.sum() / max(1, n) * 2 / math.sqrt(3))
    while True:
        rows = np.arange(step / 2, inside.shape[0], step * math.sqrt(3) / 2)
        spots = [(x, y) for k, y in enumerate(rows) for x in np.arange(step / 2 + (k % 2) * step / 2, inside.shape[1], step) if inside[int(y), int(x)]]
        if len(spots) >= n or step < 0.5:
            spots = np.array(spots[:n], dtype=float).reshape(-1, 2)
            return _slots(spots[:, 0], spots[:, 1])
        step *= 0.97


def stack(n: int) -> pd.DataFrame:
    return _slots(np.zeros(n), np.zeros(n))


def mirrored(n: int, pitch: float = 1.0) -> pd.DataFrame:
    """Pairs of slots left and right of an axis, the right one flipped."""
    pair, side = np.arange(n) // 2, np.arange(n) % 2
    columns = max(1, math.ceil(math.sqrt(n / 2)))
    x = (pair % columns + 0.5) * pitch
    out = _slots(np.where(side == 1, x, -x), pair // columns * pitch)
    out["flip"] = side == 1
    return out


def exploded(parts: Sequence[str], offsets: dict[str, tuple[float, float]]) -> pd.DataFrame:
    """Each part at its own offset."""
    spots = np.array([offsets.get(p, (0.0, 0.0)) for p in parts], dtype=float).reshape(-1, 2)
    return _slots(spots[:, 0], spots[:, 1])


def pack_circles(radii: np.ndarray) -> pd.DataFrame:
    """Circles placed one by one at the free tangent spot nearest the middle, at most CIRCLES of them."""
    if len(radii) > CIRCLES:
        raise ValueError(f"more than {CIRCLES} circles")
    spots: list[tuple[float, float]] = []
    for k, r in enumerate(radii):
        if k == 0:
            spots.append((0.0, 0.0))
            continue
        tries = [(spots[0][0] + radii[0] + r, spots[0][1])] if k == 1 else []
        for i in range(k):
            for j in range(i):
                a, b = radii[i] + r, radii[j] + r
                dx, dy = spots[j][0] - spots[i][0], spots[j][1] - spots[i][1]
                d = math.hypot(dx, dy)
                if d > a + b or d == 0:
                    continue
                along = (a * a - b * b + d * d) / (2 * d)
                h = math.sqrt(max(0.0, a * a - along * along))
                tries += [(spots[i][0] + (along * dx + s * h * dy) / d, spots[i][1] + (along * dy - s * h * dx) / d) for s in (-1, 1)]
        free = [t for t in tries if all(math.hypot(t[0] - x, t[1] - y) >= q + r - 1e-7 for (x, y), q in zip(spots, radii, strict=False))]
        spots.append(min(free, key=lambda t: (round(math.hypot(*t), 9), t)))
    out = _slots(np.array([s[0] for s in spots]), np.array([s[1] for s in spots]))
    out["scale"] = radii
    return out


def dendrogram(parents: dict[str, str], leaves: Sequence[str]) -> pd.DataFrame:
    """Leaves in a row, every clade over the mean of its leaves at its height."""
    at = {leaf: (float(k), 0.0) for k, leaf in enumerate(leaves)}
    children: dict[str, list[str]] = {}
    for child, parent in parents.items():
        children.setdefault(parent, []).append(child)

    def place(node: str) -> tuple[list[float], float]:
        if node in at and node not in children:
            return [at[node][0]], 0.0
        below = [place(c) for c in children[node]]
        xs, height = [x for b in below for x in b[0]], 1 + max(b[1] for b in below)
        at[node] = (float(np.mean(xs)), height)
        return xs, height

    for root in {p for p in parents.values() if p not in parents}:
        place(root)
    out = _slots(np.array([v[0] for v in at.values()]), np.array([v[1] for v in at.values()]))
    out["name"] = list(at)
    return out


def nested(sizes: Sequence[int], outer: Callable[[int], pd.DataFrame], inner: Callable[[int], pd.DataFrame], padding: float = 0.15) -> pd.DataFrame:
    """The inner layout of every group, placed by the outer one and kept apart by its largest extent."""
    insides = [inner(n) for n in sizes]
    reach = max((max(np.ptp(s["x"]), np.ptp(s["y"])) for s in insides if len(s)), default=0) + 1
    places = outer(len(sizes))
    frames = []
    for k, s in enumerate(insides):
        s = s.copy()
        s["x"] += places["x"][k] * reach * (1 + padding)
        s["y"] += places["y"][k] * reach * (1 + padding)
        s["group_order"] = k
        frames.append(s)
    out = pd.concat(frames, ignore_index=True)
    out["slot"] = range(len(out))
    return out


def _slots(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    n = len(x)
    return pd.DataFrame({"slot": np.arange(n), "x": x, "y": y, "scale": np.ones(n), "angle": np.zeros(n), "flip": np.zeros(n, bool)})


# Assigning ----------------------------------------------------------------------------------------


def optimal_match(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost (rows at most columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def assign(items: np.ndarray, slots: np.ndarray, reuse: bool = False, max_items: int = OPTIMAL) -> np.ndarray:
    """Item of each slot by the least total distance, each item used once, -1 where none is left; with ``reuse`` each slot's nearest item."""
    if max(len(items), len(slots)) > max_items:
        raise ValueError(f"{len(items)} items and {len(slots)} slots are more than max_items={max_items}")
    if not len(items) or not len(slots):
        return np.full(len(slots), -1)
    distance = np.sqrt(((slots[:, None, :] - items[None]) ** 2).sum(-1))
    if reuse:
        return distance.argmin(1)
    if len(slots) <= len(items):
        return optimal_match(distance)
    out = np.full(len(slots), -1)
    out[optimal_match(distance.T)] = np.arange(len(items))
    return out


def placements(items: DataFrame, layout: Callable[[int], pd.DataFrame], order_col: str = "order", id_col: str = "occurrence_id") -> DataFrame:
    """Items in order on the slots of a layout: id, slot, x, y, scale, angle, flip, z. A picture is drawn on one machine, so its slots are made there; items are joined by rank."""
    ranked = global_rank(items, [order_col, id_col], "slot")
    n = ranked.count()
    slots = items.sparkSession.createDataFrame(layout(n)).withColumn("slot", F.col("slot").cast("long"))
    return ranked.join(slots, "slot").withColumn("z", F.col("slot")).select(id_col, "slot", "x", "y", "scale", "angle", "flip", "z", *[c for c in ("group",) if c in items.columns])
