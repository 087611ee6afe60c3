"""Operations and recipes: hashable chains of segmenters, transforms and metrics, and their execution over an image table."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import raster, stacks
from gleanery.functions.color import BLACK, MIN_SATURATION, MIN_VALUE, ColorRule, hue_threshold
from gleanery.functions.identity import canonical_json, derivation_hash, hash_spec, recipe_spec
from gleanery.functions.naming import repeated_labels
from gleanery.functions.raster import NothingToMeasure, Segment
from gleanery.functions.rle import decode, decode_all, encode, encode_all
from gleanery.functions.stacks import Stack
from gleanery.operators.wide import TRANSFORM_INFO

ID = "occurrence_id"
ORGANISM = "organism"


@dataclass
class Operation:
    """One configured step. What changes its output is in ``spec``; ``deterministic`` and ``note`` are not."""

    name: str
    function: Callable
    kind: str = "transform"
    parameters: dict[str, Any] = field(default_factory=dict)
    version: str = "1"
    model: Any = None
    metric_name: str | None = None
    unit: str | None = None
    deterministic: bool = True
    note: str | None = None

    def spec(self) -> dict:
        out = {"name": self.name, "kind": self.kind, "version": str(self.version), "parameters": self.parameters}
        if self.model is not None:
            out["model"] = self.model.identity() if hasattr(self.model, "identity") else {"class": type(self.model).__name__}
        if self.kind == "metric":
            out |= {"metric_name": self.metric_name or self.name, "unit": self.unit}
        return out

    def __call__(self, segment: Segment) -> Any:
        return self.function(segment, **({"model": self.model} if self.model is not None else {}), **self.parameters)


@dataclass
class Recipe:
    """An ordered chain for one part. The hash leaves out the name: a renamed run is the same work."""

    kind: str
    name: str
    operations: Sequence[Operation]
    part: str = ORGANISM
    from_part: str | list[str] | None = None
    inputs: dict = field(default_factory=dict)

    def spec(self) -> dict:
        return recipe_spec(self.kind, self.part, [o.spec() for o in self.operations], self.from_part, self.inputs)

    @property
    def hash(self) -> str:
        return hash_spec(self.spec())

    def of(self, kind: str) -> list[Operation]:
        return [o for o in self.operations if o.kind == kind]

    def unrepeatable(self) -> list[Operation]:
        return [o for o in self.operations if not o.deterministic]


def spec_changes(old: dict, new: dict) -> list[str]:
    """What differs between two recipe specs, one line each."""
    out = [f"{k}: {old.get(k)!r} -> {new.get(k)!r}" for k in sorted({*old, *new} - {"operations"}) if old.get(k) != new.get(k)]
    before, after = ({label: o for label, o in zip(repeated_labels([o["name"] for o in s.get("operations", [])]), s.get("operations", []), strict=True)} for s in (old, new))
    out += [f"- {label}" for label in before if label not in after] + [f"+ {label}" for label in after if label not in before]
    for label in before.keys() & after.keys():
        out += [f"{label}.{k}: {before[label].get(k)!r} -> {after[label].get(k)!r}" for k in sorted({*before[label], *after[label]}) if before[label].get(k) != after[label].get(k)]
    return out


# Operations by name ---------------------------------------------------------------------------


def _transform(name: str, function: Callable, **parameters: Any) -> Operation:
    return Operation(name, function, "transform", parameters)


def _metric(name: str, function: Callable, unit: str, stored: str | None = None, **parameters: Any) -> Operation:
    return Operation(name, function, "metric", parameters, metric_name=stored, unit=unit)


def segment(model: Any, mask_threshold: float = 0.0) -> Operation:
    """A mask by a model with predict(rgb, mask_threshold) -> (mask, score, info); of another shape or empty is an error."""
    return Operation("segment", _run_model, "segment", {"mask_threshold": mask_threshold}, model=model)


def _run_model(s: Segment, model: Any, mask_threshold: float = 0.0) -> tuple[Segment, dict]:
    rgb = s.image[..., ::-1] if s.image.ndim == 3 else s.image
    try:
        mask, score, info = model.predict(rgb, mask_threshold=mask_threshold)
    except TypeError:
        mask, score, info = model.predict(rgb)
    mask = np.asarray(mask) > 0
    if mask.shape != s.frame:
        raise ValueError(f"the model returned a mask of {mask.shape} for a frame of {s.frame}")
    if not mask.any():
        raise ValueError("the model found nothing")
    out = Segment(s.image, mask, s.occurrence_id, s.part, s.matrix, s.shape0)
    return out, {"score": None if score is None else float(score), **(info or {})}


class BrightnessModel:
    """A segmenter without weights: pixels brighter than the middle between the frame's darkest and brightest."""

    def __init__(self, level: float = 0.5):
        self.level = level

    def identity(self) -> dict:
        return {"class": "BrightnessModel", "level": self.level}

    def predict(self, rgb: np.ndarray, mask_threshold: float = 0.0):
        light = rgb.mean(-1) if rgb.ndim == 3 else rgb
        cut = light.min() + (self.level - mask_threshold / 10) * (light.max() - light.min())
        mask = light > cut
        return mask, float(mask.mean()), {"cut": float(cut)}

    def predict_all(self, rgb: np.ndarray, mask_threshold: float = 0.0):
        """``predict`` of many images of one frame: masks, scores and infos."""
        light = (rgb.sum(-1) / 3 if rgb.ndim == 4 else rgb).astype(np.float64, copy=False)
        low, high = light.min((1, 2)), light.max((1, 2))
        cut = low + (self.level - mask_threshold / 10) * (high - low)
        masks = light > cut[:, None, None]
        return masks, masks.mean((1, 2)).tolist(), [{"cut": c} for c in cut.tolist()]


def remove_appendages(relative_radius: float = raster.APPENDAGE_RADIUS) -> Operation:
    return _transform("remove_appendages", raster.remove_appendages, relative_radius=relative_radius)


def remove_islands(min_area_frac: float | None = None) -> Operation:
    return _transform("remove_islands", raster.remove_islands, min_area_frac=min_area_frac)


def erode(fraction: float = raster.ERODE_FRACTION, px: float | None = None) -> Operation:
    return _transform("erode", raster.erode, fraction=fraction, px=px)


def orient(body_axis_is_higher_skew: bool = True, isotropy_warn_ratio: float = raster.ISOTROPY, axis_strategy: str = "skew") -> Operation:
    return _transform("orient", raster.orient, body_axis_is_higher_skew=body_axis_is_higher_skew, isotropy_warn_ratio=isotropy_warn_ratio, axis_strategy=axis_strategy)


def crop(region: str | None = None, x=None, y=None, width=None, height=None) -> Operation:
    box = (x, y, width, height)
    if (region is None) == (None in box) and not (region is not None and all(v is None for v in box)):
        raise ValueError("crop takes a region, or all of x, y, width and height")
    if region is not None and region not in raster.REGIONS:
        raise ValueError(f"unknown region {region!r}")
    return _transform("crop", raster.crop, region=region, x=x, y=y, width=width, height=height)


def crop_to_mask(pad: float = raster.BOX_PAD) -> Operation:
    return _transform("crop_to_mask", raster.crop_to_mask, pad=pad)


def crop_inside_mask() -> Operation:
    return _transform("crop_inside_mask", raster.crop_inside_mask)


def rotate(degrees: float) -> Operation:
    return _transform("rotate", raster.rotate, degrees=degrees)


def resize(width: int | None = None, height: int | None = None, scale: float | None = None) -> Operation:
    if scale is None and width is None and height is None:
        raise ValueError("resize needs a width, a height or a scale")
    return _transform("resize", raster.resize, width=width, height=height, scale=scale)


def remove_background(fill: int = 0) -> Operation:
    return _transform("remove_background", raster.remove_background, fill=fill)


def body_length(name: str | None = None, unit: str = "px") -> Operation:
    return _metric("body_length", raster.body_length, unit, name)


length = body_length


def max_width(name: str | None = None, unit: str = "px") -> Operation:
    return _metric("max_width", raster.max_width, unit, name)


def mask_area(name: str | None = None, unit: str = "px2") -> Operation:
    return _metric("area_px", raster.mask_area, unit, name)


def bounding_box(name: str | None = None, unit: str = "px") -> Operation:
    return _metric("bounding_box", raster.bounding_box, unit, name)


def elongation(name: str | None = None, unit: str = "ratio") -> Operation:
    return _metric("elongation", raster.elongation, unit, name)


def jaggedness(fraction: float = raster.SMOOTHING, px: float | None = None, name: str | None = None, unit: str = "ratio") -> Operation:
    return _metric("jaggedness", raster.jaggedness, unit, name, fraction=fraction, px=px)


def n_islands(name: str | None = None, unit: str = "count") -> Operation:
    return _metric("n_islands", raster.n_islands, unit, name)


def centroid(name: str | None = None, unit: str = "px") -> Operation:
    return _metric("centroid", raster.centroid, unit, name)


def relative_position(name: str | None = None, unit: str = "fraction") -> Operation:
    return _metric("relative_position", raster.relative_position, unit, name)


def image_bounds(name: str | None = None, unit: str = "px") -> Operation:
    return _metric("image_bounds", raster.image_bounds, unit, name)


def blur_variance(name: str | None = None, unit: str = "laplacian_var") -> Operation:
    return _metric("blur_variance", raster.blur_variance, unit, name)


def bilateral_asymmetry(name: str | None = None, unit: str = "fraction") -> Operation:
    return _metric("bilateral_asymmetry", raster.bilateral_asymmetry, unit, name)


def edge_fraction(name: str | None = None, unit: str = "fraction") -> Operation:
    return _metric("edge_fraction", raster.edge_fraction, unit, name)


def mask_fraction(name: str | None = None, unit: str = "fraction") -> Operation:
    return _metric("mask_fraction", raster.mask_fraction, unit, name)


def mean_lightness(name: str | None = None, unit: str = "fraction") -> Operation:
    return _metric("mean_lightness", raster.mean_lightness, unit, name)


def mean_color(name: str | None = None, unit: str = "fraction", space: str = "rgb") -> Operation:
    return _metric("mean_color", raster.mean_color, unit, name, space=space)


def white_balanced_color(name: str | None = None, unit: str = "fraction") -> Operation:
    return _metric("white_balanced_color", raster.white_balanced_color, unit, name)


def background_color(name: str | None = None, unit: str = "fraction") -> Operation:
    return _metric("background_color", raster.background_color, unit, name)


def threshold_fractions(thresholds: Sequence[ColorRule], unmatched: bool = False, name: str | None = None, unit: str = "fraction") -> Operation:
    names = [t.name for t in thresholds]
    if not names or len(set(names)) != len(names) or (unmatched and "unmatched" in names):
        raise ValueError("thresholds need distinct names")
    return _metric("threshold_fractions", raster.threshold_fractions, unit, name, thresholds=[t.spec() for t in thresholds], unmatched=unmatched)


def black_fraction(threshold: float = BLACK, name: str | None = None, unit: str = "fraction") -> Operation:
    return _metric("black_fraction", raster.single_fraction, unit, name, threshold=ColorRule("black", lab_l=(None, round(threshold * 100, 9))).spec())


def hue_fraction(hue: str, min_saturation: float = MIN_SATURATION, min_value: float = MIN_VALUE, name: str | None = None, unit: str = "fraction") -> Operation:
    return _metric(f"{hue}_fraction", raster.single_fraction, unit, name, threshold=hue_threshold(hue, min_saturation, min_value).spec())


def red_fraction(name: str | None = None, **settings: Any) -> Operation:
    return hue_fraction("red", name=name, **settings)


def yellow_fraction(name: str | None = None, **settings: Any) -> Operation:
    return hue_fraction("yellow", name=name, **settings)


def embedding(model: Any, name: str | None = None, unit: str = "embedding") -> Operation:
    """A vector by a model with embed(rgb) -> array, scaled to length one."""
    return Operation("embedding", _embed, "metric", {}, model=model, metric_name=name, unit=unit)


def _embed(s: Segment, model: Any) -> list[float]:
    v = np.asarray(model.embed(s.image[..., ::-1] if s.image.ndim == 3 else s.image), dtype=np.float64).ravel()
    return (v / max(float(np.sqrt((v * v).sum())), 1e-12)).tolist()


# Execution ------------------------------------------------------------------------------------

#: Columns of a stored mask.
MASK = ("rle_counts", "rle_height", "rle_width")
_ROW = f"{ID} string, part string, status string, error string, metric_name string, unit string, value_json string, info string, score double, rle_counts binary, rle_height int, rle_width int, area int"


def framed(row: Any) -> Segment:
    """A row's image and the union of its masks."""
    image = None
    if getattr(row, "data", None) is not None:
        flat = np.frombuffer(row.data, np.uint8)
        h, w = int(row.height), int(row.width)
        n = len(flat) // (h * w)
        image = flat.reshape(h, w) if n == 1 else flat.reshape(h, w, n)[..., :3]
    mask = None
    masks = [m for m in (getattr(row, "masks", None) if getattr(row, "masks", None) is not None else [])]
    if getattr(row, "rle_counts", None) is not None:
        masks = [{c: getattr(row, c) for c in MASK}]
    for m in masks:
        got = decode(bytes(m["rle_counts"]), int(m["rle_height"]), int(m["rle_width"]))
        mask = got if mask is None else np.logical_or(*raster.common(mask, got))
    if image is None and mask is None:
        raise NothingToMeasure("neither image nor mask")
    return Segment(image, mask, getattr(row, ID))


def _one_by_one(row: Any, recipe: Recipe, transforms: list[Operation], labels: list[str]) -> list[dict]:
    """The result rows of a single image."""
    base, out = {ID: getattr(row, ID), "part": recipe.part}, []
    try:
        s, infos, score = framed(row), {}, None
        for label, o in zip(labels, transforms, strict=True):
            s, info = o(s)
            score = info.pop("score", score) if o.kind == "segment" else score
            infos[label] = {k: v for k, v in info.items() if isinstance(v, bool | int | float | str | np.generic) or v is None}
    except NothingToMeasure as e:
        return [base | {"status": "no_input", "error": str(e)}]
    except Exception as e:  # one bad image is that row's result
        return [base | {"status": "failed", "error": f"{type(e).__name__}: {e}"}]
    if recipe.kind == "segment":
        try:
            mask = s.original_mask()
        except Exception as e:
            return [base | {"status": "failed", "error": f"{type(e).__name__}: {e}"}]
        counts, h, w = encode(mask)
        return [base | {"status": "done", "info": canonical_json(infos), "score": score, "rle_counts": counts, "rle_height": h, "rle_width": w, "area": int(mask.sum())}]
    for o in recipe.of("metric"):
        name = o.metric_name or o.name
        try:
            out.append(base | {"status": "done", "metric_name": name, "unit": o.unit, "value_json": canonical_json(o(s))})
        except NothingToMeasure as e:
            out.append(base | {"status": "no_input", "error": str(e), "metric_name": name})
        except Exception as e:
            out.append(base | {"status": "failed", "error": f"{type(e).__name__}: {e}", "metric_name": name})
    for label, info in infos.items():
        if info:
            out.append(base | {"status": "done", "metric_name": label, "unit": TRANSFORM_INFO, "value_json": canonical_json(info)})
    return out


def stackable(recipe: Recipe) -> bool:
    """Whether every step of a recipe has a form for many images at once."""
    able = lambda o: hasattr(o.model, "predict_all") if o.kind == "segment" else o.function in (stacks.METRICS if o.kind == "metric" else stacks.TRANSFORMS)
    return all(able(o) for o in recipe.operations)


def _stacked(pdf: pd.DataFrame) -> list[tuple[np.ndarray, Stack]]:
    """(places, stack) of the rows that have an image and at most one mask, of the image's shape, by frames."""
    groups: dict[tuple, list[int]] = {}
    masks = list(pdf["masks"]) if "masks" in pdf else [None] * len(pdf)
    if "rle_counts" in pdf:
        masks = [[dict(zip(MASK, m, strict=True))] for m in zip(*(pdf[c] for c in MASK), strict=True)]
    for k, (h, w, data, own) in enumerate(zip(pdf["height"], pdf["width"], pdf["data"], masks, strict=True)):
        if data is None or not h * w or len(data) % (h * w) or (own is not None and len(own) > 1):
            continue
        held = own[0] if own is not None and len(own) else None
        if held is None or (held["rle_height"], held["rle_width"]) == (h, w):
            groups.setdefault((int(h), int(w), len(data), held is not None), []).append(k)
    out, images = [], pdf["data"].tolist()
    for (h, w, size, has), places in groups.items():
        many = max(1, stacks.PIXELS // (h * w))
        for part in (places[k : k + many] for k in range(0, len(places), many)):
            image = np.frombuffer(b"".join([images[k] for k in part]), np.uint8).reshape(len(part), h, w, -1)
            image = image[..., 0] if size == h * w else image[..., :3]
            try:
                mask = decode_all([bytes(masks[k][0]["rle_counts"]) for k in part], h, w) if has else None
            except ValueError:
                continue  # one of them is damaged: each by itself
            out.append((np.array(part), Stack.of(image, mask)))
    return out


def _together(stack: Stack, recipe: Recipe, transforms: list[Operation], labels: list[str]) -> list[tuple[np.ndarray, dict[str, Any]]]:
    """(places in the stack, columns of result rows) of what can be done for many images at once; all other places are left out."""
    parts = [(np.arange(len(stack)), stack, {}, None)]
    for label, o in zip(labels, transforms, strict=True):
        after = []
        for at, s, infos, score in parts:
            if o.kind == "segment":
                masks, score, info = o.model.predict_all(s.image[..., ::-1] if s.image.ndim == 4 else s.image, **o.parameters)
                some = np.flatnonzero(masks.any((1, 2)))
                score = [score[k] for k in some]
                made = [(some, replace(s.taken(some), mask=masks[some]), [info[k] for k in some])] if len(some) else []
            else:
                some = np.flatnonzero(s.mask.any((1, 2)))
                made = [(some[p], new, info) for p, new, info in stacks.TRANSFORMS[o.function](s if len(some) == len(s) else s.taken(some), **o.parameters)] if len(some) else []
            for p, new, info in made:
                old = {k: [v[j] for j in p] for k, v in infos.items()} if len(p) < len(s) else infos
                after.append((at[p], new, old | {label: info}, score if o.kind == "segment" or score is None else [score[j] for j in p]))
        parts = after
    out = []
    for at, s, infos, score in parts:
        some = np.flatnonzero(s.mask.any((1, 2)))
        if len(some) < len(s):
            at, s, infos, score = at[some], s.taken(some), {k: [v[j] for j in some] for k, v in infos.items()}, score and [score[j] for j in some]
        if not len(s):
            continue
        if recipe.kind == "segment":
            mask = s.original()
            good = np.flatnonzero(mask.any((1, 2)))
            if len(good) == len(s):
                texts = [canonical_json(dict(zip(infos, row, strict=True))) for row in zip(*infos.values(), strict=True)]
                out.append((at, {"status": "done", "info": texts, "score": score, "rle_counts": encode_all(mask), "rle_height": mask.shape[1], "rle_width": mask.shape[2], "area": mask.sum((1, 2)).tolist()}))
            continue
        rows = [(o.metric_name or o.name, o.unit, stacks.METRICS[o.function](s, **o.parameters)) for o in recipe.of("metric")]
        rows += [(label, TRANSFORM_INFO, info) for label, info in infos.items() if info[0]]
        out += [(at, {"status": "done", "metric_name": name, "unit": unit, "value_json": [canonical_json(v) for v in values]}) for name, unit, values in rows]
    return out


def execute(work: DataFrame, recipe: Recipe, kept: Sequence[str] = ()) -> DataFrame:
    """Run a recipe over rows (occurrence_id, height, width, data, masks): one fused Python pass, a row per result.

    status is done, no_input or failed (with the error); of a metric run each metric is a row, and what its transforms
    recorded are rows of unit transform_info; of a segment run the mask is one row. One bad image fails alone. Instead
    of ``masks`` there may be one mask in rle_counts, rle_height and rle_width. Columns ``kept`` of ``work`` are
    passed on. Images of one frame are worked on together where every step has such a form; what doesn't fit there
    (another shape of mask, an empty one, an error) is done image by image.
    """
    shared, together = recipe, stackable(recipe)
    names = [c.split()[0] for c in _ROW.split(", ")]

    def run(frames):
        transforms = [o for o in shared.operations if o.kind != "metric"]
        labels = repeated_labels([o.name for o in transforms])
        for pdf in frames:
            columns: dict[str, list] = {n: [] for n in (*names, "_at")}
            ids, alone = pdf[ID].tolist(), np.ones(len(pdf), dtype=bool)
            for places, stack in _stacked(pdf) if together else ():
                try:
                    made = _together(stack, shared, transforms, labels)
                except Exception:  # which image it was shows image by image
                    continue
                for at, values in made:
                    rows = places[at]
                    alone[rows] = False
                    given = values | {ID: [ids[k] for k in rows], "part": shared.part, "_at": rows.tolist()}
                    for n, column in columns.items():
                        value = given.get(n)
                        column.extend(value if isinstance(value, list) else [value] * len(rows))
            left = np.flatnonzero(alone)
            for k, row in zip(left.tolist(), pdf.iloc[left].itertuples(index=False), strict=True):
                for r in _one_by_one(row, shared, transforms, labels):
                    for n, column in columns.items():
                        column.append(k if n == "_at" else r.get(n))
            if not columns["_at"]:
                continue
            at = columns.pop("_at")
            frame = pd.DataFrame(columns)
            for c in ("rle_height", "rle_width", "area"):
                frame[c] = frame[c].astype("Int32")
            for c in kept:
                frame[f"_{c}"] = pdf[c].to_numpy()[at]
            yield frame

    more = "".join(f", `_{c}` {work.schema[c].dataType.simpleString()}" for c in kept)
    found = work.mapInPandas(run, _ROW + more)
    return found.select(*names, *[F.col(f"_{c}").alias(c) for c in kept])


def masks_as_rows(results: DataFrame, recipe: Recipe, run_id: int, source: str = "source_mask_hash") -> DataFrame:
    """Finished segment results as mask rows, with what they derive from."""
    done = results.where("status = 'done'")
    upstream = F.col(source) if source in results.columns else F.lit(None).cast("string")
    return done.select(ID, "part", "rle_counts", "rle_height", "rle_width", "area", "score", "info", F.lit(recipe.hash).alias("recipe_hash"), F.lit(run_id).cast("long").alias("run_id"), F.lit(recipe.from_part if isinstance(recipe.from_part, str) else None).cast("string").alias("from_part"), upstream.alias("source_mask_hash"), F.current_timestamp().cast("string").alias("created_at"))


def source_identity(recipe_hash: str | None, upstream: str | None) -> str | None:
    return derivation_hash(recipe_hash, upstream)


def load_spec(text: str) -> dict:
    return json.loads(text)
