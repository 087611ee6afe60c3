"""The operations of ``raster`` over many images of one frame at once.

A transform gives parts: (places in the stack, the new stack, what it recorded of each); images of different new frames
are different parts, and places that no part holds are left to ``raster``, one by one. A measurement gives a value for
each image. Results are those of ``raster``, whose functions are the keys of ``TRANSFORMS`` and ``METRICS``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np

from gleanery.functions import raster
from gleanery.functions.color import CHANNELS, CIRCULAR, ColorRule, convert, lightness, threshold_masks

#: Pixels of a stack: small enough for the cache, many enough that calls don't count.
PIXELS = 300_000


@dataclass
class Stack:
    """Images (n, h, w[, 3]) with their masks (n, h, w) and affines (n, 2, 3) from original to working coordinates."""

    image: np.ndarray | None
    mask: np.ndarray | None
    matrix: np.ndarray
    shape0: tuple[int, int]
    moved: bool = False

    @classmethod
    def of(cls, image: np.ndarray | None, mask: np.ndarray | None) -> Stack:
        some = image if image is not None else mask
        return cls(image, mask, np.repeat(raster.IDENTITY[None], len(some), axis=0), some.shape[1:3])

    def __len__(self) -> int:
        return len(self.matrix)

    @property
    def frame(self) -> tuple[int, int]:
        return (self.image if self.image is not None else self.mask).shape[1:3]

    def taken(self, places: np.ndarray) -> Stack:
        cut = lambda a: None if a is None else a[places]
        return replace(self, image=cut(self.image), mask=cut(self.mask), matrix=self.matrix[places])

    def after(self, image, mask, applied: np.ndarray) -> Stack:
        """After an affine (2, 3) or one for each image."""
        whole = np.concatenate((np.broadcast_to(applied, self.matrix.shape), np.broadcast_to([[[0.0, 0, 1]]], (len(self), 1, 3))), axis=1) @ np.concatenate((self.matrix, np.broadcast_to([[[0.0, 0, 1]]], (len(self), 1, 3))), axis=1)
        return replace(self, image=image, mask=mask, matrix=whole[:, :2], moved=True)

    def original(self) -> np.ndarray:
        """The masks in original coordinates."""
        if not self.moved:
            return self.mask
        h, w = self.shape0
        ys, xs = np.mgrid[0:h, 0:w]
        x, y = (np.rint(self.matrix[:, k, 0, None, None] * xs + self.matrix[:, k, 1, None, None] * ys + self.matrix[:, k, 2, None, None]).astype(int) for k in (0, 1))
        out = _looked_up(self.mask, y, x)
        same = np.isclose(self.matrix, raster.IDENTITY).all((1, 2)) & (self.mask.shape[1:] == self.shape0)
        if same.any():
            out[same] = self.mask[same]
        return out

    def three(self) -> np.ndarray:
        return self.image if self.image.ndim == 4 else np.repeat(self.image[..., None], 3, axis=3)


def _looked_up(array: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """array[k, y[k], x[k]], zero outside; y and x (n, h, w), or (h, w) for all."""
    h, w = array.shape[1:3]
    good = (x >= 0) & (y >= 0) & (x < w) & (y < h)
    flat, at = array.reshape(len(array), h * w, *array.shape[3:]), np.clip(y, 0, h - 1) * w + np.clip(x, 0, w - 1)
    got = flat[:, at] if x.ndim == 2 else flat[np.arange(len(array))[:, None, None], at]
    return got if good.all() else np.where(good.reshape(good.shape + (1,) * (array.ndim - 3)), got, np.zeros((), array.dtype))


def _warped(array: np.ndarray, matrix: np.ndarray, size: tuple[int, int], linear: bool = False) -> np.ndarray:
    """``raster.warp`` of each image by its own matrix (n, 2, 3), or by one (2, 3) for all."""
    w, h = size
    some = max(1, PIXELS // 8 // (w * h))
    if len(array) > some:  # what lies between is many times the images
        cuts = range(0, len(array), some)
        return np.concatenate([_warped(array[k : k + some], matrix[k : k + some] if matrix.ndim == 3 else matrix, size, linear) for k in cuts])
    corner = np.broadcast_to([0.0, 0, 1], (*matrix.shape[:-2], 1, 3))
    inverse = np.linalg.inv(np.concatenate((matrix, corner), axis=-2))[..., None, None]
    ys, xs = np.mgrid[0:h, 0:w]
    x, y = (inverse[..., k, 0, :, :] * xs + inverse[..., k, 1, :, :] * ys + inverse[..., k, 2, :, :] for k in (0, 1))
    if not linear:
        return _looked_up(array, np.rint(y).astype(int), np.rint(x).astype(int))
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (v.reshape(v.shape + (1,) * (array.ndim - 3)) for v in (x - x0, y - y0))
    at = lambda dy, dx: _looked_up(array, y0 + dy, x0 + dx)
    if not fx.any() and not fy.any():
        return at(0, 0)
    out = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.rint(out).astype(array.dtype) if array.dtype == np.uint8 else out


def _by(*columns: np.ndarray) -> list[np.ndarray]:
    """Places of equal rows."""
    first, *more = (c for column in columns for c in (column.T if column.ndim == 2 else [column]))
    which = np.unique(first, return_inverse=True)[1]
    for c in more:
        which = np.unique(which * (int(c.max()) + 1) + c, return_inverse=True)[1]
    order = np.argsort(which.ravel(), kind="stable")
    return np.split(order, np.cumsum(np.bincount(which.ravel()))[:-1])


def _rows(**columns: Any) -> list[dict]:
    """One dict for each image of columns of values; what is no array is the same for all."""
    n = next(len(v) for v in columns.values() if isinstance(v, np.ndarray))
    lists = [v.tolist() if isinstance(v, np.ndarray) else [v] * n for v in columns.values()]
    return [dict(zip(columns, row, strict=True)) for row in zip(*lists, strict=True)]


def _areas(mask: np.ndarray) -> np.ndarray:
    return mask.sum((1, 2))


def _boxes(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, columns = mask.any(2), mask.any(1)
    y, x = rows.argmax(1), columns.argmax(1)
    return x, y, mask.shape[2] - columns[:, ::-1].argmax(1) - x, mask.shape[1] - rows[:, ::-1].argmax(1) - y


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of all components (1.. through the stack), the image of each component, and how many each image has: the masks lie below one another, a row apart."""
    n, h, w = mask.shape
    tall = np.zeros((n, h + 1, w), dtype=bool)
    tall[:, :h] = mask
    labels, many = raster.components(tall.reshape(-1, w))
    labels = labels.reshape(n, h + 1, w)[:, :h]
    of = np.zeros(many, dtype=np.int64)
    where, y, x = np.nonzero(mask)
    of[labels[where, y, x] - 1] = where
    return labels, of, np.bincount(of, minlength=n)


# Transforms -------------------------------------------------------------------------------------


def remove_islands(s: Stack, min_area_frac: float | None = None):
    labels, of, many = components(s.mask)
    areas = np.bincount(labels.ravel(), minlength=len(of) + 1)[1:]
    first = np.cumsum(many) - many
    largest = np.maximum.reduceat(areas, first)
    if min_area_frac is None:
        best = np.lexsort((np.arange(len(of)), -areas, of))[first]
        keep = np.zeros(len(of) + 1, dtype=bool)
        keep[best + 1] = True
    else:
        keep = np.concatenate(([False], areas >= min_area_frac * largest[of]))
    out = keep[labels]
    before, after = _areas(s.mask), _areas(out)
    left = np.bincount(of[keep[1:]], minlength=len(s))
    return [(np.arange(len(s)), replace(s, mask=out), _rows(area_before=before, area_after=after, removed_fraction=1 - after / before, n_components=many, n_removed=many - left))]


def _edge_distance(mask: np.ndarray) -> np.ndarray:
    m = np.pad(mask, ((0, 0), (1, 1), (1, 1)))
    h, w = m.shape[1:]
    up = np.where(m, float(h + w), 0.0)
    for y in range(1, h):
        up[:, y] = np.minimum(up[:, y], up[:, y - 1] + 1)
    for y in range(h - 2, -1, -1):
        up[:, y] = np.minimum(up[:, y], up[:, y + 1] + 1)
    square = up * up
    best = square.copy()
    for step in range(1, w):
        if step * step >= best.max():
            break
        best[:, :, step:] = np.minimum(best[:, :, step:], square[:, :, :-step] + step * step)
        best[:, :, :-step] = np.minimum(best[:, :, :-step], square[:, :, step:] + step * step)
    return np.sqrt(best)[:, 1:-1, 1:-1]


def erode(s: Stack, fraction: float = raster.ERODE_FRACTION, px: float | None = None):
    distance = _edge_distance(s.mask)
    inner = distance.max((1, 2))
    radius = np.full(len(s), float(px)) if px is not None else fraction * inner
    out = distance > radius[:, None, None]
    degenerate = ~out.any((1, 2))
    out[degenerate] = s.mask[degenerate]
    before, after = _areas(s.mask), _areas(out)
    return [(np.arange(len(s)), replace(s, mask=out), _rows(radius_px=radius, inscribed_radius_px=inner, area_before=before, area_after=after, removed_fraction=1 - after / before, n_components=components(out)[2], degenerate=degenerate))]


def _turned(s: Stack, matrix: np.ndarray, size: tuple[int, int]) -> Stack:
    image = None if s.image is None else _warped(s.image, matrix, size, linear=True)
    return s.after(image, None if s.mask is None else _warped(s.mask, matrix, size), matrix)


def rotate(s: Stack, degrees: float):
    h, w = s.frame
    matrix, size = raster.rotation(degrees, w / 2, h / 2, (h, w))
    return [(np.arange(len(s)), _turned(s, matrix, size), [{"degrees": degrees, "width": size[0], "height": size[1]} for _ in range(len(s))])]


def orient(s: Stack, **settings: Any):
    """Each image has its own angle; those of one new frame are a part."""
    turns, infos = [], []
    where, ys, xs = np.nonzero(s.mask)
    ends = np.cumsum(_areas(s.mask))
    able = np.flatnonzero(_areas(s.mask) > 1)
    for k in able.tolist():
        own = slice(ends[k - 1] if k else 0, ends[k])
        degrees, cx, cy, info = raster.oriented(ys[own], xs[own], **settings)
        turns.append(raster.rotation(degrees, cx, cy, s.frame))
        infos.append(info | {"rotation_deg": degrees})
    out = []
    for at in _by(np.array([size for _, size in turns])) if turns else []:
        matrix = np.stack([turns[k][0] for k in at])
        out.append((able[at], _turned(s.taken(able[at]), matrix, turns[at[0]][1]), [infos[k] for k in at]))
    return out


def _boxed(s: Stack, x0: int, y0: int, x1: int, y1: int):
    h, w = s.frame
    x0, y0, x1, y1 = max(0, int(x0)), max(0, int(y0)), min(w, int(x1)), min(h, int(y1))
    if x1 <= x0 or y1 <= y0:
        return None, None
    cut = lambda a: None if a is None else a[:, y0:y1, x0:x1]
    moved = s.after(cut(s.image), cut(s.mask), np.array([[1.0, 0, -x0], [0, 1.0, -y0]]))
    return moved, {"x": x0, "y": y0, "width": x1 - x0, "height": y1 - y0, "source_width": w, "source_height": h}


def crop(s: Stack, region: str | None = None, x=None, y=None, width=None, height=None):
    if region is not None:
        h, w = s.frame
        x, y, width, height = (f * n for f, n in zip(raster.REGIONS[region], (w, h, w, h), strict=True))
    moved, info = _boxed(s, x, y, x + width, y + height)
    return [] if moved is None else [(np.arange(len(s)), moved, [dict(info) for _ in range(len(s))])]


def _inscribed(mask: np.ndarray) -> np.ndarray:
    """(n, 4): the largest box inside each mask, of equal ones that of the first last row, then of the first last column, then the tallest."""
    n, h, w = mask.shape
    tall = np.zeros((n, h, w), dtype=np.int16 if h < 2**15 else np.int32)
    tall[:, 0] = mask[:, 0]
    for y in range(1, h):
        tall[:, y] = np.where(mask[:, y], tall[:, y - 1] + 1, 0)
    best, box = np.zeros(n, dtype=np.int64), np.zeros((n, 4), dtype=np.int64)
    end = np.zeros((n, 2), dtype=np.int64)
    lowest = tall
    for wide in range(1, w + 1):
        lowest = lowest if wide == 1 else np.minimum(lowest[:, :, :-1], tall[:, :, wide - 1 :])
        flat = lowest.reshape(n, -1)
        at = flat.argmax(1)
        high = flat[np.arange(n), at]
        if not high.any():
            break
        y, x = np.divmod(at, w - wide + 1)
        area, right = high.astype(np.int64) * wide, x + wide
        sooner = (y < end[:, 0]) | ((y == end[:, 0]) & (right < end[:, 1]))
        better = (area > best) | ((area == best) & (area > 0) & sooner)
        best, box[better], end[better] = np.where(better, area, best), np.column_stack((x, y - high + 1, np.full(n, wide), high))[better], np.column_stack((y, right))[better]
    return box


def crop_inside_mask(s: Stack):
    box, area, out = _inscribed(s.mask), _areas(s.mask), []
    for at in _by(box[:, 2:]):
        x, y, (w, h) = box[at, 0], box[at, 1], box[at[0], 2:].tolist()
        place = (at[:, None, None], y[:, None, None] + np.arange(h)[:, None], x[:, None, None] + np.arange(w))
        cut = lambda a, place=place: None if a is None else a[place]
        applied = np.repeat(raster.IDENTITY[None], len(at), axis=0)
        applied[:, 0, 2], applied[:, 1, 2] = -x, -y
        moved = replace(s, matrix=s.matrix[at]).after(cut(s.image), cut(s.mask), applied)
        out.append((at, moved, _rows(x=x, y=y, width=w, height=h, source_width=s.frame[1], source_height=s.frame[0], mask_fraction=w * h / area[at])))
    return out


def resize(s: Stack, width: int | None = None, height: int | None = None, scale: float | None = None):
    h, w = s.frame
    if scale is not None:
        width, height = max(1, round(w * scale)), max(1, round(h * scale))
    elif width is None:
        width = max(1, round(w * height / h))
    elif height is None:
        height = max(1, round(h * width / w))
    width, height = int(width), int(height)
    sx, sy = width / w, height / h
    image, mask = s.image, s.mask
    if image is not None and sx < 1:
        image = np.stack([raster._area_resized(i, width, height) for i in image])
    elif image is not None:
        padded = np.pad(image, ((0, 0), (1, 1), (1, 1)) + ((0, 0),) * (image.ndim - 3), mode="edge")
        centred = np.array([[sx, 0, sx / 2 - 0.5], [0, sy, sy / 2 - 0.5]])
        centred[:, 2] -= centred[:, 0] + centred[:, 1]
        image = _warped(padded, centred, (width, height), linear=True)
    if mask is not None:
        mask = mask[:, np.arange(height) * h // height][:, :, np.arange(width) * w // width]
    return [(np.arange(len(s)), s.after(image, mask, np.array([[sx, 0, 0], [0, sy, 0]])), [{"width": width, "height": height, "scale_x": sx, "scale_y": sy} for _ in range(len(s))])]


def remove_background(s: Stack, fill: int = 0):
    image = s.image.copy()
    image[~s.mask] = fill
    return [(np.arange(len(s)), replace(s, image=image), _rows(fill=fill, background_fraction=_areas(~s.mask) / s.mask[0].size))]


# Measurements -----------------------------------------------------------------------------------


def bounding_box(s: Stack) -> list:
    return _box_rows(s.mask)


def _box_rows(mask: np.ndarray) -> list:
    x, y, w, h = _boxes(mask)
    return _rows(x=x, y=y, width=w, height=h)


def max_width(s: Stack) -> list:
    w = s.mask.shape[2]
    across = w - s.mask[:, :, ::-1].argmax(2) - s.mask.argmax(2)
    return np.where(s.mask.any(2), across, 0).max(1).tolist()


def _sums(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels, and sums of their columns and rows."""
    rows, columns = mask.sum(2), mask.sum(1)
    return rows.sum(1), columns @ np.arange(mask.shape[2]), rows @ np.arange(mask.shape[1])


def elongation(s: Stack) -> list:
    n, sx, sy = (v.astype(np.float64) for v in _sums(s.mask))
    if (n < 2).any():
        raise ValueError("too few pixels to have a shape")
    rows, columns = s.mask.sum(2), s.mask.sum(1)
    x, y = np.arange(s.mask.shape[2]), np.arange(s.mask.shape[1])
    both = ((s.mask @ x) * y).sum(1)
    vx, vy, vxy = (n * (columns @ (x * x)) - sx * sx) / (n * n), (n * (rows @ (y * y)) - sy * sy) / (n * n), (n * both - sx * sy) / (n * n)
    values = np.linalg.eigvalsh(np.stack((np.stack((vx, vxy), -1), np.stack((vxy, vy), -1)), -2) + np.eye(2) / 12)
    return np.sqrt(values[:, 1] / values[:, 0]).tolist()


def centroid(s: Stack) -> list:
    n, sx, sy = _sums(s.original())
    return _rows(x=sx / n, y=sy / n)


def relative_position(s: Stack) -> list:
    n, sx, sy = _sums(s.original())
    h, w = s.shape0
    return _rows(x=sx / n / w, y=sy / n / h)


def bilateral_asymmetry(s: Stack) -> list:
    n, sx, _ = _sums(s.mask)
    where, ys, xs = np.nonzero(s.mask)
    mirror = np.rint((2 * (sx / n))[where] - xs).astype(int)
    good = (mirror >= 0) & (mirror < s.mask.shape[2])
    other = np.zeros_like(s.mask)
    other[where[good], ys[good], mirror[good]] = True
    both = _areas(s.mask & other)
    return (1.0 - both / _areas(s.mask | other)).tolist()


def edge_fraction(s: Stack) -> list:
    mask = s.original()
    inside = _areas(mask[:, 1:-1, 1:-1])
    area = _areas(mask)
    return ((area - inside) / area).tolist()


def mask_fraction(s: Stack) -> list:
    mask = s.original()
    return (_areas(mask) / mask[0].size).tolist()


def _means(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean for each image of values that are those of the masked pixels in order."""
    area = _areas(mask)
    total = np.add.reduceat(values.astype(np.float64), np.cumsum(area) - area, axis=0)
    return total / (area if values.ndim == 1 else area[:, None])


def mean_lightness(s: Stack) -> list:
    return (_means(lightness(s.three()[s.mask]), s.mask) / 100).tolist()


def mean_color(s: Stack, space: str = "rgb") -> list:
    if space in CIRCULAR:
        raise NotImplementedError
    means = _means(convert(s.three()[s.mask], space), s.mask)
    return _rows(**dict(zip(CHANNELS[space], means.T, strict=True)))


def white_balanced_color(s: Stack) -> list:
    image = s.three()
    means = image.reshape(len(s), -1, 3).mean(1)
    means[means == 0] = 1
    gains = means.mean(1, keepdims=True) / means
    pixels = np.clip(image[s.mask] * np.repeat(gains, _areas(s.mask), axis=0), 0, 255)
    b, g, r = (_means(pixels, s.mask) / 255).T
    return _rows(r=r, g=g, b=b)


def background_color(s: Stack) -> list:
    if s.mask.all((1, 2)).any():
        raise ValueError("the mask covers the frame")
    image, ground = s.three(), ~s.mask
    b, g, r = (_means(image[ground], ground) / 255).T
    out, own = (_means(lightness(image[m]), m) / 100 for m in (ground, s.mask))
    return _rows(r=r, g=g, b=b, lightness=out, contrast=own - out)


def threshold_fractions(s: Stack, thresholds: list[dict], unmatched: bool = False) -> list:
    masks = threshold_masks(s.three()[s.mask], [ColorRule.of(t) for t in thresholds])
    out = {name: _means(m, s.mask) for name, m in masks.items()}
    if unmatched:
        out["unmatched"] = _means(~np.any(list(masks.values()), axis=0), s.mask)
    return _rows(**out)


def single_fraction(s: Stack, threshold: dict) -> list:
    return [next(iter(v.values())) for v in threshold_fractions(s, [threshold])]


TRANSFORMS: dict[Callable, Callable] = {raster.remove_islands: remove_islands, raster.erode: erode, raster.rotate: rotate, raster.orient: orient, raster.crop: crop, raster.crop_inside_mask: crop_inside_mask, raster.resize: resize, raster.remove_background: remove_background}
METRICS: dict[Callable, Callable] = {
    raster.mask_area: lambda s: _areas(s.mask).tolist(), raster.bounding_box: bounding_box, raster.body_length: lambda s: _boxes(s.mask)[3].tolist(), raster.max_width: max_width, raster.elongation: elongation,
    raster.n_islands: lambda s: (components(s.mask)[2] - 1).tolist(), raster.centroid: centroid, raster.relative_position: relative_position, raster.image_bounds: lambda s: _box_rows(s.original()), raster.bilateral_asymmetry: bilateral_asymmetry,
    raster.edge_fraction: edge_fraction, raster.mask_fraction: mask_fraction, raster.mean_lightness: mean_lightness, raster.mean_color: mean_color, raster.white_balanced_color: white_balanced_color, raster.background_color: background_color,
    raster.threshold_fractions: threshold_fractions, raster.single_fraction: single_fraction,
}
