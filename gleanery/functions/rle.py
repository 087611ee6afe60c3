"""Run-length masks: column-major runs that start with background, and their compressed text form."""

from __future__ import annotations

import hashlib

import numpy as np


def runs_of(mask: np.ndarray) -> np.ndarray:
    """Lengths of alternating runs, background first, over the columns of a mask."""
    flat = np.asarray(mask, dtype=bool).ravel(order="F")
    if not len(flat):
        return np.zeros(0, dtype=np.int64)
    ends = np.concatenate((np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]))
    runs = np.diff(ends, prepend=0)
    return np.concatenate(([0], runs)) if flat[0] else runs


def mask_of(runs: np.ndarray, height: int, width: int) -> np.ndarray:
    value = np.arange(len(runs)) % 2 == 1
    flat = np.repeat(value, runs)
    if len(flat) != height * width:
        raise ValueError(f"runs cover {len(flat)} of {height * width} pixels")
    return flat.reshape((height, width), order="F")


def compress(runs: np.ndarray) -> bytes:
    """Runs as text: each after the third less the one two before, in signed groups of five bits from code point 48 on."""
    out = bytearray()
    for k, run in enumerate(np.asarray(runs).tolist()):
        x = run - int(runs[k - 2]) if k > 2 else run
        while True:
            group = x & 31
            x >>= 5
            more = x != -1 if group & 16 else x != 0
            out.append(48 + (group | 32 if more else group))
            if not more:
                break
    return bytes(out)


def expand(data: bytes) -> np.ndarray:
    """The runs of ``compress``."""
    runs: list[int] = []
    value = shift = 0
    for byte in data:
        code = byte - 48
        value |= (code & 31) << shift
        shift += 5
        if not code & 32:
            if code & 16:
                value -= 1 << shift
            runs.append(value + (runs[-2] if len(runs) > 2 else 0))
            value = shift = 0
    return np.array(runs, dtype=np.int64)


def encode(mask: np.ndarray) -> tuple[bytes, int, int]:
    """Compressed counts, height and width."""
    mask = np.asarray(mask) > 0
    return compress(runs_of(mask)), *mask.shape


def decode(counts: bytes | str, height: int, width: int) -> np.ndarray:
    return mask_of(expand(counts.encode() if isinstance(counts, str) else counts), height, width)


def encode_all(masks: np.ndarray) -> list[bytes]:
    """Compressed counts of many masks (n, height, width) of one shape: ``encode`` of each."""
    n, size = len(masks), masks.shape[1] * masks.shape[2]
    flat = masks.transpose(0, 2, 1).reshape(n, size)
    change = np.empty((n, size + 1), dtype=bool)
    change[:, 0] = flat[:, 0]
    change[:, 1:-1] = flat[:, 1:] != flat[:, :-1]
    change[:, -1] = True
    of, end = np.nonzero(change)
    first = np.searchsorted(of, np.arange(n))
    k = np.arange(len(of)) - first[of]
    runs = np.where(k == 0, end, np.diff(end, prepend=0))
    x = runs.copy()
    x[2:] -= np.where(k > 2, np.concatenate(([0, 0], runs[:-2])), 0)[2:]
    groups, place, open_ = [], [], np.arange(len(x))
    length = np.zeros(len(x), dtype=np.int64)
    while len(open_):
        group = x[open_] & 31
        x[open_] >>= 5
        more = np.where(group & 16, x[open_] != -1, x[open_] != 0)
        groups.append(48 + np.where(more, group | 32, group))
        place.append(open_)
        length[open_] += 1
        open_ = open_[more]
    to = np.cumsum(length) - length
    data = np.zeros(int(length.sum()), dtype=np.uint8)
    for j, (codes, at) in enumerate(zip(groups, place, strict=True)):
        data[to[at] + j] = codes
    text, cuts = data.tobytes(), [*to[first].tolist(), len(data)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def decode_all(counts: list[bytes], height: int, width: int) -> np.ndarray:
    """The masks (n, height, width) of many compressed counts of one shape: ``decode`` of each; ValueError where any doesn't cover its frame."""
    if not all(counts):
        raise ValueError("no runs")
    codes = np.frombuffer(b"".join(counts), np.uint8).astype(np.int64) - 48
    last = codes & 32 == 0
    value = np.cumsum(last) - last
    begin = np.flatnonzero(np.concatenate(([True], last[:-1])))
    shift = 5 * (np.arange(len(codes)) - begin[value])
    runs = np.add.reduceat((codes & 31) << shift, begin)
    tail = np.flatnonzero(last)
    runs -= np.where(codes[tail] & 16, np.int64(1) << (shift[tail] + 5), 0)
    many = np.diff(np.concatenate(([0], np.cumsum(last)[np.cumsum([len(c) for c in counts]) - 1])))
    if (many == 0).any() or not last[-1]:
        raise ValueError("a run is cut off")
    first = np.cumsum(many) - many
    k = np.arange(len(runs)) - np.repeat(first, many)
    for parity in (0, 1):
        at = np.flatnonzero((k % 2 == parity) & (k > 0))
        total = np.cumsum(runs[at])
        opens = k[at] == 2 - parity
        before = np.where(opens, total - runs[at], 0)
        runs[at] = total - before[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))] if len(at) else total
    if (runs < 0).any() or (np.add.reduceat(runs, first) != height * width).any():
        raise ValueError("runs don't cover their frame")
    return np.repeat(k % 2 == 1, runs).reshape(len(counts), width, height).transpose(0, 2, 1)


def mask_digest(mask: np.ndarray) -> str:
    """Short digest of a mask's pixels and shape."""
    mask = np.asarray(mask) > 0
    return hashlib.sha256(np.packbits(mask).tobytes() + str(mask.shape).encode()).hexdigest()[:16]
