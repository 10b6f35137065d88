"""Image primitives in numpy: blur, dark pixels, runs and components, openings, homographies and warps.

Images are grey levels (uint8, rows by columns), masks are boolean. Nothing here knows of Spark:
operators/scans.py calls it in Arrow batches, an image at a time.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from gradeloom.functions.pixels import otsu


def _kept(make):
    """Matrices of small images are made once in a worker; those of large ones are not held."""
    held = lru_cache(maxsize=64)(make)
    return lambda n, m: held(n, m) if max(n, m) <= 256 else make(n, m)


@_kept
def _gaussian(n: int, size: int) -> np.ndarray:
    """The matrix that blurs n values with an odd kernel of so many, mirrored at both ends (not twice the last)."""
    half = size // 2
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weight = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    weight /= weight.sum()
    at = np.abs(np.arange(n)[:, None] + np.arange(-half, half + 1))
    period = max(1, 2 * (n - 1))
    at = at % period
    at = np.where(at >= n, period - at, at)
    out = np.zeros((n, n))
    np.add.at(out, (np.repeat(np.arange(n), size), at.ravel()), np.tile(weight, n))
    return out


def blurred(gray: np.ndarray, size: int) -> np.ndarray:
    """A Gaussian blur of an odd kernel."""
    if size <= 7:
        half = size // 2
        weight = _gaussian(2 * size + 1, size)[size, half + 1 : half + 1 + size]
        side = np.pad(gray.astype(float), half, mode="reflect" if min(gray.shape) > half else "edge")
        side = sum(w * side[k : k + gray.shape[0]] for k, w in enumerate(weight))
        return sum(w * side[:, k : k + gray.shape[1]] for k, w in enumerate(weight))
    return _gaussian(gray.shape[0], size) @ gray.astype(float) @ _gaussian(gray.shape[1], size).T


def dark(gray: np.ndarray) -> np.ndarray:
    """Pixels on the dark side of Otsu's split, after a light blur."""
    soft = np.rint(blurred(gray, 5)).astype(np.uint8)
    return soft <= otsu(soft) if soft.min() < soft.max() else np.zeros(gray.shape, dtype=bool)


def sums(values: np.ndarray) -> np.ndarray:
    """A summed-area table with a row and a column of zeros before."""
    out = np.zeros((values.shape[0] + 1, values.shape[1] + 1), dtype=np.int64)
    out[1:, 1:] = values.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    return out


def box_sum(table: np.ndarray, y0, y1, x0, x1):
    """Sums over rows y0 to y1 and columns x0 to x1 (exclusive)."""
    return table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]


def _windows(mask: np.ndarray, height: int, width: int, flip: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the true pixels and all pixels of the window about it that lie on the image."""
    h, w = mask.shape
    up, left = (height // 2, width // 2) if not flip else (height - 1 - height // 2, width - 1 - width // 2)
    y0, x0 = np.maximum(0, np.arange(h) - up), np.maximum(0, np.arange(w) - left)
    y1, x1 = np.minimum(h, np.arange(h) - up + height), np.minimum(w, np.arange(w) - left + width)
    # sums of rows, then of columns: a window of one row or one column needs no table
    found = mask.astype(np.int32)
    if height > 1:
        table = np.zeros((h + 1, w), dtype=np.int32)
        np.cumsum(found, axis=0, out=table[1:])
        found = table[y1] - table[y0]
    if width > 1:
        table = np.zeros((h, w + 1), dtype=np.int32)
        np.cumsum(found, axis=1, out=table[:, 1:])
        found = table.take(x1, axis=1) - table.take(x0, axis=1)
    return found, (y1 - y0)[:, None] * (x1 - x0)


def eroded(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    found, all_ = _windows(mask, height, width, False)
    return found == all_


def dilated(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    return _windows(mask, height, width, True)[0] > 0


def opened(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """What a rectangle that lies within the mask (as far as it is on the image) can cover."""
    return dilated(eroded(mask, height, width), height, width)


def closed(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    return eroded(dilated(mask, height, width), height, width)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and end (exclusive) of each run of true pixels, in reading order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    return row, begin, np.nonzero(edge == -1)[1]


def components(mask: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The component of each run (0, 1, ... by its first run), eight neighbours connected; and the runs.

    A run meets those of the next row that begin not after its end and end not before its begin; the
    least run of each component is found by passing minima along the meetings and jumping pointers.
    """
    row, begin, end = runs(mask)
    n, wide = len(row), mask.shape[1] + 2
    low = np.searchsorted(row * wide + end, (row + 1) * wide + begin, side="left")
    high = np.searchsorted(row * wide + begin, (row + 1) * wide + end, side="right")
    many = np.maximum(0, high - low)
    a = np.repeat(np.arange(n), many)
    b = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        # the roots of both ends go to the lesser one
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        if (root == before).all():
            break
    return np.unique(root, return_inverse=True)[1] if n else np.zeros(0, dtype=int), (row, begin, end)


def measured(label: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each component: area, box (x0, y0, x1, y1, ends exclusive) and centre."""
    row, begin, end = found
    n = int(label.max()) + 1 if len(label) else 0
    length = (end - begin).astype(float)
    area = np.bincount(label, weights=length, minlength=n)
    box = {}
    for name, of, values, fill in (("x0", np.minimum, begin, 1 << 30), ("y0", np.minimum, row, 1 << 30), ("x1", np.maximum, end, 0), ("y1", np.maximum, row + 1, 0)):
        box[name] = np.full(n, fill)
        of.at(box[name], label, values)
    cx = np.bincount(label, weights=length * (begin + end - 1) / 2, minlength=n) / np.maximum(area, 1)
    cy = np.bincount(label, weights=length * row, minlength=n) / np.maximum(area, 1)
    return {"area": area.astype(int), "cx": cx, "cy": cy, **box}


def painted(shape: tuple[int, int], label: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], keep: np.ndarray) -> np.ndarray:
    """The mask of the components that are kept."""
    row, begin, end = (x[keep[label]] for x in found)
    edge = np.zeros((shape[0], shape[1] + 1), dtype=np.int32)
    np.add.at(edge, (row, begin), 1)
    np.add.at(edge, (row, end), -1)
    return edge.cumsum(axis=1)[:, :-1] > 0


def homography(source: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes the points to others, by the direct linear transform."""
    rows = []
    for (x, y), (u, v) in zip(source, to, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows, dtype=float))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def moved(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    p = np.column_stack([points, np.ones(len(points))]) @ matrix.T
    return p[:, :2] / p[:, 2:]


#: Pixels that are warped at once: what is made of them stays in a core's cache.
STRIP = 16384


def warped(gray: np.ndarray, matrix: np.ndarray, shape: tuple[int, int], fill: int = 255) -> np.ndarray:
    """The image under a homography: each pixel of the result is taken, bilinearly, from where it came from."""
    a = np.linalg.inv(matrix)
    h, width = gray.shape
    wide = width + 2
    side = np.pad(gray, 1, constant_values=fill).ravel()
    out = np.empty(shape, dtype=np.uint8)
    x = np.arange(shape[1], dtype=float)
    step = max(1, STRIP // max(1, shape[1]))
    for at in range(0, shape[0], step):
        y = np.arange(at, min(at + step, shape[0]), dtype=float)[:, None]
        w = a[2, 0] * x + a[2, 1] * y + a[2, 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            sx = (a[0, 0] * x + a[0, 1] * y + a[0, 2]) / w
            sy = (a[1, 0] * x + a[1, 1] * y + a[1, 2]) / w
        inside = (sx > -1) & (sy > -1) & (sx < width) & (sy < h)
        whole = inside.all()
        if not whole:
            sx, sy = np.where(inside, sx, 0.0), np.where(inside, sy, 0.0)
        ix, iy = np.floor(sx), np.floor(sy)
        fx, fy = sx - ix, sy - iy
        first = ((iy + 1) * wide + (ix + 1)).astype(np.int32 if side.size < 1 << 31 else np.int64)
        gx = 1 - fx
        top = side.take(first) * gx + side.take(first + 1) * fx
        first += wide
        below = side.take(first) * gx + side.take(first + 1) * fx
        told = top * (1 - fy) + below * fy
        if not whole:
            told = np.where(inside, told, fill)
        out[at : at + step] = np.rint(np.clip(told, 0, 255, out=told), out=told)
    return out


@_kept
def _resizing(n: int, m: int) -> np.ndarray:
    """The matrix that makes m values of n."""
    out = np.zeros((m, n))
    if m < n:
        edge = np.arange(m + 1) * n / m
        for i in range(m):
            first, last = int(edge[i]), int(np.ceil(edge[i + 1] - 1e-9))
            part = np.minimum(np.arange(first, last) + 1, edge[i + 1]) - np.maximum(np.arange(first, last), edge[i])
            out[i, first:last] = part / part.sum()
        return out
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(0, n - 2))
    out[np.arange(m), low] = 1 - (at - low)
    if n > 1:
        out[np.arange(m), low + 1] = at - low
    return out


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area means where it shrinks, bilinearly where it grows; pixel centres stay in proportion."""
    return np.rint(_resizing(gray.shape[0], height) @ gray.astype(float) @ _resizing(gray.shape[1], width).T).astype(np.uint8)
