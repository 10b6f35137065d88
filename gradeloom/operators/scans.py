"""Scanned pages: corner markers, alignment, ink, digit features and round trips.

The measuring is numpy (functions/images.py), an image at a time in Arrow batches; Spark deals the images.
A template says where a page's marks are, in millimetres: page (width, height), fiducials (a
centre for each corner), marker (side of their squares), orientation (x, y, size), bars (index to x, y,
width, height; the bar of a page's index is filled).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions import images as M
from gradeloom.functions import pixels
from gradeloom.operators import reading
from gradeloom.session import dealt

# Fixed values of the domain: what a marker's candidate is, how many are looked at, how far sizes and sides may differ.
LEAST_AREA, LEAST_SHARE, MOST_SHARE = 50.0, 0.00002, 0.02
ASPECT, INK = (0.72, 1.38), 0.55
STRONGEST, TRIED, SIZES = 160, 30, 1.60
QUAD_SHARE, QUAD_ASPECT, LEAST_SINE = 0.04, (0.55, 1.65), 0.5
INFERRED, INFERRED_BASE, BEYOND = 0.74, 1.25, 0.20
DARK, ORIENTED, BAR = 150, 0.35, 0.45
SHRINK_MARK, SHRINK_BAR = 0.72, 0.52
CORNERS = ("TL", "TR", "BR", "BL")


class ScanProblem(ValueError):
    """A page that cannot be aligned or told; its text says why."""


@dataclass
class Template:
    page: tuple[float, float] = (210.0, 297.0)
    fiducials: dict = field(default_factory=lambda: {"TL": (12.0, 12.0), "TR": (198.0, 12.0), "BR": (198.0, 285.0), "BL": (12.0, 285.0)})
    marker: float = 8.0
    orientation: tuple[float, float, float] = (27.0, 12.0, 4.5)
    bars: dict = field(default_factory=lambda: {i: (50.0 + 14.0 * i, 12.0, 10.0, 5.0) for i in range(1, 4)})

    def size(self, dpi: float) -> tuple[int, int]:
        """Height and width in pixels."""
        return round(self.page[1] * dpi / 25.4), round(self.page[0] * dpi / 25.4)

    def corners(self, dpi: float) -> np.ndarray:
        """The markers' centres in pixels, clockwise from the top left."""
        return np.array([self.fiducials[c] for c in CORNERS]) * dpi / 25.4

    @property
    def aspect(self) -> float:
        tl, tr, bl = (np.array(self.fiducials[c]) for c in ("TL", "TR", "BL"))
        return float(np.linalg.norm(tr - tl) / np.linalg.norm(bl - tl))


def _rectangle(page: np.ndarray, dpi: float, x: float, y: float, width: float, height: float, shade: int) -> None:
    k = dpi / 25.4
    # pixels whose centres lie within
    first, last = (lambda c, n: max(0, int(np.ceil((c - n / 2) * k)))), (lambda c, n: max(0, int(np.floor((c + n / 2) * k)) + 1))
    page[first(y, height) : last(y, height), first(x, width) : last(x, width)] = shade


def _disc(page: np.ndarray, cx: float, cy: float, r: float, shade: int, hollow: float = 0.0) -> None:
    """A disc, or a ring if it is hollow so far from the rim inwards."""
    y0, x0 = max(0, int(cy - r) - 1), max(0, int(cx - r) - 1)
    part = page[y0 : int(cy + r) + 3, x0 : int(cx + r) + 3]
    y, x = np.ogrid[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]]
    far = np.hypot(y - cy, x - cx)
    part[(far <= r) & ((far >= r - hollow) if hollow else True)] = shade


def drawn(template: Template, index: int, dpi: float) -> np.ndarray:
    """A page of the template with its markers and the bar of its index."""
    page = np.full(template.size(dpi), 255, dtype=np.uint8)
    for x, y in template.fiducials.values():
        _rectangle(page, dpi, x, y, template.marker, template.marker, 0)
    x, y, size = template.orientation
    _rectangle(page, dpi, x, y, size, size, 0)
    if index in template.bars:
        _rectangle(page, dpi, *template.bars[index], 0)
    return page


# Z21


def squares(gray: np.ndarray) -> pd.DataFrame:
    """Candidates for markers: cx, cy, side, area, ink: filled squares by size, shape and ink, the strongest of each place.

    Components of dark pixels; of two whose centres are nearer than 0.65 of the lesser side (or 4 pixels) the
    stronger (area times ink) stays.
    """
    mask = M.closed(M.dark(gray), 3, 3)
    m = M.measured(*M.components(mask))
    w, h = m["x1"] - m["x0"], m["y1"] - m["y0"]
    ink = M.box_sum(M.sums(mask), m["y0"], m["y1"], m["x0"], m["x1"]) / np.maximum(1, w * h)
    size = gray.shape[0] * gray.shape[1]
    fine = (m["area"] >= max(LEAST_AREA, size * LEAST_SHARE)) & (m["area"] <= size * MOST_SHARE)
    fine &= (w / np.maximum(1, h) >= ASPECT[0]) & (w / np.maximum(1, h) <= ASPECT[1]) & (ink >= INK)
    found = pd.DataFrame({"cx": m["cx"], "cy": m["cy"], "side": np.maximum(w, h).astype(float), "area": m["area"], "ink": ink})[fine]
    found = found.assign(strength=found["area"] * found["ink"]).sort_values(["strength", "cy", "cx"], ascending=[False, True, True], kind="stable").head(STRONGEST)
    kept: list[int] = []
    at, side = found[["cx", "cy"]].to_numpy(), found["side"].to_numpy()
    for i in range(len(found)):
        far = np.hypot(*(at[kept] - at[i]).T) if kept else np.zeros(0)
        if not (far < np.maximum(4.0, np.minimum(side[kept], side[i]) * 0.65)).any():
            kept.append(i)
    return found.iloc[kept[:TRIED]].drop(columns="strength").reset_index(drop=True)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _usable(quads: np.ndarray, template: Template, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which quads (n x 4 x 2) can be the markers', their areas and aspects: large, convex, of the template's shape or turned."""
    after = np.roll(quads, -1, axis=1)
    area = np.abs(_cross(quads, after).sum(axis=1)) / 2
    side = np.linalg.norm(after - quads, axis=2)
    # clockwise on the page, so none is a mirror image; a mark on the line between two markers is no corner
    bend = _cross(after - quads, np.roll(quads, -2, axis=1) - after) / np.maximum(side * np.roll(side, -1, axis=1), 1e-9)
    convex = (bend >= LEAST_SINE).all(axis=1)
    aspect = (side[:, 0] + side[:, 2]) / np.maximum(side[:, 1] + side[:, 3], 1e-9)
    want, low, high = template.aspect, *QUAD_ASPECT
    shaped = ((aspect >= want * low) & (aspect <= want * high)) | ((aspect >= low / want) & (aspect <= high / want))
    return (area >= size * QUAD_SHARE) & convex & shaped, area, aspect


def _alike(found: pd.DataFrame, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of candidates of about one size, and how much their sizes spread."""
    side = found["side"].to_numpy()[groups]
    return side.max(axis=1) / np.maximum(1.0, side.min(axis=1)) <= SIZES, side.std(axis=1) / np.maximum(1.0, side.mean(axis=1))


def four_corners(found: pd.DataFrame, shape: tuple[int, int], template: Template) -> tuple[np.ndarray, float] | None:
    """The best four candidates, clockwise, and a confidence."""
    groups = np.array(list(combinations(range(len(found)), 4)), dtype=int).reshape(-1, 4)
    fine, spread = _alike(found, groups)
    groups, spread = groups[fine], spread[fine]
    if not len(groups):
        return None
    quads = found[["cx", "cy"]].to_numpy()[groups]
    middle = quads - quads.mean(axis=1, keepdims=True)
    order = np.argsort(np.arctan2(middle[..., 1], middle[..., 0]), axis=1, kind="stable")
    quads = np.take_along_axis(quads, order[..., None], axis=1)
    usable, area, aspect = _usable(quads, template, float(shape[0] * shape[1]))
    score = area * found["ink"].to_numpy()[groups].min(axis=1) * (1 - np.minimum(spread, 0.9)) / (1 + np.abs(aspect - template.aspect))
    if not usable.any():
        return None
    best = int(np.argmax(np.where(usable, score, -1)))
    return quads[best], max(0.0, 1.0 - float(spread[best]))


def three_corners(found: pd.DataFrame, shape: tuple[int, int], template: Template) -> tuple[np.ndarray, float] | None:
    """The best three candidates with the fourth corner as in a parallelogram, and a lesser confidence."""
    groups = np.array(list(combinations(range(len(found)), 3)), dtype=int).reshape(-1, 3)
    fine, spread = _alike(found, groups)
    groups, spread = groups[fine], spread[fine]
    at, ink = found[["cx", "cy"]].to_numpy(), found["ink"].to_numpy()
    best: tuple[float, np.ndarray, float] | None = None
    far = max(shape) * BEYOND
    for missing in range(4):
        known = [k for k in range(4) if k != missing]
        for order in permutations(range(3)):
            quads = np.zeros((len(groups), 4, 2))
            for place, k in zip(known, order, strict=True):
                quads[:, place] = at[groups[:, k]]
            quads[:, missing] = quads[:, (missing + 1) % 4] + quads[:, (missing - 1) % 4] - quads[:, (missing + 2) % 4]
            new = quads[:, missing]
            near = (new >= -far).all(axis=1) & (new[:, 0] <= shape[1] + far) & (new[:, 1] <= shape[0] + far)
            usable, area, aspect = _usable(quads, template, float(shape[0] * shape[1]))
            score = area * ink[groups].min(axis=1) * INFERRED * (1 - np.minimum(spread, 0.9)) / (INFERRED_BASE + np.abs(aspect - template.aspect))
            score = np.where(usable & near, score, -1.0)
            if len(score) and score.max() > (best[0] if best else 0.0):
                i = int(np.argmax(score))
                best = float(score[i]), quads[i], float(spread[i])
    return None if best is None else (best[1], max(0.25, min(0.86, INFERRED * (1.0 - best[2]))))


def corners(gray: np.ndarray, template: Template) -> tuple[np.ndarray, float]:
    """The four corner markers, or three of them with the fourth inferred; else a problem."""
    found = squares(gray)
    if len(found) < 3:
        raise ScanProblem(f"only {len(found)} likely markers")
    quad = (four_corners(found, gray.shape, template) if len(found) >= 4 else None) or three_corners(found, gray.shape, template)
    if quad is None:
        raise ScanProblem("no reliable corner markers")
    return quad


# I5


def _inner(dpi: float, x: float, y: float, width: float, height: float, shrink: float) -> tuple[int, int, int, int]:
    """First and last (exclusive) column and row of a rectangle about a point, shrunk to its inner part."""
    k = dpi / 25.4
    cx, cy = round(x * k), round(y * k)
    half_w, half_h = max(1, round(width * k * shrink / 2)), max(1, round(height * k * shrink / 2))
    return max(0, cx - half_w), cx + half_w + 1, max(0, cy - half_h), cy + half_h + 1


def dark_share(gray: np.ndarray, dpi: float, x: float, y: float, width: float, height: float, shrink: float) -> float:
    """The share of pixels under 150 in the inner part of a rectangle."""
    x0, x1, y0, y1 = _inner(dpi, x, y, width, height, shrink)
    part = gray[y0:y1, x0:x1]
    return float((part < DARK).mean()) if part.size else 0.0


@dataclass
class Aligned:
    image: np.ndarray
    index: int
    turn: int
    confidence: float
    index_confidence: float
    corners: np.ndarray


def page_index(gray: np.ndarray, template: Template, dpi: float) -> tuple[int, float]:
    """The index whose bar alone is filled, and its lead; else a problem."""
    scores = {i: dark_share(gray, dpi, *bar, SHRINK_BAR) for i, bar in sorted(template.bars.items())}
    ranked = sorted(scores.values(), reverse=True)
    filled = [i for i, s in scores.items() if s >= BAR]
    if len(filled) != 1:
        raise ScanProblem(f"page bars are ambiguous: {scores}")
    return filled[0], max(0.0, ranked[0] - (ranked[1] if len(ranked) > 1 else 0.0))


def aligned(gray: np.ndarray, template: Template, dpi: float, index: int | None = None) -> Aligned:
    """The page as the template has it. Its markers are found, and of four ways to turn it the one
    counts that puts the orientation mark in its place. index: forced, else read from the bars.

    turn: quarters by which the scan is turned against the clock.
    """
    source, sure = corners(gray, template)
    to = template.corners(dpi)
    x0, x1, y0, y1 = _inner(dpi, *template.orientation, template.orientation[2], SHRINK_MARK)
    aside = np.array([[1.0, 0, -x0], [0, 1, -y0], [0, 0, 1]])
    # only the orientation mark's place is looked at in each of the four ways
    scores, ways = [], [np.roll(source, shift, axis=0) for shift in range(4)]
    for points in ways:
        part = M.warped(gray, aside @ M.homography(points, to), (y1 - y0, x1 - x0))
        scores.append(float((part < DARK).mean()))
    score, points = max(scores), ways[int(np.argmax(scores))]
    if score < ORIENTED:
        raise ScanProblem("orientation mark is unreadable")
    page = M.warped(gray, M.homography(points, to), template.size(dpi))
    over = points[1] - points[0]
    turn = int(-np.rint(np.arctan2(over[1], over[0]) / (np.pi / 2))) % 4
    told, lead = (index, 0.0) if index is not None else page_index(page, template, dpi)
    return Aligned(page, told, turn, min(sure, score), lead, points)


ALIGNED = "page_index int, turn int, confidence double, index_confidence double, corners array<array<double>>, problem string, image binary, height int, width int"


def align(scans: DataFrame, template: Template, dpi: float, image: bool = True, beside: tuple[str, ...] = ()) -> DataFrame:
    """I5 for scans (id, height, width, data: grey bytes): id, those beside, and ALIGNED; a page that can't be aligned has a problem and no image.

    Pages go out one by one, so a task never holds those of a batch; image: whether the aligned page goes on at all.
    """
    fields = {f.name: f.dataType.simpleString() for f in scans.select("id", *beside).schema.fields}
    kept = list(fields)
    names = [*kept, *(x.split()[0] for x in ALIGNED.split(", "))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                gray = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width)
                own = [getattr(row, c) for c in kept]
                try:
                    a = aligned(gray, template, dpi)
                    told = [a.index, a.turn, a.confidence, a.index_confidence, a.corners.tolist(), None, *((a.image.tobytes(), *a.image.shape) if image else (None, None, None))]
                except (ScanProblem, np.linalg.LinAlgError) as e:
                    told = [None, None, None, None, None, str(e) or type(e).__name__, None, None, None]
                yield pd.DataFrame([own + told], columns=names).astype(object).where(lambda d: d.notna(), None)

    types = [f"{name} {kind}" for name, kind in ({**fields, "id": "long"}).items()]
    return scans.select("id", "height", "width", "data", *beside).mapInPandas(run, ", ".join([*types, ALIGNED]))


# Z24


def flattened(gray: np.ndarray, least: int) -> np.ndarray:
    """The page divided by its blurred background: paper is white everywhere."""
    size = max(least, (min(gray.shape) // 2) | 1)
    background = np.maximum(np.rint(M.blurred(gray, size)), 1)
    return np.clip(np.rint(gray * 255.0 / background), 0, 255).astype(np.uint8)


def _filtered(ink: np.ndarray, least: float, wide: tuple[float, float, float], tall: tuple[float, float, float]) -> np.ndarray:
    """Without specks, and without lines that run through the whole patch."""
    label, found = M.components(ink)
    if not len(label):
        return ink
    m = M.measured(label, found)
    h, w = ink.shape
    across, down = m["x1"] - m["x0"], m["y1"] - m["y0"]
    keep = m["area"] >= least
    keep &= ~((across > wide[0] * w) & (down <= max(wide[1], h * wide[2])))
    keep &= ~((down > tall[0] * h) & (across <= max(tall[1], w * tall[2])))
    return M.closed(M.painted(ink.shape, label, found, keep), 2, 2)


def _rules(ink: np.ndarray, across: int, down: int) -> np.ndarray:
    return M.opened(ink, 1, across) | M.opened(ink, down, 1)


def student_ink(gray: np.ndarray) -> np.ndarray:
    """The handwriting on a written answer's crop: ink after flattening, without printed rules, specks and frames."""
    flat = flattened(gray, 17)
    low, high = int(flat.min()), int(flat.max())
    flat = np.rint((flat.astype(float) - low) * (255.0 / max(1, high - low))).astype(np.uint8)
    soft = np.rint(M.blurred(pixels.stretched(flat), 3)).astype(np.uint8)
    ink = soft <= pixels.otsu(soft) if soft.min() < soft.max() else np.zeros(gray.shape, dtype=bool)
    h, w = ink.shape
    ink &= ~M.dilated(_rules(ink, max(24, w // 5), max(12, h // 2)), 2, 2)
    if h >= 8 and w >= 8:
        ink &= ~M.dilated(_rules(ink, max(40, w // 9), max(12, h // 2)), 3, 3)
    return _filtered(ink, max(8, round(ink.size * 0.00018)), (0.92, 4, 0.10), (0.88, 4, 0.02))


# Z25

CANVAS, INNER, LEAST_INK = 28, 20, 0.003


def digit_feature(gray: np.ndarray) -> tuple[np.ndarray, float]:
    """A digit cell as CANVAS x CANVAS shares of ink, upright and fitted, and its share of ink; zeros if it is blank."""
    h, w = gray.shape
    if h >= 8 and w >= 8:
        y, x = max(1, round(h * 0.08)), max(1, round(w * 0.08))
        gray = gray[y : h - y, x : w - x]
    blank = np.zeros((CANVAS, CANVAS))
    if not gray.size:
        return blank, 0.0
    scale = 4 if max(gray.shape) < 96 else 2
    flat = flattened(M.resized(gray, gray.shape[0] * scale, gray.shape[1] * scale), 15)
    soft = np.rint(M.blurred(flat, 3)).astype(np.uint8)
    local = soft.astype(float) <= np.rint(M.blurred(soft, 31)) - 9
    split = soft <= pixels.otsu(soft) if soft.min() < soft.max() else np.zeros(soft.shape, dtype=bool)
    # a split of paper alone is no ink
    ink = local | (split if int(soft.max()) - int(soft.min()) > 40 else False)
    h, w = ink.shape
    edge = max(3, round(min(h, w) * 0.18))
    rim = np.ones(ink.shape, dtype=bool)
    rim[edge : h - edge, edge : w - edge] = False
    ink &= ~(_rules(ink, max(12, w // 2), max(12, h // 2)) & rim)
    ink = _filtered(ink, max(6, round(ink.size * 0.0015)), (0.82, 3, 0.08), (0.82, 3, 0.08))
    share = float(ink.mean())
    if share < LEAST_INK:
        return blank, share
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    glyph = ink[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    fit = INNER / max(glyph.shape)
    new_h, new_w = max(1, round(glyph.shape[0] * fit)), max(1, round(glyph.shape[1] * fit))
    canvas = np.zeros((CANVAS, CANVAS), dtype=np.uint8)
    y0, x0 = (CANVAS - new_h) // 2, (CANVAS - new_w) // 2
    canvas[y0 : y0 + new_h, x0 : x0 + new_w] = M.resized(glyph.astype(np.uint8) * 255, new_h, new_w)
    return upright(canvas) / 255.0, share


def upright(canvas: np.ndarray) -> np.ndarray:
    """A glyph sheared so that its second moments have no slant."""
    total = canvas.sum(dtype=float)
    if not total:
        return canvas
    y, x = np.mgrid[: canvas.shape[0], : canvas.shape[1]].astype(float)
    cy, cx = (canvas * y).sum() / total, (canvas * x).sum() / total
    mu02, mu11 = (canvas * (y - cy) ** 2).sum(), (canvas * (y - cy) * (x - cx)).sum()
    if abs(mu02) < 1e-2:
        return canvas
    skew = mu11 / mu02
    # a row at distance d from the middle goes back by skew * d
    middle = canvas.shape[0] / 2
    return M.warped(canvas, np.array([[1.0, -skew, skew * middle], [0, 1, 0], [0, 0, 1]]), canvas.shape, fill=0)


@F.pandas_udf(T.StructType([T.StructField("feature", T.ArrayType(T.DoubleType())), T.StructField("ink", T.DoubleType())]))
def measure_digit(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = [digit_feature(pixels._image(d, int(h), int(w))) for d, h, w in zip(data, height, width, strict=True)]
    return pd.DataFrame({"feature": [f.ravel().tolist() for f, _ in out], "ink": [s for _, s in out]})


@F.pandas_udf(T.BinaryType())
def isolate_ink(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """The crop with the student's ink black and all else white, as bytes."""
    return pd.Series([np.where(student_ink(pixels._image(d, int(h), int(w))), 0, 255).astype(np.uint8).tobytes() for d, h, w in zip(data, height, width, strict=True)])


# I11


#: A printed bubble's radius, and that of the part inside its outline which is measured, in millimetres.
PRINTED, SAMPLED = 1.75, 1.26


def simulated(bubbles: DataFrame, dpi: float, coverage: float, shade: int, page: tuple[float, float] = (210.0, 297.0)) -> DataFrame:
    """Sheet, page, q_no, option, chosen, fill, ink, enhanced: template rows printed, filled in and measured.

    bubbles: sheet, page, q_no, option, x_mm, y_mm, chosen. A page is drawn in a task from its rows, outlines
    first, then the chosen bubbles with a disc of so much of their measured area in the shade; each is measured there.
    """
    height, width = round(page[1] * dpi / 25.4), round(page[0] * dpi / 25.4)
    k = dpi / 25.4

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        gray = np.full((height, width), 255, dtype=np.uint8)
        r = SAMPLED * k
        at = [(int(round(x * k)), int(round(y * k))) for x, y in zip(rows.x_mm, rows.y_mm, strict=True)]
        for x, y in at:
            _disc(gray, x, y, PRINTED * k, 0, hollow=max(1.0, 0.1 * k))
        for (x, y), chosen in zip(at, rows.chosen, strict=True):
            if chosen:
                # a pen colours the pixels that it touches to half
                _disc(gray, x, y, r * coverage**0.5 + 0.5, shade)
        told = pixels.measured_discs(gray, at, max(1, round(r)))
        return pd.concat([rows[["sheet", "page", "q_no", "option", "chosen"]].reset_index(drop=True), pd.DataFrame(told, columns=["fill", "ink", "enhanced"])], axis=1)

    # a page is much work on few bytes
    pages = dealt(bubbles, "sheet", "page", each=4096)
    return pages.groupBy("sheet", "page").applyInPandas(run, "sheet long, page int, q_no long, option string, chosen boolean, fill double, ink double, enhanced double")


def round_trip(bubbles: DataFrame, dpi: float = 200.0, coverage: float = 0.8, shade: int = 25) -> DataFrame:
    """Sheet, questions, recovered, flagged, least_filled, most_empty: what the reader (B3) makes of the simulated sheets."""
    # read twice, drawn once
    seen = simulated(bubbles, dpi, coverage, shade).persist()
    read = reading.read_mcq(seen, ["sheet", "q_no"])
    want = bubbles.where("chosen").select("sheet", "q_no", F.col("option").alias("want"))
    told = read.join(want, ["sheet", "q_no"], "left")
    right = F.coalesce((F.col("outcome") == "answered") & (F.col("selected") == F.col("want")), F.lit(False))
    by_sheet = told.groupBy("sheet").agg(F.count("*").alias("questions"), F.count_if(right).alias("recovered"), F.count_if("needs_review").alias("flagged"))
    gap = seen.groupBy("sheet").agg(F.min(F.when(F.col("chosen"), F.col("fill"))).alias("least_filled"), F.max(F.when(~F.col("chosen"), F.col("fill"))).alias("most_empty"))
    return by_sheet.join(gap, "sheet")
