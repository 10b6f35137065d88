"""Preflight of sheets before they are printed (I10): nine checks, of rendered pages and of the template's marks.

marks: sheet, page, kind, name, x_mm, y_mm (centres; of a box its upper left corner), w_mm, h_mm, extra. Kinds: bubble,
fiducial (name: its corner), orientation (name: the corner that it marks), bar (extra: the page it stands for),
box (extra: its lines). pages: sheet, page, height, width, data (grey bytes). A page's pixels and marks meet in a
cogroup; what needs no pixels is relational. A failed check is a row; a sheet without rows can be printed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import images as M
from gradeloom.functions import pixels
from gradeloom.operators.release import crowded
from gradeloom.operators.scans import PRINTED, SAMPLED

# Fixed values of the domain.
WHITE, MOST_EMPTY, LEAST_SOLID = 250, 0.05, 0.98
MARKERS, QUIET = ("fiducial", "orientation"), 3.5
BAR_DARK, LEAST_CONTRAST, LEAST_GAP, RULE = 0.5, 0.50, 1.5, 0.8
MARKS = "sheet long, page int, kind string, name string, x_mm double, y_mm double, w_mm double, h_mm double, extra int"
ISSUES = "sheet long, page int, check string, severity string, name string, value double"


def _darkest_around(gray: np.ndarray, m, keepout: float, k: float) -> int:
    """The darkest pixel about a mark, the mark and its fringe of two pixels left out."""
    y0, y1, x0, x1 = (max(0, round(v * k)) for v in (m.y_mm - keepout, m.y_mm + keepout, m.x_mm - keepout, m.x_mm + keepout))
    part = gray[y0:y1, x0:x1].copy()
    if not part.size:
        return 255
    size = int(np.ceil(m.w_mm * k)) + 4
    top, left = (int(np.floor((c - m.w_mm / 2) * k)) - 2 for c in (m.y_mm, m.x_mm))
    part[max(0, top - y0) : max(0, top + size - y0), max(0, left - x0) : max(0, left + size - x0)] = 255
    return int(part.min())


def _bubbles_empty(gray: np.ndarray, marks: pd.DataFrame, k: float) -> list[tuple]:
    r = max(1, round(SAMPLED * k))
    shares = [(pixels.fill_and_ink(gray, round(m.x_mm * k), round(m.y_mm * k), r)[0], m.name_) for m in marks[marks.kind == "bubble"].itertuples()]
    worst = max(shares, default=(0.0, ""))
    return [("bubbles print empty", "error", worst[1], worst[0])] if worst[0] > MOST_EMPTY else []


def _quiet_and_solid(gray: np.ndarray, marks: pd.DataFrame, k: float) -> list[tuple]:
    some = [m for m in marks.itertuples() if m.kind in MARKERS]
    dark = min(((_darkest_around(gray, m, m.w_mm / 2 + QUIET, k), m.name_) for m in some), default=(255, ""))
    solid = min(((pixels.fill_and_ink(gray, round(m.x_mm * k), round(m.y_mm * k), max(1, round(m.w_mm / 2 * k * 0.6)))[0], m.name_) for m in some), default=(1.0, ""))
    return [*([("quiet zone", "error", dark[1], float(dark[0]))] if dark[0] < WHITE else []), *([("marker solid", "error", solid[1], solid[0])] if solid[0] < LEAST_SOLID else [])]


def _safe_margin(gray: np.ndarray, k: float, margin: float) -> list[tuple]:
    ink = gray < WHITE
    rows, columns = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    if not len(rows):
        return []
    clear = min((rows[0] / k, "top"), ((gray.shape[0] - 1 - rows[-1]) / k, "bottom"), (columns[0] / k, "left"), ((gray.shape[1] - 1 - columns[-1]) / k, "right"))
    return [("safe margin", "error", clear[1], float(clear[0]))] if clear[0] < margin else []


def _page_bars(gray: np.ndarray, marks: pd.DataFrame, k: float, page: int) -> list[tuple]:
    bars = marks[marks.kind == "bar"]
    if not len(bars):
        return []
    ink = {m.extra: pixels.fill_and_ink(gray, round(m.x_mm * k), round(m.y_mm * k), max(1, round(m.h_mm / 2 * k) - 2))[1] for m in bars.itertuples()}
    dark = [i for i, v in sorted(ink.items()) if v > BAR_DARK]
    if dark != [page]:
        return [("page index", "error", ",".join(map(str, dark)), float(len(dark)))]
    lead = ink[page] - max((v for i, v in ink.items() if i != page), default=0.0)
    return [("page index", "warning", str(page), float(lead))] if lead < LEAST_CONTRAST else []


def _boxes_clean(gray: np.ndarray, marks: pd.DataFrame, k: float) -> list[tuple]:
    """What is left of an answer's box without its border and its writing rules has to be paper."""
    pad, worst = max(2, round(RULE * k)), (255, "")
    for m in marks[marks.kind == "box"].itertuples():
        y0, x0 = round(m.y_mm * k), round(m.x_mm * k)
        part = gray[max(0, y0) : y0 + max(1, round(m.h_mm * k)) + 1, max(0, x0) : x0 + max(1, round(m.w_mm * k)) + 1].copy()
        if not part.size:
            continue
        part[:pad], part[-pad:], part[:, :pad], part[:, -pad:] = 255, 255, 255, 255
        for i in range(1, int(m.extra)):
            at = round(i * m.h_mm / m.extra * k)
            part[max(0, at - pad) : at + pad] = 255
        worst = min(worst, (int(part.min()), m.name_))
    return [("answer box blank", "error", worst[1], float(worst[0]))] if worst[0] < WHITE else []


def _tasks(marks: DataFrame) -> int:
    """Tasks of about 64 pages: a page is a megabyte when it is drawn, but few bytes as marks or compressed."""
    return max(1, -(-marks.count() // 2304))


def pixel_issues(marks: DataFrame, pages: DataFrame, dpi: float, margin: float) -> DataFrame:
    """The six checks that look at pixels, each page's worst place."""
    k = dpi / 25.4

    def run(key: tuple, m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        m = m.rename(columns={"name": "name_"})
        for row in p.itertuples():
            gray = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width)
            out += [*_bubbles_empty(gray, m, k), *_quiet_and_solid(gray, m, k), *_safe_margin(gray, k, margin), *_page_bars(gray, m, k, int(key[1])), *_boxes_clean(gray, m, k)]
        return pd.DataFrame([(key[0], key[1], *x) for x in out], columns=["sheet", "page", "check", "severity", "name", "value"])

    n = _tasks(marks)
    marks, pages = (x.repartition(n, "sheet", "page") for x in (marks, pages))
    return marks.groupBy("sheet", "page").cogroup(pages.groupBy("sheet", "page")).applyInPandas(run, ISSUES)


def orientation_issues(marks: DataFrame) -> DataFrame:
    """A page has one orientation mark, nearest to the corner that it marks, and clearly so."""
    is_mark, is_corner = F.col("kind") == "orientation", F.col("kind") == "fiducial"
    place = F.struct("name", "x_mm", "y_mm")
    # one aggregation by page: nothing is joined, so nothing is for the driver to hold
    told = marks.groupBy("sheet", "page").agg(F.count_if(is_mark).alias("n"), F.first(F.when(is_mark, place), ignorenulls=True).alias("o"), F.collect_list(F.when(is_corner, place)).alias("corners"))
    far = lambda c: F.hypot(c["x_mm"] - F.col("o.x_mm"), c["y_mm"] - F.col("o.y_mm"))
    by = F.array_sort(F.transform("corners", lambda c: F.struct(far(c).alias("far"), c["name"].alias("corner"))))
    j = told.select("sheet", "page", "n", F.col("o.name").alias("marks"), F.when(F.col("n") > 0, by).alias("by"))
    nearest, second = F.get("by", F.lit(0)), F.get("by", F.lit(1))
    error = (F.col("n") != 1) | ~nearest["corner"].eqNullSafe(F.col("marks"))
    severity = F.when(error, "error").when(nearest["far"] > second["far"] / 2, "warning")
    return j.where(severity.isNotNull()).select("sheet", "page", F.lit("orientation").alias("check"), severity.alias("severity"), nearest["corner"].alias("name"), F.col("n").cast("double").alias("value"))


def crowding_issues(marks: DataFrame) -> DataFrame:
    """Sampled discs that overlap (error) or have less than the least gap between them (warning)."""
    points = marks.where("kind = 'bubble'").select(F.struct("sheet", "page").alias("page"), F.col("name").alias("id"), F.col("x_mm").alias("x"), F.col("y_mm").alias("y"))
    pairs = crowded(points, SAMPLED, LEAST_GAP)
    worst = pairs.groupBy("page").agg(F.max(F.when(F.col("kind") == "overlap", 1).otherwise(0)).alias("overlap"), F.min(F.concat_ws("/", "a", "b")).alias("name"), F.count("*").alias("n"))
    return worst.select("page.sheet", "page.page", F.lit("bubble spacing").alias("check"), F.when(F.col("overlap") == 1, "error").otherwise("warning").alias("severity"), "name", F.col("n").cast("double").alias("value"))


def bounds_issues(marks: DataFrame, width: float, height: float) -> DataFrame:
    """Bubbles with their outline, and answer boxes, lie on the page."""
    off = F.when(F.col("kind") == "bubble", ~(F.col("x_mm").between(PRINTED, width - PRINTED) & F.col("y_mm").between(PRINTED, height - PRINTED))).when(F.col("kind") == "box", (F.col("x_mm") + F.col("w_mm") > width + 1e-6) | (F.col("y_mm") + F.col("h_mm") > height + 1e-6))
    found = marks.where(F.coalesce(off, F.lit(False))).groupBy("sheet", "page").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    return found.select("sheet", "page", F.lit("page bounds").alias("check"), F.lit("error").alias("severity"), "name", F.col("n").cast("double").alias("value"))


def preflight(marks: DataFrame, pages: DataFrame, dpi: float, width: float = 210.0, height: float = 297.0, margin: float = 5.0) -> DataFrame:
    """ISSUES of all nine checks."""
    return pixel_issues(marks, pages, dpi, margin).unionByName(orientation_issues(marks)).unionByName(crowding_issues(marks)).unionByName(bounds_issues(marks, width, height))


def printed(marks: DataFrame, dpi: float, width: float = 210.0, height: float = 297.0) -> DataFrame:
    """Pages as their marks print: sheet, page, height, width, data. Squares are filled, bubbles and boxes outlined, and of the bars the page's own is filled."""
    k, size = dpi / 25.4, (round(height * dpi / 25.4), round(width * dpi / 25.4))

    def run(key: tuple, m: pd.DataFrame) -> pd.DataFrame:
        gray = np.full(size, 255, dtype=np.uint8)

        def box(x: float, y: float, w: float, h: float, filled: bool) -> None:
            y0, y1, x0, x1 = (max(0, round(v * k)) for v in (y - h / 2, y + h / 2, x - w / 2, x + w / 2))
            inner = gray[y0 + 1 : y1 - 1, x0 + 1 : x1 - 1].copy()
            gray[y0:y1, x0:x1] = 0
            if not filled:
                gray[y0 + 1 : y1 - 1, x0 + 1 : x1 - 1] = inner

        for row in m.itertuples():
            if row.kind in MARKERS:
                box(row.x_mm, row.y_mm, row.w_mm, row.h_mm, True)
            elif row.kind == "bar":
                box(row.x_mm, row.y_mm, row.w_mm, row.h_mm, row.extra == key[1])
            elif row.kind == "box":
                box(row.x_mm + row.w_mm / 2, row.y_mm + row.h_mm / 2, row.w_mm, row.h_mm, False)
                for i in range(1, int(row.extra)):
                    at, x0 = round((row.y_mm + i * row.h_mm / row.extra) * k), max(0, round(row.x_mm * k))
                    gray[at : at + 1, x0 : round((row.x_mm + row.w_mm) * k)] = 150
            else:
                cx, cy, r = round(row.x_mm * k), round(row.y_mm * k), PRINTED * k
                y0, x0 = max(0, int(cy - r) - 1), max(0, int(cx - r) - 1)
                part = gray[y0 : max(0, int(cy + r) + 2), x0 : max(0, int(cx + r) + 2)]
                y, x = np.ogrid[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]]
                far = np.hypot(y - cy, x - cx)
                part[(far <= r) & (far > r - 1)] = 0
        return pd.DataFrame({"sheet": [key[0]], "page": [key[1]], "height": [size[0]], "width": [size[1]], "data": [gray.tobytes()]})

    return marks.repartition(_tasks(marks), "sheet", "page").groupBy("sheet", "page").applyInPandas(run, "sheet long, page int, height int, width int, data binary")
