"""Scans: image primitives against plain loops, pages warped by known matrices, ink and digits, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import images as M
from gradeloom.functions import pixels
from gradeloom.operators import scans as P
from gradeloom.plans import q_scans as Q


def flood(mask):
    """Components by flooding, eight neighbours."""
    label, n = np.full(mask.shape, -1), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x] < 0:
            todo = [(y, x)]
            label[y, x] = n
            while todo:
                a, b = todo.pop()
                for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[c, d] and label[c, d] < 0:
                            label[c, d] = n
                            todo.append((c, d))
            n += 1
    return label, n


@pytest.mark.parametrize("share", [0.0, 0.2, 0.4, 0.6, 1.0])
def test_components_are_those_of_flooding(share):
    random = np.random.default_rng(int(share * 10))
    for _ in range(6):
        mask = random.random((random.integers(1, 30), random.integers(1, 40))) < share
        want, n = flood(mask)
        label, found = M.components(mask)
        m = M.measured(label, found)
        assert len(m["area"]) == n
        got = np.full(mask.shape, -1)
        for k, row, begin, end in zip(label, *found):
            got[row, begin:end] = k
        pairs = set(zip(want[mask], got[mask]))
        assert len(pairs) == n
        for a, b in pairs:
            ys, xs = np.nonzero(want == a)
            assert (m["area"][b], m["x0"][b], m["y0"][b], m["x1"][b], m["y1"][b]) == (len(ys), xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)
            assert (m["cx"][b], m["cy"][b]) == pytest.approx((xs.mean(), ys.mean()))
        keep = np.arange(n) % 2 == 0
        assert (M.painted(mask.shape, label, found, keep) == (mask & (got % 2 == 0) & (got >= 0))).all()


def test_openings_are_what_rectangles_cover():
    random = np.random.default_rng(3)
    for height, width in [(1, 5), (4, 1), (3, 3), (2, 2)]:
        mask = random.random((20, 24)) < 0.75
        big = np.pad(mask, 10, constant_values=True)
        want = np.zeros(big.shape, dtype=bool)
        for y in range(big.shape[0] - height + 1):
            for x in range(big.shape[1] - width + 1):
                if big[y : y + height, x : x + width].all():
                    want[y : y + height, x : x + width] = True
        inner = M.opened(mask, height, width)
        # away from the rim both are the same
        assert (inner == want[10:-10, 10:-10])[5:-5, 5:-5].all()
        assert not (inner & ~mask).any()
        assert (M.closed(mask, 3, 3) >= mask).all()


def test_blur_is_the_plain_sum_mirrored_at_the_rim():
    random = np.random.default_rng(4)
    gray = random.integers(0, 256, (17, 23)).astype(np.uint8)
    for size in (3, 5, 9):
        half, sigma = size // 2, 0.3 * ((size - 1) * 0.5 - 1) + 0.8
        w = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
        w /= w.sum()
        side = np.pad(gray.astype(float), half, mode="reflect")
        want = [[(np.outer(w, w) * side[y : y + size, x : x + size]).sum() for x in range(23)] for y in range(17)]
        assert np.allclose(M.blurred(gray, size), want)


def test_homography_and_warp():
    random = np.random.default_rng(5)
    for _ in range(20):
        source = np.array([[0, 0], [50, 0], [50, 70], [0, 70]]) + random.uniform(-8, 8, (4, 2))
        to = np.array([[0, 0], [60, 0], [60, 60], [0, 60]]) + random.uniform(-8, 8, (4, 2))
        matrix = M.homography(source, to)
        assert np.allclose(M.moved(source, matrix), to)
    gray = random.integers(0, 256, (30, 40)).astype(np.uint8)
    assert (M.warped(gray, np.eye(3), gray.shape) == gray).all()
    shift = np.array([[1, 0, 3], [0, 1, 2], [0, 0, 1.0]])
    assert (M.warped(gray, shift, gray.shape)[2:, 3:] == gray[:-2, :-3]).all()
    half = M.warped(gray, np.array([[1, 0, 0.5], [0, 1, 0], [0, 0, 1.0]]), gray.shape).astype(int)
    assert np.abs(half[:, 1:] - (gray[:, 1:].astype(int) + gray[:, :-1]) / 2).max() <= 0.5
    assert M.resized(gray, 30, 40).tolist() == gray.tolist()
    assert M.resized(np.full((9, 7), 80, dtype=np.uint8), 4, 20).tolist() == np.full((4, 20), 80).tolist()


@pytest.mark.parametrize("key", [1, 2, 3, 4, 5, 6, 7, 8, 11, 22, 33])
def test_pages_are_found_turned_and_told(key):
    scan, truth = Q.photographed(key)
    got = P.aligned(scan, Q.TEMPLATE, Q.DPI)
    far = np.hypot(*(got.corners - truth).T)
    assert far[[0, 1, 3] if key % 11 == 0 else [0, 1, 2, 3]].max() < 1.5
    assert (got.index, got.turn) == (key % 3 + 1, key % 4)
    if key % 11:
        assert np.abs(got.image.astype(int) - P.drawn(Q.TEMPLATE, key % 3 + 1, Q.DPI)).mean() < 6
    assert P.aligned(scan, Q.TEMPLATE, Q.DPI, index=9).index == 9


def test_markers_on_a_flat_page_to_the_pixel():
    page = P.drawn(Q.TEMPLATE, 2, Q.DPI)
    found = P.squares(page)
    want = Q.TEMPLATE.corners(Q.DPI)
    for x, y in want:
        assert np.hypot(found.cx - x, found.cy - y).min() <= 1.0
    # a large blot and text are no markers
    page[200:420, 100:300] = 0
    for y in range(450, 600, 12):
        page[y : y + 3, 60:300:2] = 30
    assert np.hypot(*(P.corners(page, Q.TEMPLATE)[0] - want).T).max() <= 1.0


def test_what_cannot_be_aligned_says_why(spark):
    with pytest.raises(P.ScanProblem, match="likely markers"):
        P.aligned(np.full((300, 200), 255, dtype=np.uint8), Q.TEMPLATE, Q.DPI)
    page = P.drawn(Q.TEMPLATE, 7, Q.DPI)
    with pytest.raises(P.ScanProblem, match="ambiguous"):
        P.aligned(page, Q.TEMPLATE, Q.DPI)
    plain = P.drawn(Q.TEMPLATE, 1, Q.DPI)
    y, x = (round(v * Q.DPI / 25.4) for v in (12, 27))
    plain[y - 12 : y + 12, x - 10 : x + 10] = 255
    with pytest.raises(P.ScanProblem, match="orientation"):
        P.aligned(plain, Q.TEMPLATE, Q.DPI)
    rows = [(1, *page.shape, bytearray(page.tobytes())), (2, *plain.shape, bytearray(P.drawn(Q.TEMPLATE, 1, Q.DPI).tobytes()))]
    got = {r.id: r for r in P.align(spark.createDataFrame(rows, "id long, height int, width int, data binary"), Q.TEMPLATE, Q.DPI).collect()}
    assert "ambiguous" in got[1].problem and got[1].image is None and got[1].page_index is None
    assert got[2].problem is None and got[2].page_index == 1 and len(got[2].image) == got[2].height * got[2].width


def test_ink_keeps_strokes_and_drops_rules():
    shares = []
    for key in range(12):
        gray, ink, rules = Q.answer(key)
        found = P.student_ink(gray)
        shares.append((found[ink & ~M.dilated(rules, 9, 9)].mean(), found[rules & ~M.dilated(ink, 5, 5)].mean()))
    kept, left = np.mean(shares, axis=0)
    assert kept > 0.75 and left < 0.05
    assert not P.student_ink(np.full((60, 200), 230, dtype=np.uint8)).any()
    assert P.student_ink(np.full((3, 3), 0, dtype=np.uint8)).shape == (3, 3)


def test_digit_features():
    one, share = P.digit_feature(Q.digit_cell(8))
    assert one.shape == (28, 28) and 0.02 < share < 0.5
    ys, xs = np.nonzero(one > 0.5)
    assert max(ys.max() - ys.min(), xs.max() - xs.min()) in range(17, 22)
    assert abs(ys.mean() - 13.5) < 2 and abs(xs.mean() - 13.5) < 2
    for blank in (np.full((56, 48), 240, dtype=np.uint8), np.zeros((0, 0), dtype=np.uint8)):
        feature, share = P.digit_feature(blank)
        assert not feature.any() and share < P.LEAST_INK
    # a slanted bar stands upright
    bar = np.zeros((28, 28), dtype=np.uint8)
    for y in range(4, 24):
        bar[y, 9 + y // 3 : 12 + y // 3] = 255
    up = P.upright(bar)
    centre = lambda g, y: (g[y] * np.arange(28.0)).sum() / g[y].sum()
    assert abs(centre(bar, 5) - centre(bar, 22)) > 4 and abs(centre(up, 6) - centre(up, 21)) < 1.5
    features = np.array([P.digit_feature(Q.digit_cell(k))[0].ravel() for k in range(200)])
    far = ((features[:, None] - features[None]) ** 2).sum(axis=2) + np.diag(np.full(200, 1e9))
    assert np.mean(far.argmin(axis=1) % 10 == np.arange(200) % 10) >= 0.95


@pytest.mark.parametrize(("coverage", "shade", "recovered", "flagged"), [(0.8, 25, 20, 0), (0.45, 110, 20, None), (0.3, 160, 0, 20)])
def test_round_trips_of_twenty_questions(spark, coverage, shade, recovered, flagged):
    rows = [(1, 1 + q // 12, q, "ABCD"[o], 30.0 + 70 * (q % 2) + 8 * o, 60.0 + 9.0 * (q % 12), o == q * 7 % 4) for q in range(20) for o in range(4)]
    sheet = spark.createDataFrame(rows, "sheet long, page int, q_no long, option string, x_mm double, y_mm double, chosen boolean")
    got = P.round_trip(sheet, coverage=coverage, shade=shade).collect()[0]
    assert (got.questions, got.recovered) == (20, recovered)
    assert flagged is None or got.flagged == flagged
    if coverage == 0.8:
        assert got.least_filled - got.most_empty > 0.7
    assert P.round_trip(sheet.where(F.lit(False))).collect() == []


def test_a_mark_between_two_markers_is_no_corner():
    # of this page the lower right marker is hidden, and the orientation mark is nearly as large as the markers
    gray, truth = Q.photographed(4136)
    found = P.aligned(gray, Q.TEMPLATE, Q.DPI)
    assert (found.index, found.turn) == (4136 % 3 + 1, 0)
    assert np.hypot(*(found.corners - truth)[[0, 1, 3]].T).max() <= 1.5


def test_discs_at_once_are_as_one_by_one():
    random = np.random.default_rng(4)
    for _ in range(6):
        gray = np.full((200, 160), 255, dtype=np.uint8)
        at = [(int(random.integers(0, 160)), int(random.integers(0, 200))) for _ in range(60)] + [(-40, 20), (5, 5)]
        for x, y in at[::2]:
            P._disc(gray, x, y, random.uniform(3, 12), int(random.integers(0, 230)), hollow=float(random.choice([0.0, 2.0])))
        if random.integers(2):
            gray = np.clip(gray.astype(int) - random.integers(0, 60, gray.shape), 0, 255).astype(np.uint8)
        strong, r = pixels.stretched(gray), int(random.integers(2, 11))
        assert (pixels._levels(gray)[gray] == strong).all()
        want = [(*pixels.fill_and_ink(gray, x, y, r), max(pixels.against_paper(gray, x, y, r), pixels.against_paper(strong, x, y, r))) for x, y in at]
        assert pixels.measured_discs(gray, at, r) == want
    assert (pixels._levels(np.full((5, 5), 7, dtype=np.uint8)) == np.arange(256)).all()


def test_pages_to_be_drawn_are_dealt_to_tasks(spark):
    rows = spark.range(12000).select(F.lit(1).cast("long").alias("sheet"), F.floor(F.col("id") / 240).cast("int").alias("page"), F.col("id").alias("q_no"), F.lit("A").alias("option"), F.lit(20.0).alias("x_mm"), F.lit(20.0).alias("y_mm"), F.lit(True).alias("chosen"))
    assert P.simulated(rows, 20.0, 0.8, 25).rdd.getNumPartitions() == 3


def test_photos_are_neither_kept_nor_met_again(spark, sf):
    plan = Q.Q["page_alignment"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "Join" not in plan
    scan, at = Q.photographed(5)
    rows = spark.createDataFrame([(5, *scan.shape, scan.tobytes(), "x")], "id long, height int, width int, data binary, note string")
    got = P.align(rows, Q.TEMPLATE, Q.DPI, image=False, beside=("note",)).first()
    assert (got.id, got.note, got.page_index, got.image, got.height) == (5, "x", 3, None, None)
    assert np.hypot(*(np.array(got.corners) - at).T).max() < 1.5
    assert P.align(rows, Q.TEMPLATE, Q.DPI).first().image is not None
