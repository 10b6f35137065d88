"""Queries on pixels, matching, streams, models and plug-ins, and on nested evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import schemas
from gradeloom.functions import pixels
from gradeloom.operators import evaluation as E
from gradeloom.operators import matching as M
from gradeloom.plans import adapters as A
from gradeloom.session import dealt
from gradeloom.sources.files import pseudonymised
from gradeloom.streaming import logs

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("evidence_flatten", A.sql("pages", "SELECT source_index, cell_roll, floor(cell_min * 100 + 0.5) / 100 AS cell_min, CASE WHEN sheet_page = 1 THEN bubble_roll END AS bubble_roll, 2 AS n_cells, selector_state FROM pages"))
def _(spark, d):
    p = A.pages(spark, d)
    cell = lambda x: F.struct(F.substring("cell_roll", 1, 1).alias("digit"), x.alias("p"), F.create_map(F.substring("cell_roll", 1, 1), x).alias("probs"))
    payload = F.to_json(F.struct(F.col("cell_roll").alias("text"), F.col("cell_min").alias("confidence"), F.array(cell(F.col("cell_min")), cell(F.lit(1.0))).alias("cells")))
    read = p.select("source_index", "sheet_page", "bubble_roll", "selector_state", F.from_json(payload, schemas.OCR).alias("r"))
    least = F.array_min(F.transform("r.cells", lambda c: c["p"]))
    return read.select("source_index", F.col("r.text").alias("cell_roll"), (F.floor(least * 100 + 0.5) / 100).alias("cell_min"), F.when(F.col("sheet_page") == 1, F.col("bubble_roll")).alias("bubble_roll"), F.size("r.cells").alias("n_cells"), "selector_state")


def drawn(spark, d):
    k = F.col("s_suppkey")
    return dealt(A.table(spark, d, "supplier"), "s_suppkey", each=1024).select(k.alias("id"), F.lit(64).alias("size"), pixels.draw_bubble(F.lit(64), F.lit(12), (k % 10 + 1) / 10.0, (k % 5) * 30).alias("data"))


@query("disc_fill")
def _(spark, d):
    m = pixels.measure_disc("data", "size", "size", F.lit(32), F.lit(32), F.lit(12))
    return drawn(spark, d).select("id", m.alias("m")).select("id", "m.fill", "m.enhanced")


@query("ink_density")
def _(spark, d):
    m = pixels.measure_disc("data", "size", "size", F.lit(32), F.lit(32), F.lit(12))
    return drawn(spark, d).select("id", m.alias("m"), pixels.measure_cell("data", "size", "size").alias("cell_ink")).select("id", "m.ink", "cell_ink")


@query("shape_features")
def _(spark, d):
    return drawn(spark, d).select("id", F.explode(pixels.measure_shapes("data", "size", "size", F.lit(12))).alias("feature", "value"))


@query("crop_labels")
def _(spark, d):
    """Features of drawn bubbles and the labels that they lead to."""
    m = drawn(spark, d).select("id", pixels.measure_shapes("data", "size", "size", F.lit(12)).alias("m"))
    return m.select("id", E.crop_label(F.col("m"), F.lit(False), F.lit("mcq")).alias("label"))


@query("block_calibration")
def _(spark, d):
    """Blocks of twelve printed centres, moved, turned and short of one, brought back on what is observed."""
    s = A.table(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("page"), F.col("s_suppkey").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("id"))
    x, y = 100.0 + (F.col("id") % 4) * 30, 100.0 + F.floor(F.col("id") / 4) * 40
    expected = s.select("page", "block", "id", x.alias("x"), y.alias("y"))
    turn = (F.col("block") % 5 - 2) / 100.0
    seen = expected.select("page", "block", "id", (F.col("x") * F.cos(turn) - F.col("y") * F.sin(turn) + F.col("block") % 7).alias("x"), (F.col("x") * F.sin(turn) + F.col("y") * F.cos(turn) - F.col("block") % 3).alias("y")).where("id <> block % 12")
    return pixels.calibrated(expected, seen, 18.0).select("block", "id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "fitted")


@query("line_bands", "SELECT p_partkey, CAST(l AS INTEGER) AS line, greatest(10.0::DOUBLE, 10 + p_size / 4.0::DOUBLE * l - p_size / 4.0::DOUBLE * 0.12::DOUBLE) AS top, least(10.0::DOUBLE + p_size, 10 + p_size / 4.0::DOUBLE * (l + 1) + p_size / 4.0::DOUBLE * 0.12::DOUBLE) AS bottom FROM part, range(4) t(l)")
def _(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("line"))
    top, bottom = pixels.band_of_line(F.lit(10.0), F.col("h"), F.lit(4.0), F.col("line"))
    return p.select("p_partkey", "line", top.alias("top"), bottom.alias("bottom"))


@query("nearest_match")
def _(spark, d):
    k = F.col("p_partkey")
    p = A.table(spark, d, "part").select(F.col("p_size").cast("long").alias("page"), k.alias("id"), (k * 37 % 200).cast("double").alias("x"), (k * 53 % 280).cast("double").alias("y"))
    return M.nearest_matches(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 40.0)


@query("regular_run")
def _(spark, d):
    k = F.col("p_partkey")
    p = A.table(spark, d, "part").select(F.col("p_size").cast("long").alias("page"), (k * 37 % 200).cast("double").alias("at"))
    return M.regular_run(p, 4, 10.0, 3.0)


@query("decision_fold_stream", A.sql("decisions", "SELECT entity, action, seq, decisions FROM (SELECT entity, action, seq, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, seq DESC) AS place, count(*) OVER (PARTITION BY entity) AS decisions FROM decisions) WHERE place = 1"))
def _(spark, d):
    return logs.fold_stream(logs.decision_stream(spark, f"{d}/events.parquet"))


@query("incremental_inventory", "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def _(spark, d):
    done = A.table(spark, d, "events").where("event_id % 3 = 0").select("event_id")
    return logs.inspect_stream(spark, f"{d}/events.parquet", schemas.EVENTS, done, "event_id").select("event_id", "event_type")


@query("idempotent_sink", "SELECT DISTINCT user_id, event_type, 'SENT' AS status FROM events")
def _(spark, d):
    queue = logs.files_stream(spark, schemas.EVENTS, f"{d}/events.parquet").select("user_id", "event_type")
    return logs.send_once(queue, ["user_id", "event_type"])


@query("crop_classifier")
def _(spark, d):
    e = A.table(spark, d, "embeddings").where("embedding IS NOT NULL")
    rows = e.select("vec_id", (F.col("label") % 2).cast("int").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(8)])
    model = M.crop_classifier(rows.where("vec_id % 5 <> 0"), [f"f{i}" for i in range(8)], "y")
    return model.transform(rows.where("vec_id % 5 = 0")).select("vec_id", "y", F.col("prediction").cast("int").alias("predicted"))


@query("crop_forest", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'filled' ELSE 'cancelled' END AS label, count(*) AS crops, TRUE AS told FROM part WHERE p_size % 5 = 0 GROUP BY 1")
def _(spark, d):
    """A forest on shapes of drawn bubbles: of the sheets that it was not fitted on, whether nine crops of ten are told."""
    k = F.col("p_partkey")
    label = F.when(k % 3 == 0, "empty").when(k % 3 == 1, "filled").otherwise("cancelled")
    crops = dealt(A.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", each=2048).select(k.alias("id"), F.col("p_size").alias("sheet"), label.alias("label"), (k % 3).cast("double").alias("y"), pixels.draw_crop(k, (k % 3).cast("int")).alias("data"))
    told = crops.select("*", pixels.measure_shapes("data", F.lit(48), F.lit(48), F.lit(14)).alias("m")).select("id", "sheet", "label", "y", *(F.col("m")[n].alias(n) for n in pixels.SHAPES)).persist()
    forest = M.crop_forest(told.where("sheet % 5 <> 0"), list(pixels.SHAPES), "y")
    found = forest.transform(told.where("sheet % 5 = 0"))
    return found.groupBy("label").agg(F.count("*").alias("crops"), (F.avg((F.col("prediction") == F.col("y")).cast("int")) >= 0.9).alias("told"))


@query("digit_plugin", "SELECT page_id, CAST(length(url) % 10 AS VARCHAR) AS text, 0.9::DOUBLE AS confidence FROM pages")
def _(spark, d):
    M.register_reader("length", lambda: lambda crops: [(str(len(c) % 10), 0.9) for c in crops])
    r = A.table(spark, d, "pages").select("page_id", M.read_with("length", F.col("url").cast("binary")).alias("r"))
    return r.select("page_id", "r.text", "r.confidence")


@query("grid_udtf", "SELECT n_nationkey, CAST(p AS INTEGER) AS place, CAST(g AS INTEGER) AS digit, 10 + n_regionkey + p * 6.5::DOUBLE AS cx_mm, 20 + g * 5.5::DOUBLE AS cy_mm FROM nation, range(5 + n_nationkey % 3) a(p), range(10) b(g)")
def _(spark, d):
    """The centres of each nation's digit grid, by a table function beside its row."""
    n = A.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    grid = M.DigitGrid((5 + F.col("n_nationkey").outer() % 3).cast("int"), (10.0 + F.col("n_regionkey").outer()), F.lit(20.0), F.lit(5.5), F.lit(6.5))
    return n.lateralJoin(grid).drop("n_regionkey")


@query("public_export")
def _(spark, d):
    return pseudonymised(A.roster(spark, d).select("roll_no", "program"), "roll_no", b"a key of one export").orderBy("roll_no")
