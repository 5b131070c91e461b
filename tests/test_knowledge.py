from pyspark.sql import functions as F

from figmill.operators import evidence, knowledge, tables
from figmill.plans import figures, pipeline
from tests.test_tables import CELL
from tests.test_units import packets


def test_replies(spark):
    rows = [(1, '```json\n{"term_mapping": {"PhCl": "chlorobenzene"}, "global_conditions": {"T": "25 C"}}\n```'), (2, "sorry"), (3, None), (4, '{"term_mapping": {}}')]
    k = knowledge.replies(spark.createDataFrame(rows, "doc_id long, reply string"))
    got = {r.doc_id: (r.term_mapping, r.global_conditions) for r in k.collect()}
    assert got == {1: ({"PhCl": "chlorobenzene"}, {"T": "25 C"}), 2: ({}, {}), 3: ({}, {}), 4: ({}, {})}
    items = spark.createDataFrame([(1, "PhCl"), (1, "x"), (2, "PhCl"), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in knowledge.explained(items, k).collect() if r.text) == [(1, "PhCl (chlorobenzene)"), (1, "x"), (2, "PhCl")]
    assert {r.doc_id: r.conditions for r in knowledge.with_conditions(items, k).collect()}[1] == {"T": "25 C"}


def test_prompt(spark):
    df = spark.createDataFrame([(["b", "a"], "text"), ([], None)], "terms array<string>, text string")
    assert [r.p for r in df.select(knowledge.prompt(F.col("terms"), F.col("text"), 2).alias("p")).collect()] == ["Terms: a, b\nText: te", "Terms: \nText: "]


def test_forced_caption(spark):
    p = packets(spark, [(1, ("f", "old"), None, None, "z"), (2, ("g", "keep"), None, None, "z")])
    forced = spark.createDataFrame([(1, "new"), (2, None)], "packet_id long, caption string")
    assert {r.packet_id: r.meta.caption for r in evidence.forced_caption(p, forced).collect()} == {1: "new", 2: "keep"}


def test_outcome_and_placed(spark):
    rows = [("p", "t", i, i, None, None, 1, 1, 0.5, "cell", text, x, y, x + 10, y + 10, None, None) for i, (text, x, y) in enumerate([("a", 0.0, 0.0), ("b", 50.0, 0.0), ("c", 0.0, 40.0)])]
    c = spark.createDataFrame(rows, CELL)
    assert {r.content: (r.row_index, r.col_index) for r in tables.placed(c).collect()} == {"a": (0, 0), "b": (0, 1), "c": (1, 0)}
    t = spark.createDataFrame([("p", "t", True, True), ("p", "u", True, True), ("p", "v", False, True), ("p", "w", True, False)], "paper_id string, table_id string, accepted boolean, readable boolean")
    assert {r.table_id: r.reason for r in tables.outcome(t, c).collect()} == {"t": "", "u": "No cells detected", "v": "Filtered by YOLO", "w": "Image read error"}


def test_pipeline(spark, data, tmp_path):
    dets = figures.dets(spark, data)
    m = pipeline.run(spark, data, str(tmp_path), figures.texts(dets), figures.coloured(dets).select("det_id", "h", "s", "v"))
    assert m.count() == spark.read.parquet(f"{data}/micro_detections.parquet").select("paper_id", "figure_id").distinct().count()
    assert spark.read.json(f"{tmp_path}/packets").count() > 0 and spark.read.parquet(f"{tmp_path}/pixels").count() > 0
