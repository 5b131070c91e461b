import json

from pyspark.sql import functions as F

from figmill.sources import files, recorded, seams
from figmill.streaming import ingest


def test_files(spark, tmp_path):
    (tmp_path / "page_1_figure_0_t0_evidence.json").write_text(json.dumps({"meta": {"figure_id": "a"}, "raw_data": [{"X": 1.0}]}, indent=1))
    (tmp_path / "page_1_figure_1_t0_evidence.json").write_text("{broken")
    (tmp_path / "page_1_figure_0_t0_extraction.json").write_text('[{"Series": "s", "X": 1, "Y_Right": NaN}]')
    (tmp_path / "page_1_figure_0_t0_legend_0.PNG").write_bytes(b"x")
    (tmp_path / "page_1_figure_0_t0_legend_1.png").write_bytes(b"xy")
    got = files.packet_files(spark, str(tmp_path)).select(F.col("meta.figure_id").alias("f"), F.size("raw_data").alias("n")).collect()
    assert sorted((r.f or "", r.n or 0) for r in got) in ([("", 0), ("a", 1)], [("", -1), ("a", 1)])
    pts = files.point_files(spark, str(tmp_path)).collect()
    assert len(pts) == 1 and pts[0].X == 1.0
    assert [r.figure_id for r in files.images(spark, str(tmp_path), "*.png").collect()] == ["page_1_figure_0_t0"]
    out = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([("f", 1, "a"), ("g", None, "b")], "figure_id string, x int, y string"), out, by=["figure_id"])
    assert spark.read.csv(out, header=True).count() == 2


def test_recognition_forms(spark):
    rows = [('[{"rec_texts": ["a", "b"], "rec_boxes": []}]',), ('[[["[[0,0]]", "[\\"a\\", \\"0.9\\"]"]]]',), ("[]",), ("nonsense",), (None,)]
    df = spark.createDataFrame(rows, "j string")
    got = [(r.f, r.a) for r in df.select(recorded.first_text(F.col("j")).alias("f"), recorded.all_texts(F.col("j")).alias("a")).collect()]
    assert got == [("a", "a b"), ("a", "a"), ("", ""), ("", ""), ("", "")]


def test_seam_keeps_going(spark):
    def open_model():
        def model(v):
            if v < 0:
                raise ValueError("negative")
            return [{"text": str(v)}] * v

        return model

    df = spark.createDataFrame([(1, 2), (2, -1), (3, 0)], "id long, v int")
    got = sorted((r.id, r.text, r.error) for r in seams.Adapter(open_model, "text string, conf double").apply(df, "id", "v").collect())
    assert got == [(1, "2", None), (1, "2", None), (2, None, "negative")]
    assert set(seams.SEAMS) >= {"regions", "layout", "detections", "text"}


def test_stream(spark, tmp_path, data):
    src = str(tmp_path / "in")
    raw = spark.read.parquet(f"{data}/raw_packets.parquet").limit(20)
    raw.write.parquet(src)
    stream = ingest.arriving(spark, src)
    out = str(tmp_path / "items")
    for _ in range(2):
        ingest.shred_available(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    unique = raw.dropDuplicates(["file_name", "payload"])
    from figmill.operators import shred

    assert spark.read.parquet(out).count() == shred.flat_legend_items(unique).count()


def test_files_of_any_shape(spark):
    packet = {"meta": {"figure_id": "a"}, "raw_data": [{"X": 1.0}]}
    rows = [(1, json.dumps(packet)), (2, json.dumps([packet, packet, {"other": 1}])), (3, json.dumps({"v": 2, "packets": [packet]})), (4, '[{"Series": "s", "X": NaN, "Y_Right/Data_Value": 3}, {"X": "1"}]'), (5, None), (6, ""), (7, '{"meta":'), (8, json.dumps({"raw_data": {"X": [1]}})), (9, "[]"), (10, "3")]
    raw = spark.createDataFrame(rows, "file_id long, payload string")
    got = sorted((r.file_id, r.packet.meta.figure_id if r.packet.meta else None, None if r.packet.raw_data is None else len(r.packet.raw_data)) for r in recorded.packets(raw).collect())
    assert got == [(1, "a", 1), (2, "a", 1), (2, "a", 1), (3, "a", 1), (8, None, None)]
    assert sorted(((r.file_id, r.series, r.x, r.y_right) for r in recorded.mapped_points(raw).collect()), key=str) == [(4, "s", None, 3.0), (4, None, None, None)]
