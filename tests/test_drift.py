import functools
import itertools
import json

import numpy as np
from hypothesis import given, settings, strategies as st

from figmill import session
from figmill.operators import drift

PATHS = {"meta": "object", "meta.figure_id": "string", "meta.caption": "string", "text_evidence": "object", "raw_data": "array", "raw_data[]": "object", "raw_data[].Series": "string", "raw_data[].X": "number", "raw_data[].Y_Right": "number"}
for _f in ("x_axis_title", "legend_text"):
    PATHS |= {f"text_evidence.{_f}": "array", f"text_evidence.{_f}[]": "object", f"text_evidence.{_f}[].text": "string", f"text_evidence.{_f}[].source_file": "string", f"text_evidence.{_f}[].note": "string"}


def schema(spark):
    return spark.createDataFrame([(p, t, not p.endswith("note")) for p, t in PATHS.items()], "field_path string, json_type string, required boolean")


def packet(i):
    item = [{"text": f"Total flow {i}", "source_file": f"page_{i}.png"}]
    return {"meta": {"figure_id": f"page_{i}_figure_0", "caption": f"Fig. {i} of it"}, "text_evidence": {"x_axis_title": item, "legend_text": item}, "raw_data": [{"Series": "s", "X": i + 0.5, "Y_Right": 20.0 + i % 20}]}


def test_changes(spark, monkeypatch):
    rows = [(i, json.dumps(packet(i))) for i in range(20)]

    def file(n, f):
        p = packet(n)
        f(p)
        rows.append((n, json.dumps(p)))

    def rename(p):
        p["meta"]["figure_caption"] = p["meta"].pop("caption")

    def moved(p):
        p["caption"] = p["meta"].pop("caption")

    def mixed(p):
        del p["raw_data"][0]["Y_Right"]
        p["raw_data"][0]["x_pixel"] = 400
        p["text_evidence"]["legend_text"] = ["a"]

    def values(p):
        p["raw_data"][0]["Data_Value"] = p["raw_data"][0].pop("Y_Right")

    def whole(p):
        p["text_evidence"] = json.dumps(p["text_evidence"])

    for n, f in zip(range(100, 110), (rename, moved, mixed, values, whole)):
        file(n, f)
    nan = packet(1)
    rows += [(200, json.dumps(nan).replace("21.0", "NaN")), (201, None), (202, ""), (203, rows[0][1][:-4]), (204, json.dumps([{"Series": "s", "X": "1,5", "Y_Right": None}])), (205, json.dumps({"packets": [packet(1), packet(2)]})), (206, "[]")]
    rows.append(rows[20])
    raw = spark.createDataFrame([(*r, "x", "y") for r in rows], "file_id long, payload string, path string, version string")
    got = sorted(tuple(r) for r in drift.found(raw, schema(spark)).collect())
    want = [
        (100, "meta.caption", "renamed"), (100, "meta.caption", "renamed"), (101, "meta.caption", "renamed"), (102, "raw_data[].Y_Right", "removed"), (102, "raw_data[].x_pixel", "added"), (102, "text_evidence.legend_text[]", "retyped"),
        (103, "raw_data[].Y_Right", "renamed"), (104, "text_evidence", "retyped"), (204, "raw_data[].X", "retyped"),
    ]
    assert got == sorted(want)
    by_join = sorted(map(str, drift.unified(raw.dropDuplicates(["file_id"]), schema(spark)).collect()))
    monkeypatch.setattr(drift, "looked_up", functools.partial(session.looked_up, limit=0))
    assert by_join == sorted(map(str, drift.unified(raw.dropDuplicates(["file_id"]), schema(spark)).collect()))
    u = {(r.file_id, r.packet_no): r for r in drift.unified(raw, schema(spark)).collect()}
    assert u[(100, 0)].caption == "Fig. 100 of it" and u[(101, 0)].caption == "Fig. 101 of it" and u[(103, 0)].raw_data[0].Y_Right == 23.0
    assert u[(204, 0)].raw_data[0].X == 1.5 and u[(104, 0)].legend_text[0].text == "Total flow 104" and (205, 1) in u and (201, 0) not in u


def test_empty(spark):
    raw = spark.createDataFrame([], "file_id long, payload string")
    assert drift.found(raw, schema(spark)).count() == 0 and drift.unified(raw, schema(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_assignment_is_best(n, m, data):
    w = np.array([[data.draw(st.integers(0, 9)) for _ in range(m)] for _ in range(n)], float)
    got = sum(w[i, j] for i, j in drift.assignment(w))
    small, large = (w, m) if n <= m else (w.T, n)
    best = max(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(large), small.shape[0]))
    assert got == best


def test_names():
    assert drift.name_similarity("Y_Right", "yRight") == 1.0 and drift.name_similarity("Right_Y", "Y_Right") == 1.0
    assert drift.name_similarity("caption", "figure_caption") > 0.6 > drift.name_similarity("text", "conf")
    assert drift.name_similarity("source_intermediate_dir", "src_dir") > 0.6


def test_unified_keeps_every_value(spark):
    p, q = packet(1), packet(2)
    p["text_evidence"]["x_axis_title"] = [{"text": "T", "source_file": "a.png", "note": "hand", "conf": 0.5}]
    p["text_evidence"]["legend_text"] = [{"text": "L", "source_file": "b.png", "note": "twice", "lang": "de"}]
    p["meta"] |= {"page": 7, "dpi": None}
    p["run"], p["raw_data"][0]["color"], p["raw_data"][0]["X"] = {"id": "r"}, "#f00", "about 3"
    q["raw_data"][0]["Y_Right"], q["raw_data"] = [1, 2], [*q["raw_data"], 5]
    rows = [(1, json.dumps(p)), (2, json.dumps({"schema_version": 3, "packets": [q]}))]
    got = {r.file_id: r for r in drift.unified(spark.createDataFrame(rows, "file_id long, payload string"), schema(spark)).collect()}
    u = got[1]
    assert u.x_axis_title[0].asDict() == {"text": "T", "source_file": "a.png", "note": "hand", "rest": {"text_evidence.x_axis_title[].conf": "0.5"}}
    assert u.legend_text[0].asDict() == {"text": "L", "source_file": "b.png", "note": "twice", "rest": {"text_evidence.legend_text[].lang": '"de"'}}
    assert u.rest == {"meta.page": "7", "run": '{"id": "r"}'} and u.raw_data[0].rest == {"raw_data[].color": '"#f00"', "raw_data[].X": '"about 3"'}
    assert got[2].raw_data[0].rest == {"raw_data[].Y_Right": "[1, 2]"} and got[2].rest["schema_version"] == "3" and json.loads(got[2].rest["raw_data"])[1] == 5


def test_one_file_of_another_type_leaves_the_rename(spark):
    rows = [(i, json.dumps(packet(i))) for i in range(20)]
    for i in range(20, 41):
        p = packet(i)
        p["raw_data"][0]["Right_Y"] = p["raw_data"][0].pop("Y_Right") if i < 40 else "n/a"
        p["raw_data"][0].pop("Y_Right", None)
        rows.append((i, json.dumps(p)))
    raw = spark.createDataFrame(rows, "file_id long, payload string")
    assert sorted(tuple(r) for r in drift.found(raw, schema(spark)).collect()) == [(i, "raw_data[].Y_Right", "renamed") for i in range(20, 41)]


def test_whole_values_are_sketched():
    """Texts that differ only after a long common start have other bins."""
    start = "the same words again and again " * 40
    a, b = ({} for _ in "ab")
    drift.add_to_sketch(a, start + "then electrolyte; 12 bar")
    drift.add_to_sketch(b, start + "then nothing")
    assert set(a) != set(b) and drift.NUMBER_BINS + drift._hash("electrolyte") % drift.SHAPE_BINS in drift._text_bins("x " * 500 + "electrolyte")
