import json

from hypothesis import given, settings, strategies as st

from figmill.operators import shred

plain = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text("ab", max_size=3))
nested = st.recursive(plain, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text("xyz", min_size=1, max_size=2), x, max_size=3)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text("xyz", min_size=1, max_size=2), nested, min_size=1, max_size=3), min_size=1, max_size=3))
def test_round_trip(records):
    assert shred.assemble(shred.shred(records)) == records


def test_levels():
    cols = shred.shred([{"a": [{"b": 1}, {"b": 2}]}, {"a": []}, {}])
    c = cols[(".a", "[]", ".b")]
    assert list(zip(c.reps, c.defs, c.vals)) == [(0, 3, 1), (1, 3, 2), (0, 1, None), (0, 0, None)]
    assert [(r, i) for r, i, _, _ in shred.rows_of(c, (".a", "[]"))] == [(0, 0), (0, 1), (1, -1), (2, -1)]


SHAPES = [
    ([{"text": "a", "source_file": "f.png"}, {"text": ""}], [("a", "f.png"), ("", "")]),
    (["a", ""], [("a", ""), ("", "")]),
    ([[{"text": "a", "source_file": "f"}], [{"text": "b"}, {"text": "c"}]], [("a", "f"), ("b", ""), ("c", "")]),
    ({"f_0.png": "a", "f_1.png": "b"}, [("a", "f_0.png"), ("b", "f_1.png")]),
    ({"text": "a", "source_file": "f.png"}, [("a", "f.png")]),
    ([{"txt": "a", "crop_file": "f", "conf": 0.5, "lang": "en"}], [("a", "f")]),
    ([{"content": "a", "sourceFile": "f", "note": "x"}], [("a", "f")]),
    ([], []), (None, []),
]


def test_legend_shapes():
    for value, want in SHAPES:
        packet = {"meta": {}, "text_evidence": {"legend_text": value, "chart_text": [{"text": "no"}]}}
        assert shred.legend_items(packet) == want, value
        inside = {"meta": {}, "text_evidence": json.dumps({"LegendText": value})}
        assert shred.legend_items(inside) == want, value


def test_found(spark):
    one = json.dumps({"meta": {"figure_id": "g"}, "text_evidence": {"legend_text": ["a", {"text": "b", "source_file": "s"}]}, "raw_data": []})
    rows = [(1, one, "x"), (2, one, "x"), (3, None, "x"), (4, "", "x"), (5, one[:-3], "x"), (6, '[{"Series": "q", "X": NaN}]', "x"), (7, f'{{"packets": [{one}, {one}]}}', "x"), (8, "7", "x")]
    got = sorted(tuple(r) for r in shred.found(spark.createDataFrame(rows, "file_id long, payload string, figure_id string")).collect())
    assert got == sorted([(f, "g", i, s) for f in (1, 2, 7, 7) for i, s in ((0, ""), (1, "s"))])
    assert shred.found(spark.createDataFrame([], "file_id long, payload string")).count() == 0


def rebuilt(rows):
    """The record back from its tables, for records of objects and arrays of objects or plain values."""
    kids = {}
    for t, r, pt, pr, fields in rows:
        kids.setdefault((pt, pr), []).append((t, r, fields))
    by = {(t, r): fields for t, r, _, _, fields in rows}

    def put(out, path, v):
        *steps, last = path.split(".")
        for s in steps:
            out = out.setdefault(s, {})
        out[last] = v

    def build(t, r):
        fields = by[(t, r)]
        if set(fields) == {"value"} and t.endswith("[]"):
            return json.loads(fields["value"])
        out = {}
        for k, v in fields.items():
            put(out, k, json.loads(v))
        for child, no, _ in sorted(kids.get((t, r), ()), key=lambda x: (x[0], x[1])):
            at = child.removeprefix(t).lstrip(".").removesuffix("[]")
            have = out
            *steps, last = at.split(".")
            for s in steps:
                have = have.setdefault(s, {})
            have.setdefault(last, []).append(build(child, no))
        return out

    return build("", 0)


def test_tables_rebuild_the_record():
    record = {"meta": {"figure_id": "f", "tags": ["a", "b"]}, "raw_data": [{"X": 1.0, "marks": [{"k": 1}, {"k": 2}]}, {"X": 2.0}, {"X": 3.0, "marks": [{"k": 4}]}], "text_evidence": {"legend_text": [{"text": "t", "box": {"w": 3}}]}}
    rows = shred.tables_of(record)
    assert rebuilt(rows) == record
    assert [(r, pr, f) for t, r, _, pr, f in rows if t == "raw_data[].marks[]"] == [(0, 0, {"k": "1"}), (1, 0, {"k": "2"}), (2, 2, {"k": "4"})]
    assert shred.tables_of({}) == [("", 0, None, None, {"value": "{}"})] or shred.tables_of({})[0][:2] == ("", 0)


def test_tables_of_files(spark, data):
    raw = spark.read.parquet(f"{data}/raw_packets.parquet")
    got = {}
    for r in shred.flat_tables(raw).collect():
        got.setdefault((r.file_id, r.packet_no, r.table_path), []).append(r)
    seen = 0
    for r in raw.select("file_id", "payload").dropDuplicates(["file_id"]).collect():
        for no, p in enumerate(shred.packets_of(shred.load(r.payload))):
            data_ = p.get("raw_data")
            if isinstance(data_, list) and data_ and all(isinstance(x, dict) and x for x in data_):
                rows = sorted(got[(r.file_id, no, "raw_data[]")], key=lambda x: x.row_no)
                assert len(rows) == len(data_) and all(x.parent_path == "" and x.parent_row == 0 for x in rows)
                for x, point in zip(rows, data_):
                    plain = {k: v for k, v in point.items() if v is not None and not isinstance(v, (dict, list))}
                    assert {k: json.dumps(v) for k, v in plain.items() if isinstance(v, (int, float))} == {k: x.fields[k] for k, v in plain.items() if isinstance(v, (int, float))}
                seen += 1
    assert seen > 10 and shred.flat_tables(raw.limit(0)).count() == 0
