import unicodedata

import pytest

from figmill.llm import lookalikes as look

NAMES = [(1, "benzyl alcohol"), (2, "α-tetralone"), (3, "café extract"), (4, "gas phase CO"), (5, "Pd/C fresh"), (6, "Δ-isomer"), (7, "first fraction"), (8, "10 mL/min stream"), (9, "solvent-free run"), (10, "β-lactam")]


@pytest.fixture(scope="module")
def names():
    return look.Names(NAMES)


CASES = [
    ("benzyl alcohol", []), ("bеnzyl alcоhol", [1]), ("benzyl alcohol", [1]), ("ben​zyl alcohol", [1]), ("benzyl alcohol‍", [1]), ("ｂｅｎｚｙｌ　ａｌｃｏｈｏｌ", [1]), ("α-tetralone", []), ("ɑ-tеtralone", [2]), ("⍺-tetralone", [2]), ("α‐tetralone", [2]),
    (unicodedata.normalize("NFD", "café extract"), [3]), ("ϲafé extract", [3]), ("gas phase СО", [4]), ("Pd／C fresh", [5]), ("∆-isomer", [6]), ("ﬁrst fraction", [7]), ("１０ mL/min stream", [8]), ("solvent−free run", [9]), ("ß-lactam", [10]), ("ꞵ-lаctam", [10]),
    # visible differences
    ("BENZYL ALCOHOL", []), ("Β-LACTAM", []), ("benzyl alcoho1", []), ("— café extract", []), ("café extract.", []), ("afé extract", []), ("benzyl\nalcohol", []), ("ben¬ zyl alcohol", []), ("ben­ zyl alcohol", []), ("", []), ("​", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_label(names, text, want):
    assert names.disguised(text, False) == want


def test_legend_text(names):
    assert names.disguised("benzyl alcohol gas phase СO first fraction", True) == [4]
    assert names.disguised("bеnzyl alcohol ﬁrst fraction Δ-isomer", True) == [1, 7]
    assert names.disguised("bеnzyl alcohols", True) == [] and names.disguised("benzyl alcohol​ gas phase CO", True) == [1]


def packets(spark, rows):
    schema = "packet_id long, text_evidence struct<legend_text: array<struct<text: string, source_file: string>>>, raw_data array<struct<Series: string, X: double>>, label string"
    return spark.createDataFrame(rows, schema)


def test_tables(spark):
    ref = spark.createDataFrame(NAMES, "name_id int, series_name string")
    p = packets(spark, [(1, ([("bеnzyl alcohol", None), None, (None, None)],), [("α-tetralone", 1.0), ("ɑ-tetralone", 2.0), None], "x"), (1, None, None, "x"), (2, (None,), [], "x")])
    assert sorted(tuple(r) for r in look.found(p, ref).collect()) == [(1, "legend_text", 0, 1), (1, "series", 1, 2)]
    got = {(r.field, r.item_no): r.canonical for r in look.canonical_labels(p, ref).collect()}
    assert got == {("legend_text", 0): "benzyl alcohol", ("series", 0): "α-tetralone", ("series", 1): "α-tetralone"}
    assert look.found(p.limit(0), ref).count() == 0


def test_long_labels(names):
    text = "а" * 200_000 + " bеnzyl alcohol " + "\u200b" * 100_000
    assert names.disguised(text, True) == [1] and names.disguised(text, False) == []


@pytest.mark.parametrize("text, want", [("раствор", "раствор"), ("вода", "вода"), ("скорость", "скорость"), ("пар", "пар"), ("ΝΕΡΟ", "ΝΕΡΟ"), ("ρυθμός", "ρυθμός"), ("скoрость", "скорость"), ("вoда и пар", "вода и пар")])
def test_words_of_other_scripts_stay(names, text, want):
    assert look.canonical(text, names.model)[0] == want


def test_a_disguised_name_in_one_other_script_is_found():
    names = look.Names([(1, "control run"), (2, "coop"), (3, "γ-butyrolactone")])
    assert names.disguised("соор", False) == [2] and names.disguised("ү-butyrolactone", False) == [3]
