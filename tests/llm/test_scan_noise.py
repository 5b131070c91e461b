import random

import pytest

from figmill.llm import editor as ed, furniture, scan_noise as scan

WORDS = "reactor temperature conversion selectivity hydrogen pressure catalyst measured standard residence electrolyte conductivity solvent mixture sample column response observed different between without another distribution stream cooling machine current reached together".split()
#: Pairs (read, true) that training never sees.
UNKNOWN = {(a, b) for a, b in zip("ypkvzxgjw" * 26, (c for c in ed.LETTERS for _ in range(9))) if a != b and f"{a}>{b}" not in ed.USUAL}


def corpus(seed=0, n=300):
    """Texts of wrapped sentences with headers and page numbers."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(60)]
        lines = [" ".join(words[k : k + 8]) for k in range(0, 60, 8)]
        lines[0] = lines[0].capitalize()
        lines[3] += " back-pressure and pre- and post-treatment"
        if i % 3 == 0:
            lines.insert(4, f"{100 + i}")
            lines.insert(5, rng.choice(["Notes on Calibration", "Long Runs with Fixed Beds"]))
        if i % 20 == 0:
            lines += ["", "T / °C", "25", "30", "35"]
        out.append("\n".join(lines) + ".")
    return out


CASES = [
    ("The catalyst was measured", set()), ("The cata1yst was measured", {(0, "misread")}), ("the rneasured colurnn", {(0, "misread")}), ("the meas-\nured column", {(0, "hyphen")}), ("the meas¬ \r\nured column", {(0, "hyphen")}),
    ("a back-\npressure valve", set()), ("See the pre-\nand post-treatment", set()), ("the temp-\n117\nerature reached", {(0, "hyphen"), (1, "page_number")}), ("the stream\nNotes on Calibration\n12\nreached another", {(1, "header"), (2, "page_number")}),
    ("the stream\n12  Notes on Calibratlon\nreached another", {(1, "header")}), ("T / °C\n25\n30\n35", set()), ("the end of\n[77]\nanother stream", {(1, "page_number")}), ("12", set()), ("c1ccccc1CCl and NOCl", set()), ("hydroxycyclohexanooxime", set()), ("", set()), ("成本估算", set()),
    ("the tcmper-\naturc reached", {(0, "hyphen"), (0, "misread")}), (None, set()),
]
PACKET = [("Reactor pres- sure", {(0, "hyphen")}), ("Reactor pres­sure", set()), ("- catalyst", set()), ("Notes on cata1yst\nreached", {(0, "misread")})]


def item(rows, spark):
    return spark.createDataFrame(rows, "doc_id long, text string, origin string")


def packets(spark, texts):
    one = "array<struct<text: string, source_file: string>>"
    rows = [(i, (t,), ([("Reactor", None), None], None, [("cata1yst", None)]) if i == 0 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"packet_id long, meta struct<caption: string>, text_evidence struct<x_axis_title: {one}, chart_text: {one}, legend_text: {one}>")


def harmed(pairs, seed):
    """(damaged, true) words, each of one damaged place of the given pairs (read, true)."""
    rng, out = random.Random(seed), []
    for w in WORDS:
        spots = sorted({(i, s, t) for s, t in pairs if t.islower() for i in range(1, len(w)) if w.startswith(t, i)})
        for i, s, t in rng.sample(spots, min(4, len(spots))):
            bad = w[:i] + s + w[i + len(t) :]
            if bad not in WORDS and ed.is_word(bad):
                out.append((bad, w))
    return out


@pytest.fixture(scope="module")
def result(spark):
    """(found by row, repaired by row) of the corpus with all cases among its rows; damage of unknown pairs has ids from 5000."""
    ed.HELD_OUT.update(UNKNOWN)
    rows = [(i, t, "x") for i, t in enumerate(corpus())]
    rows += [(1000 + i, t, "x") for i, (t, _) in enumerate(CASES)]
    rows += [(3000 + i, f"The {bad} reached", "x") for i, (bad, _) in enumerate(harmed(ed.MISREAD, 3))]
    rows += [(5000 + i, f"The {bad} reached", "x") for i, (bad, _) in enumerate(harmed(UNKNOWN, 4))]
    rows += [(9000, "The temp-\nerature reached the cata1yst and the\n117\nLong Runs with Fixed Beds\nstream of the residence.\n\nAnother sample.", "x")]
    docs, p = item(rows, spark), packets(spark, [t for t, _ in PACKET])
    found = {}
    for r in scan.found(docs, p).collect():
        found.setdefault((r.origin, r.row_id, r.field), []).append((r.item_no, r.defect))
    fixed = {(r.origin, r.row_id, r.field): r.text for r in scan.repaired(docs, p).collect()}
    ed.HELD_OUT.clear()
    return found, fixed


@pytest.mark.parametrize("i", range(len(CASES)))
def test_defects(result, i):
    assert set(result[0].get(("document", 1000 + i, "text"), [])) == CASES[i][1]


@pytest.mark.parametrize("i", range(len(PACKET)))
def test_packet_items(result, i):
    assert set(result[0].get(("packet", i, "caption"), [])) == PACKET[i][1]
    assert result[0][("packet", 0, "legend_text")] == [(0, "misread")]


@pytest.mark.parametrize("pairs, first, seed, least", [(ed.MISREAD, 3000, 3, 0.95), (UNKNOWN, 5000, 4, 0.9)])
def test_held_out_damage(result, pairs, first, seed, least):
    """Damaged words that stand once; those of unknown pairs were drawn from replacements that training never shows."""
    words = harmed(pairs, seed)
    right = [result[1][("document", first + i, "text")] == f"The {w} reached" for i, (_, w) in enumerate(words)]
    assert len(right) > 60 and sum(right) / len(right) >= least


def test_clean_words_stay(result):
    assert not any(d == "misread" for (o, i, _), x in result[0].items() if o == "document" and i < 300 for _, d in x)


def test_repair(result):
    assert result[1][("document", 9000, "text")] == "The temperature reached the catalyst and the stream of the residence.\n\nAnother sample."
    assert result[1][("packet", 0, "caption")] == "Reactor pressure"


def test_what_is_sent_does_not_matter(spark, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(corpus(1, 200))] + [(1000 + i, t, "x") for i, (t, _) in enumerate(CASES)] + [(1001, CASES[1][0], "x")]
    docs, p = item(rows, spark), packets(spark, ["Reactor pres- sure"])
    want, text = sorted(map(tuple, scan.found(docs, p).collect())), sorted(map(tuple, scan.repaired(docs, p).collect()))
    monkeypatch.setattr(scan, "COMMON", 7)
    monkeypatch.setattr(scan, "SENT_COPIES", 0)
    assert sorted(map(tuple, scan.found(docs, p).collect())) == want and sorted(map(tuple, scan.repaired(docs, p).collect())) == text
    assert want.count(("document", 1001, "text", 0, "misread")) == 2


def test_small_and_empty_inputs(spark):
    docs = item([(i, "the catalyst reached the column between the stream", "x") for i in range(12)] + [(50, "the cata1yst reached the", "x")], spark)
    assert scan.found(docs.limit(0), packets(spark, []).limit(0)).count() == 0 and scan.repaired(docs.limit(0), packets(spark, []).limit(0)).count() == 0
    scan.found(docs, packets(spark, [None])).collect()


def test_a_corpus_of_a_hundred_words(spark):
    """There is no least size: few words are enough to see that one of them is misread."""
    docs = item([(i, f"the catalyst of the column reached sample {i} between the stream and the catalyst", "x") for i in range(10)] + [(50, "the cata1yst reached the stream", "x")], spark)
    got = [(r.row_id, r.defect) for r in scan.found(docs, packets(spark, [])).collect()]
    assert got == [(50, "misread")]


def test_copies_count_once(spark):
    """A third of the rows hold one text, under other ids or the same: its misread words are as rare as in one copy."""
    hot = "The cata1yst of the reacfor was measured between current and pressure"
    rows = [(i, t, "x") for i, t in enumerate(corpus(2, 200))]
    copies = rows + [(1000 + i % 60, hot, "x") for i in range(100)]
    p = packets(spark, [])
    one = {(r.kind, r.key): r.n for r in scan.corpus_counts(scan.weighted(scan.items_of(item([*rows, (1000, hot, "x")], spark), p))).collect()}
    all_ = {(r.kind, r.key): r.n for r in scan.corpus_counts(scan.weighted(scan.items_of(item(copies, spark), p))).collect()}
    assert {k: round(n, 3) for k, n in all_.items()} == one
    got = [(r.row_id, r.defect) for r in scan.found(item(copies, spark), p).collect() if r.row_id >= 1000]
    assert len(got) == 100 and {d for _, d in got} == {"misread"}


def test_a_title_of_many_packets_is_no_copy(spark):
    """The same title in different packets is evidence of its words."""
    one = "array<struct<text: string, source_file: string>>"
    rows = [(i, (f"Figure {i} of both reactors and both columns",), ([("Bath temperature", None)], None, None)) for i in range(40)]
    p = spark.createDataFrame(rows, f"packet_id long, meta struct<caption: string>, text_evidence struct<x_axis_title: {one}, chart_text: {one}, legend_text: {one}>")
    n = {r.key: r.n for r in scan.corpus_counts(scan.weighted(scan.items_of(item([], spark), p))).where("kind = 'w'").collect()}
    assert n["Bath"] == 40 and n["both"] == 80


def test_many_outlines(spark):
    """30,000 outlines, the header among the rarest: none is left out."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("bcdfgklprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    rows = [(i, "\n".join(x for _ in range(10) for x in (f"{name()} {name()} {name()}", "went on with the work.")) + "\nEnd of it.", "x") for i in range(3000)]
    rows += [(9000 + i, f"the stream of the\n{i + 3}\nNotes on Rare Gases\ncolumn was reached", "x") for i in range(4)]
    rows += [(9100 + i, f"the stream of the\n{i + 3}\nWork with Flow {'Cells' if i % 2 else 'Beds'}\ncolumn was reached", "x") for i in range(400)]
    got = [(r.row_id, r.item_no) for r in scan.found(item(rows, spark), packets(spark, [])).where("defect = 'header' and row_id between 9000 and 9050").collect()]
    assert sorted(got) == [(9000 + i, 2) for i in range(4)]


def test_places():
    assert ed.places("rneasured", "measured") == [(0, "rn", "m")] and ed.places("eoiumn", "column") == [(0, "e", "c"), (2, "i", "l")]
    assert ed.operations("rn", "m") == [("replace", "r", "m"), ("delete", "n", "")] and ed.places("abcdefgh", "hgfedcba") is None
    assert ed.keys("c1ensity") & ed.keys("density") and ed.keys("temporature") & ed.keys("temperature") and not ed.keys("the") & ed.keys("that")


def test_places_on_a_page():
    lines = "The stream\n12\nNotes on Calibration\nwent on.\n\nT / °C\n25\n30".split("\n")
    got = {i: (k, p) for i, k, p in furniture.candidates(lines)}
    assert got[1][0] == "#9" and got[1][1][2:6] == ",,ta" and furniture.near(got[2][1]) and furniture.inside(got[2][1]) and got[6][1][2] == "h" and got[7][1][4] == "$"
    assert furniture.candidates(["Notes on Calibration"]) == []


def test_long_texts():
    import time

    began = time.time()
    tool = scan.Repairer({}, {}, {}, frozenset("wpt"))
    for text in ("o" * 300_000, "o" * 300_000 + "- " + "c" * 300_000, ("catalyst meas-\nured " * 20_000), "-" * 200_000, "a-" * 200_000 + "\nb", "1" * 200_000, " " * 300_000 + "\n" * 1000, "Aa Bb\n" * 30_000):
        for origin in ("document", "packet"):
            tool.defects(origin, text)
        tool.repaired("document", text[:100_000])
        scan.without_broken(text, scan._BREAK_ITEM)
    assert time.time() - began < 60
