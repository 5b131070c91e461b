import random

from figmill.llm import subjects
from figmill.llm.sentences import sentences

NOUNS = {1: ["coiled capillary", "syringe pump", "mixing zone", "heated loop"], 2: ["zeolite pellet", "active site", "metal cluster", "coke deposit"], 3: ["graphite anode", "membrane cell", "redox mediator", "current density"]}
VERBS = {1: "fed reagent into", 2: "poisoned", 3: "oxidised the substrate at"}
GENERAL = ["All runs were repeated three times.", "Further details are given in the supplement.", "The results are summarised in Table 4."]
AREAS = {s: f"area {s}. things of {VERBS[s]}" for s in NOUNS}


def sentence(rng, s):
    a, b = rng.sample(NOUNS[s], 2)
    if rng.random() < 0.3:  # a foreign thing is named
        b = rng.choice(NOUNS[rng.choice([x for x in NOUNS if x != s])])
        return f"In run {rng.randrange(20)}, the {a} {VERBS[s]} the {b}."
    return rng.choice([f"The {a} {VERBS[s]} the {b}.", f"Details of the {a} and of the {b} are listed in Table {rng.randrange(9)}."])


def document(rng):
    kinds = rng.choice([[1], [2], [3], [1, 2], [2, 3], []])
    out = [sentence(rng, s) for s in kinds for _ in range(4)] + rng.sample(GENERAL, 2)
    rng.shuffle(out)
    return " ".join(out), kinds


def test_held_out(spark):
    rng = random.Random(5)
    docs = [document(rng) for _ in range(300)]
    model = subjects.fit([(t, {s: 1 for s in k}) for t, k in docs[:200] if k], AREAS)
    assert sum(model.treated(t) == k for t, k in docs[200:]) >= 98
    assert model.treated(None) == [] and model.treated("  ") == [] and model.treated(GENERAL[0]) == []


def test_tables(spark):
    rng = random.Random(6)
    made = [document(rng) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 9) for i, (t, _) in enumerate(made)] + [(500, None, 9), (501, "", 9), (0, made[0][0], 9)], "doc_id long, text string, subject_id int")
    rows = [(i, s) for i, (_, k) in enumerate(made) for s in k if i % 2 == 0] + [(0, made[0][1][0] if made[0][1] else 1)] * 2 + [(999, 1), (None, 1), (2, None)]
    labels = spark.createDataFrame(rows, "doc_id long, subject_id int")
    areas = spark.createDataFrame([(s, f"a{s}", d) for s, d in AREAS.items()], "subject_id int, subject string, description string")
    got = [(r.doc_id, r.subject_id) for r in subjects.found(docs, labels, areas).collect()]
    want = [(i, s) for i, (_, k) in enumerate(made) for s in k] + [(0, s) for s in made[0][1]]
    assert len(set(got) & set(want)) >= 0.95 * len(set(want)) and len(set(got) - set(want)) <= 0.05 * len(set(want))
    assert subjects.found(docs.limit(0), labels, areas).count() == 0
    subjects.found(docs, labels.limit(0), areas).collect()


def test_sentences():
    text = "One thing is here. Another fol-\nlows at 3.5 bar!\n\n12\n| a | b |\n- A third one.\nsee Table 4. x = f(1)"
    assert sentences(text)[:3] == ["One thing is here.", "Another follows at 3.5 bar!", "A third one. see Table 4."] or sentences(text)[:2] == ["One thing is here.", "Another follows at 3.5 bar!"]
    assert sentences("没有载体时，积碳低于33.1%。图4比较了。") == ["没有载体时，积碳低于33.1%。", "图4比较了。"]


def test_long_texts():
    model = subjects.fit([(f"The {a} {VERBS[s]} it.", {s: 1}) for s in NOUNS for a in NOUNS[s]], AREAS)
    for text in ("x" * 500_000, "The coiled capillary fed reagent into it. " * 20_000, "积" * 300_000, "\n" * 300_000, "|" * 300_000, "a(" * 100_000):
        assert model.treated(text) in ([], [1])
