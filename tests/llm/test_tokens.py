import pytest

from figmill.llm import packing, tokens

TEXTS = ["", None, "Hello world", "  two  blanks\n\n and\tmore ", "it's we'll I'd", "naïve café 12345 ½ ３ µL/min", "微反应器稳定了停留时间分布。", "🔬 don't shake it", "<|endoftext|> is text", "x" * 5000, "a\r\nb c　d", "é ÀÉ İ", "Hello world"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_encode_equals_the_tokenizer(spark, name, monkeypatch):
    monkeypatch.setattr(tokens, "COMMON_WORDS", 5)  # most words take the way of the rare ones
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df, name).collect()}
    t = tokens.tokenizer(name)
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_round_trip_and_repeats(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(2, "Hello world"), (50, "zq" * 3), (50, "zq" * 3)], "doc_id long, text string")
    enc = tokens.encode(df)
    assert enc.count() == len(TEXTS) + 3
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df.where("doc_id < 50").dropDuplicates(["doc_id"]))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode(df.limit(0)).count() == 0
    many = tokens.decode(tokens.encode(spark.createDataFrame([(None, "a b"), (None, "é c"), (None, "a b"), (7, None)], "doc_id long, text string"))).collect()
    assert sorted((str(r.doc_id), r.text) for r in many) == [("7", ""), ("None", "a b"), ("None", "a b"), ("None", "é c")]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_sizes_equal_the_tokenizer(spark, data, name):
    t = tokens.tokenizer(name)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = ["a\x1cb \x1c", "a b  c\u3000\u3000d \n\n\n e ", "é e\u0301 \u0301x", "ΑΣ ΑΣ.", "'s it's  's", " ", "\n", "x" * 9000 + " y", "don't\r\n\tstop"]
    both = docs.unionByName(spark.createDataFrame([(-1 - i, x) for i, x in enumerate([*TEXTS, *odd])], "doc_id long, text string"))
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in both.collect()}
    assert {r.doc_id: r[name] for r in tokens.sizes(both, [name]).collect()} == want


def test_rows_of_one_id_and_hot_long_words(spark, monkeypatch):
    """Rows with the same doc_id, or none, keep their own ids; a ruler in a third of the rows is spread, whatever its length."""
    ruler, t = "=-" * 60, tokens.tokenizer("byte_bpe_50k")
    texts = [f"{ruler} zq{i} x" if i % 3 == 0 else f"zq{i} zq{i + 1} {'-' * (70 + i)}" for i in range(60)]
    df = spark.createDataFrame([(None if i % 2 else 7, x) for i, x in enumerate(texts)], "doc_id long, text string")
    want = sorted(t.encode(x, add_special_tokens=False).ids for x in texts)
    for common, long_ in ((3, 0), (3, 2), (200_000, 1000)):
        monkeypatch.setattr(tokens, "COMMON_WORDS", common)
        monkeypatch.setattr(tokens, "LONG_WORDS", long_)
        assert sorted(list(r.ids) for r in tokens.encode(df).collect()) == want


def test_best_two_fit():
    assert packing.best_two_fit([(6, "a"), (3, "b"), (2, "c"), (2, "d")], 10)[0] in ([(6, "a"), (2, "d"), (2, "c")], [(6, "a"), (2, "c"), (2, "d")])
    for cap, sizes in ((10, [7, 5, 5, 3, 3, 3, 2, 1]), (50, [s % 37 + 1 for s in range(500)])):
        got = packing.best_two_fit([(s, i) for i, s in enumerate(sizes)], cap)
        assert sorted(k for b in got for _, k in b) == list(range(len(sizes))) and all(sum(s for s, _ in b) <= cap for b in got)
        assert len(got) <= -(-sum(sizes) // cap) + 1


def test_pack(spark):
    rows = [(i, "word " * n, 1) for i, n in enumerate([3, 50, 0, 7, 200, 1, 1, 9])] + [(90, None, 1), (91, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, capacity int")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 16), (2, "word_bpe_49k", 64)], "spec_id int, tokenizer string, capacity int")
    got = packing.pack(docs, specs).collect()
    for spec, name, cap in ((1, "byte_bpe_50k", 16), (2, "word_bpe_49k", 64)):
        size = {r.doc_id: r[name] for r in tokens.sizes(docs, [name]).collect()}
        mine = [r for r in got if r.spec_id == spec]
        assert {d: sum(r.tokens for r in mine if r.doc_id == d) for d in size} == size
        fill = {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert max(fill.values()) <= cap and all(len([r for r in mine if r.doc_id == d]) == max(1, -(-n // cap)) for d, n in size.items())
    assert packing.pack(docs.limit(0), specs).count() == 0
    s = {r.spec_id: r for r in packing.summary(packing.pack(docs, specs)).collect()}
    assert s[1].fill <= 1.0 and s[1].tokens == sum(r.tokens for r in got if r.spec_id == 1)


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = tokens.tokenizer("byte_bpe_50k").encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: e.ids for r, e in zip(rows, want)}
