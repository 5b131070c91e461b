"""Encoding of a corpus with a public tokenizer (problem 6).

A table of distinct words is the core: Spark splits the texts into words, every
distinct word is encoded once, and the ids are joined back by position. The most
frequent words (a bounded table) are joined on the map side; only the rare
rest is shuffled, by word, where no key is hot (long words, which may be, are spread). Decoding joins ids with the
tokenizer's pieces.

Edge cases: null and empty texts have an empty list of ids; special tokens in a
text are ordinary text; repeated rows come out as often as they went in; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from figmill.session import cut

VOCABULARIES = os.environ.get("FIGMILL_TOKENIZERS", "/opt/tokenizers")
#: Words of the table that is joined on the map side, of up to COMMON_LENGTH characters; besides, so many longer ones of up
#: to LONG_LENGTH (rulers, say). What is rarer or longer is joined by a shuffle, words over COMMON_LENGTH spread over SALTS.
COMMON_WORDS, COMMON_LENGTH, LONG_WORDS, LONG_LENGTH, SALTS = 200_000, 64, 1000, 4096, 16
#: The public split patterns of the tokenizers, in Java's notation for Unicode classes.
BYTE_SPLIT = r" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\p{IsWhite_Space}\p{L}\p{N}]++|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
WORD_SPLIT = r"\p{L}++|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\p{IsWhite_Space}\p{L}\p{N}]++"
SPLITS = {"byte_bpe_50k": BYTE_SPLIT, "word_bpe_49k": WORD_SPLIT}
#: Unicode's white space, and the parts of a text between which no token reaches, by tokenizer.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = {"byte_bpe_50k": re.compile(rf" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]"), "word_bpe_49k": re.compile(rf"[^{_BLANK}]+")}


@lru_cache(8)
def tokenizer(name: str, folder: str = VOCABULARIES):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    t.encode_special_tokens = True
    return t


def _normalised(docs: DataFrame, name: str, folder: str) -> DataFrame:
    """doc_id and text as the tokenizer sees it; a tokenizer without a normaliser leaves texts in the JVM."""
    slim = docs.select("doc_id", "text")
    if tokenizer(name, folder).normalizer is None:
        return slim

    @F.pandas_udf("string")
    def norm(text: pd.Series) -> pd.Series:
        f = tokenizer(name, folder).normalizer.normalize_str
        return text.map(lambda s: s if s is None else f(s))

    return slim.withColumn("text", norm("text"))


def word_arrays(docs: DataFrame, name: str, folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, words: the words of each text in order; null for a null text."""
    return _normalised(docs, name, folder).select("doc_id", F.regexp_extract_all("text", F.lit(SPLITS[name]), F.lit(0)).alias("words"))


def lexicon(docs: DataFrame, name: str, folder: str = VOCABULARIES) -> DataFrame:
    """word, n, ids: every distinct word of the corpus with its count, encoded once."""
    counts = word_arrays(docs, name, folder).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(name, folder)
        for pdf in it:
            for at in range(0, len(pdf), 5000):
                part = pdf.iloc[at : at + 5000]
                yield part.assign(ids=[e.ids for e in t.encode_batch(part.word.tolist(), add_special_tokens=False)])

    return counts.mapInPandas(run, "word string, n long, ids array<int>")


def _mapped(batch: pa.RecordBatch, known: dict[str, list[int]]) -> pa.RecordBatch:
    """doc_id, ids, gap_at, gap_word of a batch of doc_id, words: the ids of known words and, for each other word,
    the place in ids where its own belong. Each distinct word of the batch is looked up once, the rest is array work."""
    words = batch.column(1)
    per_doc = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(pc.list_flatten(words))
    names = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = [known.get(w) for w in names]
    size = np.array([0 if f is None else len(f) for f in found], dtype=np.int64)
    start = np.cumsum(size) - size
    flat = np.fromiter((i for f in found if f is not None for i in f), dtype=np.int32, count=int(size.sum()))
    n = size[index]
    ends = np.cumsum(n)
    ids = flat[np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(start[index], n)] if len(index) else np.zeros(0, np.int32)
    word_end = np.cumsum(per_doc)
    before = np.concatenate([[0], ends])  # ids before each word
    edges = np.concatenate([[0], before[word_end]])
    missing = np.flatnonzero(np.array([f is None for f in found], dtype=bool)[index]) if len(index) else np.zeros(0, np.int64)
    owner = np.searchsorted(word_end, missing, side="right")
    gap_edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(per_doc)))])
    lists = lambda edge, values: pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), values)
    gap_at = pa.array((before[missing] - edges[owner]).astype(np.int32))
    gap_word = coded.dictionary.take(pa.array(index[missing])) if len(missing) else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0), lists(edges, pa.array(ids, pa.int32())), lists(gap_edges, gap_at), lists(gap_edges, gap_word.cast(pa.string()))], names=["doc_id", "ids", "gap_at", "gap_word"])


def encode(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, ids: the token ids of each text, one row per row of the input."""
    spark: SparkSession = docs.sparkSession
    lex = cut(lexicon(docs, name, folder))
    size = F.length("word")
    common = lex.where(size <= COMMON_LENGTH).orderBy(F.desc("n"), "word").limit(COMMON_WORDS).unionByName(lex.where((size > COMMON_LENGTH) & (size <= LONG_LENGTH)).orderBy(F.desc("n"), "word").limit(LONG_WORDS))
    # a bounded number of words of bounded length
    known = {r.word: r.ids for r in common.select("word", "ids").toLocalIterator()}
    whole_lexicon = lex.count() == len(known)
    table = spark.sparkContext.broadcast(known)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in it:
            for at in range(0, batch.num_rows, 2048):
                yield _mapped(batch.slice(at, 2048), known)

    mapped = word_arrays(docs, name, folder).mapInArrow(run, "doc_id long, ids array<int>, gap_at array<int>, gap_word array<string>")
    if whole_lexicon:  # no word is left to be joined
        return mapped.select("doc_id", "ids")
    # read three times below, so it is written once; a row's number is stored with it
    mapped = cut(mapped.withColumn("uid", F.monotonically_increasing_id()))
    whole = mapped.where("size(gap_at) = 0").select("doc_id", "ids")
    open_ = mapped.where("size(gap_at) > 0")
    long_ = F.length("word") > COMMON_LENGTH
    asked = open_.select("uid", F.posexplode(F.arrays_zip("gap_at", "gap_word")).alias("k", "g")).select("uid", "k", F.col("g.gap_at").alias("at"), F.col("g.gap_word").alias("word")).withColumn("salt", F.when(long_, F.pmod("uid", F.lit(SALTS)).cast("int")).otherwise(0))
    spread = lex.select("word", F.col("ids").alias("piece"), F.explode(F.when(long_, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    filled = asked.join(spread, ["word", "salt"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "at", "piece"))).alias("fill"))

    def splice(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for ids, fill in zip(pdf.ids, pdf.fill):
                out, last = [], 0
                for f in fill:
                    out += [*ids[last : f["at"]].tolist(), *f["piece"]]
                    last = f["at"]
                rows.append(out + ids[last:].tolist())
            yield pd.DataFrame({"doc_id": pdf.doc_id, "ids": rows})

    return whole.unionByName(open_.select("doc_id", "ids", "uid").join(filled, "uid").select("doc_id", "ids", "fill").mapInPandas(splice, "doc_id long, ids array<int>"))


def sizes(docs: DataFrame, names: list[str], folder: str = VOCABULARIES) -> DataFrame:
    """doc_id and, for each tokenizer, a column of its name: the length of each text in tokens.

    Ids aren't needed for that: the length is the sum over the parts of a text that no token crosses (words with their
    marks, blanks), and each distinct part is encoded once in a task. One pass over the texts, nothing is shuffled."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, dict[str, int]] = {n: {} for n in names}
        for pdf in it:
            out = {"doc_id": pdf.doc_id}
            for n in names:
                known, t, find = seen[n], tokenizer(n, folder), PARTS[n].findall
                lengths = []
                for text in pdf.text:
                    parts = find(text) if text else []
                    if new := set(parts).difference(known):
                        new_ = list(new)
                        known.update(zip(new_, (len(e) for e in t.encode_batch(new_, add_special_tokens=False))))
                    lengths.append(sum(map(known.__getitem__, parts)))
                    if new and (len(known) > 300_000 or max(map(len, new)) > 4096):  # keep it small; long parts seldom return
                        known.clear()
                out[n] = lengths
            yield pd.DataFrame(out)

    return docs.select("doc_id", "text").mapInPandas(run, ", ".join(["doc_id long", *(f"{n} int" for n in names)]))


def pieces(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """id, piece: the bytes of every id of a byte-level vocabulary (a table of fixed size)."""
    rows = [line.split() for line in open(os.path.join(folder, f"{name}.tiktoken"), "rb")]
    return spark.createDataFrame(pd.DataFrame({"id": [int(i) for _, i in rows], "piece": [base64.b64decode(b) for b, _ in rows]}), "id int, piece binary")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, text: ids joined with their pieces; an empty list gives an empty text; one row per row."""
    table = F.broadcast(pieces(encoded.sparkSession, name, folder))
    # rows of the same doc_id are told apart by their ids; equal rows are decoded once and given back as often. The lists are
    # brought to their row's place before they are taken apart, so that no single token is shuffled
    rows = encoded.select("doc_id", "ids", F.xxhash64("ids").alias("row")).repartition("doc_id", "row")
    flat = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("pos", "id")).join(table, "id", "left")
    first = F.count_if(F.coalesce("pos", F.lit(0)) == 0).cast("int").alias("n")
    parts = flat.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("pos", F.hex("piece").alias("hex")))).alias("parts"), first)
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "UTF-8").alias("text")
    return parts.select("doc_id", text, F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc_id", "text")
