"""Repair of text from scanned pages (problem 2).

An averaged-perceptron editor (``editor``) turns misread words into words of the
corpus by keep, replace, delete and insert operations on their characters and
joins words at line ends; two perceptrons over a line's place on its page and the
corpus counts of its outline find running headers and page numbers (``furniture``).

How it runs. One pass over the texts counts words, lines that may be furniture and
pairs of word parts; copies of a document or packet together count once. All
judgements are made on these tables in Spark, once for each distinct word, pair and
line: words meet their possible corrections by an equi-join on keys, counts are
looked up by joins. The models learn from a bounded sample (TRAIN_WORDS,
``furniture.EXAMPLES``). A last pass over the texts puts the verdicts in place: the
most frequent ones (COMMON) are sent to the tasks; texts that hold any other key
ask for theirs by a shuffle and are done in a second step, so that the result
doesn't depend on COMMON.

Edge cases: null and empty texts have no defects; lines may end in \\r\\n; numbers
in tables, suspended hyphens (pre- and post-), compounds at a line end, formulas
and words in other scripts are no defects; repeated rows give rows each; an empty
table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from figmill.llm import furniture
from figmill.llm.editor import LONGEST, USUAL, Editor, Trigrams, damaged, is_word, keys, misreading, places
from figmill.llm.furniture import MARKS, Furniture
from figmill.llm.perceptron import Perceptron
from figmill.session import cut

#: Verdicts of each kind that are sent to the tasks; words the editor learns from; groups of copies that are joined by broadcast.
COMMON, TRAIN_WORDS, SENT_COPIES = 200_000, 4000, 500_000
#: A word with another one beside it that is seen over DOMINANCE times as often may itself be misread and isn't learned from.
DOMINANCE = 25
WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
UNSEEN = re.compile("[\u200b-\u200f\u2060-\u2064\ufeff]")
BROKEN_END = re.compile(rf"([^\W_][^\W_'’-]*(?:[-'’][^\W_]+)*)([{MARKS}])[ \t]*$")
BROKEN_INSIDE = re.compile(rf"(?<=[^\W_])([{MARKS}])[ \t]+(?=[^\W\d_])")
STARTS = re.compile(r"[^\W\d_][^\W_]*(?:[-'’][^\W_]+)*")
_BREAK_LINE = re.compile(rf"[{MARKS}][ \t]*\r?\n")
_BREAK_ITEM = re.compile(rf"(?<=[^\W\d_])[{MARKS}]\s+")


def _pair(first: str, mark: str, second: str) -> str:
    return f"{first}\t{mark}\t{second}"


class Page:
    """The lines of a text with what may be furniture and what may be a broken word."""

    def __init__(self, text: str, inside: bool):
        self.lines = lines = [x.strip(" \t\r") for x in text.split("\n")]
        self.marks = {i: (k, f"{k}\t{p}") for i, k, p in furniture.candidates(lines)}
        #: line of the first part -> (line of the second, first, mark, second), for each line that may follow it
        self.ends: dict[int, list[tuple[int, str, str, str]]] = {}
        for a, x in enumerate(lines[:-1]):
            if x and x[-1] in MARKS and (m := BROKEN_END.search(x[-2 * LONGEST :])):
                for b in range(a + 1, len(lines)):
                    if not lines[b]:
                        break
                    if s := STARTS.match(lines[b][: 2 * LONGEST]):
                        self.ends.setdefault(a, []).append((b, m[1], m[2], s[0]))
                    if b not in self.marks:
                        break
        #: (line, first, mark, second) of breaks within a line
        self.within: list[tuple[int, str, str, str]] = []
        if inside:
            for i, x in enumerate(lines):
                for m in BROKEN_INSIDE.finditer(x):
                    first, s = BROKEN_END.search(x[max(0, m.end(1) - 2 * LONGEST) : m.end(1)]), STARTS.match(x, m.end())
                    if first and s and len(s[0]) <= LONGEST:
                        self.within.append((i, first[1], m[1], s[0]))

    def pairs(self) -> Iterator[tuple[str, str, str]]:
        for e in self.ends.values():
            for _, f, m, s in e:
                yield f, m, s
        for _, f, m, s in self.within:
            yield f, m, s

    def settle(self, is_furniture: Callable[[str], bool], joins: Callable[[str], bool]) -> None:
        """Fill in the verdicts: number, header (by line), broken and inside (joined words)."""
        self.number = [False] * len(self.lines)
        self.header = [False] * len(self.lines)
        for i, (k, ask) in self.marks.items():
            if is_furniture(ask):
                (self.number if k[0] == "#" else self.header)[i] = True
        out = [n or h for n, h in zip(self.number, self.header)]
        self.broken: list[tuple[int, int, str, str, str]] = []
        for a, options in self.ends.items():
            if not out[a]:
                b = next((b for b in range(a + 1, len(self.lines)) if not out[b]), None)
                self.broken += [(a, b, f, m, s) for at, f, m, s in options if at == b and joins(_pair(f, m, s))]
        self.inside = [(i, f, m, s) for i, f, m, s in self.within if not out[i] and joins(_pair(f, m, s))]

    def bodies(self, keep: bool = False) -> Iterator[tuple[int, str, list[str]]]:
        """(line, its text, its joined words): lines that aren't furniture, with the parts of broken words taken out
        or, with ``keep``, joined in place at their first line."""
        tail = {a: (f + m, f + s) for a, _, f, m, s in self.broken}
        head = {b: s for _, b, _, _, s in self.broken}
        inside: dict[int, list[tuple[str, str, str]]] = {}
        for i, first, mark, second in self.inside:
            inside.setdefault(i, []).append((first, mark, second))
        for i, x in enumerate(self.lines):
            if not x or self.number[i] or self.header[i]:
                continue
            joined = []
            if i in head:
                x = x[len(head[i]) :].lstrip(" ") if keep else x[len(head[i]) :]
                if keep and x[:1] in (".", ",", ";", ":", ")"):  # goes to the joined word above
                    joined.append("")
            if i in tail and x.endswith(tail[i][0]):
                x = x[: -len(tail[i][0])]
                if keep:
                    x += tail[i][1]
                else:
                    joined.append(tail[i][1])
            for first, mark, second in inside.get(i, ()):
                x = re.sub(re.escape(first + mark) + r"[ \t]+" + re.escape(second), (lambda m, w=first + second: w) if keep else " ", x, count=1)
                if not keep:
                    joined.append(first + second)
            yield i, x, joined


# --- texts and counts ---------------------------------------------------------

ITEM = "origin string, row_id long, field string, item_no int, text string"
_TEXTS = ("x_axis_title", "chart_text", "legend_text")


def items_of(docs: DataFrame, packets: DataFrame) -> DataFrame:
    """origin, row_id, field, item_no, text, record, head: the texts of documents and, each with its place in its array, the
    captions and the texts of x-axis titles, charts and legends of packets. ``record`` is a hash of all texts of the row,
    ``head`` is true for one of them."""
    one = docs.select(F.lit("document").alias("origin"), F.col("doc_id").alias("row_id"), F.lit("text").alias("field"), F.lit(0).alias("item_no"), "text", F.xxhash64("text").alias("record"), F.lit(True).alias("head")).where("length(text) > 0")
    fields = [F.array(F.struct(F.lit("caption").alias("field"), F.lit(0).alias("item_no"), F.col("meta.caption").alias("text")))]
    for f in _TEXTS:
        name = F.lit(f).alias("field")
        at = F.transform(F.col(f"text_evidence.{f}.text"), lambda x, i: F.struct(name, i.alias("item_no"), x.alias("text")))  # noqa: B023
        fields.append(F.coalesce(at, F.array().cast("array<struct<field: string, item_no: int, text: string>>")))
    record = F.xxhash64("meta.caption", *(F.col(f"text_evidence.{f}.text") for f in _TEXTS))
    full = F.filter(F.concat(*fields), lambda x: F.length(x["text"]) > 0)
    rows = packets.select(F.lit("packet").alias("origin"), F.col("packet_id").alias("row_id"), record.alias("record"), F.posexplode(full).alias("pos", "i"))
    return one.unionByName(rows.select("origin", "row_id", "i.field", "i.item_no", "i.text", "record", (F.col("pos") == 0).alias("head")))


def weighted(items: DataFrame) -> DataFrame:
    """origin, text, weight: a text of a record with k copies counts 1/k, so that copies together count once and no text
    need be shuffled. The records with copies, two numbers each, are joined by broadcast while they are few."""
    copies = cut(items.where("head").groupBy("origin", "record").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    few = copies.limit(SENT_COPIES + 1).count() <= SENT_COPIES
    return items.join(F.broadcast(copies) if few else copies, ["origin", "record"], "left").select("origin", "text", F.coalesce(F.lit(1.0) / F.col("k"), F.lit(1.0)).alias("weight"))


def without_broken(text: str, breaks: re.Pattern) -> str:
    """A text without the chunks on both sides of each break."""
    out, last = [], 0
    for m in breaks.finditer(text):
        if m.start() < last:
            continue
        start, end = m.start(), m.end()
        while start > last and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        out.append(text[last:start])
        last = end
    return " ".join([*out, text[last:]])


def corpus_counts(items: DataFrame) -> DataFrame:
    """kind, key, n: counts of words (w), pairs of parts (p) and places of lines that may be furniture (t), from origin, text, weight.

    Parts of broken words count 0 and are listed all the same, as are the words that they may make. Each task sends one
    row per distinct key."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks: Counter[str] = Counter()
        words: Counter[str] = Counter()
        other: dict[str, Counter[str]] = {"p": Counter(), "t": Counter()}

        def out() -> pd.DataFrame:
            for c, n in chunks.items():
                for w in WORD.findall(c):
                    if len(w) <= LONGEST:
                        words[w] += n
                        if "-" in w:  # its parts are words, too
                            for x in w.split("-"):
                                words[x] += n
            rows = [("w", k, n) for k, n in words.items()] + [(kind, k, n) for kind, c in other.items() for k, n in c.items()]
            for c in (chunks, words, *other.values()):
                c.clear()
            return pd.DataFrame(rows, columns=["kind", "key", "n"])

        for pdf in it:
            for origin, text, weight in zip(pdf.origin, pdf.text, pdf.weight):
                text = UNSEEN.sub("", text)
                page = Page(text, origin == "packet")
                pairs = list(page.pairs())
                bare = text
                if pairs:
                    bare = without_broken(text, _BREAK_ITEM if origin == "packet" else _BREAK_LINE)
                    for f, m, s in pairs:
                        other["p"][_pair(f, m, s)] += weight
                        words[f + s] += 0
                    for c in text.split():
                        chunks[c] += 0
                if weight == 1.0:
                    chunks.update(bare.split())
                else:
                    for c in bare.split():
                        chunks[c] += weight
                for _, ask in page.marks.values():
                    other["t"][ask] += weight
            if len(chunks) > 400_000:
                yield out()
        yield out()

    part = items.mapInPandas(run, "kind string, key string, n double")
    return part.groupBy("kind", "key").agg(F.round(F.sum("n"), 6).alias("n"))


# --- judgement, once for each distinct key -------------------------------------


def _mapped(df: DataFrame, f: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows of f(*row) for every row, batch by batch."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([r for row in pdf.itertuples(index=False) for r in f(*row)], columns=names)

    return df.mapInPandas(run, schema)


def judged_lines(counts: DataFrame) -> DataFrame:
    """key, n, say: is a line of this outline at this place furniture?"""
    rows = counts.where("kind = 't'").select("key", "n", F.substring_index("key", "\t", 1).alias("outline"), F.substring_index("key", "\t", -1).alias("place"))
    near = F.substring("place", 3, 1).isin("#", "n") | F.substring("place", 5, 1).isin("#", "n")
    when = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0.0))
    stats = rows.groupBy("outline").agg(F.sum("n").alias("all_n"), when(near).alias("near"), when(F.substring("place", 6, 1) == "a").alias("inside"), when(F.substring("place", 7, 1) == "d").alias("numbered"))
    full = cut(rows.join(stats, "outline").select("key", "n", "outline", "place", "all_n", "near", "inside", "numbered"))
    cols = ["outline", "place", "all_n", "near", "inside", "numbered"]
    own = []
    for test in ("outline like '#%'", "outline not like '#%' and near + numbered > 0", "outline not like '#%' and near + numbered = 0"):
        own += [tuple(r) for r in full.where(test).orderBy(F.xxhash64("key"), "key").limit(furniture.EXAMPLES).select(*cols).collect()]
    model = full.sparkSession.sparkContext.broadcast(Furniture().train(own))
    return _mapped(full, lambda key, n, *row: [(key, n, model.value.judge(row))], "key string, n double, say boolean")


def _sample(counts: DataFrame) -> list[tuple[str, float]]:
    """Words to learn from: half the most frequent ones, half by a hash."""
    words = counts.where("kind = 'w' and n >= 3").where(F.col("key").rlike(r"^[\p{L}'’-]{3,}$")).select("key", "n")
    got = {r.key: r.n for order in ([F.desc("n"), "key"], [F.xxhash64("key"), "key"]) for r in words.orderBy(*order).limit(TRAIN_WORDS // 2).collect()}
    return sorted(((w, n) for w, n in got.items() if is_word(w)), key=lambda x: (-x[1], x[0]))


def judged_words(counts: DataFrame, sample: list[tuple[str, float]], editor: Editor, seed: int = 11) -> DataFrame:
    """key, n, say: every word that may be misread, with its correction or null.

    Words meet those that are seen more often on the keys of ``editor.keys``; a pair is scored once. What is itself
    misread is then no correction of another word."""
    spark, rng = counts.sparkSession, random.Random(seed)
    harm: list[tuple[str, str]] = []
    for v, _ in sample:
        for _ in range(2):
            if (w := damaged(v, rng)) != v and is_word(w):
                harm.append((w, v))
    asked = sorted({w for w, _ in harm} | {w for w, _ in sample})
    own = counts.where("kind = 'w'").select("key", "n")
    real = _mapped(own, lambda w, n: [(w, n, k, False) for k in keys(w)] if is_word(w) else [], "w string, n double, k string, train boolean")
    extra = _mapped(spark.createDataFrame([(w,) for w in asked], "w string").repartition(1), lambda w: [(w, 0.0, k, True) for k in keys(w)], "w string, n double, k string, train boolean")
    meet = cut(real)
    right = meet.where("n >= 2").select("k", F.col("w").alias("v"), F.col("n").alias("have"))
    pairs = cut(meet.unionByName(extra).join(right, "k").where("have > n and (train or v <> w)").select("w", "n", "train", "v", "have").distinct())

    # training, on what the sample meets
    near: dict[str, list[tuple[str, float]]] = {}
    for r in sorted(pairs.where("train").select("w", "v", "have").collect()):
        near.setdefault(r.w, []).append((r.v, r.have))
    count = dict(sample)

    def usual(w: str, v: str) -> bool:
        s = places(w, v)
        return bool(s) and all(f"{a}>{b}".lower() in USUAL for _, a, b in s)

    # a word with a far more frequent one beside it may itself be misread and would teach the wrong thing
    good = {w for w, n in sample if not any(have > DOMINANCE * n and usual(w, v) for v, have in near.get(w, ()) if v != w)}
    examples: list[tuple[list[str], bool]] = []

    def show(w: str, n: float, v: str, have: float, right: bool) -> None:
        script = places(w, v)
        if script and misreading(w, script):
            examples.append((editor.features(w, n, v, have, script, named=rng.random() < 0.7), right))

    for w, truth in harm:
        n = count[truth]
        met = dict(near.get(w, ()))
        if truth not in good or met.pop(w, 0.0) > n / 25:
            continue
        seen = max(1, int(n / rng.choice((25, 40, 60, 200, 400, 1000)))) if rng.random() < 0.7 else 1
        hidden = rng.random() < 0.12 and n < 50  # a word the corpus holds in its damaged form only
        for v, have in met.items():
            if have > seen and not (hidden and v == truth):
                show(w, seen, v, have, v == truth)
        for v in editor.proposals(w):
            if v not in met or hidden and v == truth:
                show(w, seen, v, 0.0, v == truth)
    for w, n in sample:
        if w not in good:
            continue
        # the word itself, at its own count and as if it were rare
        met = {v: have for v, have in near.get(w, ()) if v != w}
        for m in {n, max(1, n // rng.choice((1, 2, 8))), max(1, n // rng.choice((30, 100, 1000)))}:
            for v, have in met.items():
                # else w may itself be a misread word, unless the change is an unusual one
                if have > m and (have < 20 * m or not usual(w, v)):
                    show(w, m, v, have, False)
            for v in editor.proposals(w):
                if v not in met:
                    show(w, m, v, 0.0, False)
    editor.words = Perceptron.train(examples, 6, seed)

    sent = spark.sparkContext.broadcast(editor)
    whole = lambda w, n, v, have: [(w, v, have, s)] if (s := sent.value.score(w, max(1.0, n), v, have)) > 0 else []
    met_ = _mapped(pairs.where("not train").select("w", "n", "v", "have"), whole, "w string, v string, have double, score double")
    free = _mapped(own, lambda w, n: [(w, n, v) for v in sent.value.proposals(w)] if is_word(w) else [], "w string, n double, v string").join(own.select(F.col("key").alias("v")), "v", "left_anti")
    new = _mapped(free.select("w", "n", "v", F.lit(0.0).alias("have")), whole, "w string, v string, have double, score double")
    scored = cut(met_.unionByName(new))
    best = lambda df: df.groupBy("w").agg(F.max_by("v", F.struct("score", "have", "v")).alias("say"))
    misread = best(scored).select(F.col("w").alias("v"))
    fixes = best(scored.join(misread, "v", "left_anti"))
    return own.join(fixes.withColumnRenamed("w", "key"), "key", "left").select("key", "n", "say")


def judged_pairs(counts: DataFrame, judged: DataFrame, sample: list[tuple[str, float]], editor: Editor, seed: int = 12) -> DataFrame:
    """key, n, say: is the mark between two parts a break of one word? A misread form counts as often as its correction (``judged``)."""
    spark, rng = counts.sparkSession, random.Random(seed)
    own = counts.where("kind = 'w'").select("key", "n")
    better = judged.where("say is not null").join(own.select(F.col("key").alias("say"), F.col("n").alias("seen")), "say").select("key", "seen")
    words = own.join(better, "key", "left").select("key", F.coalesce("seen", "n").alias("n"))
    good = [w for w, _ in sample]
    examples: list[tuple[str, str, str, bool, bool]] = []  # first, mark, second, is a break, as if never seen whole
    for w in good:
        if len(w) >= 5 and "-" not in w:
            i = rng.randrange(2, len(w) - 2)
            examples.append((w[:i], rng.choice("---‐‑¬\u00ad"), w[i:], True, rng.random() < 0.3))
    compounds = [r.key for r in words.where("n >= 2").where(F.col("key").rlike(r"^[^-]+-.*[^-]$")).orderBy(F.xxhash64("key"), "key").limit(TRAIN_WORDS).collect()]
    for w in (rng.choice(compounds) for _ in range(len(examples) if compounds else 0)):
        i = rng.choice([k for k, c in enumerate(w) if c == "-"])
        if w[:i] and w[i + 1 :]:
            examples.append((w[:i], rng.choice("-------‐‑"), w[i + 1 :], False, False))
    for _ in range(len(good) // 4):
        examples.append((rng.choice(good), rng.choice("----‐"), rng.choice(good[:60]), False, False))
    rows = [(i, f, m, s) for i, (f, m, s, _, _) in enumerate(examples)]
    mine = spark.createDataFrame(rows, "no long, first string, mark string, second string").selectExpr("no", "concat_ws('\t', first, mark, second) as key", "0.0D as n")
    asks = counts.where("kind = 'p'").selectExpr("cast(null as long) as no", "key", "n").unionByName(mine)
    part = F.split("key", "\t")
    parts = asks.select("no", "key", "n", part[0].alias("first"), part[1].alias("mark"), part[2].alias("second"))
    forms = F.array(*(F.struct(F.lit(i).alias("slot"), f.alias("form")) for i, f in enumerate((F.concat("first", "second"), F.concat("first", F.lit("-"), "second"), F.col("first"), F.col("second")))))
    looked = parts.withColumn("f", F.explode(forms)).select("no", "key", "n", "f.slot", "f.form").join(words.select(F.col("key").alias("form"), F.col("n").alias("seen")), "form", "left")
    slot = lambda i: F.coalesce(F.max(F.when(F.col("slot") == i, F.col("seen"))), F.lit(0.0)).alias(f"c{i}")
    full = cut(looked.groupBy("no", "key").agg(F.max("n").alias("n"), *map(slot, range(4))))
    shown = []
    for r in sorted(full.where("no is not null").collect(), key=lambda r: r.no):
        first, mark, second, is_break, unseen = examples[r.no]
        shown.append((editor.end_features(first, second, mark, 0.0 if unseen else r.c0, r.c1, r.c2, r.c3), is_break))
    editor.ends = Perceptron.train(shown, 6, seed)
    sent = spark.sparkContext.broadcast(editor)

    def judge(key: str, n: float, *seen: float) -> list[tuple]:
        first, mark, second = key.split("\t")
        return [(key, n, sent.value.joins(first, second, mark, *seen))]

    return _mapped(full.where("no is null").select("key", "n", "c0", "c1", "c2", "c3"), judge, "key string, n double, say boolean")


# --- verdicts in the texts -------------------------------------------------------


class _Open(Exception):
    """A text holds a key that was not sent."""


class Repairer:
    """The verdicts of the most frequent keys, as they are sent to the tasks. ``whole`` kinds hold all their keys."""

    def __init__(self, words: dict[str, str | None], pairs: dict[str, bool], lines: dict[str, bool], whole: frozenset[str]):
        self.words, self.pairs, self.lines, self.whole = words, pairs, lines, whole
        self.known: dict[str, tuple[tuple[str, str], ...]] = {}

    def _say(self, kind: str, table: dict, key: str) -> object:
        got = table.get(key, _Open)
        if got is _Open:
            if kind not in self.whole:
                raise _Open
            got = None
        return got

    def fix(self, w: str) -> str | None:
        """The correction of a word; None to keep it."""
        return self._say("w", self.words, w) if is_word(w) else None

    def chunk(self, c: str) -> tuple[tuple[str, str], ...]:
        """(word, correction) of the misread words of a chunk between blanks."""
        got = self.known.get(c)
        if got is None:
            if len(self.known) > 400_000:
                self.known.clear()
            got = self.known[c] = tuple((w, v) for w in WORD.findall(c) if (v := self.fix(w)) is not None)
        return got

    def page(self, origin: str, text: str) -> Page:
        page = Page(UNSEEN.sub("", text), origin == "packet")
        page.settle(lambda k: bool(self._say("t", self.lines, k)), lambda k: bool(self._say("p", self.pairs, k)))
        return page

    def asks(self, origin: str, text: str) -> set[tuple[str, str]]:
        """All keys that the verdicts on a text may need and that were not sent."""
        text = UNSEEN.sub("", text)
        page = Page(text, origin == "packet")
        pairs = list(page.pairs())
        out = {("t", a) for _, a in page.marks.values()} | {("p", _pair(*x)) for x in pairs}
        out |= {("w", w) for c in set(text.split()) for w in WORD.findall(c) if is_word(w)} | {("w", f + s) for f, _, s in pairs if is_word(f + s)}
        have = {"w": self.words, "p": self.pairs, "t": self.lines}
        return {(kind, k) for kind, k in out if kind not in self.whole and k not in have[kind]}

    def with_answers(self, answers: list[tuple[str, str, str | None]]) -> "Repairer":
        """A repairer that knows a text's other keys, too; what isn't answered has no verdict."""
        words, pairs, lines = dict(self.words), dict(self.pairs), dict(self.lines)
        for kind, key, say in answers:
            {"w": words, "p": pairs, "t": lines}[kind][key] = say if kind == "w" else say == "true"
        return Repairer(words, pairs, lines, frozenset("wpt"))

    def defects(self, origin: str, text: str) -> set[tuple[int, str]]:
        """(line, defect) of a text."""
        page = self.page(origin, text)
        out = {(i, "page_number") for i, x in enumerate(page.number) if x} | {(i, "header") for i, x in enumerate(page.header) if x}
        out |= {(a, "hyphen") for a, *_ in page.broken} | {(i, "hyphen") for i, *_ in page.inside}
        for i, line, joined in page.bodies():
            for c in line.split():
                if self.chunk(c):
                    out.add((i, "misread"))
            for w in joined:
                if self.fix(w) is not None:
                    out.add((i, "misread"))
        return out

    def repaired(self, origin: str, text: str) -> str:
        """The text as continuous paragraphs: furniture out, broken words joined, misread words corrected, wrapped lines joined.

        An item of a packet is one paragraph. Lines of a document are wrapped if many of them end within a sentence; then a line
        of over half the usual width goes on in the next."""
        page = self.page(origin, text)
        body = {i: (line, joined) for i, line, joined in page.bodies(keep=True)}
        lines = [page.lines[i] for i in body]
        wide = sorted(map(len, lines))
        width = wide[int(len(wide) * 0.8)] if wide else 0
        wrapped = origin == "packet" or 4 * sum(x[-1] not in ".!?:;" for x in lines) >= len(lines)
        joins = {a for a, *_ in page.broken}
        out: list[str] = []
        open_ = False
        for i, x in enumerate(page.lines):
            if page.number[i] or page.header[i]:
                continue
            if not x:
                open_ = False
                out.append("")
                continue
            line = body[i][0]
            if body[i][1] and out and open_:  # a mark that closes the word joined above
                out[-1] += line[0]
                line = line[1:].lstrip(" ")
            for c in set(line.split()):
                for w, v in self.chunk(c):
                    line = re.sub(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", v, line)
            free = bool(re.search(r"[|\t{}=<>]|^\d+$|^- |^T / ", x))
            if open_ and out and not free:
                out[-1] = f"{out[-1]} {line}".strip()
            elif line or not out:
                out.append(line)
            open_ = i in joins or not free and wrapped and (origin == "packet" or len(x) >= 0.55 * width)
        return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def learned(items: DataFrame) -> tuple[Repairer, dict[str, DataFrame]]:
    """The repairer with the most frequent verdicts and the tables (key, n, say) of all verdicts by kind."""
    counts = cut(corpus_counts(weighted(items)))
    word_rows = counts.where("kind = 'w' and n > 1").select("key", "n")
    tri: Counter[str] = Counter()

    def grams(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: Counter[str] = Counter()
        for pdf in it:
            part.update(Trigrams.count((w, n) for w, n in zip(pdf.key, pdf.n) if is_word(w)))
        yield pd.DataFrame(list(part.items()), columns=["t", "k"])

    # no more rows than there are trigrams of Latin letters and digits
    for r in word_rows.mapInPandas(grams, "t string, k double").groupBy("t").agg(F.round(F.sum("k"), 4).alias("k")).collect():
        tri[r.t] = r.k
    total = counts.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0.0
    sample = _sample(counts)
    editor = Editor(Trigrams(dict(sorted(tri.items()))), total)
    words = cut(judged_words(counts, sample, editor))
    tables = {"t": judged_lines(counts), "w": words, "p": judged_pairs(counts, words, sample, editor)}
    sent, whole = {}, set()
    for kind, t in tables.items():
        rows = t.orderBy(F.desc("n"), "key").limit(COMMON + 1).collect()
        if len(rows) <= COMMON:
            whole.add(kind)
        sent[kind] = {r.key: r.say for r in rows[:COMMON]}
    return Repairer(sent["w"], sent["p"], sent["t"], frozenset(whole)), tables


def _applied(items: DataFrame, step: Callable[[Repairer, str, str], list[tuple]], schema: str) -> DataFrame:
    """origin, row_id, field, item_no and the columns of the schema: step(repairer, origin, text) of every text."""
    slim = items.select("origin", "row_id", "field", "item_no", "text")
    tool, tables = learned(items)
    sent = items.sparkSession.sparkContext.broadcast(tool)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    head = ["origin", "row_id", "field", "item_no"]
    kinds = f"origin string, row_id long, field string, item_no int, {schema}"

    def done(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = sent.value
        for pdf in it:
            yield pd.DataFrame([(o, i, f, k, *x) for o, i, f, k, t in pdf.itertuples(index=False) for x in step(r, o, t)], columns=head + names)

    if len(tool.whole) == 3:  # all verdicts were sent: no text can be open
        return slim.mapInPandas(done, kinds)

    def tried(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = sent.value
        for pdf in it:
            rows = []
            for o, i, f, k, t in pdf.itertuples(index=False):
                try:
                    rows += [(o, i, f, k, *x, None, None) for x in step(r, o, t)]
                except _Open:
                    rows.append((o, i, f, k, *[None] * len(names), t, [f"{a}{b}" for a, b in sorted(r.asks(o, t))]))
            yield pd.DataFrame(rows, columns=[*head, *names, "whole_", "asks_"])

    # a text's number is stored with it, so a lost task finds the same one
    first = cut(slim.mapInPandas(tried, f"{kinds}, whole_ string, asks_ array<string>").withColumn("uid_", F.monotonically_increasing_id()))
    open_ = first.where("asks_ is not null")
    verdicts = None
    for kind, t in tables.items():
        one = t.where("say is not null").select(F.concat(F.lit(kind), "key").alias("ask"), F.col("say").cast("string").alias("say"))
        verdicts = one if verdicts is None else verdicts.unionByName(one)
    answers = open_.select("uid_", F.explode("asks_").alias("ask")).join(verdicts, "ask").groupBy("uid_").agg(F.collect_list(F.struct("ask", "say")).alias("answers"))

    def again(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for o, i, f, k, t, known in pdf.itertuples(index=False):
                r = sent.value.with_answers([] if known is None else [(a["ask"][0], a["ask"][1:], a["say"]) for a in known])
                rows += [(o, i, f, k, *x) for x in step(r, o, t)]
            yield pd.DataFrame(rows, columns=head + names)

    rest = open_.join(answers, "uid_", "left").select(*head, F.col("whole_").alias("text"), "answers").mapInPandas(again, kinds)
    return first.where("asks_ is null").select(*head, *names).unionByName(rest)


def found(docs: DataFrame, packets: DataFrame) -> DataFrame:
    """The columns of p2_found: the damaged places of all documents and packets."""


    def places_of(r: Repairer, origin: str, text: str) -> list[tuple]:
        got = r.defects(origin, text)
        # an item of a packet has one row for each defect, wherever in it that is
        return sorted(got) if origin == "document" else sorted({(0, d) for _, d in got})

    rows = _applied(items_of(docs, packets), places_of, "line int, defect string")
    at = F.when(F.col("origin") == "packet", F.col("item_no")).otherwise(F.col("line"))
    return rows.select("origin", "row_id", "field", at.cast("int").alias("item_no"), "defect")


def repaired(docs: DataFrame, packets: DataFrame) -> DataFrame:
    """origin, row_id, field, item_no, text: every text, repaired."""
    return _applied(items_of(docs, packets), lambda r, o, t: [(r.repaired(o, t),)], "text string")
