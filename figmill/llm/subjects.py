"""Subject areas of documents (problem 8).

The matrix of sentences and terms is factored by seeded non-negative alternating
updates (multiplicative, under the divergence of Kullback and Leibler). One
component per subject is anchored: it starts from the terms that labelled
documents of the subject and its description use more than others do, and a
sentence of a labelled document may draw on its labels, on the background
component and, barely, on the rest. With the term factors fixed, each document
gets its mixture of subjects and each sentence its own; a subject is treated
that holds at least a quarter of the document's sentences.

The fit reads a bounded sample of labelled documents (FIT_DOCUMENTS, by hash of
the id, none longer than FIT_LENGTH; documented parameters); every document is then
scored, whole and without a shuffle.

Edge cases: null, blank and purely general texts have no rows; labels without a
document are ignored; without any label the descriptions alone are the anchors;
repeated documents get rows each; ties between subjects go to the lower id.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from figmill.llm.sentences import sentences

#: Labelled documents of the fit, and the length up to which a document is taken for it (every document is scored, whole).
FIT_DOCUMENTS, FIT_LENGTH = 6000, 20_000
ROUNDS, LEAK, SHARE = 12, 0.03, 0.25
#: A term speaks for a subject that explains at least this share of it; a sentence needs this much of such terms.
SPECIFIC, LEAST_LOAD = 0.6, 0.9
#: Occurrences of terms that an update handles at once; documents that are scored at once.
CHUNK, SLICE = 200_000, 500
_WORD = re.compile(r"[一-鿿]+|[^\W\d_][^\W_]*(?:[-'][^\W_]+)*")


def terms(sentence: str) -> list[str]:
    """Words, pairs of neighbouring words and, where no blanks part words, pairs of characters."""
    out: list[str] = []
    last = None
    for w in _WORD.findall(sentence.lower()):
        if "一" <= w[0] <= "鿿":
            out += [w[i : i + 2] for i in range(len(w) - 1)]
            last = None
        else:
            out.append(w)
            if last:
                out.append(f"{last} {w}")
            last = w
    return out


class Model:
    """Term factors of the subjects and the background (its last row)."""

    def __init__(self, subjects: list[int], vocabulary: dict[str, int], factors: np.ndarray, shared: np.ndarray):
        self.subjects = subjects
        # how much of a term each subject explains; terms that the background or no one subject explains carry nothing
        share = factors / np.maximum(factors.sum(axis=0), 1e-12)
        specific = (share[:-1].max(axis=0, initial=0.0) >= SPECIFIC) & ~shared if share.size else np.zeros(0, bool)
        kept = [t for t, i in vocabulary.items() if specific[i]]
        self.loads = np.ascontiguousarray(share[:-1, [vocabulary[t] for t in kept]].T) if kept else np.zeros((0, len(subjects)))
        #: a word, or the second word of a pair below its first one, to its row of loads
        self.single: dict[str, int] = {}
        self.pair: dict[str, dict[str, int]] = {}
        for i, t in enumerate(kept):
            first, _, second = t.partition(" ")
            if second:
                self.pair.setdefault(first, {})[second] = i
            else:
                self.single[t] = i

    def _rows(self, sentence: str) -> list[int]:
        """The rows of loads of a sentence's terms."""
        out, single, pair, last = [], self.single, self.pair, None
        for w in _WORD.findall(sentence.lower()):
            if "一" <= w[0] <= "鿿":
                out += [single[x] for i in range(len(w) - 1) if (x := w[i : i + 2]) in single]
                last = None
                continue
            if w in single:
                out.append(single[w])
            if last is not None and w in last:
                out.append(last[w])
            last = pair.get(w)
        return out

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents by subjects: mixture; documents by subjects: sentences; documents: all sentences).

        The sentences of all texts are one matrix of sentences and subjects, the loads of their terms; a document's mixture
        is the fixed point of its sentences' shares, and between the subjects that a sentence names its document's mixture decides."""
        k, d = len(self.subjects), len(texts)
        of: list[int] = []  # the document of each sentence
        rows: list[int] = []
        size: list[int] = []
        for i, t in enumerate(texts):
            for s in sentences(t):
                r = self._rows(s)
                of.append(i)
                rows += r
                size.append(len(r))
        doc, n = np.asarray(of, dtype=np.int64), np.zeros(d, dtype=np.int64)
        np.add.at(n, doc, 1)
        at = np.repeat(np.arange(len(size)), size)
        loads = self.loads[np.asarray(rows, dtype=np.int64)] if rows else np.zeros((0, k))
        every = np.stack([np.bincount(at, weights=loads[:, c], minlength=len(size)) for c in range(k)], axis=1) if k else np.zeros((len(size), 0))
        known = every.max(axis=1, initial=0.0) >= LEAST_LOAD
        every, doc = every[known], doc[known]
        per = lambda x: np.stack([np.bincount(doc, weights=x[:, c], minlength=d) for c in range(k)], axis=1)
        mix, total = np.full((d, k), 1.0 / max(k, 1)), every.sum(axis=1, keepdims=True)
        for _ in range(6 if len(doc) else 0):
            part = mix[doc] * every
            mix = per(part * (total / part.sum(axis=1, keepdims=True)))
            mix = (mix + 0.05) / (mix.sum(axis=1, keepdims=True) + 0.05 * k)
        picks = np.zeros((d, k), dtype=np.int64)
        if len(doc):
            np.add.at(picks, (doc, (every * np.sqrt(mix[doc])).argmax(axis=1)), 1)
        mix[picks.sum(axis=1) == 0] = 0.0
        return mix, picks, n

    def treated(self, text: str | None, share: float = SHARE) -> list[int]:
        _, picks, n = self.documents([text])
        return [self.subjects[c] for c in np.flatnonzero((picks[0] > 0) & (picks[0] >= share * n[0]))]


def fit(texts: list[tuple[str, dict[int, int]]], descriptions: dict[int, str], rounds: int = ROUNDS) -> Model:
    """The model from (text, subject -> number of labels) of labelled documents and the subjects' descriptions."""
    subjects = sorted(descriptions)
    place = {s: i for i, s in enumerate(subjects)}
    k = len(subjects) + 1
    weights: list[np.ndarray] = []
    owner: list[int] = []  # of each sentence, the row of weights

    def lines() -> Iterator[tuple[int, str]]:
        for i, (text, _) in enumerate(texts):
            for s in sentences(text):
                yield i, s
        for j, s in enumerate(subjects):
            yield len(texts) + j, descriptions[s]

    for _, labels in [*texts, *(("", {s: 1}) for s in subjects)]:
        weight = np.full(k, LEAK, dtype=np.float32)
        total = sum(labels.values()) or 1
        for s, n in labels.items():
            if s in place:
                weight[place[s]] = n / total
        weight[-1] = 1.0
        weights.append(weight)
    # two numbers for each occurrence of a term; texts and terms themselves aren't kept
    number: dict[str, int] = {}
    at_l, term_l, held = array("i"), array("i"), array("i")  # held: sentences that hold a term
    for doc, line in lines():
        own = [number.setdefault(t, len(number)) for t in terms(line)]
        held.extend([0] * (len(number) - len(held)))
        for j in set(own):
            held[j] += 1
        at_l.extend([len(owner)] * len(own))
        term_l.extend(own)
        owner.append(doc)
    anchors = {t for d in descriptions.values() for t in terms(d)}
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, j in number.items() if held[j] > 1 or t in anchors))}
    v = len(vocabulary)
    place_of = np.full(len(number) + 1, -1, dtype=np.int32)
    for t, i in vocabulary.items():
        place_of[number[t]] = i
    term_ = place_of[np.frombuffer(term_l, dtype=np.int32)] if term_l else np.zeros(0, np.int32)
    at_ = np.frombuffer(at_l, dtype=np.int32)[term_ >= 0] if at_l else np.zeros(0, np.int32)
    term_ = term_[term_ >= 0]
    del number, held
    s = np.stack(weights)[owner]
    allowed = np.where(s > LEAK, np.float32(1.0), np.float32(LEAK))
    # anchors: terms by how much more a subject's documents use them than others do; the background by evenness
    use = np.stack([np.bincount(term_, weights=np.where(s[:, c] > LEAK, s[:, c], 0.0)[at_], minlength=v) for c in range(k - 1)])
    p = (use + 0.02) / (use.sum(axis=1, keepdims=True) + 0.02 * max(v, 1))
    lift = p / np.maximum(p.mean(axis=0), 1e-12)
    q = p / np.maximum(p.sum(axis=0), 1e-12)
    spread = np.exp(-(q * np.log(np.maximum(q, 1e-12))).sum(axis=0))  # number of subjects that share a term
    # a term that four and more subjects use alike is general, whatever the updates make of it
    shared = (spread >= 4.0) & (np.bincount(term_, minlength=v) >= 6)
    general = np.clip((spread - 2.5) / 1.5, 0.03, 1.0)
    h = np.concatenate([p * np.clip(lift - 1.2, 0.02, None), (p.mean(axis=0) * 4 * general)[None, :]]) + 1e-12
    h = (h / h.sum(axis=1, keepdims=True)).astype(np.float32) if v else h
    n = len(owner)
    for _ in range(rounds if v else 0):
        own, grown = np.full((n, k), 1e-3), np.full((k, v), 1e-3)
        for lo in range(0, len(at_), CHUNK):  # the factors' products of one chunk of occurrences at a time
            a, t = at_[lo : lo + CHUNK], term_[lo : lo + CHUNK]
            part = s[a] * h[:, t].T
            part /= part.sum(axis=1, keepdims=True) + 1e-12
            first, last = int(a[0]), int(a[-1]) + 1
            for c in range(k):
                own[first:last, c] += np.bincount(a - first, weights=part[:, c], minlength=last - first)
                grown[c] += np.bincount(t, weights=part[:, c], minlength=v)
        s = (allowed * own / own.sum(axis=1, keepdims=True)).astype(np.float32)
        h = (grown / grown.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(subjects, vocabulary, h.astype(np.float64), shared)


def train(docs: DataFrame, labels: DataFrame, areas: DataFrame, limit: int = FIT_DOCUMENTS) -> Model:
    """Fit on at most ``limit`` labelled documents, taken in the order of a hash of their ids."""
    descriptions = {r.subject_id: f"{(r.subject or '').replace('_', ' ')}. {r.description or ''}" for r in areas.select("subject_id", "subject", "description").collect()}
    per = labels.where("doc_id is not null and subject_id is not null").groupBy("doc_id", "subject_id").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("subject_id", "n"))).alias("labels"))
    sample = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").where(f"length(trim(text)) > 0 and length(text) <= {FIT_LENGTH}").join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("text", "labels").collect()
    return fit([(r.text, dict(r.labels)) for r in texts], descriptions)


def found(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """The columns of p8_found: one row per document and subject it treats."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, areas))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        ids = np.asarray(m.subjects, dtype=np.int64)
        for pdf in it:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at : at + SLICE]
                _, picks, n = m.documents(part.text.tolist())
                doc, subject = np.nonzero((picks > 0) & (picks >= SHARE * n[:, None]))
                yield pd.DataFrame({"doc_id": part.doc_id.iloc[doc].array, "subject_id": ids[subject]})

    return docs.select("doc_id", "text").where("length(trim(text)) > 0").mapInPandas(run, "doc_id long, subject_id int")


def mixtures(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id, subject_id, weight, sentences, share: the whole mixture of each document, subjects below the quarter included."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, areas))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        ids = np.asarray(m.subjects, dtype=np.int64)
        for pdf in it:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at : at + SLICE]
                mix, picks, n = m.documents(part.text.tolist())
                doc, subject = np.nonzero(picks)
                yield pd.DataFrame({"doc_id": part.doc_id.iloc[doc].array, "subject_id": ids[subject], "weight": mix[doc, subject], "sentences": picks[doc, subject], "share": picks[doc, subject] / n[doc]})

    return docs.select("doc_id", "text").where("length(trim(text)) > 0").mapInPandas(run, "doc_id long, subject_id int, weight double, sentences int, share double")


def composition(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """subject_id, documents, sentences: the make-up of the corpus by subject."""
    m = mixtures(docs, labels, areas)
    return m.groupBy("subject_id").agg(F.sum(F.when(F.col("share") >= SHARE, 1).otherwise(0)).alias("documents"), F.sum(F.col("sentences").cast("long")).alias("sentences"))
