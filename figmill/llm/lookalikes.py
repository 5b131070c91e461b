"""One form for text that looks the same (problem 3).

Text is normalised by compatibility, characters nobody sees are deleted and all
kinds of blanks become one. Every remaining character is then a column of a
lattice: itself and the characters it looks like. A Viterbi search picks the
path with the best score under character n-grams of the reference names, with a
price for changing the script inside a word. A run of letters whose script is
certain keeps it: a word of another script isn't rewritten because its letters look
Latin. Two labels are equal to the eye if their paths are equal.

Edge cases: null labels have no rows, empty ones stay empty; a line break is not
a blank (a word broken in two is a visible difference); letter case, marks and
ASCII letters are never changed; repeated packets give a row each. Labels are
independent of each other, so nothing is shuffled; repeats are decoded once per task.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: A character and the characters of other scripts that look like it.
LOOKALIKES = {
    "a": "аɑα⍺", "b": "Ьƅ", "c": "сϲⅽᴄ", "d": "ԁⅾ", "e": "еҽ℮", "g": "ɡց", "h": "һհ", "i": "іıɩⅰ", "j": "јϳ",
    "k": "κкᴋ", "l": "ӏⅼǀ", "m": "ⅿм", "n": "ոп", "o": "оοօσ", "p": "рρ", "q": "ԛզ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ",
    "u": "υսᴜ", "v": "νѵⅴᴠ", "w": "ԝѡᴡ", "x": "хⅹ", "y": "уүγ", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹⅭᏟ", "D": "ⅮᎠ", "E": "ЕΕᎬ", "F": "ϜᖴꜰꞘ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀⅠ", "J": "ЈᎫͿ",
    "K": "КΚᏦ", "L": "ⅬᏞ", "M": "МΜⅯᎷ", "N": "ΝꓠᏁ", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "ԚⵕႳ", "R": "ƦᎡᏒ", "S": "ЅՏᏚ", "T": "ТΤᎢ",
    "U": "Սᑌ", "V": "Ѵⅴᐯ", "W": "ԜᎳ", "X": "ХΧⅩ", "Y": "ΥҮУ", "Z": "ΖᏃ",
    "α": "ɑа⍺𝛼", "β": "ßꞵϐв", "γ": "ɣүᵧ", "δ": "ẟ", "ε": "ɛєϵԑ", "η": "ղ", "μ": "µ", "ω": "ɯ", "Δ": "∆△", "Ω": "Ω", "π": "п", "σ": "ơ",
    "-": "‐‑‒–−﹣⁃˗", "/": "⁄∕╱", "%": "٪﹪", ",": "‚⸲٬", ".": "․", "'": "’ʼ′‘", "(": "❨", ")": "❩",
}
#: Deleted besides format characters: fillers and joiners that show nothing.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}
SWITCH_COST, SWAP_COST = 2.5, 0.4
_RUN = re.compile(r"[^\W\d_]+")


def ignorable(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ord(ch) in INVISIBLE or 0xE0100 <= ord(ch) <= 0xE01EF


@lru_cache(1)
def _looks() -> dict[str, str]:
    out: dict[str, str] = {}
    for to, chars in LOOKALIKES.items():
        for c in chars:
            for form in {c, unicodedata.normalize("NFKC", c)} - {to}:
                out[form] = out.get(form, "") + to
    return out


@lru_cache(100_000)
def script_of(ch: str) -> str:
    if not ch.isalpha():
        return ""
    return unicodedata.name(ch, "?").split(" ")[0]


def clusters(text: str) -> list[tuple[int, int, str]]:
    """(start, end, normalised characters): a base character with its combining marks, invisible ones taken out."""
    out: list[tuple[int, int, str]] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and (unicodedata.combining(text[j]) or ignorable(text[j])):
            j += 1
        raw = "".join(c for c in text[i:j] if not ignorable(c))
        norm = unicodedata.normalize("NFKC", raw) if raw else ""
        norm = "".join(c if c == "\n" else " " if unicodedata.category(c) == "Zs" or c in "\t\r" else c for c in norm if not ignorable(c))
        out.append((i, j, norm))
        i = j
    return out


class Ngrams:
    """Character trigram scores of words, with backing off to shorter contexts."""

    def __init__(self, texts: list[str]):
        self.counts: dict[str, int] = {}
        #: runs of letters of the texts, by their length
        self.runs: dict[int, set[str]] = {}
        for t in texts:
            for r in _RUN.findall(t):
                self.runs.setdefault(len(r), set()).add(r)
            s = "  " + t.replace("\n", " ") + " "
            for i in range(2, len(s)):
                for k in (0, 1, 2):
                    self.counts[s[i - k : i + 1]] = self.counts.get(s[i - k : i + 1], 0) + 1
                    if k:
                        self.counts["<" + s[i - k : i]] = self.counts.get("<" + s[i - k : i], 0) + 1
        self.total = sum(v for k, v in self.counts.items() if len(k) == 1) or 1
        self.cache: dict[tuple[str, str], float] = {}

    def score(self, context: str, ch: str) -> float:
        key = (context, ch)
        if key not in self.cache:
            p = (self.counts.get(ch, 0) + 0.05) / (self.total + 50)
            for k in (1, 2):
                c = context[-k:]
                seen = self.counts.get("<" + c, 0)
                p = (self.counts.get(c + ch, 0) + 2.0 * p) / (seen + 2.0)
            self.cache[key] = math.log(p)
        return self.cache[key]


@lru_cache(1)
def _back() -> dict[tuple[str, str], str]:
    """(character, script) -> its look-alike in that script."""
    out: dict[tuple[str, str], str] = {}
    for to, chars in LOOKALIKES.items():
        for c in chars:
            out.setdefault((to, script_of(c)), c)
    return out


def settled(word: str, model: Ngrams) -> str | None:
    """A run of letters whose script is certain, in that script; None where the search has to decide.

    A letter without a look-alike in Latin settles the script of its run: look-alikes from others come over to it. A run of
    one other script that could be read as Latin stays as it is, unless that reading is a word of the names."""
    scripts = {script_of(c) for c in word}
    if scripts == {"LATIN"}:
        return None
    looks = _looks()
    sure = {script_of(c) for c in word if c not in looks and script_of(c) != "LATIN"} - {""}
    if len(sure) == 1 and not any(_reads(word, k) for k in model.runs.get(len(word), ())):
        script = sure.pop()
        return "".join(c if script_of(c) == script else _back().get((c, script), c) for c in word)
    if len(scripts) == 1 and not any(_reads(word, k) for k in model.runs.get(len(word), ())):
        return word
    return None


def _reads(word: str, known: str) -> bool:
    looks = _looks()
    return all(c == k or k in looks.get(c, "") for c, k in zip(word, known))


def decode(chars: str, model: Ngrams) -> str:
    """The best path through the lattice of look-alikes, word by word; as long as its input."""
    looks = _looks()
    if all(c not in looks for c in chars):
        return chars
    return "".join(_decode_word(w, model, looks) if not w.isspace() else w for w in re.split(r"([ \n]+)", chars))


def _decode_word(word: str, model: Ngrams, looks: dict[str, str]) -> str:
    if all(c not in looks for c in word):
        return word
    fixed = {}
    for m in _RUN.finditer(word):
        if (got := settled(m[0], model)) is not None:
            fixed.update(zip(range(*m.span()), got))
    if fixed:
        word = "".join(fixed.get(i, c) for i, c in enumerate(word))
        if len(fixed) == len(word):
            return word
    states: dict[tuple[str, str], float] = {("  ", ""): 0.0}
    back: list[dict[tuple[str, str], tuple[str, str]]] = []
    for i, c in enumerate(word):
        step: dict[tuple[str, str], float] = {}
        came: dict[tuple[str, str], tuple[str, str]] = {}
        for state, cost in states.items():
            ctx, script = state
            for o in c if i in fixed else c + looks.get(c, ""):
                sc = script_of(o)
                total = cost + model.score(ctx, o) - (SWITCH_COST if sc and script and sc != script else 0) - (SWAP_COST if o != c else 0)
                key = (ctx[-1] + o, sc or script)
                if key not in step or total > step[key]:
                    step[key], came[key] = total, state
        states = step
        back.append(came)
    state = max(states, key=lambda k: (states[k], k))
    out = []
    for came in reversed(back):
        out.append(state[0][-1])
        state = came[state]
    return "".join(reversed(out))


def canonical(text: str, model: Ngrams) -> tuple[str, list[tuple[int, int]]]:
    """The one form of a text and, for each of its characters, the span of the text it stands for."""
    chars, spans = "", []
    for start, end, norm in clusters(text):
        if norm:
            chars += norm
            spans += [(start, end)] * len(norm)
    return decode(chars, model), spans


class Names:
    """The reference names by their canonical forms."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.model = Ngrams([unicodedata.normalize("NFC", n) for _, n in rows])
        self.by_form: dict[str, tuple[int, str]] = {}
        for i, n in sorted(rows):
            self.by_form.setdefault(canonical(n, self.model)[0], (i, n))
        self.forms = sorted(self.by_form, key=lambda f: (-len(f), f))
        self.cache: dict[tuple[str, bool], list[int]] = {}

    def disguised(self, text: str, contained: bool) -> list[int]:
        """Ids of the names that the text is (or contains, between blanks) to the eye but not in its characters."""
        key = (text, contained)
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[key] = self._search(text, contained)
        return self.cache[key]

    def _search(self, text: str, contained: bool) -> list[int]:
        form, spans = canonical(text, self.model)
        if not contained:
            hit = self.by_form.get(form.strip(" "))
            return [hit[0]] if hit and text.strip(" ") != hit[1] else []
        taken = [False] * len(form)
        out: list[int] = []
        for f in self.forms:
            at = form.find(f)
            while at >= 0:
                end = at + len(f)
                if (at == 0 or form[at - 1] in " \n") and (end == len(form) or form[end] in " \n") and not any(taken[at:end]):
                    taken[at:end] = [True] * len(f)
                    start, stop = spans[at][0], spans[end - 1][1]
                    while start > 0 and ignorable(text[start - 1]):
                        start -= 1
                    i, name = self.by_form[f]
                    if text[start:stop] != name:
                        out.append(i)
                at = form.find(f, end)
        return sorted(set(out))


def label_items(packets: DataFrame) -> DataFrame:
    """packet_id, field, item_no, label: every legend text and Series label that isn't null."""
    legend = packets.select("packet_id", F.lit("legend_text").alias("field"), F.posexplode("text_evidence.legend_text.text").alias("item_no", "label"))
    series = packets.select("packet_id", F.lit("series").alias("field"), F.posexplode("raw_data.Series").alias("item_no", "label"))
    return legend.unionByName(series).where("label is not null")


def _names(series_names: DataFrame) -> Names:
    """The reference names: a table of fixed size."""
    return Names([(r.name_id, r.series_name) for r in series_names.select("name_id", "series_name").collect() if r.series_name])


def found(packets: DataFrame, series_names: DataFrame) -> DataFrame:
    """The columns of p3_found. Labels in plain ASCII can't be disguised and are dropped before the Python stage."""
    names = _names(series_names)
    items = label_items(packets).where(F.col("label").rlike(r"[^\x00-\x7F]"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p, f, i, n) for p, f, i, label in pdf.itertuples(index=False) for n in names.disguised(label, f == "legend_text")]
            yield pd.DataFrame(rows, columns=["packet_id", "field", "item_no", "name_id"])

    return items.mapInPandas(run, "packet_id long, field string, item_no int, name_id int")


def canonical_labels(packets: DataFrame, series_names: DataFrame) -> DataFrame:
    """packet_id, field, item_no, label, canonical: every label in its one form."""
    names = _names(series_names)
    items = label_items(packets)
    plain = items.where(~F.col("label").rlike(r"[^\x00-\x7F]")).withColumn("canonical", F.regexp_replace(F.trim("label"), r"[ \t\r]+", " "))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, str] = {}
        for pdf in it:
            for label in pdf.label.unique():
                if label not in seen:
                    seen[label] = " ".join(canonical(label, names.model)[0].split(" ")).strip()
            yield pdf.assign(canonical=pdf.label.map(seen))
            if len(seen) > 200_000:
                seen.clear()

    rest = items.where(F.col("label").rlike(r"[^\x00-\x7F]")).mapInPandas(run, "packet_id long, field string, item_no int, label string, canonical string")
    return plain.unionByName(rest)
