"""The character editor of problem 2: an averaged perceptron over edit scripts and line joins.

A script turns a word into another by operations on its characters: keep,
replace, delete, insert (m read as rn is a replacement and a deletion). The
perceptron scores a script by its operations, the characters around them, the
trigrams before and after, and how often both forms stand in the corpus; no
script, all characters kept, scores 0. At a mark that may break a word a second
perceptron decides whether to join the parts. Both learn from words of the
corpus that are damaged and broken artificially: by the usual confusions and, as
often, by any other letters, so that confusions they have not seen are found too.

What a word may be turned into comes from the corpus: words that share one of its
``keys`` (see there); a usual confusion undone may also give a word that stands
nowhere, if it is a far likelier row of characters.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from figmill.llm.furniture import OUTLINE
from figmill.llm.perceptron import Perceptron

#: What is read and what stands on the page, for the usual confusions.
MISREAD = [
    ("o", "a"), ("a", "o"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"),
    ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"),
    ("vv", "w"), ("w", "vv"), ("l", "I"), ("1", "I"), ("0", "O"), ("5", "S"), ("8", "B"), ("6", "G"), ("li", "h"), ("lc", "k"), ("q", "g"), ("g", "q"), ("u", "n"), ("n", "u"),
]
USUAL = {f"{s.lower()}>{t.lower()}" for s, t in MISREAD}
BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _seen, _true in MISREAD:
    BY_FIRST.setdefault(_seen[0], []).append((_seen, _true))
#: Letters by their outer form.
FORMS = {c: k for k, cs in {"x": "acemnorsuvwxz", "b": "bdfhklt", "p": "gpqy", "i": "ij", "0": "0123456789"}.items() for c in cs}
LATIN = re.compile(r"^[A-Za-zÀ-ÖØ-öø-ÿ0-9'’-]+$")
CHEMICAL_LINE = re.compile(r"^(?:[BCNOPSFIHclnosr0-9]{1,2}|[\[\]()=#@+\\/-])+$")
#: A longer run of letters is no word, and no part of a broken one.
LONGEST = 64
#: One character for another only, for the keys of single damaged places.
_PLAIN = str.maketrans({k: v for k, v in OUTLINE.items() if len(v) == 1})
#: A correction that stands nowhere in the corpus must be likelier by this (a logarithm).
NOWHERE = 3.0


def is_word(w: str) -> bool:
    """Can a token be a word with a misread character? At least two letters, Latin, no formula."""
    letters = sum(c.isalpha() for c in w)
    if letters < 2 or not 3 <= len(w) <= LONGEST or len(w) - letters > max(2, letters // 2) or not LATIN.match(w):
        return False
    if (w.isupper() or any(c.isdigit() for c in w)) and CHEMICAL_LINE.match(w):
        return False
    return w.isupper() or "-" in w or not any(c.isupper() for c in w[1:])


def keys(w: str) -> set[str]:
    """Where a word meets its likely corrections: its outline, in which usual confusions fall together, so that any number
    of them is found; and, for one damaged place of any characters, the word without one or two neighbouring letters."""
    low = w.lower()
    out = {"=" + low.translate(OUTLINE)}
    plain = low.translate(_PLAIN)
    n = len(plain)
    if n >= 5:
        out |= {plain[:i] + plain[i + 1 :] for i in range(n)}
    if n >= 6:
        out |= {plain[:i] + plain[i + 2 :] for i in range(n - 1)}
    return out


def undone(w: str) -> Iterator[str]:
    """Words that one usual confusion, undone, gives."""
    upper = w.isupper()
    for i, c in enumerate(w):
        for seen, true in BY_FIRST.get(c.lower() if upper else c, ()):
            if upper:
                seen, true = seen.upper(), true.upper()
            if w.startswith(seen, i):
                yield w[:i] + true + w[i + len(seen) :]


_STEPS = ((1, 1), (2, 1), (1, 2), (1, 0), (0, 1), (2, 2))


def places(w: str, v: str, most: int = 3) -> list[tuple[int, str, str]] | None:
    """(place, read, true) of the fewest damaged places, of at most two characters each, that turn w into v; of equally
    few those with most usual confusions. None if there are more than ``most``."""
    p, n, m = 0, len(w), len(v)
    while p < n and p < m and w[p] == v[p]:
        p += 1
    while n > p and m > p and w[n - 1] == v[m - 1]:
        n, m = n - 1, m - 1
    if n - p <= 2 and m - p <= 2:
        return [(p, w[p:n], v[p:m])]
    if abs((n - p) - (m - p)) > most or n - p > 16 or m - p > 16:
        return None

    def walk(i: int, j: int, left: int) -> Iterator[list[tuple[int, str, str]]]:
        while i < n and j < m and w[i] == v[j]:
            i, j = i + 1, j + 1
        if i == n and j == m:
            yield []
        elif left:
            for a, b in _STEPS:
                if i + a <= n and j + b <= m:
                    for rest in walk(i + a, j + b, left - 1):
                        yield [(i, w[i : i + a], v[j : j + b]), *rest]

    for left in range(2, most + 1):
        best = max(walk(p, p, left), key=lambda s: sum(f"{a}>{b}".lower() in USUAL for _, a, b in s), default=None)
        if best is not None:
            return best
    return None


def misreading(w: str, script: list[tuple[int, str, str]]) -> bool:
    """Can a script be a misreading? Marks inside a word are no letters, and letters more or less at a word's edge make
    another form of it."""
    for i, a, b in script:
        if "-" in a + b or "'" in a + b or "’" in a + b:
            return False
        if (not a or not b) and (i == 0 or i + len(a) == len(w)):
            return False
    return True


def operations(seen: str, true: str) -> list[tuple[str, str, str]]:
    """(operation, character read, character written) of one place."""
    k = min(len(seen), len(true))
    return [("replace", a, b) for a, b in zip(seen, true)] + [("delete", a, "") for a in seen[k:]] + [("insert", "", b) for b in true[k:]]


class Trigrams:
    """Log-probabilities of the characters of words, from counts of trigrams."""

    def __init__(self, tri: dict[str, float]):
        ctx: Counter[str] = Counter()
        for t, k in tri.items():
            ctx[t[:2]] += k
        self.score_of = {t: math.log((k + 0.05) / (ctx[t[:2]] + 2.0)) for t, k in tri.items()}
        self.low = {c: math.log(0.05 / (k + 2.0)) for c, k in ctx.items()}
        self.cache: dict[str, tuple[float, float]] = {}

    @staticmethod
    def count(words: Iterable[tuple[str, float]]) -> Counter:
        """Trigrams of words, each word weighted by the logarithm of its count."""
        tri: Counter[str] = Counter()
        for w, n in words:
            s, k = f"^^{w.lower()}$", 1 + math.log2(max(1.0, n))
            for i in range(2, len(s)):
                tri[s[i - 2 : i + 1]] += k
        return tri

    def score(self, w: str) -> tuple[float, float]:
        """The sum over a word's trigrams and the least of them."""
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            s = f"^^{w.lower()}$"
            each = [self.score_of.get(t) or self.low.get(t[:2], -4.0) for t in (s[k - 2 : k + 1] for k in range(2, len(s)))]
            got = self.cache[w] = (sum(each), min(each))
        return got


def _log(x: float, most: int) -> int:
    return min(most, int(math.log2(1 + x)))


class Editor:
    """Perceptron weights for scripts and for joins, with the trigrams they look at."""

    def __init__(self, grams: Trigrams, total: float):
        self.grams, self.total = grams, max(1.0, total)
        self.words, self.ends = Perceptron(), Perceptron()

    # scripts

    def features(self, w: str, n: float, v: str, have: float, script: list[tuple[int, str, str]], named: bool = True) -> list[str]:
        """Features of a script from w (seen n times) to v (seen ``have`` times); without ``named``, none that knows which characters it changes."""
        gain = self.grams.score(v)[0] - self.grams.score(w)[0]
        odd = max(-6, int(self.grams.score(w)[1]))
        usual = sum(f"{a}>{b}".lower() in USUAL for _, a, b in script) == len(script)
        feats = ["bias", f"places{len(script)}", f"len{min(8, len(w))}", f"usual{usual}"]
        for i, seen, true in script:
            a, b = seen.lower(), true.lower()
            edge = ("^" if i == 0 else "") + ("$" if i + len(seen) == len(w) else "")
            kinds = "+".join(f"{op[0]}{FORMS.get(x.lower(), '') if x else ''}>{FORMS.get(y.lower(), '') if y else ''}" for op, x, y in operations(seen, true))
            feats += [f"kind{kinds}", f"edge{edge}{len(seen)}{len(true)}"]
            if named:
                left, right = w[max(0, i - 1) : i].lower(), w[i + len(seen) : i + len(seen) + 1].lower()
                feats += [f"op{a}>{b}", f"left{left}{a}>{b}", f"right{a}>{b}{right}", *(f"{op}{x}>{y}".lower() for op, x, y in operations(seen, true))]
        g = max(-4, min(6, int(gain / 1.5)))
        ratio = max(-3, min(9, int(math.log2((have + 0.5) / (n + 0.5))))) if have else -9
        digit = any(c.isdigit() for c in w) and not any(c.isdigit() for c in v)
        often = _log(n, 12)
        return feats + [
            f"gain{g}", f"ratio{ratio}", f"ratio{ratio}gain{g}", f"digit{digit}gain{g}", f"digit{digit}ratio{ratio}", f"short{len(w) < 5}ratio{ratio}", f"n{_log(n, 4)}have{_log(have, 8)}",
            f"often{often}digit{digit}", f"often{often // 2}ratio{ratio}digit{digit}", f"usual{usual}ratio{ratio}", f"usual{usual}gain{g}", f"usual{usual}odd{odd}", f"usual{usual}often{often // 2}", f"usual{usual}len{min(8, len(w))}",
        ]

    def score(self, w: str, n: float, v: str, have: float) -> float:
        """How much better v is than keeping w; negative where no script leads there."""
        script = places(w, v)
        return self.words.score(self.features(w, n, v, have, script)) if script and misreading(w, script) else -1.0

    def proposals(self, w: str) -> list[str]:
        """Corrections that need not stand in the corpus: one usual confusion undone, far likelier."""
        have = self.grams.score(w)[0]
        return [v for v in dict.fromkeys(undone(w)) if self.grams.score(v)[0] - have > NOWHERE and is_word(v)]

    # joins

    def end_features(self, first: str, second: str, mark: str, joined: float, compound: float, n_first: float, n_second: float) -> list[str]:
        """Features of a mark between two parts: how often the corpus has them joined, as a compound and alone."""
        a, b, d = _log(joined, 6), _log(compound, 6), _log(n_first, 4)
        alone = n_second / self.total
        c = 0 if alone == 0 else max(-12, int(math.log10(alone) * 2)) + 13
        j = self.grams.score(first + second)[0] - self.grams.score(first)[0]
        return [
            "bias", f"mark{mark}", f"plain{mark == '-'}j{a > 0}", f"j{a}c{b}", f"more{joined > compound}{compound > joined}", f"alone{c}j{a > 0}c{b > 0}", f"first{d}j{a > 0}c{b > 0}", f"case{second[:1].isupper()}",
            f"gram{max(-12, int(j / 4))}j{a > 0}c{b > 0}", f"known{joined > 0}{compound > 0}", f"mark{mark}known{joined > 0}{compound > 0}",
        ]

    def joins(self, first: str, second: str, mark: str, joined: float, compound: float, n_first: float, n_second: float) -> bool:
        """Is a mark between two parts a break of one word?"""
        if not any(c.isalpha() for c in first) or not second or not second[0].isalpha():
            return False
        return self.ends.score(self.end_features(first, second, mark, joined, compound, n_first, n_second)) > 0


# --- artificial damage ----------------------------------------------------------

_REVERSE: dict[str, list[tuple[str, str]]] = {}
for _seen, _true in MISREAD:
    _REVERSE.setdefault(_true[0], []).append((_seen, _true))
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Replacements (read, true) that artificial damage never shows, to measure what the editor makes of unknown ones.
HELD_OUT: set[tuple[str, str]] = set()


def damaged(v: str, rng: random.Random) -> str:
    """A word with one or two misread places: usual confusions or, one time in three, other letters, one letter more or less."""
    if rng.random() < 0.33 and len(v) > 4:
        i, kind = rng.randrange(len(v)), rng.random()
        a, b = rng.choice(LETTERS), rng.choice(LETTERS)
        if kind < 0.5:
            return v if (a, v[i]) in HELD_OUT else v[:i] + a + v[i + 1 :]
        if kind < 0.65:
            return v[:i] + v[i + 1 :]
        if kind < 0.8:
            return v[:i] + a + v[i:]
        return v[:i] + a + b + v[i + 1 :] if kind < 0.9 else v[:i] + a + v[i + 2 :]
    w = v
    for _ in range(2 if rng.random() < 0.4 and len(v) > 5 else 1):
        spots = [(i, s, t) for i, c in enumerate(w) for s, t in _REVERSE.get(c, ()) if w.startswith(t, i)]
        if spots:
            i, s, t = rng.choice(spots)
            w = w[:i] + s + w[i + len(t) :]
    return w
