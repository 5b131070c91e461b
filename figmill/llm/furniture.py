"""Furniture of scanned pages: running headers and page numbers (problem 2).

Every line that may be furniture (a number in one of the usual forms, or a line
worded like a title) is described by its place on the page: its distance from the
first and the last line, blank lines beside it, what stands before and after it,
whether it breaks a sentence, its length against the other lines. Two averaged
perceptrons, one for numbers and one for titles, judge lines by these features
and by how lines of the same outline stand elsewhere in the corpus. They learn
from the clear cases of the corpus itself.

Edge cases: a text of one line has no furniture; blank lines are none.
"""

from __future__ import annotations

import math
import re
from statistics import median

from figmill.llm.perceptron import Perceptron

#: Marks that break a word.
MARKS = "-‐‑¬\u00ad"
#: What a page number looks like: the only lines without words that are asked about.
PAGE_NUMBER = re.compile(r"^(?:\d{1,5}|\d+ ?/ ?\d+|p\. ?\d+|pp?\. \d+|[-–—] ?\d+ ?[-–—]|Page \d+(?: of \d+)?|\[\d+\]|S\d+)$", re.I)
_VOLUME = re.compile(r"(?:,? Vol\. ?\w+| \w+ \(\w{4}\))(?:\s+\w+)?$")
_TABLE_HEAD = re.compile(r"^(?:- )?\S{1,12} / \S+$")
#: Characters that recognition confuses, by what stands for them (so that rn and m, cl and d, ii and u fall together).
OUTLINE = str.maketrans({"1": "l", "i": "l", "|": "l", "0": "o", "a": "o", "q": "g", "9": "g", "e": "c", "f": "t", "5": "s", "8": "b", "h": "b", "m": "rrl", "n": "rl", "u": "ll", "d": "cl", "w": "vv", "6": "b"})
#: Words that stay small in a title, by outline.
SMALL_WORDS = {w.translate(OUTLINE) for w in "a an and as at by for from in into of on or over per the to under via with und der die das im in für von mit bei y de del la el en los las con por".split()}
#: Examples of each kind that the perceptrons learn from at most.
EXAMPLES = 4000


def title_key(line: str) -> str | None:
    """The outline of a line that is worded like a title (with or without a page or volume number), else None."""
    if line[-1] in ".;:!?" + MARKS and not line.endswith("Vol."):
        return None
    body = re.sub(r"^\d+\s{2,}|\s{2,}\d+$", "", line)
    body = _VOLUME.sub("", body).strip()
    words = body.split()
    if len(words) < 2 or any(c in body for c in "|=<>{}/\t\"%°"):
        return None
    if not (words[0][0].isupper() or words[0][0].isdigit() and any(c.isalpha() for c in words[0])):
        return None
    for w in words:
        if not (w[0].isupper() or w[0].isdigit() and not w.isdigit() or w.translate(OUTLINE) in SMALL_WORDS) or w[-1] in ".,;:":
            return None
    return "".join(c for c in body.lower().translate(OUTLINE) if c.isalpha()) or None


def _key(line: str) -> str | None:
    if PAGE_NUMBER.match(line):
        return "#" + re.sub(r"\d+", "9", line.lower())
    return title_key(line) if line[0].isupper() or line[0].isdigit() else None


def candidates(lines: list[str]) -> list[tuple[int, str, str]]:
    """(line, key, place) of each line that may be furniture. The key is the outline of a title or, after #, the form of a
    number; the place is eight characters: lines to the top and to the bottom (0 to 3), what stands before, the next text
    before, what stands after, the next text after, has a digit, is short."""
    if len(lines) < 2:
        return []
    keys: dict[int, str] = {}
    for i, x in enumerate(lines):
        if x and (c := x[0]) and (c.isupper() or c.isdigit() or c in "pP[-–—sS") and (k := _key(x)) is not None:
            keys[i] = k
    if not keys:
        return []
    full = [i for i, x in enumerate(lines) if x]
    at = {i: k for k, i in enumerate(full)}
    mid = median(len(lines[i]) for i in full)

    def before(i: int) -> str:
        k = keys.get(i, "")
        if k:
            return "t" if k[0] != "#" else "#" if k == "#9" else "n"
        return "h" if _TABLE_HEAD.match(lines[i]) else "." if lines[i][-1] in ".!?:;" else ","

    def after(i: int) -> str:
        k = keys.get(i, "")
        if k:
            return "t" if k[0] != "#" else "#" if k == "#9" else "n"
        return "a" if lines[i][0].islower() else "A"

    # of each line, the next text before and after it that can't be furniture itself
    above: dict[int, int | None] = {}
    below: dict[int, int | None] = {}
    for order, next_ in ((full, above), (full[::-1], below)):
        text = None
        for i in order:
            next_[i] = text
            if i not in keys:
                text = i
    out = []
    for i, k in keys.items():
        p = at[i]
        up, down = full[p - 1] if p else None, full[p + 1] if p + 1 < len(full) else None
        far_up, far_down = above[i], below[i]
        x = lines[i]
        place = (
            str(min(3, p)), str(min(3, len(full) - 1 - p)),
            "^" if up is None else "_" if up < i - 1 else before(up), "^" if far_up is None else before(far_up),
            "$" if down is None else "_" if down > i + 1 else after(down), "$" if far_down is None else after(far_down),
            "d" if any(c.isdigit() for c in x) else "-", "s" if len(x) < 0.7 * mid else "l",
        )
        out.append((i, k, "".join(place)))
    return out


def near(place: str) -> bool:
    """Stands a number of a page beside the line?"""
    return place[2] in "#n" or place[4] in "#n"


def inside(place: str) -> bool:
    """Does the text go on in small letters after the line?"""
    return place[5] == "a"


def numbered(place: str) -> bool:
    return place[6] == "d"


def title_features(place: str, n: float, n_near: float, n_inside: float, n_numbered: float) -> list[str]:
    """Features of a title-like line: its place, and over the corpus how often its outline is seen, beside page numbers,
    inside a sentence, with a number."""
    b = lambda x: str(min(5, int(6 * x / max(1.0, n))))
    t, u, p, pp, a, aa, d, w = place
    return [
        "bias", f"n{min(6, int(math.log2(1 + n)))}", "near" + b(n_near), "inside" + b(n_inside), "numbered" + b(n_numbered), f"near{b(n_near)}numbered{b(n_numbered)}",
        f"top{t}", f"bottom{u}", f"before{p}{pp}", f"after{a}{aa}", f"between{pp}{aa}", f"digit{d}", f"width{w}", f"top{t}near{b(n_near)}numbered{b(n_numbered)}", f"between{pp}{aa}digit{d}",
    ]


def number_features(key: str, place: str, n: float, n_near: float, n_inside: float) -> list[str]:
    """Features of a line that is only a number: its form and place, and how lines of this form stand in the corpus."""
    b = lambda x: str(min(5, int(6 * x / max(1.0, n))))
    t, u, p, pp, a, aa, _, _ = place
    bare = key == "#9"
    return ["bias", f"form{key}", f"bare{bare}top{t}", f"bare{bare}bottom{u}", f"bare{bare}before{p}", f"bare{bare}after{a}", f"bare{bare}between{p}{a}", f"bare{bare}beyond{pp}{aa}", f"bare{bare}near{b(n_near)}", f"bare{bare}inside{b(n_inside)}"]


def clear_title(place: str, n: float, n_near: float, n_inside: float, n_numbered: float) -> bool | None:
    """What a title-like line is, where its outline leaves no doubt: seen often and with numbers, or never with one."""
    if n >= 3 and (n_near + n_numbered) / n >= 0.3:
        return True
    if not n_near + n_numbered and (n >= 3 or n_inside):
        return False
    return None


def clear_number(key: str, place: str) -> bool | None:
    """What a number is, where its place leaves no doubt: in a column or below its head, or within a sentence, beside a
    blank line or at the edge of a page."""
    if key == "#9" and ("#" in (place[2], place[4]) or place[2] == "h"):
        return False
    if "," in place[2:4] and place[5] == "a" or "_" in (place[2], place[4]) or "0" in place[:2]:
        return True
    return None


#: A row of the table of lines: key, place, and of the key n, near, inside, numbered.
Row = tuple[str, str, float, float, float, float]


class Furniture:
    """The two perceptrons."""

    def __init__(self) -> None:
        self.titles, self.numbers = Perceptron(), Perceptron()

    def train(self, rows: list[Row]) -> "Furniture":
        """Learn from rows whose case is clear. Each title is shown a second time as if it were the only one of its outline."""
        titles, numbers = [], []
        for key, place, n, n_near, n_inside, n_numbered in rows:
            if key[0] == "#":
                if (good := clear_number(key, place)) is not None:
                    numbers.append((number_features(key, place, n, n_near, n_inside), good))
                continue
            if (good := clear_title(place, n, n_near, n_inside, n_numbered)) is not None:
                titles.append((title_features(place, n, n_near, n_inside, n_numbered), good))
            alone = near(place) and numbered(place)
            if alone or not near(place) and not numbered(place):
                titles.append((title_features(place, 1, near(place), inside(place), numbered(place)), alone))
        self.titles, self.numbers = Perceptron.train(titles, 8), Perceptron.train(numbers, 8)
        return self

    def judge(self, row: Row) -> bool:
        key, place, n, n_near, n_inside, n_numbered = row
        if key[0] == "#":
            return self.numbers.score(number_features(key, place, n, n_near, n_inside)) > 0
        return self.titles.score(title_features(place, n, n_near, n_inside, n_numbered)) > 0
