"""Lines and sentences of documents, shared by the text operators."""

from __future__ import annotations

import re

#: Marks that break a word at a line end.
BREAK_MARKS = "-‐‑¬­"
_JOIN = re.compile(rf"[{BREAK_MARKS}](?<=[^\W\d_].)[ \t]*\r?\n[ \t]*(?!(?:and|or|und|oder|y|o)\b)(?=[^\W\d_])")
_NUMBER_LINE = re.compile(r"^\W*(?:p\.|page|s)?\s*\d+\s*(?:(?:/|of)\s*\d+)?\W*$", re.I)
#: Lines that are no prose: by their start (tables, code, headings by a sign, equations, symbols), or by what is in them (tabs, braces, arrows, pictures).
_BLOCK_START = re.compile(r"[|{}<>#=]|-{3,}|\W*$|[^ ]+\([^)]*\)|\w+ = |[^\w\s\"'“(\[\-°%‰±]")
_BLOCK_SIGN = re.compile(r"[\t{}←-⇿✀-➿\U0001F300-\U0001FAFF]|->")
_END = re.compile(r"[.!?][\"')\]]?\s+(?=[^\sa-zäöüß])|[。！？]")


def prose_lines(text: str) -> list[str]:
    """Paragraphs of a text: its lines joined, without tables, code, page numbers and short titles."""
    lines = [x.strip() for x in _JOIN.sub("", text).replace("\r", "").split("\n")]
    paragraphs: list[list[str]] = [[]]
    for line in lines:
        if not line:
            paragraphs.append([])
        elif _NUMBER_LINE.match(line) or _BLOCK_START.match(line) or _BLOCK_SIGN.search(line):
            continue
        else:
            paragraphs[-1].append(line[2:] if line.startswith("- ") else line)
    return [" ".join(p) for p in paragraphs if p]


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; what ends without a full stop counts only if it is long enough to be one."""
    out: list[str] = []
    for p in prose_lines(text or ""):
        last, parts = 0, []
        for m in _END.finditer(p):
            parts.append(p[last : m.start() + 1])  # the mark stays with its sentence
            last = m.end()
        for s in (*parts, p[last:]):
            s = s.strip()
            if s and (s[-1] in ".!?。！？\"')" or len(s) >= 60):
                out.append(s)
    return out
