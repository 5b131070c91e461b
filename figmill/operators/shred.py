"""Columnar shredding of nested records (problem 5).

A record is split into one column per leaf path. Each entry of a column has a
repetition level (the number of the repeated ancestor at which the entry starts
anew, 0 for the first of a record) and a definition level (how many steps of
the path exist). Tables are rebuilt per repeated ancestor from these level
sequences alone, so every row keeps the link to its parent row.

Results in the edge cases: null, empty or cut-off payloads give no rows; a path
that is absent gives one entry with a low definition level; values of mixed
shapes at one place (text here, object there) become separate leaf columns;
repeated files are kept, as rows of their own file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

ELEM = "[]"


class Column:
    """Levels and values of one leaf path."""

    __slots__ = ("path", "reps", "defs", "vals")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.reps, self.defs, self.vals = path, [], [], []

    def add(self, rep: int, level: int, value: object) -> None:
        self.reps.append(rep)
        self.defs.append(level)
        self.vals.append(value)


class _Node:
    __slots__ = ("fields", "leaf")

    def __init__(self) -> None:
        self.fields: dict[str, _Node] = {}
        self.leaf = False


def load(payload: str | None) -> object:
    """The parsed payload, or None where it is null, blank or not complete JSON. A bare NaN is a number."""
    if not payload or not payload.strip():
        return None
    try:
        return json.loads(payload)
    except (ValueError, RecursionError):
        return None


def _grow(node: _Node, value: object) -> None:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            _grow(node.fields.setdefault("." + k, _Node()), v)
    elif isinstance(value, list) and value:
        sub = node.fields.setdefault(ELEM, _Node())
        for v in value:
            _grow(sub, v)
    else:
        node.leaf = True


def _steps(value: object) -> dict[str, object] | None:
    if isinstance(value, dict) and value:
        return {"." + k: v for k, v in value.items()}
    if isinstance(value, list) and value:
        return {ELEM: value}
    return None


def shred(records: list[object]) -> dict[tuple[str, ...], Column]:
    """Leaf path -> column, over all records of a batch."""
    root = _Node()
    for r in records:
        _grow(root, r)
    cols: dict[tuple[str, ...], Column] = {}

    def absent(node: _Node, path: tuple[str, ...], rep: int, level: int) -> None:
        if node.leaf:
            cols.setdefault(path, Column(path)).add(rep, level, None)
        for step, sub in node.fields.items():
            absent(sub, (*path, step), rep, level)

    def walk(node: _Node, value: object, path: tuple[str, ...], rep: int, level: int, depth: int) -> None:
        inner = _steps(value)
        if node.leaf:
            own = inner is None
            cols.setdefault(path, Column(path)).add(rep, level if own else level - 1, value if own else None)
        for step, sub in node.fields.items():
            if inner is None or step not in inner:
                absent(sub, (*path, step), rep, level)
            elif step == ELEM:
                for i, v in enumerate(inner[ELEM]):
                    walk(sub, v, (*path, ELEM), rep if i == 0 else depth + 1, level + 1, depth + 1)
            else:
                walk(sub, inner[step], (*path, step), rep, level + 1, depth)

    for r in records:
        walk(root, r, (), 0, 0, 0)
    return cols


def rows_of(column: Column, ancestor: tuple[str, ...]) -> list[tuple[int, int, int, object]]:
    """Entries of a column numbered by a repeated ancestor: (record, ancestor row
    or -1, entry, value). ``ancestor`` is a prefix of the path that ends in ``[]``,
    or () for the record itself. An entry belongs to the row of the ancestor that
    was opened last; rows are counted from the levels, not from the values."""
    depth = sum(s == ELEM for s in ancestor)
    need = len(ancestor)
    out, record, row = [], -1, -1
    for i, (r, d, v) in enumerate(zip(column.reps, column.defs, column.vals)):
        if r == 0:
            record += 1
            row = -1
        if d >= need and (r <= depth):
            row += 1
        out.append((record, row if d >= need else -1, i, v if d >= len(column.path) else None))
    return out


def assemble(cols: dict[tuple[str, ...], Column]) -> list[object]:
    """The records back from their columns (the inverse of ``shred``)."""
    n = max((c.reps.count(0) for c in cols.values()), default=0)
    out: list[object] = [None] * n
    seen = [False] * n
    for path, col in cols.items():
        record, idx = -1, []
        for r, d, v in zip(col.reps, col.defs, col.vals):
            if r == 0:
                record += 1
                idx = [0] * (path.count(ELEM) + 1)
            else:
                idx[r - 1] += 1
                idx[r:] = [0] * (len(idx) - r)
            if d < len(path):
                continue
            node, at, k = (out, record, 0)
            for step in path:
                want = [] if step == ELEM else {}
                if node[at] is None or type(node[at]) is not type(want):
                    node[at] = want
                node = node[at]
                if step == ELEM:
                    at = idx[k]
                    k += 1
                    while len(node) <= at:
                        node.append(None)
                else:
                    at = step[1:]
                    node.setdefault(at, None)
            node[at] = v
            seen[record] = True
    return out


_PARTS = {"meta", "text_evidence", "raw_data"}


def packets_of(root: object) -> list[dict]:
    """The packets of a parsed payload, wrappers removed; a file of mapped points has none."""
    if isinstance(root, dict) and not _PARTS & set(root):  # a wrapper: the list in it that holds packets
        lists = [v for k, v in sorted(root.items(), key=lambda x: x[0] != "packets") if isinstance(v, list) and any(isinstance(x, dict) and _PARTS & set(x) for x in v)]
        root = lists[0] if lists else root
    rows = root if isinstance(root, list) else [root]
    return [r for r in rows if isinstance(r, dict) and _PARTS & set(r)]


def open_text_evidence(packet: dict) -> dict:
    """The packet with a text_evidence that was stored as JSON text opened in place."""
    te = packet.get("text_evidence")
    if isinstance(te, str):
        inner = load(te)
        if isinstance(inner, (dict, list)):
            return {**packet, "text_evidence": inner}
    return packet


_FIGURE, _TEXT, _SOURCE = ("figure", "fig"), ("text", "txt", "content", "label", "value"), ("file", "source", "src", "crop", "image", "path")


def _words(key: str) -> list[str]:
    out, word, prev = [], "", ""
    for ch in key:
        if ch.isalnum():
            if word and ch.isupper() and not prev.isupper():
                out.append(word.lower())
                word = ""
            word += ch
        elif word:
            out.append(word.lower())
            word = ""
        prev = ch
    return [*out, word.lower()] if word else out


def _pick(keys: list[str], exact: str, wanted: tuple[str, ...], avoid: tuple[str, ...] = ()) -> str | None:
    """The key that stands for a field: its own name first, else the first of the wanted words in it."""
    if exact in keys:
        return exact
    for w in wanted:
        for k in keys:
            ws = _words(k)
            if any(x == w or x.startswith(w) for x in ws) and not any(x in avoid for x in ws):
                return k
    return None


def _legend_part(packet: dict) -> dict:
    """The fields of a packet at whose first or second step a legend is named; the rest, points above all, isn't shredded."""
    named = lambda k: "legend" in [w[:6] for w in _words(k)]
    out = {}
    for k, v in packet.items():
        if named(k):
            out[k] = v
        elif isinstance(v, dict) and (part := {x: y for x, y in v.items() if named(x)}):
            out[k] = part
    return out


def legend_items(packet: dict) -> list[tuple[str | None, str]]:
    """(text, source file) of each legend item of a packet in reading order, from
    the level sequences of the leaf columns below its legend field."""
    cols = shred([_legend_part(open_text_evidence(packet))])
    homes: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for path in cols:
        for k, step in enumerate(path[:2]):
            if step.startswith(".") and "legend" in [w[:6] for w in _words(step)]:
                homes.setdefault(path[: k + 1], []).append(path)
                break
    if not homes:
        return []
    exact = [h for h in homes if h[-1] == ".legend_text"]
    home = (exact or sorted(homes, key=len))[0]
    below = {p[len(home):]: cols[p] for p in homes[home]}
    leaves = [p for p in below if any(d >= len(home) + len(p) for d in below[p].defs)]
    items: dict[tuple[int, ...], list] = {}

    def slot(at: tuple[int, ...]) -> list:
        return items.setdefault(at, [None, ""])

    maps = [p for p in leaves if p and p[-1] != ELEM]
    heads: dict[tuple[str, ...], list[str]] = {}
    for p in maps:
        k = max((i for i, s in enumerate(p) if s == ELEM), default=-1) + 1
        if len(p) == k + 1:
            heads.setdefault(p[:k], []).append(p[k][1:])
    for p in leaves:
        col, full = below[p], len(home) + len(p)
        idx = [0] * (p.count(ELEM) + 1)
        head = p[: max((i for i, s in enumerate(p) if s == ELEM), default=-1) + 1]
        key = p[len(head)][1:] if len(p) == len(head) + 1 else None
        keys = heads.get(head, [])
        text, source = _pick(keys, "text", _TEXT, _SOURCE), _pick(keys, "source_file", _SOURCE)
        if text == source and text is not None and text != "text":
            text = None
        for r, d, v in zip(col.reps, col.defs, col.vals):
            if r:
                idx[r - 1] += 1
                idx[r:] = [0] * (len(idx) - r)
            if d < full or isinstance(v, (dict, list)):
                continue
            at = tuple(idx[:-1])
            if p == head or key is None:
                if p == head and v is not None:
                    slot(at)[0] = v
            elif key == text:
                slot(at)[0] = v
            elif key == source:
                slot(at)[1] = v or ""
            elif text is None and not head:
                items[(*at, keys.index(key))] = [v, key]
            elif text is None and isinstance(v, str) and "." in key:
                items[(*at, keys.index(key))] = [v, key]
    return [tuple(items[k]) for k in sorted(items)]


def _figure(packet: dict) -> str | None:
    meta = packet.get("meta")
    meta = meta if isinstance(meta, dict) else {}
    key = _pick(list(meta), "figure_id", _FIGURE, ("caption", "dir", "title", "text"))
    got = meta.get(key) if key else packet.get("figure_id")
    return got if got is None or isinstance(got, str) else str(got)


def tables_of(record: object) -> list[tuple[str, int, str | None, int | None, dict[str, str]]]:
    """(table, row, parent table, parent row, fields) of a record: one table per repeated ancestor, the record's own first.

    A table's rows are the elements of its array, numbered by the level sequences of its columns; a row's parent is the row
    of the next repeated ancestor above it that was open when it began. Fields are leaf paths below the ancestor with their
    values as JSON; a path that is absent or null in a row has no entry."""
    cols = shred([record])
    rows: dict[tuple[str, ...], dict[int, tuple[int | None, dict[str, str]]]] = {(): {0: (None, {})}}
    for path, col in cols.items():
        at = [()] + [path[: i + 1] for i, s in enumerate(path) if s == ELEM]
        numbers = {a: [r for _, r, _, _ in rows_of(col, a)] if a else [0] * len(col.reps) for a in at}
        for k, a in enumerate(at[1:], 1):
            table, up = rows.setdefault(a, {}), numbers[at[k - 1]]
            for i, r in enumerate(numbers[a]):
                if r >= 0 and r not in table:
                    table[r] = (up[i], {})
        home = at[-1]
        for _, _, i, v in rows_of(col, home):
            if v is not None and numbers[home][i] >= 0:
                rows[home][numbers[home][i]][1]["".join(path[len(home) :]).lstrip(".") or "value"] = json.dumps(v, ensure_ascii=False)
    out = []
    for a in sorted(rows, key=lambda a: (len(a), a)):
        ups = [a[: i + 1] for i, s in enumerate(a[:-1]) if s == ELEM]
        parent = "".join(ups[-1]).lstrip(".") if ups else ""
        for r, (up, fields) in sorted(rows[a].items()):
            out.append(("".join(a).lstrip("."), r, parent if a else None, up, fields))
    return out


def flat_tables(raw: DataFrame) -> DataFrame:
    """file_id, packet_no, table_path, row_no, parent_path, parent_row, fields: every packet as related flat tables.

    ``table_path`` names the repeated ancestor ("" for the packet itself, ``raw_data[]`` for points, ``text_evidence.chart_text[]``
    and so on, whatever the file holds), ``fields`` maps the leaf paths below it to JSON values. (file_id, packet_no,
    parent_path, parent_row) is the key of the parent's row. Files of mapped points alone are one packet of points."""
    names = ["file_id", "packet_no", "table_path", "row_no", "parent_path", "parent_row", "fields"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 200):
                part, rows = pdf.iloc[at : at + 200], []
                for fid, payload in zip(part.file_id, part.payload):
                    root = load(payload)
                    own = packets_of(root)
                    if not own and isinstance(root, list) and any(isinstance(x, dict) for x in root):
                        own = [{"raw_data": root}]
                    rows += [(fid, no, *r) for no, packet in enumerate(own) for r in tables_of(open_text_evidence(packet))]
                yield pd.DataFrame(rows, columns=names)

    return raw.select("file_id", "payload").mapInPandas(run, "file_id long, packet_no int, table_path string, row_no int, parent_path string, parent_row int, fields map<string, string>")


def flat_packets(raw: DataFrame) -> DataFrame:
    """file_id, packet_no, figure_id, n_items: one row per packet of each file."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for fid, payload in zip(pdf.file_id, pdf.payload):
                for no, packet in enumerate(packets_of(load(payload))):
                    rows.append((fid, no, _figure(packet), len(legend_items(packet))))
            yield pd.DataFrame(rows, columns=["file_id", "packet_no", "figure_id", "n_items"])

    return raw.select("file_id", "payload").mapInPandas(run, "file_id long, packet_no int, figure_id string, n_items int")


def flat_legend_items(raw: DataFrame) -> DataFrame:
    """file_id, packet_no, figure_id, item_no, text, source_file: one row per legend item.

    Items without a source file have an empty string there; empty texts are
    items; null payloads and files of mapped points have none. Files are
    independent, so nothing is shuffled."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for fid, payload in zip(pdf.file_id, pdf.payload):
                for no, packet in enumerate(packets_of(load(payload))):
                    fig = _figure(packet)
                    for i, (text, src) in enumerate(legend_items(packet)):
                        rows.append((fid, no, fig, i, None if text is None else str(text), str(src)))
            yield pd.DataFrame(rows, columns=["file_id", "packet_no", "figure_id", "item_no", "text", "source_file"])

    return raw.select("file_id", "payload").mapInPandas(run, "file_id long, packet_no int, figure_id string, item_no int, text string, source_file string")


def found(raw: DataFrame) -> DataFrame:
    """The columns of p5_found."""
    return flat_legend_items(raw).select("file_id", "figure_id", F.col("item_no").cast("int").alias("item_no"), "source_file")
