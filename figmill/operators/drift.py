"""Schemas that drift between files (problem 1).

Each file is profiled once: its observed paths, their JSON types and how its
fields differ from the baseline schema. Fields that left and fields that came
make a *version*; over all files of the corpus every path gets a value sketch.
A version's missing and new fields are matched as a bipartite graph, weighted
by name similarity, types, sketch similarity and how often the new field stands
where the old one lacks, and solved for the best assignment. Matched pairs are renames; with them every file is read into one
consistent table.

Size: only sketches per path are aggregated, and what joins back is one row per
version. Files are profiled and unified without a shuffle of payloads.

Edge cases: null, empty or cut-off payloads have no changes; a bare NaN is a
number and null is no change of type; files of mapped points alone are compared
below ``raw_data[]`` only; repeated files are reported each; an empty table
gives an empty result.
"""

from __future__ import annotations

import difflib
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from figmill.operators.shred import _words, load, packets_of
from figmill.session import cut, looked_up

#: Numbers: bins of a signed logarithm. Texts: hashed shapes and words, then lengths.
NUMBER_BINS, SHAPE_BINS, LENGTH_BINS = 48, 64, 12
BINS = NUMBER_BINS + SHAPE_BINS + LENGTH_BINS
#: A pair below this weight is no rename.
MATCH_AT = 0.42


def json_type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


_LETTERS, _DIGITS, _BLANKS, _RUNS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"\s+"), re.compile(r"(.)\1+", re.S)


def _shape(s: str) -> str:
    """A text with each run of letters, digits, blanks or of one sign as a single character."""
    return _RUNS.sub(r"\1", _BLANKS.sub(" ", _DIGITS.sub("9", _LETTERS.sub("a", s))))


def _bins_of(v: str) -> tuple[int, ...]:
    words = {w for w in _words(v) if not w.isdigit()}
    return (*{NUMBER_BINS + _hash(key) % SHAPE_BINS for key in {_shape(v)} | words | {w[:4] for w in words}}, NUMBER_BINS + SHAPE_BINS + min(LENGTH_BINS - 1, int(2 * math.log2(1 + len(v)))))


_cached_bins = lru_cache(50_000)(_bins_of)


def _text_bins(v: str) -> tuple[int, ...]:
    """Bins of a whole text: its shape, its words and their stems, and its length. Short texts, which repeat, are kept."""
    return _cached_bins(v) if len(v) <= 256 else _bins_of(v)


def add_to_sketch(sketch: dict[int, int], v: object) -> None:
    """Count one plain value: numbers by magnitude, texts by shape, words and length."""
    if isinstance(v, str):
        if v:
            for b in _text_bins(v):
                sketch[b] = sketch.get(b, 0) + 1
    elif not isinstance(v, bool) and isinstance(v, (int, float)) and math.isfinite(v):
        b = max(0, min(NUMBER_BINS - 1, int(NUMBER_BINS / 2 + math.copysign(4 * math.log2(1 + abs(v) / 1.5), v) / 2)))
        sketch[b] = sketch.get(b, 0) + 1


class Baseline:
    """The baseline schema as dictionaries."""

    def __init__(self, rows: list[tuple[str, str, bool]]):
        self.types = {p: t for p, t, _ in rows}
        self.required = {p for p, _, r in rows if r}
        self.children: dict[str, list[str]] = {}
        for p in self.types:
            self.children.setdefault(parent(p), []).append(p)


@lru_cache(100_000)
def parent(path: str) -> str:
    return path[:-2] if path.endswith("[]") else path.rpartition(".")[0]


def _version(missing: set, new: set) -> str | None:
    """The name of a file's missing and new fields, None where one of them is empty."""
    return "|".join(sorted(missing)) + " -> " + "|".join(sorted(new)) if missing and new else None


def profile_file(base: Baseline, payload: str | None, sketches: bool = True) -> tuple[dict, set, set, set] | None:
    """(path -> [objects, type set, sketch], missing, new, retyped) of one file, or None where it has no cases."""
    root = load(payload)
    packets = packets_of(root)
    seen: dict[str, list] = {}
    holders: dict[str, int] = {}

    def note(path: str, v: object) -> str:
        t = json_type(v)
        e = seen.setdefault(path, [0, set(), {}])
        e[0] += 1
        e[1].add(t)
        if sketches:
            add_to_sketch(e[2], v)
        return t

    def walk(path: str, v: object) -> None:
        want = base.types.get(path)
        t = note(path, v)
        if want is None or t != want:
            return
        if t == "object":
            fields(path, v)
        elif t == "array":
            for x in v:
                if x is not None:
                    walk(path + "[]", x)

    def fields(path: str, v: dict) -> None:
        holders[path] = holders.get(path, 0) + 1
        for k, x in v.items():
            walk(f"{path}.{k}" if path else k, x)

    if packets:
        for p in packets:
            fields("", p)
    elif isinstance(root, list) and any(isinstance(x, dict) for x in root):
        for x in root:
            if isinstance(x, dict):
                walk("raw_data[]", x)
    else:
        return None
    retyped = {p for p, (_, ts, _) in seen.items() if p in base.types and ts - {"null", base.types[p]}}
    missing = {c for h in holders for c in base.children.get(h, ()) if c in base.required and c not in seen}
    new = {p for p in seen if p not in base.types}
    changed = retyped | missing

    def hidden(p: str) -> bool:
        q = p
        while q := parent(q):
            if q in changed:
                return True
        return False

    return seen, {p for p in missing if not hidden(p)}, {p for p in new if not hidden(p)}, {p for p in retyped if not hidden(p)}


def name_similarity(a: str, b: str) -> float:
    """Of two field names: words, abbreviations and spelling; 1 for the same words in any order."""
    wa, wb = _words(a), _words(b)
    if not wa or not wb:
        return 0.0
    if sorted(wa) == sorted(wb) or "".join(wa) == "".join(wb):
        return 1.0

    def like(x: str, y: str) -> float:
        if x == y:
            return 1.0
        s, t = sorted((x, y), key=len)
        if len(s) > 1 and (t.startswith(s) or s.rstrip("s") == t.rstrip("s")):
            return 0.9
        it = iter(t)
        return 0.7 if len(s) > 1 and s[0] == t[0] and all(c in it for c in s) else 0.0

    short, long = sorted((wa, wb), key=len)
    hit = sum(max(like(x, y) for y in long) for x in short)
    back = sum(max(like(x, y) for y in short) for x in long)
    words = 0.6 * hit / len(short) + 0.4 * back / len(long)
    return max(words, 0.8 * difflib.SequenceMatcher(None, "".join(wa), "".join(wb)).ratio())


def sketch_similarity(base: np.ndarray, new: np.ndarray) -> float | None:
    """Likeness of a new field's sketch to a baseline field's, None where one of them holds no value: the overlap of the
    distributions, for few values rather the share that lies where the baseline has values."""
    if base.sum() == 0 or new.sum() == 0:
        return None
    parts = []
    for lo, hi in ((0, NUMBER_BINS), (NUMBER_BINS, NUMBER_BINS + SHAPE_BINS), (NUMBER_BINS + SHAPE_BINS, BINS)):
        x, y = base[lo:hi], new[lo:hi]
        n, m = x.sum(), y.sum()
        if n and m:
            x, y = x / n, y / m
            trust = m / (m + 10.0)
            parts.append((trust * float(np.minimum(x, y).sum()) + (1 - trust) * float(y[x > 0.01].sum()), n + m))
        elif n or m:
            parts.append((0.0, n + m))
    return sum(v * w for v, w in parts) / sum(w for _, w in parts)


def pair_weight(base_path: str, base_type: str, base_sketch: np.ndarray, new_path: str, new_types: dict[str, int], new_sketch: np.ndarray, replaces: float) -> float:
    """How much a new field looks like the successor of a missing one: name, values and ``replaces``,
    the share of the new field's files that lack the old one; all by the share of the new field's files (``new_types``
    counts them by type) that have the old one's type. 0 where types or places exclude it."""
    kinds = {t: n for t, n in new_types.items() if t != "null"}
    fits = kinds.get(base_type, 0) / sum(kinds.values()) if kinds else 1.0
    if not fits:
        return 0.0
    if base_type in ("array", "object") and not kinds:
        return 0.0
    same_place = parent(base_path) == parent(new_path)
    name = name_similarity(base_path.rpartition(".")[2], new_path.rpartition(".")[2])
    if not same_place and (name < 0.99 or "[]" in base_path or "[]" in new_path):
        return 0.0
    value = sketch_similarity(base_sketch, new_sketch)
    if base_type in ("array", "object"):
        return fits * (0.6 * name + 0.4 * replaces)
    if value is None:
        return fits * (0.65 * name + 0.35 * replaces)
    return fits * (0.3 * name + 0.35 * value + 0.35 * replaces)


def assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total weight: the Hungarian method with potentials."""
    flip = weight.shape[0] > weight.shape[1]
    w = weight.T if flip else weight
    n, m = w.shape
    cost = w.max(initial=0.0) - w
    u, v, way, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if cur < low[j]:
                        low[j], way[j] = cur, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(j, i) for i, j in pairs] if flip else pairs


def _baseline(schema: DataFrame) -> Baseline:
    """The baseline has one row per field of one packet, a size that does not depend on the data."""
    return Baseline([(r.field_path, r.json_type, bool(r.required)) for r in schema.select("field_path", "json_type", "required").collect()])


PASS = "path string, type string, files long, objects long, sketch array<long>, file_id long, missing array<string>, new array<string>, retyped array<string>, version string"


def _one_pass(raw: DataFrame, schema: DataFrame) -> DataFrame:
    """Payloads are parsed once: rows with a path are value sketches of a task, rows with a file_id the changes of a file.

    Sketches are summed in each task before anything is shuffled, so a path that all files hold costs one row per task.
    Retyped uses of a path do not count to it. The rows, few beside the payloads, are cut through the checkpoint folder."""
    base = _baseline(schema)
    names = ["path", "type", "files", "objects", "sketch", "file_id", "missing", "new", "retyped", "version"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str], list] = {}
        for pdf in it:
            rows = []
            for fid, payload in zip(pdf.file_id, pdf.payload):
                got = profile_file(base, payload)
                if got is None:
                    continue
                if any(got[1:]):
                    missing, new, retyped = map(sorted, got[1:])
                    rows.append((None, None, None, None, None, fid, missing, new, retyped, _version(got[1], got[2])))
                for p, (n, types, sk) in got[0].items():
                    kinds = types - {"null"}
                    if len(kinds) > 1 or (p in base.types and kinds and kinds != {base.types[p]}):
                        continue
                    e = total.setdefault((p, next(iter(kinds), "null")), [0, 0, np.zeros(BINS, dtype=np.int64)])
                    e[0] += 1
                    e[1] += n
                    for b, c in sk.items():
                        e[2][b] += c
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame([(p, t, *e, None, None, None, None, None) for (p, t), e in total.items()], columns=names)

    return cut(raw.select("file_id", "payload").mapInPandas(run, PASS))


def _sketches(part: DataFrame) -> DataFrame:
    part = part.where("path is not null")
    # few rows per task and path: their bins are added as rows of (path, bin)
    bins = part.select("path", F.posexplode("sketch").alias("bin", "n")).where("n > 0").groupBy("path", "bin").agg(F.sum("n").alias("n"))
    vec = bins.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    head = part.groupBy("path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("files").alias("files"), F.sum("objects").alias("objects"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0).cast("long")))
    kinds = part.groupBy("path", "type").agg(F.sum("files").alias("n")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("by_type"))
    return head.join(vec, "path", "left").join(kinds, "path", "left").select("path", "types", "files", "objects", filled.alias("sketch"), "by_type")


def _changes(part: DataFrame) -> DataFrame:
    return part.where("file_id is not null").select("file_id", "missing", "new", "retyped", "version")


def sketch_table(raw: DataFrame, schema: DataFrame) -> DataFrame:
    """path, types, files, objects, sketch, by_type: value sketches of every path over the whole corpus, its files by type."""
    return _sketches(_one_pass(raw, schema))


def file_changes(raw: DataFrame, schema: DataFrame) -> DataFrame:
    """One row per file that differs from the baseline: its missing, new and retyped fields and its version."""
    return _changes(_one_pass(raw, schema))


def renames(changes: DataFrame, sketches: DataFrame, schema: DataFrame) -> DataFrame:
    """version, base_path, new_path, weight: the best assignment of new to missing fields of each version."""
    base = _baseline(schema)
    versions = changes.where("version is not null").groupBy("version").agg(F.first("missing").alias("missing"), F.first("new").alias("new"), F.count(F.lit(1)).alias("files"))
    sides = versions.select("version", F.explode(F.concat(F.transform("missing", lambda p: F.struct(p.alias("path"), F.lit("missing").alias("side"))), F.transform("new", lambda p: F.struct(p.alias("path"), F.lit("new").alias("side"))))).alias("s")).select("version", "s.path", "s.side")
    # how many files have a new path while a baseline path is missing: at most one entry per baseline path
    pairs = versions.select(F.explode("new").alias("path"), "missing", "files").select("path", F.explode("missing").alias("base_path"), "files").groupBy("path", "base_path").agg(F.sum("files").alias("n"))
    lacking = pairs.groupBy("path").agg(F.collect_list(F.struct("base_path", "n")).alias("lacking"))
    rows = sides.join(sketches.select("path", F.map_entries("by_type").alias("types"), "files", "sketch"), "path", "left").join(lacking, "path", "left")

    # one row per version, with its few fields
    per = rows.groupBy("version").agg(F.sort_array(F.collect_list(F.struct("path", "side", "types", "files", "sketch", "lacking"))).alias("fields"))

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero = np.zeros(BINS)
        for pdf in it:
            out = []
            for version, fields in zip(pdf.version, pdf.fields):
                old, new = [], []
                for f in fields:
                    sk = zero if f["sketch"] is None else np.asarray(f["sketch"], float)
                    if f["side"] == "missing":
                        old.append((f["path"], sk))
                    else:
                        share = {} if f["lacking"] is None else {e["base_path"]: e["n"] / (max(f["files"] or 0, e["n"]) + 0.5) for e in f["lacking"]}
                        new.append((f["path"], {} if f["types"] is None else {e["key"]: e["value"] for e in f["types"]}, sk, share))
                w = np.array([[pair_weight(p, base.types[p], s, q, t, k, share.get(p, 0.0)) for q, t, k, share in new] for p, s in old])
                w[w < MATCH_AT] = 0.0
                out += [(version, old[i][0], new[j][0], float(w[i, j])) for i, j in assignment(w) if w[i, j] > 0]
            yield pd.DataFrame(out, columns=["version", "base_path", "new_path", "weight"])

    return per.mapInPandas(solve, "version string, base_path string, new_path string, weight double")


def resolved(raw: DataFrame, schema: DataFrame) -> DataFrame:
    """file_changes with the renames of each file as a map from baseline to new path."""
    part = _one_pass(raw, schema)
    changes = _changes(part)
    found_ = renames(changes, _sketches(part), schema)
    maps = found_.groupBy("version").agg(F.map_from_entries(F.collect_list(F.struct("base_path", "new_path"))).alias("renamed"))
    # files without a version have nothing to look up and stay out of the join
    rest = changes.where("version is null").withColumn("renamed", F.lit(None).cast("map<string,string>"))
    return looked_up(changes.where("version is not null"), maps, "version").select(*rest.columns).unionByName(rest)


def found(raw: DataFrame, schema: DataFrame) -> DataFrame:
    """The columns of p1_found: one row per file and changed field."""
    r = resolved(raw, schema)
    olds = F.coalesce(F.map_keys("renamed"), F.array().cast("array<string>"))
    news = F.coalesce(F.map_values("renamed"), F.array().cast("array<string>"))
    tag = lambda arr, name: F.transform(arr, lambda p: F.struct(p.alias("field_path"), F.lit(name).alias("change")))
    rows = F.concat(tag(F.array_except("missing", olds), "removed"), tag(olds, "renamed"), tag(F.col("retyped"), "retyped"), tag(F.array_except("new", news), "added"))
    return r.select("file_id", F.explode(rows).alias("c")).select("file_id", "c.field_path", "c.change")


# --- one consistent table -------------------------------------------------


def _number(v: object) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v) if math.isfinite(v) else None
    if isinstance(v, str):
        try:
            x = float(v.strip().replace(",", "."))
            return x if math.isfinite(x) else None
        except ValueError:
            return None
    if isinstance(v, list):
        return _number(v[0]) if len(v) == 1 else None
    return _number(next(iter(v.values()), None)) if len(v) == 1 else None


def _string(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, list):
        return " ".join(x for x in map(_string, v) if x)
    if isinstance(v, dict):
        return _string(v.get("text", next((x for x in v.values() if isinstance(x, str)), None)))
    return str(v)


def _without(v: object, packets: set[int]) -> object:
    """A value of a wrapper without the packets (by id) in it, None where nothing is left."""
    if isinstance(v, list) and any(id(x) in packets for x in v):
        return [x for x in v if id(x) not in packets] or None
    return v


def unify_packet(packet: dict, renamed: dict[str, str], around: dict[str, object] | None = None) -> dict:
    """A packet in the baseline's shape: renamed fields under their baseline names, values in the baseline's types.

    What has no column, or more in it than its column holds, stays in the ``rest`` of the packet, item or point: a map
    of path to JSON value, without nulls. ``around`` is what a wrapper holds beside the packets."""
    from figmill.operators.shred import legend_items, open_text_evidence

    packet = open_text_evidence(packet)
    used: set[tuple[int, str]] = set()

    def place(holder: dict, path: str) -> tuple[dict, str] | None:
        key = path.rpartition(".")[2]
        if key in holder:
            return holder, key
        new = renamed.get(path)
        if new is None:
            return None
        return (holder, new.rpartition(".")[2]) if parent(new) == parent(path) else (packet, new)

    def get(holder: object, path: str, read: Callable = lambda v: v, whole: Callable = lambda v, x: True) -> object:
        at = place(holder, path) if isinstance(holder, dict) else None
        v = at[0].get(at[1]) if at else None
        x = read(v)
        if at and whole(v, x):
            used.add((id(at[0]), at[1]))
        return x

    plain = lambda v, x: x is not None and not isinstance(v, (list, dict))
    string = lambda h, path: get(h, path, _string, plain)
    number = lambda h, path: get(h, path, _number, plain)

    def rest(holder: object, path: str) -> dict[str, str]:
        """The unused fields of a holder; a holder that is none, or has fields to lose, as a whole."""
        if isinstance(holder, dict):
            return {(f"{path}.{k}" if path else k): json.dumps(v, ensure_ascii=False) for k, v in holder.items() if v is not None and (id(holder), k) not in used}
        return {path: json.dumps(holder, ensure_ascii=False)} if isinstance(holder, list) else {}

    def item(x: object, at: str) -> dict:
        if not isinstance(x, dict):
            return {"text": _string(x), "source_file": None, "note": None, "rest": rest(x, f"{at}[]")}
        out = {k: string(x, f"{at}[].{k}") for k in ("text", "source_file", "note")}
        return out | {"rest": rest(x, f"{at}[]")}

    is_object = lambda v, x: isinstance(v, dict)
    meta, te = get(packet, "meta", whole=is_object), get(packet, "text_evidence", whole=is_object)
    out = {k: string(meta, f"meta.{k}") for k in ("figure_id", "source_intermediate_dir", "caption")}
    for kind in ("x_axis_title", "y_axis_title", "chart_text"):
        at = f"text_evidence.{kind}"
        items = get(te, at)
        items = items if isinstance(items, list) else [items] if items else []
        out[kind] = [item(x, at) for x in items]
    at = "text_evidence.legend_text"
    legend = legend_items(packet)
    # items that stand one by one keep their other fields; other forms of a legend stay whole in the packet's rest
    own = get(te, at, whole=lambda v, x: isinstance(v, list) and len(v) == len(legend))
    own = own if isinstance(own, list) and len(own) == len(legend) else [None] * len(legend)
    out["legend_text"] = [item(x, at) | {"text": _string(t), "source_file": s or None} for (t, s), x in zip(legend, own)]
    data = get(packet, "raw_data", whole=lambda v, x: isinstance(v, dict) or isinstance(v, list) and all(y is None or isinstance(y, dict) for y in v))
    if isinstance(data, dict):
        cols = {k: v if isinstance(v, list) else [v] for k, v in data.items()}
        data = [{k: v[i] if i < len(v) else None for k, v in cols.items()} for i in range(max(map(len, cols.values()), default=0))]
    pts = [x for x in data if isinstance(x, dict)] if isinstance(data, list) else []
    out["raw_data"] = []
    for x in pts:
        point = {"Series": string(x, "raw_data[].Series"), **{k: number(x, f"raw_data[].{k}") for k in ("X", "Y_Left", "Y_Right")}}
        out["raw_data"].append(point | {"rest": rest(x, "raw_data[]")})
    out["rest"] = {k: json.dumps(v, ensure_ascii=False) for k, v in (around or {}).items() if v is not None} | rest(packet, "")
    for holder, path in ((meta, "meta"), (te, "text_evidence")):
        if isinstance(holder, dict):
            out["rest"] |= rest(holder, path)
    return out


_REST = "rest: map<string, string>"
_ITEMS = f"array<struct<text: string, source_file: string, note: string, {_REST}>>"
UNIFIED = f"file_id long, packet_no int, figure_id string, source_intermediate_dir string, caption string, x_axis_title {_ITEMS}, y_axis_title {_ITEMS}, chart_text {_ITEMS}, legend_text {_ITEMS}, raw_data array<struct<Series: string, X: double, Y_Left: double, Y_Right: double, {_REST}>>, rest map<string, string>"


def unified(raw: DataFrame, schema: DataFrame) -> DataFrame:
    """All packets of all files in one table; a file of mapped points is one packet with points only.

    Every payload's version is found again from the payload itself, so rows of one file_id stay apart; the renames, one row
    per version, are looked up (by broadcast while they are few, so payloads aren't shuffled)."""
    base = _baseline(schema)
    part = _one_pass(raw, schema)
    found_ = renames(_changes(part), _sketches(part), schema)
    names = ["file_id", "packet_no", "figure_id", "source_intermediate_dir", "caption", "x_axis_title", "y_axis_title", "chart_text", "legend_text", "raw_data", "rest"]

    def packets(fid: int, payload: str | None, renamed: dict[str, str]) -> list[tuple]:
        root = load(payload)
        own = packets_of(root)
        if not own and isinstance(root, list) and any(isinstance(x, dict) for x in root):
            own = [{"raw_data": root}]
        # of a wrapper, all but the packets themselves
        ids = set(map(id, own))
        around = {k: left for k, v in root.items() if (left := _without(v, ids)) is not None} if isinstance(root, dict) and own and own[0] is not root else {}
        return [(fid, no, *(u[k] for k in names[2:])) for no, u in enumerate(unify_packet(p, renamed, around) for p in own)]

    @F.pandas_udf("string")
    def version_of(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: _version(got[1], got[2]) if (got := profile_file(base, p, sketches=False)) else None)

    maps = found_.groupBy("version").agg(F.collect_list(F.struct("base_path", "new_path")).alias("renamed"))
    rows = looked_up(raw.select("file_id", "payload", version_of("payload").alias("version")), maps, "version").select("file_id", "payload", "renamed")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for fid, payload, ren in zip(pdf.file_id, pdf.payload, pdf.renamed):
                out += packets(fid, payload, {} if ren is None else {e["base_path"]: e["new_path"] for e in ren})
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, UNIFIED)
