"""Quantities recorded in different units (problem 4).

A multi-pattern automaton finds the aliases of all units in axis titles and
captions; the longest match wins and the field it stands in settles what is left
(an alias must belong to the quantity the axis names; a caption counts only where
it says that the axis quantity *is in* that unit, so conditions don't). Then the
conversion factors, a table of fixed size, are joined by broadcast.

Texts are compared by an outline in which characters that recognition confuses
fall together, and words broken at a line end are joined first, so a damaged
``minufes`` still reads as a unit; aliases of under five letters must match exactly.

Edge cases: null or empty titles, captions and arrays state no unit; NaN counts
as null; an axis without values gives no row; repeated packets give a row each.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Unit code, quantity, factor and offset to the target unit (target = value * factor + offset), aliases.
UNITS = [
    ("ml_per_min", "flow_rate", 1.0, 0.0, "mL/min;ml/min;mL min-1;ml min-1;mL min^-1;ml min^-1;mL·min⁻¹;ml·min⁻¹;mL min⁻¹;cm3/min;cm³/min;cm3 min-1;cc/min;ccm;millilitres per minute;milliliters per minute;millilitre per minute;mL per min;cubic centimetres per minute"),
    ("l_per_h", "flow_rate", 1000.0 / 60.0, 0.0, "L/h;l/h;L/hr;l/hr;L h-1;l h-1;L h^-1;L·h⁻¹;l·h⁻¹;L h⁻¹;dm3/h;dm³/h;dm3 h-1;litres per hour;liters per hour;litre per hour"),
    ("ul_per_min", "flow_rate", 0.001, 0.0, "µL/min;μL/min;uL/min;ul/min;µl/min;μl/min;µL min-1;μL min-1;uL min-1;µl min-1;μl min-1;ul min-1;µL·min⁻¹;μL·min⁻¹;uL·min⁻¹;µL min⁻¹;mm3/min;microlitres per minute;microliters per minute"),
    ("ml_per_h", "flow_rate", 1.0 / 60.0, 0.0, "mL/h;ml/h;mL/hr;ml/hr;mL h-1;ml h-1;mL h^-1;mL·h⁻¹;ml·h⁻¹;mL h⁻¹;cc/hr;cc/h;cm3/h;cm3 h-1;millilitres per hour;milliliters per hour"),
    ("deg_c", "temperature", 1.0, 0.0, "°C;℃;deg C;degC;oC;º C;ºC;° C;degrees Celsius;degree Celsius;Celsius;degrees C;centigrade"),
    ("kelvin", "temperature", 1.0, -273.15, "K;kelvin;kelvins;Kelvin;Kelvins"),
    ("deg_f", "temperature", 5.0 / 9.0, -160.0 / 9.0, "°F;℉;deg F;degF;oF;ºF;° F;degrees Fahrenheit;degree Fahrenheit;Fahrenheit;degrees F"),
    ("mpa", "pressure", 1.0, 0.0, "MPa;Mpa;MPa abs;MPa(a);N/mm2;N/mm²;N mm-2;megapascal;megapascals;mega pascal"),
    ("bar", "pressure", 0.1, 0.0, "bar;bars;bar(a);bara;bar abs;bar(g)"),
    ("kpa", "pressure", 0.001, 0.0, "kPa;KPa;kPa abs;kN/m2;kN/m²;kN m-2;kilopascal;kilopascals"),
    ("psi", "pressure", 0.006894757293168, 0.0, "psi;psia;psig;PSI;lbf/in2;lbf/in²;lb/in2;pounds per square inch"),
    ("atm", "pressure", 0.101325, 0.0, "atm;atmosphere;atmospheres"),
    ("minute", "time", 1.0, 0.0, "min;mins;minute;minutes;min."),
    ("second", "time", 1.0 / 60.0, 0.0, "s;sec;secs;second;seconds"),
    ("hour", "time", 60.0, 0.0, "h;hr;hrs;hour;hours"),
    ("mol_per_l", "concentration", 1.0, 0.0, "mol/L;mol/l;mol L-1;mol L^-1;mol l-1;mol·L⁻¹;mol L⁻¹;mol dm-3;mol dm^-3;mol·dm⁻³;mol/dm3;mol/dm³;M;molar;moles per litre;kmol/m3"),
    ("mmol_per_l", "concentration", 0.001, 0.0, "mmol/L;mmol/l;mmol L-1;mmol L^-1;mmol·L⁻¹;mmol L⁻¹;mmol dm-3;mmol dm^-3;mmol·dm⁻³;mmol/dm3;mM;mol/m3;mol/m³;mol m-3;mol·m⁻³;millimolar;millimoles per litre"),
    ("percent", "ratio", 1.0, 0.0, "%;percent;per cent;pct;mol%;mol %;mol-%;wt%;area%;%age;percentage;per hundred"),
    ("fraction", "ratio", 100.0, 0.0, "fraction;0-1;0–1;0 to 1;mole fraction;mol/mol;dimensionless;-;–;−"),
    ("permille", "ratio", 0.1, 0.0, "‰;per mille;permille;per mil;promille;per thousand;parts per thousand"),
    ("g_per_h", "productivity", 1.0, 0.0, "g/h;g/hr;g h-1;g h^-1;g·h⁻¹;g h⁻¹;grams per hour;gram per hour"),
    ("kg_per_day", "productivity", 1000.0 / 24.0, 0.0, "kg/day;kg/d;kg d-1;kg d^-1;kg·d⁻¹;kg d⁻¹;kg day-1;kilograms per day;kilogram per day"),
    ("mg_per_min", "productivity", 0.06, 0.0, "mg/min;mg min-1;mg min^-1;mg·min⁻¹;mg min⁻¹;milligrams per minute;milligram per minute"),
]
#: Words of an axis title that name its quantity.
QUANTITY_WORDS = [
    ("flow_rate", ["flow", "feed rate", "flow rate", "throughput"]),
    ("temperature", ["temperature", "temp."]),
    ("pressure", ["pressure"]),
    ("concentration", ["concentration", "molarity"]),
    ("time", ["time"]),
    ("ratio", ["selectivity", "conversion", "yield", "recovery"]),
    ("productivity", ["productivity", "output"]),
]
FACTOR = {u: (q, f, o) for u, q, f, o, _ in UNITS}
#: Characters that recognition confuses, by what stands for them (so that rn and m, cl and d, ii and u fall together).
OUTLINE = str.maketrans({"1": "l", "i": "l", "|": "l", "j": "l", "0": "o", "a": "o", "q": "g", "9": "g", "e": "c", "f": "t", "5": "s", "8": "b", "h": "b", "m": "rrl", "n": "rl", "u": "ll", "d": "cl", "w": "vv"})
BREAK = re.compile(r"(?<=[^\W\d_])(?:[-‐‑]|[¬­])[ \t]*(?:\r?\n|[ \t])[ \t]*(?=[^\W\d_])|(?<=[^\W\d_])­(?=[^\W\d_])")
_SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")


def outline(s: str) -> str:
    return s.lower().translate(OUTLINE)


def smooth(text: str) -> str:
    """Broken words joined, white space as single blanks."""
    return " ".join(BREAK.sub("", text).split())


@lru_cache(1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton, ahocorasick.Automaton]:
    exact, rough, words = ahocorasick.Automaton(), ahocorasick.Automaton(), ahocorasick.Automaton()
    seen: dict[str, list[tuple[str, str]]] = {}
    for code, quantity, _, _, aliases in UNITS:
        for a in aliases.split(";"):
            exact.add_word(a, (len(a), code, quantity))
            if sum(c.isalpha() for c in a) >= 5 and a.replace(" ", "").isalpha():
                seen.setdefault(outline(a), []).append((code, quantity))
    for a, units in seen.items():
        if len(set(units)) == 1:
            rough.add_word(a, (len(a), *units[0]))
    for quantity, names in QUANTITY_WORDS:
        for n in names:
            words.add_word(outline(n), (len(outline(n)), quantity))
    for a in (exact, rough, words):
        a.make_automaton()
    return exact, rough, words


def _free(text: str, start: int, end: int) -> bool:
    """Is a match no part of a longer word or number?"""
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    head, tail = text[start], text[end - 1]
    if head.isalnum() and (before.isalpha() or before in "^·⁻"):
        return False
    if tail.isalnum() and (after.isalnum() or after in "^⁻·" or after == "-" and text[end + 1 : end + 2].isdigit()):
        return False
    if tail.isalnum() and after == "/" and text[end + 1 : end + 2].isalnum():
        return False
    if head.isalnum() and before == "/" and start > 1 and text[start - 2].isalnum():
        return False
    return not (text[start:end] in ("-", "–", "−") and not (before in "([" or re.search(r"[(\[/,]\s*$|\bin\s+$", text[:start])))


def unit_matches(text: str, quantity: str | None) -> list[tuple[int, int, str]]:
    """(start, end, unit code) of the longest unit aliases in a text, from the left, of one quantity if it is known."""
    exact, rough, _ = _automata()
    found: list[tuple[int, int, str]] = []
    for end, (n, code, q) in exact.iter(text):
        if (quantity is None or q == quantity) and _free(text, end - n + 1, end + 1):
            found.append((end - n + 1, end + 1, code))
    low, place = "", []
    for i, ch in enumerate(text):
        part = outline(ch)
        low += part
        place += [i] * len(part)
    for end, (n, code, q) in rough.iter(low):
        start, stop = place[end - n + 1], place[end] + 1
        if (quantity is None or q == quantity) and _free(text, start, stop):
            found.append((start, stop, code))
    found.sort(key=lambda m: (m[0] - m[1], m[0]))
    out: list[tuple[int, int, str]] = []
    for m in found:
        if all(m[1] <= o[0] or m[0] >= o[1] for o in out):
            out.append(m)
    return sorted(out)


def quantity_of(title: str) -> str | None:
    """The quantity that an axis title names: of its words the longest, of these the first."""
    best = None
    low = outline(title)
    for end, (n, q) in _automata()[2].iter(low):
        key = (-n, end)
        if best is None or key < best[0]:
            best = (key, q)
    return best[1] if best else None


_POWER = re.compile(r"(?:[×x]\s*)?1[0oO]\s*(?:\^\s*([+\-−]?\s*\d+)|([⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+))\s*$")
_WORD_SCALE = [("thousandths? of", -3), ("thousands? of", 3), ("hundreds? of", 2), ("millions? of", 6), ("thousands?", 3), ("hundreds?", 2), ("millions?", 6), ("tens? of", 1)]
_WORD_SCALES = [(re.compile(r"\b" + outline(w).replace("s?", "s?") + r"\s*$"), e) for w, e in _WORD_SCALE]


def scale_before(text: str, start: int) -> int:
    """The power of ten stated right before a unit, 0 where none is."""
    head = text[:start]
    m = _POWER.search(head)
    if m:
        return int((m[1] or m[2].translate(_SUPERSCRIPT)).replace(" ", "").replace("−", "-"))
    low = outline(head)
    if re.search(r"\bp[ce]r\s+$", head.lower()):
        return 0
    for w, e in _WORD_SCALES:
        if w.search(low) and not re.search(r"\bpcr\s+\S+\s*$", low):
            return e
    return 0


def own_title(items: list[str | None]) -> str:
    """The first title of an axis with its continuations; another full title belongs to another axis."""
    items = [smooth(x) for x in items if x and x.strip()]
    if not items:
        return ""
    out = items[0]
    for x in items[1:]:
        if re.match(r"[(\[/,]|in\s", x):
            out += " " + x
        else:
            break
    return out


def title_unit(title: str, quantity: str | None) -> tuple[str, int] | None:
    """(unit, power of ten) stated in a title: the last unit of its quantity."""
    hits = unit_matches(title, quantity)
    if not hits:
        return None
    start, _, code = hits[-1]
    return code, scale_before(title, start)


_NAME_END = re.compile(r"\s*[(\[,/].*$|\s+in\s.*$")


def quantity_name(title: str) -> str:
    """A title without its unit part."""
    return _NAME_END.sub("", title).strip()


def caption_unit(caption: str, name: str, quantity: str | None) -> tuple[str, int] | None:
    """(unit, power of ten) that a caption's sentence gives for the named axis quantity: "<name> [is plotted|given] in <unit>."."""
    want = outline(name)
    if not want:
        return None
    for sentence in re.split(r"\.(?=\s)|\.$", smooth(caption)):
        low = outline(sentence)
        at = low.rfind(want)
        if at < 0:
            continue
        for start, end, code in reversed(unit_matches(sentence, quantity)):
            if end < len(sentence.rstrip(" .;,)]")):
                continue
            scale = scale_before(sentence, start)
            lead = sentence[:start]
            if scale:
                lead = _POWER.sub("", lead) if _POWER.search(lead) else lead.rstrip().rpartition(" ")[0] + " "
            if re.search(r"\b[il1]n\s+(?:the\s+)?(?:unit\s+)?$", lead) and len(outline(lead)) > at + len(want):
                return code, scale
    return None


#: Nouns after which a caption names the abscissa first (the effect of x on y), and words between two quantities of which the
#: first is the ordinate (y on, with, at, against, versus x, as a function of x).
_CAUSES = "|".join(outline(w) for w in ("effects? of", "influences? of", "impacts? of", "role of", "action of"))
_CAUSE = re.compile(rf"\b(?:{_CAUSES})\s+(?:\S+\s+){{0,3}}$")
_ON = re.compile(rf"\b{outline('on')}\b")
_RELATION = re.compile(r"\b(?:" + "|".join(outline(w) for w in ("on", "upon", "with", "at", "over", "by", "against", "versus", "vs", "as a function of", "for different", "under")) + r")\b")


def plotted(caption: str, axis: str) -> str:
    """The quantity that the caption says an axis shows, for axes without a title.

    The first two quantities that a sentence relates are its ordinate and abscissa, in this order, or the other way round
    where the sentence speaks of an effect."""
    text = smooth(caption)
    low, place = "", []
    for i, ch in enumerate(text):
        part = outline(ch)
        low += part
        place += [i] * len(part)
    hits: list[tuple[int, int, str]] = []
    for end, (n, q) in _automata()[2].iter(low):
        hits.append((end - n + 1, end + 1, q))
    hits.sort(key=lambda h: (h[0] - h[1], h[0]))
    free: list[tuple[int, int, str]] = []
    for h in hits:  # longest first
        if all(h[1] <= o[0] or h[0] >= o[1] for o in free):
            free.append(h)
    free.sort()
    for (a, b, _), (c, d, _) in zip(free, free[1:]):
        between = low[b:c]
        if re.search(r"\.\s", between):
            continue
        first, second = text[place[a] : place[b - 1] + 1], text[place[c] : place[d - 1] + 1]
        if _CAUSE.search(low[:a]) and _ON.search(between):
            return first if axis == "X" else second
        if _RELATION.search(between):
            return second if axis == "X" else first
    return ""


def recorded_unit(axis: str, items: list[str | None] | None, caption: str | None, at_most_one: bool) -> tuple[str, int] | None:
    """(unit, power of ten) an axis is recorded in; None where nothing states it."""
    title = own_title(list(items) if items is not None else [])
    name = quantity_name(title) or plotted(caption or "", axis)
    quantity = quantity_of(name) or quantity_of(title)
    hit = title_unit(title, quantity) if title else None
    if hit is None and caption:
        hit = caption_unit(caption, name, quantity)
    if hit is None and quantity == "ratio" and at_most_one:
        return "fraction", 0
    return hit


def _texts(field: str) -> Column:
    """The texts of a field; only this leaf of the nested column is read."""
    return F.col(f"text_evidence.{field}.text")


_AXIS = "array<struct<axis: string, unit_code: string, scale_exp: int>>"


def with_units(packets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """packet_id, the columns to keep, and ``axis_units``: axis, unit and power of ten of every axis with a value and a
    known recorded unit.

    Value tests run in the JVM over the arrays; the Python stage sees titles and captions only. Nothing is shuffled."""
    vals = lambda k: F.filter(F.col(f"raw_data.{k}"), lambda v: v.isNotNull() & ~F.isnan(v))
    has = lambda k: F.coalesce(F.size(vals(k)) > 0, F.lit(False))
    small = lambda k: F.coalesce(F.array_max(vals(k)) <= 1, F.lit(False))
    names = ("xt_", "yt_", "cap_", "hx_", "hy_", "sx_", "sy_")
    inputs = (_texts("x_axis_title"), _texts("y_axis_title"), F.col("meta.caption"), has("X"), has("Y_Left"), small("X"), small("Y_Left"))
    slim = packets.select("packet_id", *keep, *(c.alias(n) for n, c in zip(names, inputs)))

    @F.pandas_udf(_AXIS)
    def units_of(xt: pd.Series, yt: pd.Series, cap: pd.Series, hx: pd.Series, hy: pd.Series, sx: pd.Series, sy: pd.Series) -> pd.Series:
        out = []
        for x, y, c, has_x, has_y, small_x, small_y in zip(xt, yt, cap, hx, hy, sx, sy):
            row = []
            for axis, items, there, low in (("X", x, has_x, small_x), ("Y_Left", y, has_y, small_y)):
                if there and (hit := recorded_unit(axis, items, c, bool(low))):
                    row.append({"axis": axis, "unit_code": hit[0], "scale_exp": hit[1]})
            out.append(row)
        return pd.Series(out)

    once = units_of.asNondeterministic()  # else the filter that an explode implies would evaluate it a second time
    return slim.withColumn("axis_units", once(*names)).select("packet_id", *keep, "axis_units")


def axis_units(packets: DataFrame) -> DataFrame:
    """packet_id, axis, unit_code, scale_exp of every axis with a value and a known recorded unit."""
    return with_units(packets).select("packet_id", F.explode("axis_units").alias("u")).select("packet_id", "u.axis", "u.unit_code", "u.scale_exp")


def _factors(codes: DataFrame) -> DataFrame:
    """unit_codes with the factors of this module: a table of fixed size, safe to broadcast."""
    spark = codes.sparkSession
    own = spark.createDataFrame([(u, float(f), float(o)) for u, (_, f, o) in FACTOR.items()], "unit_code string, factor double, offset double")
    targets = codes.where("is_target").select(F.col("quantity").alias("q"), F.col("unit_code").alias("target_code"))
    return codes.select("unit_code", "quantity", "is_target").join(F.broadcast(own), "unit_code", "left").join(F.broadcast(targets), F.col("quantity") == F.col("q"), "left").drop("q")


def found(packets: DataFrame, codes: DataFrame) -> DataFrame:
    """The columns of p4_found: axes that aren't recorded in the target unit at scale one."""
    j = axis_units(packets).join(F.broadcast(_factors(codes)), "unit_code")
    return j.where("not (is_target and scale_exp = 0)").select("packet_id", "axis", "unit_code", F.col("scale_exp").cast("int").alias("scale_exp"))


def converted(packets: DataFrame, codes: DataFrame) -> DataFrame:
    """packet_id, point_no, axis, value, unit_code, target_code, target_value: every value of X and Y_Left.

    Axes with no known unit keep their value with a null unit; null and NaN values stay null."""
    both = packets.withColumn("xy_", F.arrays_zip(F.col("raw_data.X").alias("X"), F.col("raw_data.Y_Left").alias("Y_Left")))
    rows = with_units(both, ("xy_",)).select("packet_id", "axis_units", F.posexplode("xy_").alias("point_no", "p")).select("packet_id", "point_no", "axis_units", F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), F.col(f"p.{k}").alias("value")) for k in ("X", "Y_Left")))).alias("a"))
    own = rows.select("packet_id", "point_no", F.col("a.axis").alias("axis"), F.nanvl("a.value", F.lit(None).cast("double")).alias("value"), F.get(F.filter("axis_units", lambda u: u["axis"] == F.col("a.axis")), F.lit(0)).alias("u"))
    j = own.withColumn("unit_code", F.col("u.unit_code")).join(F.broadcast(_factors(codes)), "unit_code", "left")
    return j.select("packet_id", "point_no", "axis", "value", "unit_code", "target_code", F.coalesce(F.col("value") * F.pow(F.lit(10.0), F.col("u.scale_exp")) * F.col("factor") + F.col("offset"), "value").alias("target_value"))
