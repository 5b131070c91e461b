"""Reading numbers and texts the way the extraction scripts read them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What a Python float literal looks like without underscores, infinities and NaN.
FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def py_float(text: Column) -> Column:
    """A text as a double, null where Python's float would fail; suffixes such as 5f are no numbers."""
    t = F.btrim(text)
    return F.when(t.rlike(FLOAT), t.try_cast("double"))


def parse_val(text: Column, strict: bool = False) -> Column:
    """The value of a tick label.

    A text with 10 is first tried as a power of ten; otherwise all but digits, points, minus signs
    and e is cut away. That reads 100 as 1.0, which is kept for equal results; ``strict`` reads
    plain numbers as such and powers of ten by their exponent."""
    if strict:
        power = F.regexp_extract(text, r"^\s*10\s*\^?\s*\{?(-?[0-9]+)\}?\s*$", 1)
        return F.coalesce(py_float(text), F.when(power != "", F.pow(F.lit(10.0), power.try_cast("double"))))
    powered = F.replace(F.replace(text, F.lit("10^"), F.lit("1e")), F.lit("10"), F.lit("1e"))
    cleaned = F.regexp_replace(text, r"[^0-9.\-eE]", "")
    return F.coalesce(F.when(text.contains("10") & powered.contains("1e"), py_float(powered)), py_float(cleaned))


def log_target(value: Column) -> Column:
    """What a logarithmic axis is fitted to: small integers are exponents, positive values their logarithm, else nothing."""
    return F.when((F.abs(value) < 15) & (value == F.floor(value)), value).when(value > 0, F.log10(value))


def is_log_text(text: Column) -> Column:
    return F.btrim(text).startswith("10") | text.contains("e")


#: Words whose presence makes a chart relevant (spelling variants included).
KEYWORDS = ["yield", "uiel", "yeild", "selectivity", "slelctivity", "selectiv", "conversion", "convers", "recovery", "purity", "efficiency", "ee%", "ee", "dr"]
#: Words and units that are no terms.
STOP_WORDS = [
    "of", "the", "and", "in", "with", "for", "to", "by", "on", "at", "figure", "fig", "table", "graph",
    "yield", "selectivity", "conversion", "temperature", "pressure", "time", "min", "h", "c", "k", "mpa", "bar",
]
#: Signs that are cut from the ends of a term.
TERM_EDGES = ".,;:()[]{}"


def squeezed(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def is_relevant(text: Column, keywords: list[str] = KEYWORDS) -> Column:
    t = squeezed(text)
    out = F.lit(False)
    for k in keywords:
        out = out | t.contains(k)
    return out


def is_evidence(text: Column) -> Column:
    """Two characters or more and not only digits and points."""
    return (F.length(text) >= 2) & ~F.replace(text, F.lit("."), F.lit("")).rlike("^[0-9]+$")


def clean_json(text: Column) -> Column:
    """A reply without its Markdown code fence."""
    t = F.btrim(text, F.lit(" \n\r\t"))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"^```(json)?", ""), r"```$", ""), F.lit(" \n\r\t"))


def sentinel(text: Column, start: str = "---JSON_START---", end: str = "---JSON_END---") -> Column:
    """What stands between two marks of a log, null where one is missing."""
    got = F.regexp_extract(text, rf"(?s){start}(.*?){end}", 1)
    return F.when(text.contains(start) & text.contains(end), F.btrim(got, F.lit(" \n\r\t")))


def mime_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".png"), "image/png").when(p.endswith(".webp"), "image/webp").otherwise("image/jpeg")


def crop_kind(file: Column) -> Column:
    """The text field that a crop belongs to by its file name, null if to none (fixed values, in this order)."""
    return (
        F.when(file.contains("x_axis_title"), "x_axis_title").when(file.contains("y_axis_title"), "y_axis_title").when(file.contains("chart_text"), "chart_text")
        .when(file.contains("caption"), "chart_text").when(file.contains("legend"), "legend_text")
    )


def base_name(file: Column) -> Column:
    """A file's name without its folders."""
    return F.regexp_replace(file, "^.*/", "")


def page_of_file(file: Column) -> Column:
    """The page part (page_<n>) of a file's name, "" if there is none."""
    return F.regexp_extract(file, "(page_[0-9]+)_", 1)


def figure_of_file(file: Column, suffix: str = "_evidence.json") -> Column:
    """The figure that a file is about: its base name without the suffix."""
    return base_name(F.replace(file, F.lit(suffix), F.lit("")))
