import json

import pytest

from figmill.operators import units

CASES = [
    (["Total flow (mL/min)"], None, ("ml_per_min", 0)), (["Total flow in ml h-1"], None, ("ml_per_h", 0)), (["Gas flow rate", "[l/hr]"], None, ("l_per_h", 0)), (["Feed rate (µL·min⁻¹"], None, ("ul_per_min", 0)),
    (["Liquid flow rate [10^-3 mL min-1]"], None, ("ml_per_min", -3)), (["Total flow / 10² ml h-1"], None, ("ml_per_h", 2)), (["Total flow (thousand mL/min)"], None, ("ml_per_min", 3)),
    (["Bath temperature (deg C"], None, ("deg_c", 0)), (["Temperature, K"], None, ("kelvin", 0)), (["Temperature (Kelv-\nlns)"], None, ("kelvin", 0)), (["Reaction femp-\nerature (de9rees Fahre¬\nnhelt)"], None, ("deg_f", 0)),
    (["Pressure, kN/m2", "(b)"], None, ("kpa", 0)), (["Hydrogen pressure (N/mm2)"], None, ("mpa", 0)), (["Outlet pressure (MPa abs)"], None, ("mpa", 0)), (["Pressure (bar(a))"], None, ("bar", 0)),
    (["Inlet concentration (M"], None, ("mol_per_l", 0)), (["Substrate concentration / mol/m3"], None, ("mmol_per_l", 0)), (["Time on stream", "(h)"], None, ("hour", 0)), (["Residence time (s)"], None, ("second", 0)),
    (["Yield (%)", "Selectivity of by-products (%)"], None, ("percent", 0)), (["Yield [0-1]"], None, ("fraction", 0)), (["Conversion (-)"], None, ("fraction", 0)), (["Yield (per thousand)"], None, ("permille", 0)),
    (["Space output (thousand g/h)"], None, ("g_per_h", 3)), (["Hourly output (kg d-1)"], None, ("kg_per_day", 0)), (["Conversion"], "Fig. 1 x. Conversion is plotted in ‰. Conditions: 8 h, 404 K.", ("permille", 0)),
    (["Bath temperature"], "Fig. 5 of it. Bath temperature given in deg F. Recovery is plotted in per cent.", ("deg_f", 0)), (["Total flow"], "Effect of total flow on yield. Conditions: 14 mL/min, 8 h.", None),
    (["Yield", "Selectivity of by-products (%)"], None, None), (["Total flow"], None, None), ([], None, None), (None, "", None), ([None, ""], None, None),
]


@pytest.mark.parametrize("titles, caption, want", CASES)
def test_recorded_unit(titles, caption, want):
    assert units.recorded_unit("X", titles, caption, False) == want


def test_ratio_without_unit():
    assert units.recorded_unit("Y_Left", ["Yield", "Selectivity of by-products (%)"], None, True) == ("fraction", 0)
    assert units.recorded_unit("Y_Left", ["Yield (%)"], None, True) == ("percent", 0)
    assert units.recorded_unit("Y_Left", None, "Fig. 1 Effect of total flow on yield of furfural.", True) == ("fraction", 0)


def packets(spark, rows):
    item = "array<struct<text: string, source_file: string, note: string>>"
    schema = f"packet_id long, meta struct<figure_id: string, caption: string>, text_evidence struct<x_axis_title: {item}, y_axis_title: {item}, chart_text: {item}, legend_text: {item}>, raw_data array<struct<Series: string, X: double, Y_Left: double, Y_Right: double>>, unit_code string"
    return spark.createDataFrame(rows, schema)


def codes(spark):
    return spark.createDataFrame([(u, q, (f, o) == (1.0, 0.0)) for u, q, f, o, _ in units.UNITS], "unit_code string, quantity string, is_target boolean")


def test_tables(spark):
    nan = float("nan")
    te = lambda x, y: ([(x, None, None)], [(y, None, None), None], None, [])
    rows = [
        (1, ("f", None), te("Temperature (K)", "Yield [0-1]"), [("s", 300.0, 0.5, None), None, (None, nan, None, 1.0)], "z"),
        (2, ("f", None), te("Total flow (mL/min)", "Yield"), [("s", None, 0.5, None), ("s", None, 0.7, None)], "z"),
        (3, None, None, None, "z"), (4, ("f", ""), te(None, "Yield (%)"), [("s", nan, 5.0, None)], "z"),
    ]
    p = packets(spark, rows)
    assert sorted(tuple(r) for r in units.found(p, codes(spark)).collect()) == [(1, "X", "kelvin", 0), (1, "Y_Left", "fraction", 0), (2, "Y_Left", "fraction", 0)]
    conv = {(r.packet_id, r.point_no, r.axis): r.target_value for r in units.converted(p, codes(spark)).collect()}
    assert conv[(1, 0, "X")] == pytest.approx(26.85) and conv[(1, 0, "Y_Left")] == 50.0 and conv[(1, 2, "X")] is None and conv[(4, 0, "Y_Left")] == 5.0
    assert units.found(p.limit(0), codes(spark)).count() == 0
    json.dumps(str(conv))


def test_every_unit_of_the_codes_is_known(spark, data):
    known = set(units.FACTOR)
    assert {r.unit_code for r in spark.read.parquet(f"{data}/unit_codes.parquet").collect()} == known


@pytest.mark.parametrize("caption, x, y", [
    ("Conversion as a function of temperature for A", "temperature", "ratio"), ("Conversion versus residence time.", "time", "ratio"), ("Impact of total flow on the isolated yield.", "flow_rate", "ratio"),
    ("Fig. 3. Dependence of space output on pressure for x.", "pressure", "productivity"), ("Selectivity is high. Temperature was low.", None, None), ("", None, None),
])
def test_what_a_caption_says_is_plotted(caption, x, y):
    assert (units.quantity_of(units.plotted(caption, "X")), units.quantity_of(units.plotted(caption, "Y_Left"))) == (x, y)
