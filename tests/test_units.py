import pytest
from pyspark.sql import functions as F

from lodestone.operators import units as U

CASES = [("mV", "voltage", 1e-3), ("MV", "voltage", 1e6), ("millivolt", "voltage", 1e-3), ("x10^-6 V", "voltage", 1e-6), ("1E-3 A", "current", 1e-3), ("V*1000", "voltage", 1e3), ("F x 1e-9", "capacitance", 1e-9), ("1/s", "frequency", 1.0), ("s^-1", "frequency", 1.0), ("MHZ", "frequency", 1e6), ("kΩ", "resistance", 1e3), ("kOhm", "resistance", 1e3), ("‰", "ratio", 0.1), ("PPM", "ratio", 1e-4), ("nanosec", "time", 1e-9), ("pf", "capacitance", 1e-12), (" deg C ", "temperature", 1.0)]
CASES += [("m", "length", 1.0), ("kPa", "pressure", 1e3), ("mm", "length", 1e-3), ("mAh", "charge", 3.6), ("V/A", "resistance", 1.0), ("mV/µA", "resistance", 1e3), ("A·s/V", "capacitance", 1.0), ("mV/V", "ratio", 0.1), ("V A", "power", 1.0), ("1/µs", "frequency", 1e6), ("s⁻¹", "frequency", 1.0), ("cm²", "m^2", 1e-4), ("V^2", "kg^2 m^4 s^-6 A^-2", 1.0), ("m/s^2", "m s^-2", 1.0), ("V/us", "kg m^2 s^-4 A^-1", 1e6), ("mV/s", "kg m^2 s^-4 A^-1", 1e-3), ("Ohm cm", "kg m^3 s^-3 A^-2", 1e-2), ("uV/√Hz", "kg m^2 s^-2.5 A^-1", 1e-6), ("nV/sqrt(Hz)", "kg m^2 s^-2.5 A^-1", 1e-9), ("ppm/°C", "K^-1", 1e-6), ("dBV", "voltage", 20.0)]


@pytest.mark.parametrize(("text", "quantity", "factor"), CASES)
def test_segment(text, quantity, factor):
    best = U.segment(text)[0]
    assert best[0] == quantity
    assert best[1] == pytest.approx(factor)


@pytest.mark.parametrize("text", ["OS", "clk", "out", "in", "volts per metre", "", "1E-3", "V/", "√", "sqrt(Hz", "dBm/V", "/s", "V^"])
def test_no_unit(text):
    assert U.segment(text) == ()


def test_offsets_and_logarithms(spark):
    df = spark.createDataFrame([(300.0, 1.0, -273.15, False), (212.0, 5 / 9, -160 / 9, False), (30.0, 10.0, -30.0, True), (5.0, None, None, None), (None, 1.0, 0.0, False)], "v double, factor double, offset double, is_log boolean")
    got = [r[0] for r in df.select(U.to_common(F.col("v"))).collect()]
    assert got[:4] == pytest.approx([26.85, 100.0, 1.0, 5.0])
    assert got[4] is None


def test_names(spark):
    names = ["Cin_1 [nF]", "Cont_OS (mV)[2]", "vref_0 / V", "err_at_1kHz_4 in pct", "p_out_6_W", "leak_at_5V_2", "PLL_lock_f_18", None, "x [3]", "tj_1_deg C", "bw_2_1/s", "Cont_OS_µV[3]"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(U.from_name(F.col("n"))).collect()] == ["nF", "mV", "V", "pct", "W", None, None, None, None, "deg C", "1/s", "µV"]


def _tables(spark, tmp_path, results, columns):
    from pyspark.sql import types as T

    r = spark.createDataFrame(results, "id long, doc_id long, test_num int, test_txt string, units string, conditions string, result double, quantity string")
    c = spark.createDataFrame(columns, "id long, kind string, name string, units string, lo double, hi double")
    t = spark.createDataFrame([("voltage", "V"), ("temperature", "degC"), ("capacitance", "F")], "quantity string, common_unit string")
    for name, df in (("stdf_results", r), ("data_columns", c), ("unit_targets", t), ("data_values", spark.createDataFrame([], T.StructType.fromDDL("col_id long, row_idx int, value double, grp string")))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_found_inherits_from_the_first_row(spark, tmp_path):
    from lodestone.plans.units import p6_found, p6_results_common

    rows = [
        (1, 1, 10, "Vref_1", "mV", None, 1500.0, "x"), (2, 1, 10, "Vref_1", None, None, 1400.0, None), (2, 1, 10, "Vref_1", None, None, 1400.0, None),
        (3, 1, 11, "Vref_2", None, None, 1.0, None), (4, 1, 11, "Vref_2", "mV", None, 900.0, None), (5, 1, 11, "Vref_2", "-", None, 1.1, None),
        (6, 2, 10, "Vref_1", "", '{"UNITS": "uV"}', 5.0, None), (7, 2, 10, "Vref_1", "V", None, float("nan"), None), (8, None, None, None, None, None, None, None), (9, 2, 12, "T_1 [K]", "n/a", "not json", 300.0, None),
    ]
    cols = [(1, "numeric", "vout_1", "mV", None, None), (2, "numeric", "vout_2 (V)", "-", None, None), (3, "text", "vout_3", "mV", None, None), (None, None, None, None, None, None)]
    sf = _tables(spark, tmp_path, rows, cols)
    got = {tuple(r) for r in p6_found(spark, sf).collect()}
    assert got == {("stdf_results", 1), ("stdf_results", 2), ("stdf_results", 4), ("stdf_results", 6), ("stdf_results", 9), ("data_columns", 1)}
    values = {r["id"]: r["result"] for r in p6_results_common(spark, sf).collect()}
    assert values[2] == pytest.approx(1.4) and values[3] == 1.0 and values[9] == pytest.approx(26.85)


def test_empty_tables(spark, tmp_path):
    from lodestone.plans.units import QUERIES

    sf = _tables(spark, tmp_path, [], [])
    for q in QUERIES.values():
        assert q(spark, sf).count() == 0


def test_nanoampere_is_not_missing_and_unreadable_units_are_reported(spark, tmp_path):
    from lodestone.plans.units import p6_found, p6_results_common, p6_units

    rows = [(i, 1, 20, "Iq_1", "mA", None, 1.0, None) for i in range(1, 6)] + [(i, 2, 20, "Iq_1", "NA", None, 1.0, None) for i in range(6, 8)] + [(8, 3, 20, "Iq_1", "nA", None, 1.0, None)]
    rows += [(9, 4, 21, "Vx_1", "NA", '{"UNITS": "mV"}', 1.0, None), (10, 4, 21, "Vx_1", "na", None, 1.0, None), (11, 5, 21, "Vx_1", "V", None, 1.0, None), (12, 5, 21, "Vx_1", "NA", None, 1.0, None), (13, 6, 21, "Vx_1", "mV", None, 1.0, None), (14, 6, 21, "Vx_1", "furlongs", None, 1.0, None)]
    sf = _tables(spark, tmp_path, rows, [])
    assert {r["row_id"] for r in p6_found(spark, sf).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13}
    values = {r["id"]: (r["quantity"], r["result"]) for r in p6_results_common(spark, sf).collect()}
    assert values[6] == ("current", pytest.approx(1e-9)) and values[10] == ("voltage", pytest.approx(1e-3)) and values[12] == ("voltage", 1.0) and values[14] == (None, 1.0)
    units = {r["unit"]: r["quantity"] for r in p6_units(spark, sf).collect()}
    assert units["furlongs"] is None and units["nA"] == "current"
