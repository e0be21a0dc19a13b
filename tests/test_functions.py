import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, numeric, taxid


def column(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.orderBy("i").select(*(e.alias(f"c{k}") for k, e in enumerate(exprs))).collect()
    return [r[0] if len(exprs) == 1 else tuple(r) for r in rows]


def test_to_float(spark):
    cases = {
        "₹1,25,000.50": 125000.5, "(250.00)": -250.0, "18 %": 18.0, "Rs 40": 40.0, "rs 40": 40.0, "10 Nos @ 5": 10.0, "1e5": 1.0, "": None,
        "none": None, "true": None, "-3.456": -3.46, "2.005": 2.01, None: None, "\t 7\n": 7.0,
    }
    assert column(spark, list(cases), "string", numeric.to_float(F.col("v"))) == list(cases.values())
    assert column(spark, ["x", "5"], "string", numeric.to_money(F.col("v"), 1.5)) == [1.5, 5.0]


def test_rounding(spark):
    values = [2.005, -2.005, 12.345, 1.005, -0.001, 0.0, float("nan"), float("inf"), None]
    assert column(spark, values, "double", numeric.round2(F.col("v"))) == [2.01, -2.01, 12.35, 1.0, 0.0, 0.0, None, None, None]
    assert column(spark, [1.2345, -1.2345], "double", numeric.round3(F.col("v"))) == [1.235, -1.235]


def test_digits_only(spark):
    assert column(spark, ["+91 98-7", "abc", "", None], "string", numeric.digits_only(F.col("v"))) == ["91987", None, None, None]


def test_nearest_rank(spark):
    assert column(spark, [[3.0, 1.0, 2.0, 4.0], []], "array<double>", numeric.nearest_rank(F.col("v"), 50), numeric.nearest_rank(F.col("v"), 95)) == [(3.0, 4.0), (0.0, 0.0)]


@pytest.mark.parametrize("text,iso", [
    ("03/04/2026", "2026-04-03"), ("2026-04-03", "2026-04-03"), ("3 Apr 2026", "2026-04-03"), ("3-Sept-26", "2026-09-03"), ("04/25/2026", "2026-04-25"),
    ("dated 1.2.26.", "2026-02-01"), ("2026-13-40 and 1/2/2026", None), ("31/02/2026", None), ("12 Foo 2026", None), ("no date", None), ("", None), (None, None),
    ("3 march 2026", "2026-03-03"), ("1/2/202", "0202-02-01"),
])
def test_normalize_date(spark, text, iso):
    assert column(spark, [text], "string", dates.normalize_date(F.col("v"))) == [iso]


def test_add_days(spark):
    assert column(spark, ["2026-02-27", "x", None], "string", dates.add_days(F.col("v"), F.lit(2))) == ["2026-03-01", None, None]


def test_tax_ids(spark):
    v = F.col("v")
    good = "27ABCDE1234F1Z5"
    assert column(spark, [" 27abcde1234f1z5 ", "27ABCDE1234F1Z", "77ABCDE1234F1Z5", None], "string", taxid.is_valid_gstin(v)) == [True, False, False, False]
    assert column(spark, [good], "string", taxid.state_code_of(v), taxid.state_name_of(v), taxid.pan_of(v)) == [("27", "Maharashtra", "ABCDE1234F")]
    assert column(spark, [f"x {good} y 24PQRSX6789K1Z2 {good.lower()} 00PQRSX6789K1Z2"], "string", taxid.find_gstins(v)) == [[good, "24PQRSX6789K1Z2"]]
    inter = [taxid.is_inter_state(v, F.lit(x)) for x in (good, "24PQRSX6789K1Z2", "bad")]
    assert column(spark, [good], "string", *inter) == [(False, True, None)]


def test_slabs(spark):
    values = [17.4, 18.6, 12.6, 5.6, 0.85, 18.0, 9.0, None]
    assert column(spark, values, "double", taxid.nearest_rate_slab(F.col("v"))) == [17.4, 18.6, 12.0, 5.0, 0.25, 18.0, 9.0, None]
