from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stintworks.functions import cleaning, rates


def column(spark, values, kind, build):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("v"))).collect()]


def test_clean_int(spark):
    cases = {
        "12.7": 12, "-12.7": -12, "1,234": 1234, "+5": 5, " ": None, "abc": None, "40%": None, "+0.5": 0,
        "27-123": None, "5d": None, "5f": None, "1e3": 1000, " 7 ": 7, "(8)": -8, "9-": -9, "": None, None: None,
        "3000000000": None, ".9": 0, "NaN": None, "1 2": None, "0012": 12, "1e400": None,
    }
    assert dict(zip(cases, column(spark, list(cases), "string", cleaning.clean_int))) == cases


def test_clean_decimal(spark):
    cases = {
        "40%": "40.00", "+0.5": "0.50", "1,234": "1234.00", "5d": None, "2.345": "2.35", "-2.345": "-2.35",
        "1e3": "1000.00", " ": None, "abc": None, "1234567.1": None, "(3.5)": "-3.50", "%": None, "+ 1": None,
    }
    got = column(spark, list(cases), "string", lambda c: cleaning.clean_decimal(c, 8, 2))
    assert dict(zip(cases, got)) == {k: v and Decimal(v) for k, v in cases.items()}


def test_first_token(spark):
    values = ["es ESP", "  eng  Premier League ", "one", "", None, " \t "]
    assert column(spark, values, "string", cleaning.first_token) == ["es", "eng", "one", "", "", ""]
    assert column(spark, values, "string", cleaning.rest_after_first_token) == ["ESP", "Premier League", "", "", "", ""]


def test_first_integer_and_text(spark):
    assert column(spark, ["185 cm", "cm", None, "a12b34"], "string", cleaning.first_integer) == [185, None, None, 12]
    assert column(spark, [" ", "", "x "], "string", cleaning.text_or_null) == [None, None, "x "]


def test_source_key_counts_null_as_empty(spark):
    import hashlib

    frame = spark.createDataFrame([("A", None, "es ESP")], "p string, b string, n string")
    got = frame.select(cleaning.source_key(F.col("p"), F.col("b"), F.col("n"))).first()[0]
    assert got == hashlib.sha256("A||es ESP".encode()).hexdigest()


def test_folded_keeps_accents(spark):
    assert column(spark, ["kYLE É", "Straße", "ΣΑΣ"], "string", cleaning.folded) == ["kyle é", "strasse", "σασ"]


def test_position_groups_and_families(spark):
    raw = ["MF,FW", "FW,MF", "DF,MF", "MF,DF", "DF,FW", "FW,DF", "FW", "MF", "DF", "GK", "GK,MF", "", None]
    groups = column(spark, raw, "string", rates.position_group)
    assert groups == ["FW_MF", "FW_MF", "DF_MF", "DF_MF", "DF_FW", "DF_FW", "FW", "MF", "DF", "GK"] + ["UNKNOWN"] * 3
    families = column(spark, groups, "string", rates.role_family)
    assert families == ["ATTACKING_HYBRID"] * 2 + ["DEFENSIVE_HYBRID"] * 2 + ["OTHER_HYBRID"] * 2 + [
        "FORWARD", "MIDFIELDER", "DEFENDER", "GOALKEEPER"] + ["UNKNOWN"] * 3


def test_quality_bounds(spark):
    got = column(spark, [899, 900, 1799, 1800, None], "int", rates.sample_quality)
    assert got == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "LOW"]


def test_eligibility_rules_differ(spark):
    rows = [(1000, ""), (1000, None), (1000, "GK"), (1000, "GK,MF"), (899, "FW"), (900, "FW"), (None, "FW")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m int, p string").orderBy("i")
    canonical = [r[0] for r in frame.select(rates.canonical_eligible(F.col("m"), F.col("p"))).collect()]
    base = [r[0] for r in frame.select(rates.stint_eligible(F.col("m"), rates.position_group(F.col("p")))).collect()]
    assert canonical == [True, False, False, True, False, True, False]
    assert base == [False, False, True, False, False, True, False]


@pytest.mark.parametrize(
    "value, minutes, expected",
    [(1, 2000, "0.0450"), (None, 90, "0.0000"), (3, 0, None), (3, None, None), (-1, 7200, "-0.0125"), (1, 1440000, "0.0001")],
)
def test_per90(spark, value, minutes, expected):
    frame = spark.createDataFrame([(value, minutes)], "goals long, minutes long")
    got = frame.select(rates.per90("goals")).first()[0]
    assert got == (expected and Decimal(expected))


def test_per90_keeps_missing_measure(spark):
    frame = spark.createDataFrame([(None, 90)], "goals int, minutes int")
    assert frame.select(rates.per90("goals", scale=2, null_as_zero=False)).first()[0] is None


def test_folding_and_trimming_beyond_ascii(spark):
    texts = ["STRASSE", "straße", "ﬁne", "ΌΣΟΣ", "ŉ", "K", "Ⅷ", "µ", "İ", "Ꭰ", "plain", None]
    assert column(spark, texts, "string", cleaning.folded) == [t and t.casefold() for t in texts]
    blank = "  　 x y  \x1f"
    assert column(spark, [blank], "string", cleaning.trimmed) == [blank.strip()]


def test_strict_number_rounds_half_to_even_and_tells_bad_cells(spark):
    cases = {"12": 12, "12.0": 12, "12.7": 13, "12.5": 12, "13.5": 14, " 7 ": 7, "1e2": 100, "-0.6": -1, "": None, " ": None, None: None, "x": None, "3000000000": None, "5 min": None}
    assert dict(zip(cases, column(spark, list(cases), "string", lambda c: cleaning.strict_number(c, "int")))) == cases
    bad = dict(zip(cases, column(spark, list(cases), "string", lambda c: cleaning.bad_number(c, "int"))))
    assert [t for t, b in bad.items() if b] == ["x", "3000000000", "5 min"]
    assert column(spark, ["6.755", "x"], "string", lambda c: cleaning.strict_number(c, "decimal(5,2)")) == [Decimal("6.76"), None]
