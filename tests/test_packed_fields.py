"""Packed fields: shapes, nulls, quoting, placeholders, clashing columns."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators.packed_fields import CLOSE, ESCAPE, MARK, split_codes, split_names, unpack_fields

NAMES = [
    ("Roe, Ann; Doe, Bob", ["Roe, Ann", "Doe, Bob"]),
    ("Ann Roe, Bob B. Doe", ["Ann Roe", "Bob B. Doe"]),
    ("Ann Roe,Bob Doe", ["Ann Roe", "Bob Doe"]),
    ("Ann Roe, Bob Doe, and Cid Poe", ["Ann Roe", "Bob Doe", "Cid Poe"]),
    ("Ann Roe, Bob Doe & Cid Poe", ["Ann Roe", "Bob Doe", "Cid Poe"]),
    ("Roe, Ann and Doe, Bob and Poe, Cid", ["Roe, Ann", "Doe, Bob", "Poe, Cid"]),
    ("de la Roe, A., van Doe-Poe, B. C., Moe, D.", ["de la Roe, A.", "van Doe-Poe, B. C.", "Moe, D."]),
    ('"Roe, Ann", "Doe, Bob, Jr.", "Cid ""Ace"" Poe"', ["Roe, Ann", "Doe, Bob, Jr.", 'Cid "Ace" Poe']),
    ('"Survey of Hills; Section B"; "Doe, Bob"', ["Survey of Hills; Section B", "Doe, Bob"]),
    ("['Ann Roe', 'Bob O''Neil']", ["Ann Roe", "Bob O'Neil"]),
    ('["Ann Roe", "Bob Doe"]', ["Ann Roe", "Bob Doe"]),
    ("Roe, Ann\r\nDoe, Bob", ["Roe, Ann", "Doe, Bob"]),
    ("Roe, Ann | Cid Poe;Doe, Bob", ["Roe, Ann", "Cid Poe", "Doe, Bob"]),
    ("Ann Roe / Bob Doe", ["Ann Roe", "Bob Doe"]),
    ("Roe, Ann;; Doe, Bob;", ["Roe, Ann", "Doe, Bob"]),
    ("Institute of Rivers and Lakes", ["Institute of Rivers and Lakes"]),
    ("Ashe & Birk Survey", ["Ashe & Birk Survey"]),
    ("Roe, Ann ; Ashe & Birk Survey", ["Roe, Ann", "Ashe & Birk Survey"]),
    ("Ashe R&D Survey", ["Ashe R&D Survey"]),
    ("Roe, Ann", ["Roe, Ann"]),
    (" Ann Roe ", ["Ann Roe"]),
    ('"Roe, Ann";' + " " * 30 + '"Doe; Co"', ["Roe, Ann", "Doe; Co"]),
    ("Ann Roe and Bob" + " " * 9 + "Doe", ["Ann Roe", "Bob" + " " * 9 + "Doe"]),
    ("A" * 90 + " Roe and Bob " + "D" * 90, ["A" * 90 + " Roe", "Bob " + "D" * 90]),
    ("River and Lake Institute and Ann Roe", ["River and Lake Institute", "Ann Roe"]),
    ("Ann Roe,  and Bob Doe and Cid Poe", ["Ann Roe", "Bob Doe", "Cid Poe"]),
    ("N/A", []), ("-", []), ("", []), ("  \t", []), (";", []), (None, []),
]
CODES = [
    ("a.B c.D", ["a.B", "c.D"]), ("a.B\tc.D", ["a.B", "c.D"]), ("a.B ;c.D, e-f", ["a.B", "c.D", "e-f"]), ("a.B,, c.D", ["a.B", "c.D"]),
    ("ice/core|Tides; Currents", ["ice/core", "Tides; Currents"]), ("Fog, Mist and Dew, a.B", ["Fog, Mist and Dew", "a.B"]),
    ('"Old Maps";"a.B"', ["Old Maps", "a.B"]), ("[\"a.B\", 'c.D']", ["a.B", "c.D"]), ("Old Maps", ["Old Maps"]), ("?", []), (None, []), (",", []),
]
KNOWN = ["Tides; Currents", "Fog, Mist and Dew", "Old Maps", "ice/core"]


def both(spark, rows, f):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "id int, v string").repartition(2)
    got = {r[0]: r[1] for r in df.select("id", f(F.col("v"))).collect()}
    return [(rows[i][0], got[i], rows[i][1]) for i in range(len(rows)) if got[i] != rows[i][1]]


def test_names(spark):
    assert both(spark, NAMES, split_names) == []


def test_codes(spark):
    assert both(spark, CODES, lambda c: split_codes(c, KNOWN)) == []


def test_placeholders_in_the_input(spark):
    odd = f'"a{MARK}0{CLOSE}"; "b{MARK}{ESCAPE}c"; d{MARK}1{CLOSE} x'
    rows = [(odd, [f"a{MARK}0{CLOSE}", f"b{MARK}{ESCAPE}c", f"d{MARK}1{CLOSE} x"])]
    assert both(spark, rows, split_names) == []


def test_very_long_field(spark):
    value = "; ".join(f'"N{i}, A; B"' for i in range(5000))
    assert both(spark, [(value, [f"N{i}, A; B" for i in range(5000)])], split_names) == []


def test_rows_positions_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Roe, Ann; Doe, Bob", "x", 9), (1, "Roe, Ann; Doe, Bob", "y", 8), (2, "Solo", "z", 7), (None, "Roe, A; Doe, B", "q", 6)], "entry_id int, v string, field string, pos int")
    got = {tuple(r) for r in unpack_fields(df, "entry_id", {"n": split_names(F.col("v"))}, 2).collect()}
    assert got == {(1, "n", 1, "Roe, Ann"), (1, "n", 2, "Doe, Bob"), (None, "n", 1, "Roe, A"), (None, "n", 2, "Doe, B")}
    assert unpack_fields(df.limit(0), "entry_id", {"n": split_names(F.col("v"))}).count() == 0


@pytest.mark.parametrize("least,n", [(1, 1), (2, 0)])
def test_least(spark, least, n):
    df = spark.createDataFrame([(1, "Solo Name")], "k int, v string")
    assert unpack_fields(df, "k", {"n": split_names(F.col("v"))}, least).count() == n
