import pytest
from pyspark.sql import functions as F

from loomtext.functions import identifiers as ids


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("f", "values", "want"),
    [
        (ids.canonical_id, ["T1n250", "T08n0250a", "T250", "x"], ["T01n0250", "T08n0250a", None, None]),
        (ids.bare_number, ["T250", "T08n0250", "0251", "T", "x1"], [250, 250, 251, None, None]),
        (ids.volume, ["T08n0250", "T250"], [8, None]),
        (ids.without_suffix, ["T0310-7", "T0310_a", "T1"], ["T0310", "T0310", "T1"]),
        (ids.toh_numbers, ["toh251, toh12a toh251", "none"], [["251", "12a"], []]),
        (ids.sanskrit_term, ["heart (Skt. *hṛdaya, mind)", "the term prajñā here", "plain English"], ["hṛdaya", "prajñā", None]),
    ],
)
def test_functions(spark, f, values, want):
    assert each(spark, f, values) == want


def test_reference_order(spark):
    refs = ["760,02", "7a", "7", "760,01", "12", "760"]
    got = spark.createDataFrame([(r,) for r in refs], "r string").orderBy(ids.sort_key(F.col("r"))).collect()
    assert [r["r"] for r in got] == ["7", "7a", "12", "760", "760,01", "760,02"]


def test_volumes_of_numbers(spark):
    numbers = spark.createDataFrame([(1,), (150,), (999,)], "number int")
    ranges = spark.createDataFrame([(1, 1, 98), (2, 99, 151)], "volume int, low int, high int")
    assert sorted(map(tuple, ids.with_volume(numbers, ranges).collect())) == [(1, 1), (150, 2), (999, 0)]


def test_labels(spark):
    assert [r[0] for r in spark.createDataFrame([(5,), (-3,)], "n int").select(ids.toh_label(F.col("n"))).collect()] == ["Toh 5", "CBETA-Tib 3"]


def test_more_forms_and_resolution(spark):
    df = spark.createDataFrame([("T1",), ("2917A",), ("x9",)], "r string").select(ids.catalogue_id(F.col("r")), ids.id_in_volume(F.col("r"), F.lit("T08")), ids.text_number(F.lit("T08n0251")), ids.dictionary_id(F.lit("w/xpr-ddb.pl?5.xml+id('b1')")))
    assert [tuple(r) for r in df.collect()] == [("T0001", "T08n0001", 251, "5.xml+id(b1)"), ("T2917a", "2917A", 251, "5.xml+id(b1)"), ("x9", "x9", 251, "5.xml+id(b1)")]
    texts = spark.createDataFrame([("T08n0251",), ("T10n0251",), ("T02n0150A",), ("T05n0220",)], "text_id string")
    raw = spark.createDataFrame([("T251",), ("251",), ("T08n0251",), ("T05n0220b",), ("T02n0150A",), ("T99n0001",), ("xyz",), ("T7",)], "raw string")
    got = {r["raw"]: r["text_id"] for r in ids.resolved(raw, texts).collect()}
    assert got == {"T251": "T08n0251", "251": "T08n0251", "T08n0251": "T08n0251", "T05n0220b": "T05n0220", "T02n0150A": "T02n0150A", "T99n0001": "T99n0001", "xyz": None, "T7": None}
