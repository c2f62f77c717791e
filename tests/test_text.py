from pyspark.sql import functions as F

from chainalerts.functions.text import (
    amount_text, cents_of_float, float_text, mentioned_names, percent_text, timestamp_text,
    valid_account_name,
)


def evaluate(spark, rows, schema, expression):
    frame = spark.createDataFrame(rows, schema).select(F.expr(expression).alias("x"))
    return [row["x"] for row in frame.collect()]


def test_amount_text(spark):
    cases = [
        ("110000", 1000, "110"), ("1", 1000, "0.001"), ("0", 1000, "0"), ("0", 1000000, "0"),
        ("12856764", 1000000, "12.856764"), ("100", 1000000, "0.0001"),
        ("10", 1000000, "1e-05"), ("25", 1000000, "2.5e-05"), ("1", 1000000, "1e-06"),
        ("12500", 1000, "12.5"), ("100000000", 1000, "100000"), ("007", 1000, "0.007"),
        ("-1500", 1000, "-1.5"), ("999999999999999", 1000, "999999999999.999"),
        ("1000000000000000000", 1000, "1e+15"), ("1234500000000000000000", 1000, "1.2344999999999997e+18"),
        ("1234567890123456789", 1000, "1.2345678901234568e+15"),
        ("1.5", 1000, "0.0015"), ("abc", 1000, None), (None, 1000, None), ("5", None, None),
    ]
    got = evaluate(spark, cases, "raw string, div int, want string", amount_text("raw", "div"))
    assert got == [case[2] for case in cases]


def test_float_text(spark):
    cases = [(110.0, "110"), (0.001, "0.001"), (1e-05, "1e-05"), (12345678.9, "12345678.9"),
             (1e15, "1e+15"), (123456789012345.6, "123456789012345.6"), (-2.5, "-2.5"),
             (0.0001, "0.0001"), (0.00009, "9e-05"), (None, None)]
    got = evaluate(spark, cases, "x double, want string", float_text("x"))
    assert got == [case[1] for case in cases]


def test_cents_of_float(spark):
    cases = [(0.015, "0.02"), (0.0149, "0.01"), (0.014999999999999998, "0.02"),
             (2.675, "2.68"), (1.005, "1.01"), (0.0, "0.00"), (1e9, None), (None, None)]
    got = evaluate(spark, cases, "x double, want string", f"CAST({cents_of_float('x')} AS STRING)")
    assert got == [case[1] for case in cases]


def test_percent_and_timestamp_text(spark):
    cases = [(5.0, "05.00%"), (99.994, "99.99%"), (99.995, "##.##%"), (100.0, "##.##%"),
             (0.126, "00.13%")]
    assert evaluate(spark, cases, "x double, want string", percent_text("x")) == [
        case[1] for case in cases]
    stamps = evaluate(spark, [("2024-01-02 03:04:05.678",)], "t string",
                      timestamp_text("CAST(t AS TIMESTAMP_NTZ)"))
    assert stamps == ["2024-01-02T03:04:05"]


def test_mentions(spark):
    cases = [
        ("hi @someone.test", ["someone"]), ("a@mail5.org", ["mail5"]), ("@@x", ["x"]),
        ("@abcdefghijklmnopqrstu", ["abcdefghijklmnop"]), ("@_no", []), ("@-", ["-"]),
        ("@bob and @bob", ["bob"]), (None, None),
    ]
    got = evaluate(spark, cases, "t string, want array<string>", mentioned_names("t"))
    assert got == [case[1] for case in cases]


def test_account_names(spark):
    cases = [("abc", False), ("abcd", True), ("a" * 17, True), ("a" * 18, False),
             ("1abc", False), ("a.b-c", True), ("Abcd", False)]
    assert evaluate(spark, cases, "n string, want boolean", valid_account_name("n")) == [
        case[1] for case in cases]
