"""Python's rules, against Python."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import board
from tickloom.functions.pysem import BINARY, COMPARE, KindError, Value, number, py_abs, py_compare, py_int, py_join, py_neg, py_not, py_pow, py_str, py_truthy


def value(v):
    if isinstance(v, bool):
        return Value(F.lit(v), "bool")
    return Value(F.lit(v), "str") if isinstance(v, str) else number(v)


def tree(r, depth):
    """A random expression: its value by Spark's columns, and by Python."""
    if depth == 0 or r.random() < 0.2:
        v = r.choice([0, 1, -7, 3, 2.5, -0.75, True, False, 12])
        return value(v), v
    (a, x), (b, y) = tree(r, depth - 1), tree(r, depth - 1)
    op = r.choice(["+", "-", "*", "/", "%", "and", "or", "not", "abs", "neg", "int", *COMPARE])
    if op in ("/", "%") and y == 0:
        op = "+"
    if op in ("and", "or") and type(x) is not type(y):
        op = "-"
    if op in COMPARE:
        return py_compare(op, a, b), eval(f"x {op} y", {"x": x, "y": y})
    unary = {"not": (py_not, lambda v: not v), "abs": (py_abs, abs), "neg": (py_neg, lambda v: -v), "int": (py_int, int)}
    if op in unary:
        return unary[op][0](a), unary[op][1](x)
    return BINARY[op](a, b), eval(f"x {op} y", {"x": x, "y": y})


def test_random_trees(spark):
    r = random.Random(11)
    pairs = [tree(r, 3) for _ in range(120)]
    row = spark.range(1).select(*[v.col.alias(f"c{i}") for i, (v, _) in enumerate(pairs)]).first()
    for got, (v, want) in zip(row, pairs, strict=True):
        assert got == pytest.approx(want, rel=1e-12) and {"int": int, "float": float, "bool": bool}[v.kind] is type(want)


@pytest.mark.parametrize("v", [True, False, 0, -12, 3.0, 0.1, 1e16, 1e15, 123456789.25, 1e7, 0.001, 0.0001, 0.00001, -2.5e-7, 1.5e300, float("inf"), float("-inf"), float("nan"), 6 / 2, "a"])
def test_str(spark, v):
    assert spark.range(1).select(py_str(value(v)).col).first()[0] == str(v)


def test_edge_cases(spark):
    cases = [
        (BINARY["%"](number(-7), number(3)), -7 % 3),
        (BINARY["%"](number(7), number(-3)), 7 % -3),
        (BINARY["%"](number(-7.5), number(2)), -7.5 % 2),
        (py_int(number(-2.7)), -2),
        (py_pow(number(2), number(-1), -1), 0.5),
        (py_pow(number(-5), number(2), 2), 25),
        (BINARY["and"](number(0), number(5)), 0),
        (BINARY["or"](number(3), number(9)), 3),
        (py_compare("==", value("5"), number(5)), False),
        (py_compare("!=", value("5"), number(5)), True),
        (py_compare("==", value(True), number(1)), True),
        (py_join([]), ""),
        (py_join([value(True), number(1), number(0.5)]), "True10.5"),
        (Value(py_truthy(value("")), "bool"), False),
    ]
    row = spark.range(1).select(*[v.col.alias(f"c{i}") for i, (v, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, w in cases]
    with pytest.raises(KindError):
        py_compare("<", value("a"), number(1))
    with pytest.raises(KindError):
        BINARY["+"](value("a"), number(1))


def test_board(spark):
    lit = F.lit
    cases = [
        (board.pwm_duty(lit(-5)), 0), (board.pwm_duty(lit(150.9)), 65500), (board.servo_ns(lit(0)), 500_000), (board.servo_ns(lit(90)), 1_400_000),
        (board.servo_ns(lit(200)), 2_300_000), (board.analog(lit(0)), 0), (board.analog(lit(65535)), 1023), (board.distance_cm(lit(5), lit(580)), 10),
        (board.distance_cm(lit(5), lit(30_001)), 999), (board.distance_cm(lit(40_000), lit(1)), 999), (board.tone_hz(lit(0)), 1), (board.pin(lit("x")), 2),
        (board.pin(lit("39")), 39), (board.pin(lit("40")), 2), (board.pin(lit("1.5")), 2), (board.chip(lit("ESP32-c3")), "esp32c3"), (board.chip(lit("esp8266")), None),
    ]
    assert list(spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()) == [w for _, w in cases]
    low, high = spark.range(2000).select(board.random_int(lit(1), lit(6), 3).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert (low, high) == (1, 6)


def test_powers_are_exact(spark):
    from tickloom.functions.pysem import Value, py_pow

    for base, n in ((3, 35), (7, 21), (-2, 63), (2, 0), (-1, 1001), (0, 99), (1, 10**6)):
        (row,) = spark.createDataFrame([(base,)], "a long").select(py_pow(Value(F.col("a"), "int"), Value(F.lit(n), "int"), n).col.alias("p")).collect()
        assert row.p == base**n
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        spark.createDataFrame([(3,)], "a long").select(py_pow(Value(F.col("a"), "int"), Value(F.lit(41), "int"), 41).col).collect()


def test_powers_by_column(spark):
    from tickloom.functions.pysem import py_pow_int

    rows = [(a, n) for a in (-3, -1, 0, 1, 2, 9, None) for n in (0, 1, 2, 19, 62, 64, 65, 10**12, None) if a is None or n is None or abs(a) < 2 or abs(a) ** min(n, 70) < 2**63]
    p = py_pow_int(Value(F.col("a"), "int"), Value(F.col("n"), "int")).col.alias("p")
    got = spark.createDataFrame(rows, "a long, n long").select("a", "n", p).collect()
    for a, n, x in got:
        assert x == (None if a is None or n is None else a ** (n if abs(a) > 1 else n % 2 + 2 * (n > 0)))
    for bad in ((2, -1), (2, 63), (3, 10**9)):
        with pytest.raises(Exception, match="negative exponent|overflow|OVERFLOW"):
            spark.createDataFrame([bad], "a long, n long").select(p).collect()


def test_text_of_floats_is_the_shortest(spark):
    """Java 17 has more digits than are needed, or not the nearest, for some floats."""
    r = random.Random(5)
    v = [2e23, 2.0**-44, 65537 / 131072, 5e-324, 1.2e-322, 1.7976931348623157e308, 9007199254740993.0, 0.1 + 0.2, -0.0, -2e23, None]
    v += [r.uniform(0, 1000) * by for by in (1, 1e-6, 1e-12, 1e14, 1e20, 1e35) for _ in range(400)]
    v += [round(r.uniform(0, 1000), 4) * by for by in (1e-6, 1e14) for _ in range(400)]
    v += [r.choice((-1, 1)) * 2.0 ** r.randrange(-44, 130) for _ in range(100)] + [float(r.randrange(2**53, 2**63)) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in v], "v double").repartition(4).select("v", py_str(Value(F.col("v"), "float")).col.alias("s")).collect()
    assert [(x.v, x.s) for x in rows if x.s != (None if x.v is None else repr(x.v))] == []
