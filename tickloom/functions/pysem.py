"""Arithmetic, comparison and text with Python's rules, as Spark columns.

A ``Value`` is a column with its kind (``int``, ``float``, ``bool`` or ``str``),
known before the query runs, since Spark would coerce or reject what Python
computes: ``-7 % 3`` is 2, ``'5' == 5`` is false, ``0 and 5`` is 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("bool", "int", "float")
SPARK_TYPE = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string"}


class KindError(TypeError):
    """An operation that Python would refuse for these kinds."""


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str

    def cast(self, kind: str) -> Column:
        if self.kind == kind:
            return self.col
        if "str" in (kind, self.kind):
            return py_str(self).col if kind == "str" else self.col.cast(SPARK_TYPE[kind])
        if self.kind == "bool":
            return self.col.cast("bigint").cast(SPARK_TYPE[kind])
        return self.col.cast(SPARK_TYPE[kind])


def number(v: int | float) -> Value:
    return Value(F.lit(v).cast("bigint"), "int") if isinstance(v, int) else Value(F.lit(float(v)), "float")


def _both(a: Value, b: Value) -> str:
    if a.kind not in NUMERIC or b.kind not in NUMERIC:
        raise KindError(f"{a.kind} and {b.kind}")
    return "float" if "float" in (a.kind, b.kind) else "int"


def py_add(a: Value, b: Value) -> Value:
    if a.kind == b.kind == "str":
        return Value(F.concat(a.col, b.col), "str")
    k = _both(a, b)
    return Value(a.cast(k) + b.cast(k), k)


def py_sub(a: Value, b: Value) -> Value:
    k = _both(a, b)
    return Value(a.cast(k) - b.cast(k), k)


def py_mul(a: Value, b: Value) -> Value:
    k = _both(a, b)
    return Value(a.cast(k) * b.cast(k), k)


def py_div(a: Value, b: Value) -> Value:
    """True division; a zero divisor is an error."""
    _both(a, b)
    return Value(a.cast("float") / b.cast("float"), "float")


def py_mod(a: Value, b: Value) -> Value:
    """The result has the divisor's sign."""
    k = _both(a, b)
    x, y = a.cast(k), b.cast(k)
    return Value(F.when((x % y != 0) & ((x % y < 0) != (y < 0)), x % y + y).otherwise(x % y), k)


def py_pow(a: Value, b: Value, literal: int | None = None) -> Value:
    """``literal``: the exponent if it is a literal integer; then an integer's
    power stays an exact integer unless the exponent is negative. Beyond 64 bits it is
    an error. An integer to the power of a column is a float, as the kind must be known
    before the values are."""
    k = _both(a, b)
    if k == "int" and literal is not None and literal >= 0:
        # Over 64 factors only 0, 1 and -1 are in range, and their number's parity counts.
        n = literal if literal <= 64 else 64 + literal % 2
        one = F.lit(1).cast("bigint")
        return Value(F.aggregate(F.array_repeat(a.cast("int"), n), one, lambda out, x: out * x), "int")
    return Value(F.pow(a.cast("float"), b.cast("float")), "float")


def py_pow_int(a: Value, b: Value) -> Value:
    """An integer to the power of an integer column, as an exact integer. The kind must be
    known before the values are, so a negative exponent, whose power would be a float,
    is an error here, and so is a power beyond 64 bits. Null where either is."""
    if _both(a, b) != "int":
        raise KindError("integers only")
    base, n = a.cast("int"), b.cast("int")
    # Over 64 factors only 0, 1 and -1 are in range, and their number's parity counts.
    times = F.when(n < 0, F.raise_error("a negative exponent has no integer power").cast("bigint")).when(n <= 64, n).otherwise(64 + n % 2)
    one = F.lit(1).cast("bigint")
    return Value(F.aggregate(F.array_repeat(base, times.cast("int")), F.when(base.isNotNull(), one), lambda out, x: out * x), "int")


def py_neg(a: Value) -> Value:
    k = "int" if a.kind == "bool" else a.kind
    _both(a, a)
    return Value(-a.cast(k), k)


def py_abs(a: Value) -> Value:
    k = "int" if a.kind == "bool" else a.kind
    _both(a, a)
    return Value(F.abs(a.cast(k)), k)


def py_int(a: Value) -> Value:
    """Toward zero."""
    return Value(a.cast("int"), "int")


def py_truthy(a: Value) -> Column:
    return a.col if a.kind == "bool" else F.length(a.col) > 0 if a.kind == "str" else a.col != 0


def py_not(a: Value) -> Value:
    return Value(~py_truthy(a), "bool")


def _choose(first: Column, a: Value, b: Value) -> Value:
    """``a`` where ``first``, else ``b``. Operands of unlike kinds, of which Python
    would keep one as it is, meet in the wider kind."""
    k = a.kind if a.kind == b.kind else "str" if "str" in (a.kind, b.kind) else _both(a, b)
    return Value(F.when(first, a.cast(k)).otherwise(b.cast(k)), k)


def py_and(a: Value, b: Value) -> Value:
    return _choose(~py_truthy(a), a, b)


def py_or(a: Value, b: Value) -> Value:
    return _choose(py_truthy(a), a, b)


def py_compare(op: str, a: Value, b: Value) -> Value:
    if (a.kind == "str") != (b.kind == "str"):
        if op in ("==", "!="):
            return Value(F.lit(op == "!="), "bool")
        raise KindError(f"{a.kind} {op} {b.kind}")
    k = "str" if a.kind == "str" else _both(a, b)
    x, y = a.cast(k), b.cast(k)
    out = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Value(out, "bool")


def py_str(a: Value) -> Value:
    if a.kind == "str":
        return a
    if a.kind == "bool":
        return Value(F.when(a.col, "True").otherwise("False"), "str")
    if a.kind == "int":
        return Value(a.col.cast("string"), "str")
    return Value(_float_text(a.col), "str")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(base: int, most: int, n: Column) -> Column:
    """``base`` to the power of ``n`` in 0 to ``most``, exactly."""
    return F.element_at(F.array(*[F.lit(Decimal(base**k)).cast("decimal(38,0)") for k in range(most + 1)]), n + 1)


def _at(n: Column, e: Column) -> Column:
    return F.concat(n.cast("string"), F.lit("E"), e.cast("string")).cast("double")


def _exact(v: Column, e: Column) -> Column:
    """``n, q`` of decimals next to ``v`` of 15, 16 and 17 digits, the first of which counts
    ``10 ** e``: of each the nearest, of two as near the even one. One quotient in integers
    of 38 digits gives 17 digits and on which side of the half the rest is."""
    q, two, zero = e - 16, F.floor(F.log2(v)).cast("int") - 54, F.lit(0)  # two bits to spare, should the logarithm be off

    def divided(x: Column) -> Column:
        whole = (x["v"] * F.pow(F.lit(2.0), (-x["two"]).cast("double"))).cast("bigint").cast("decimal(38,0)")
        over = whole * _power(5, 30, F.greatest(zero, -x["q"])) * _power(2, 70, F.greatest(zero, x["two"] - x["q"]))
        under = _power(5, 30, F.greatest(zero, x["q"])) * _power(2, 80, F.greatest(zero, x["q"] - x["two"]))
        return _once(F.struct(over.alias("a"), under.alias("b"), x["q"].alias("q")), halved)

    def halved(x: Column) -> Column:
        rest = _once(F.struct((x["a"] % x["b"]).alias("r"), x["b"].alias("b")), lambda y: F.when(y["r"] == 0, 0).when(y["r"] * 2 < y["b"], 1).when(y["r"] * 2 == y["b"], 2).otherwise(3))
        return _once(F.struct(F.call_function("div", x["a"], x["b"]).alias("n"), rest.alias("rest"), x["q"].alias("q")), rounded)

    def rounded(x: Column) -> Column:
        out = []
        for cut, unit, more in ((2, 100, (0,)), (1, 10, (0, 1)), (0, 1, (0,))):
            n, past = F.call_function("div", x["n"], F.lit(unit)), x["n"] % unit * 4 + x["rest"]
            near = n + F.when((past > 2 * unit) | ((past == 2 * unit) & (n % 2 == 1)), 1).otherwise(0)
            out += [F.struct((near + d).alias("n"), (x["q"] + cut).alias("q")) for d in more]
        return F.array(*out)

    return _once(F.struct(v.alias("v"), q.alias("q"), two.alias("two")), divided)


def _shortest(v: Column, digits: Column, e: Column) -> Column:
    """``n, q`` of the shortest ``n * 10 ** q`` that is read as ``v``, the nearest of these.
    ``digits`` are some that are read as ``v``, the first of which counts ``10 ** e``: Java
    before 19 has too many in places. Two numbers of 15 digits are never read as the same one,
    so 15, 16 and 17 are tried. Below a power of two the nearest decimal may be too far where
    the next above is not. Where 38 digits do not hold the quotient, ``digits`` are rounded."""
    size, whole = F.length(digits), digits.cast("bigint")
    unit = lambda k: F.rpad(F.lit("1"), size - k + 1, "0").cast("bigint")
    tried = lambda n, q: F.array(*[F.struct((n + d).alias("n"), q.alias("q")) for d in (0, 1, -1)])
    least = F.when(v < 2.3e-308, 1).otherwise(F.least(F.lit(15), size))
    near = F.flatten(F.transform(F.sequence(least, size), lambda k: tried(F.call_function("div", whole + F.call_function("div", unit(k), F.lit(2)), unit(k)), e - k + 1)))
    return F.element_at(F.filter(F.when(e.between(-13, 40), _exact(v, e)).otherwise(near), lambda x: _at(x["n"], x["q"]) == v), 1)


def _float_text(col: Column) -> Column:
    """Python's ``repr``: the shortest digits, with an exponent where Python has one."""

    def parts(x: Column) -> Column:
        s = F.abs(x).cast("string")
        plain = F.substring_index(s, "E", 1)
        point, all_digits = F.instr(plain, "."), F.replace(plain, F.lit("."))
        digits = F.ltrim(all_digits, F.lit("0"))
        e = F.when(F.instr(s, "E") > 0, F.substring_index(s, "E", -1).cast("int")).otherwise(0) + point - 2 - F.length(all_digits) + F.length(digits)
        return F.struct(F.abs(x).alias("v"), F.rtrim(digits, F.lit("0")).alias("digits"), e.alias("e"))

    def best(x: Column) -> Column:
        found = _once(_shortest(x["v"], x["digits"], x["e"]), lambda y: F.struct(F.rtrim(y["n"].cast("string"), F.lit("0")).alias("digits"), (y["q"] + F.length(y["n"].cast("string")) - 1).alias("e")))
        return F.when((F.length(x["digits"]) > 15) | (x["v"] < 2.3e-308), found).otherwise(F.struct(x["digits"], x["e"]))

    def written(x: Column) -> Column:
        digits, e = x["digits"], x["e"]
        after, tail = F.substring(digits, e + 2, F.lit(40)), F.substring(digits, 2, 40)
        whole = F.concat(F.substring(F.rpad(digits, 40, "0"), F.lit(1), e + 1), F.lit("."), F.when(after == "", "0").otherwise(after))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        power = F.concat(F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        wide = F.concat(F.substring(digits, 1, 1), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), F.lit("e"), power)
        return F.when(e.between(0, 15), whole).when(e.between(-4, -1), small).otherwise(wide)

    def text(x: Column) -> Column:
        finite = F.concat(F.when(x < 0, "-").otherwise(""), _once(_once(parts(x), best), written))
        out = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, x.cast("string"))
        return out.when(x.isNotNull(), finite)

    return _once(col, text)


def py_join(items: list[Value]) -> Value:
    return Value(F.concat(*[py_str(i).col for i in items]) if items else F.lit(""), "str")


BINARY = {"+": py_add, "-": py_sub, "*": py_mul, "/": py_div, "%": py_mod, "and": py_and, "or": py_or}
COMPARE = ("==", "!=", "<", "<=", ">", ">=")
