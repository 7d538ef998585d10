"""Registered queries: each operator over the given tables, with its SQL.

``events`` stands for readings: ``user_id`` is the device, ``event_id`` the tick,
``value`` the raw signal. Text operators read ``documents`` and ``pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import board
from .functions.pysem import BINARY, Value, number, py_abs, py_compare, py_int, py_join, py_neg, py_not, py_pow, py_pow_int, py_str, py_truthy
from .operators import joins, markers, pins, skew, state, tables, ticks, windows
from .plans.examples import EXAMPLES, block, change, compare, if_else, num, say, text, var, workspace
from .plans.program import run_program
from .scratch import shared_dir
from .sources import serial
from .streaming import serial as streams
from .streaming import waiters
from .streaming import windows as stream_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ORDER = ("ts", "event_id")


def _day() -> Column:
    """Cuts a device's events into ranges."""
    return F.date_trunc("day", F.col("ts"))


def query(sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a query over ``events``; its function gets the table."""
    return table_query("events", sql)


def table_query(table: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    def register(f: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


def _int(name: str) -> Value:
    return Value(F.col(name).cast("bigint"), "int")


def _value() -> Value:
    return Value(F.col("value"), "float")


def _signed() -> Value:
    return Value(F.col("event_id") % 41 - 20, "int")


def _divisor() -> Value:
    return Value(F.when(F.col("user_id") % 2 == 0, F.lit(7)).otherwise(F.lit(-7)).cast("bigint"), "int")



# Sources and sinks


@query("SELECT event_id, CASE WHEN CAST(trunc(value) AS BIGINT) % 3 <> 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS level FROM events")
def digital_read(e: DataFrame) -> DataFrame:
    return e.select("event_id", board.digital(F.col("value").cast("bigint") % 3).alias("level"))


@query("SELECT event_id, CAST(floor(greatest(0, least(65535, CAST(trunc(value * 200) AS BIGINT))) / 64) AS BIGINT) AS level FROM events")
def analog_read(e: DataFrame) -> DataFrame:
    return e.select("event_id", board.analog((F.col("value") * 200).cast("bigint")).alias("level"))


@query("""SELECT event_id, CASE WHEN w > 30000 OR p > 30000 THEN CAST(999 AS BIGINT) ELSE p // 58 END AS cm
FROM (SELECT event_id, (event_id % 7) * 6000 AS w, CAST(trunc(value * 100) AS BIGINT) AS p FROM events)""")
def distance(e: DataFrame) -> DataFrame:
    return e.select("event_id", board.distance_cm(F.col("event_id") % 7 * 6000, (F.col("value") * 100).cast("bigint")).alias("cm"))


@query("SELECT event_id, 'dw' AS kind, CAST(user_id % 40 AS INTEGER) AS pin, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS num_val FROM events")
def digital_write(e: DataFrame) -> DataFrame:
    on = F.col("value") > 50
    rows = ticks.actions(e, ticks.action("dw", F.col("user_id") % 40, F.when(on, 1).otherwise(0)))
    return rows.select("event_id", "kind", "pin", "num_val")


@query("SELECT event_id, greatest(0, least(100, CAST(trunc(value - 20) AS BIGINT))) * 655 AS duty FROM events")
def analog_write(e: DataFrame) -> DataFrame:
    return e.select("event_id", board.pwm_duty(F.col("value") - 20).alias("duty"))


@query("SELECT event_id, greatest(0, least(180, CAST(trunc(value - 20) AS BIGINT))) * 10000 + 500000 AS ns FROM events")
def servo_write(e: DataFrame) -> DataFrame:
    return e.select("event_id", board.servo_ns(F.col("value") - 20).alias("ns"))


@query("""SELECT event_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq = 1 THEN 'pwm' ELSE 'tone' END AS kind,
  CASE WHEN seq = 1 THEN 0.0::DOUBLE ELSE CAST(greatest(1, CAST(trunc(value - 10) AS BIGINT)) AS DOUBLE) END AS num_val
FROM events, (SELECT unnest([0, 1]) AS seq) WHERE seq = 0 OR event_type = 'click'""")
def tone_write(e: DataFrame) -> DataFrame:
    """A tone of a given length is also switched off."""
    rows = ticks.actions(e, ticks.action("tone", 15, board.tone_hz(F.col("value") - 10)), ticks.action("pwm", 15, F.lit(0), when=F.col("event_type") == "click"))
    return rows.select("event_id", "seq", "kind", "num_val")


@query("""SELECT event_id, user_id FROM (
  SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS handle FROM events
) WHERE event_type = 'error' AND handle = 1""")
def no_tone(e: DataFrame) -> DataFrame:
    """Switched off only where an earlier tone made the pin's handle."""
    made = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    rows = ticks.scan(e, "user_id", ORDER, _day(), maxima={"handle": made}, exclusive=True)
    return rows.where("event_type = 'error' and handle = 1").select("event_id", "user_id")


@query("SELECT event_id, 'print' AS kind, event_type || ' ' || CAST(user_id AS VARCHAR) AS str_val FROM events")
def print_write(e: DataFrame) -> DataFrame:
    said = py_join([Value(F.col("event_type"), "str"), Value(F.lit(" "), "str"), _int("user_id")])
    return ticks.actions(e, ticks.action("print", F.lit(None), text=said.col)).select("event_id", "kind", "str_val")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS mode FROM events GROUP BY ALL")
def pin_mode(e: DataFrame) -> DataFrame:
    return ticks.last_write(e, ["user_id", "event_type"], ORDER, "value").withColumnRenamed("value", "mode")


_ACCESSES = """p AS (SELECT event_id, ts, user_id, event_id % 3 AS pin, CAST(trunc(value) AS BIGINT) AS n,
  CASE event_type WHEN 'signup' THEN 'mode' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'none' ELSE 'read' END AS kind FROM events),
a AS (SELECT *, CASE WHEN kind = 'mode' THEN CASE n % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'pullup' ELSE 'out' END END AS asked,
  CASE WHEN kind = 'write' THEN n % 2 END AS put FROM p),
m AS (SELECT *, CASE kind WHEN 'write' THEN 'out' WHEN 'none' THEN NULL ELSE coalesce(last_value(asked IGNORE NULLS) OVER w, 'in') END AS mode,
  coalesce(last_value(put IGNORE NULLS) OVER w, 0) AS held FROM a
  WINDOW w AS (PARTITION BY user_id, pin ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT *, CASE WHEN mode IS NOT NULL THEN last_value(mode IGNORE NULLS)
  OVER (PARTITION BY user_id, pin ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS DISTINCT FROM mode END AS opened FROM m)"""


def _accesses(e: DataFrame) -> DataFrame:
    """Sign-ups set modes, purchases write, errors do neither and the others read; a
    signal that divides by five is no connection."""
    n = F.col("value").cast("bigint")
    e = e.withColumn("pin", F.col("event_id") % 3)
    kind = F.when(F.col("event_type") == "signup", "mode").when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "error", "none").otherwise("read")
    asked = F.when(n % 4 == 0, "in").when(n % 4 == 1, "pullup").when(n % 4 == 2, "out")
    return pins.accesses(e, "user_id", "pin", ORDER, _day(), kind, asked, n % 2, F.when(n % 5 != 0, n % 3))


@query(f"""WITH {_ACCESSES} SELECT event_id, mode, opened, CASE WHEN kind = 'read' THEN CAST(CASE WHEN mode = 'out' THEN held
  WHEN n % 5 = 0 THEN CASE WHEN mode = 'pullup' THEN 1 ELSE 0 END WHEN n % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) END AS level FROM o""")
def pin_accesses(e: DataFrame) -> DataFrame:
    return _accesses(e).select("event_id", "mode", "opened", "level")


@query(f"""WITH {_ACCESSES} SELECT user_id, pin, arg_max(mode, (ts, event_id)) AS mode, CAST(sum(CAST(opened AS INTEGER)) AS BIGINT) AS times_opened
FROM o WHERE mode IS NOT NULL GROUP BY ALL""")
def open_pins(e: DataFrame) -> DataFrame:
    return pins.open_modes(_accesses(e), "user_id", "pin", ORDER)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 4000")
def monitor_tail(e: DataFrame) -> DataFrame:
    return ticks.tail(e, ORDER).select("event_id", "ts", "event_type")


def _projects(e: DataFrame) -> DataFrame:
    app = F.when(F.col("event_type") == "view", "other").otherwise("loom")
    return e.select(app.alias("app"), F.lit(1).alias("version"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("name"), F.col("props").alias("workspace"))


@query("SELECT 'p' || CAST(event_id AS VARCHAR) AS name, props AS workspace FROM events WHERE event_type <> 'view'")
def project_import(e: DataFrame) -> DataFrame:
    """Project files, written and read again; those of another application are refused."""
    path = shared_dir(e.sparkSession, "projects")
    serial.write_projects(_projects(e), path)
    return serial.read_projects(e.sparkSession, path, "loom").select("name", "workspace")


@query("""SELECT '{"app":"' || CASE WHEN event_type = 'view' THEN 'other' ELSE 'loom' END || '","version":1,"name":"p' || CAST(event_id AS VARCHAR) || '","workspace":"' || replace(props, '"', '\\"') || '"}' AS line FROM events""")
def project_export(e: DataFrame) -> DataFrame:
    """The lines of project files."""
    path = shared_dir(e.sparkSession, "projects")
    serial.write_projects(_projects(e), path)
    return e.sparkSession.read.text(path).select(F.col("value").alias("line"))


@query("SELECT 'p' || CAST(event_id AS VARCHAR) AS name, version FROM (SELECT event_id, 1 AS version FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 7 FROM events)")
def project_fallback(e: DataFrame) -> DataFrame:
    """Saved projects where there are any, and where not, the given ones."""
    spark, path = e.sparkSession, shared_dir(e.sparkSession, "projects")
    serial.write_projects(_projects(e), path)
    default = _projects(e).withColumn("version", F.lit(7))
    found = serial.read_or_default(spark, path, "other", default)
    absent = serial.read_or_default(spark, f"{path}-absent", "other", default)
    return found.unionByName(absent).select("name", "version")


@query("SELECT 'dwrite(' || CAST(user_id % 40 AS VARCHAR) || ', ' || CAST(event_id % 2 AS VARCHAR) || ')' AS line FROM events")
def code_export(e: DataFrame) -> DataFrame:
    path = shared_dir(e.sparkSession, "code")
    serial.write_code(e.withColumn("line", F.format_string("dwrite(%d, %d)", F.col("user_id") % 40, F.col("event_id") % 2)), "line", path)
    return e.sparkSession.read.text(path).select(F.col("value").alias("line"))


# Expressions


@query("""SELECT event_id, s + 3 AS plus, s - user_id AS minus, s * 11 AS times, s + value AS mixed, abs(s) AS abs_s, -s AS neg_s
FROM (SELECT *, event_id % 41 - 20 AS s FROM events)""")
def arithmetic(e: DataFrame) -> DataFrame:
    out = {"plus": BINARY["+"](_signed(), number(3)), "minus": BINARY["-"](_signed(), _int("user_id")), "times": BINARY["*"](_signed(), number(11)), "mixed": BINARY["+"](_signed(), _value()), "abs_s": py_abs(_signed()), "neg_s": py_neg(_signed())}
    return e.select("event_id", *[v.col.alias(k) for k, v in out.items()])


@query("SELECT event_id, CAST(event_id % 41 - 20 AS DOUBLE) / CASE WHEN user_id % 2 = 0 THEN 7 ELSE (-7) END AS quotient FROM events")
def division(e: DataFrame) -> DataFrame:
    return e.select("event_id", BINARY["/"](_signed(), _divisor()).col.alias("quotient"))


@query("""SELECT event_id, CASE WHEN s % d <> 0 AND ((s % d < 0) <> (d < 0)) THEN s % d + d ELSE s % d END AS remainder
FROM (SELECT event_id, event_id % 41 - 20 AS s, CASE WHEN user_id % 2 = 0 THEN CAST(7 AS BIGINT) ELSE -7 END AS d FROM events)""")
def modulo(e: DataFrame) -> DataFrame:
    return e.select("event_id", BINARY["%"](_signed(), _divisor()).col.alias("remainder"))


@query("SELECT event_id, s * s * s AS cube, CASE WHEN s = 0 THEN NULL ELSE 1.0::DOUBLE / CAST(s AS DOUBLE) END AS inverse FROM (SELECT event_id, event_id % 41 - 20 AS s FROM events)")
def power(e: DataFrame) -> DataFrame:
    inverse = F.when(_signed().col != 0, py_pow(_signed(), number(-1), -1).col)
    return e.select("event_id", py_pow(_signed(), number(3), 3).col.alias("cube"), inverse.alias("inverse"))


@query("SELECT event_id, CAST(round(pow(event_id % 7 - 3, user_id % 20)) AS BIGINT) AS p FROM events")
def power_by_column(e: DataFrame) -> DataFrame:
    base, n = Value(F.col("event_id") % 7 - 3, "int"), Value(F.col("user_id") % 20, "int")
    return e.select("event_id", py_pow_int(base, n).col.alias("p"))


@query()
def random_ints(e: DataFrame) -> DataFrame:
    """Between 1 and 6; no SQL, as any value in that range is right."""
    return e.select("event_id", board.random_int(F.lit(1), F.lit(6), 7).alias("n"))


@query("""SELECT event_id, event_type || '=' || CAST(user_id AS VARCHAR) || ',' || CASE WHEN value > 50 THEN 'True' ELSE 'False' END || ',' || CAST(CAST(user_id AS DOUBLE) / 4 AS VARCHAR) AS joined FROM events""")
def text_join(e: DataFrame) -> DataFrame:
    items = [Value(F.col("event_type"), "str"), Value(F.lit("="), "str"), _int("user_id"), Value(F.lit(","), "str"), Value(F.col("value") > 50, "bool"), Value(F.lit(","), "str"), BINARY["/"](_int("user_id"), number(4))]
    return e.select("event_id", py_join(items).col.alias("joined"))


@query("SELECT event_id, CAST(value AS VARCHAR) AS plain, CAST(value * 1e-6::DOUBLE AS VARCHAR) AS small, CAST(value * 1e14::DOUBLE AS VARCHAR) AS large FROM events")
def number_text(e: DataFrame) -> DataFrame:
    """``str()`` of floats: the shortest digits, with an exponent where Python has one."""
    scaled = {"plain": 1.0, "small": 1e-6, "large": 1e14}
    return e.select("event_id", *[py_str(BINARY["*"](_value(), number(by))).col.alias(k) for k, by in scaled.items()])


@query("SELECT event_id, CAST(trunc(value - 100) AS BIGINT) AS whole FROM events")
def int_coercion(e: DataFrame) -> DataFrame:
    return e.select("event_id", py_int(Value(F.col("value") - 100, "float")).col.alias("whole"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 50 BETWEEN 0 AND 39 AND value < 100 THEN event_id % 50 ELSE 2 END AS INTEGER) AS pin FROM events")
def default_pin(e: DataFrame) -> DataFrame:
    raw = F.when(F.col("value") < 100, (F.col("event_id") % 50).cast("string")).otherwise("x")
    return e.select("event_id", board.pin(raw).alias("pin"))


# Predicates


@query("""SELECT event_id, s = 5 AS eq, s <> 5 AS ne, s < value AS lt, s <= 3 AS le, s > 3 AS gt, s >= value AS ge, false AS text_eq
FROM (SELECT *, event_id % 41 - 20 AS s FROM events)""")
def comparisons(e: DataFrame) -> DataFrame:
    out = {"eq": ("==", number(5)), "ne": ("!=", number(5)), "lt": ("<", _value()), "le": ("<=", number(3)), "gt": (">", number(3)), "ge": (">=", _value()), "text_eq": ("==", Value(F.col("event_type"), "str"))}
    return e.select("event_id", *[py_compare(op, _signed(), b).col.alias(k) for k, (op, b) in out.items()])


@query("""SELECT event_id, CASE WHEN s = 0 THEN s ELSE user_id END AS both, CASE WHEN s <> 0 THEN s ELSE user_id END AS either, s = 0 AS neither
FROM (SELECT *, event_id % 3 AS s FROM events)""")
def logic(e: DataFrame) -> DataFrame:
    """``and`` and ``or`` give one of their operands."""
    s, u = Value(F.col("event_id") % 3, "int"), _int("user_id")
    return e.select("event_id", BINARY["and"](s, u).col.alias("both"), BINARY["or"](s, u).col.alias("either"), py_not(s).col.alias("neither"))


@query("SELECT event_id, CASE WHEN value < 20 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS level FROM events")
def if_elif_else(e: DataFrame) -> DataFrame:
    low, mid = py_compare("<", _value(), number(20)), py_compare("<", _value(), number(100))
    return e.select("event_id", F.when(py_truthy(low), "low").when(py_truthy(mid), "mid").otherwise("high").alias("level"))


@table_query("pages", "SELECT page_id, CASE WHEN contains(upper(url), 'C3') THEN 'esp32c3' WHEN contains(upper(url), 'S3') THEN 'esp32s3' WHEN contains(upper(url), 'ESP32') THEN 'esp32' END AS chip FROM pages")
def chip_choice(p: DataFrame) -> DataFrame:
    return p.select("page_id", board.chip(F.col("url")).alias("chip"))


# Control flow over ticks


@query("SELECT user_id, min(event_id) AS first_tick, count(*) AS loops FROM events GROUP BY user_id")
def start_and_forever(e: DataFrame) -> DataFrame:
    """The start runs at a device's first tick, the loop at each."""
    return ticks.start_and_loop(e, "user_id", ["event_id"]).withColumnRenamed("event_id", "first_tick")


@table_query("orders", "SELECT o_orderkey, i FROM (SELECT o_orderkey, unnest(range(greatest(0, o_orderkey % 5 - 1))) AS i FROM orders)")
def repeat_times(o: DataFrame) -> DataFrame:
    return ticks.repeat(o, F.col("o_orderkey") % 5 - 1).select("o_orderkey", "i")


@query("""WITH RECURSIVE h AS (
  SELECT event_id, CAST(trunc(value) AS BIGINT) AS n, CAST(0 AS BIGINT) AS halvings FROM events
  UNION ALL SELECT event_id, n // 2, halvings + 1 FROM h WHERE n > 1
) SELECT event_id, max(halvings) AS halvings FROM h GROUP BY event_id""")
def while_loop(e: DataFrame) -> DataFrame:
    """Rounds of ``while n > 1: n = n // 2``."""
    halved = state.while_loop(e, {"n": F.col("value").cast("bigint")}, lambda s: s["n"] > 1, lambda s: {"n": F.floor(s["n"] / 2)}, rounds="halvings")
    return halved.select("event_id", "halvings")


@table_query("orders", """WITH RECURSIVE h AS (
  SELECT o_orderkey, o_orderkey AS n, CAST(0 AS BIGINT) AS rounds FROM orders
  UNION ALL SELECT o_orderkey, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, rounds + 1 FROM h WHERE n > 1
) SELECT o_orderkey, max(rounds) AS rounds FROM h GROUP BY o_orderkey""")
def until_loop(o: DataFrame) -> DataFrame:
    """``repeat until n <= 1``, with as many rounds as each row needs: hundreds for some."""
    step = lambda s: {"n": F.when(s["n"] % 2 == 0, F.floor(s["n"] / 2)).otherwise(s["n"] * 3 + 1)}
    return state.while_loop(o.select("o_orderkey"), {"n": F.col("o_orderkey")}, lambda s: ~(s["n"] <= 1), step).select("o_orderkey", "rounds")


@query("""SELECT event_id, user_id FROM (
  SELECT *, max(CASE WHEN value > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS broke FROM events
) WHERE broke = 0""")
def break_prefix(e: DataFrame) -> DataFrame:
    return ticks.until_break(e, "user_id", ORDER, _day(), F.col("value") > 120).select("event_id", "user_id")


@query("SELECT event_id, CAST(i AS INTEGER) AS i FROM events, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE NOT (event_type = 'view' AND i >= 2)")
def continue_guard(e: DataFrame) -> DataFrame:
    """``continue`` leaves out the rest of a round."""
    rounds = ticks.repeat(e, F.lit(4).cast("bigint")).withColumn("i", F.col("i").cast("int"))
    return ticks.continue_when(rounds, (F.col("event_type") == "view") & (F.col("i") >= 2)).select("event_id", "i")


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events WHERE value > 60) WHERE ts = first_ts GROUP BY user_id")
def wait_until(e: DataFrame) -> DataFrame:
    return ticks.wait_until(e, "user_id", ORDER, F.col("value") > 60).select("user_id", "event_id")


@query("""SELECT event_id, CAST(coalesce(sum(CAST(trunc(value * 10) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t_ms FROM events""")
def sleep_clock(e: DataFrame) -> DataFrame:
    return ticks.clock(e, "user_id", ORDER, _day(), (F.col("value") * 10).cast("bigint")).select("event_id", "t_ms")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def set_variable(e: DataFrame) -> DataFrame:
    return ticks.last_write(e, ["user_id"], ORDER, "event_type").withColumnRenamed("event_type", "last_type")


@query("SELECT event_id, CAST(sum(CAST(trunc(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def change_variable(e: DataFrame) -> DataFrame:
    return ticks.accumulate(e, "user_id", ORDER, _day(), F.col("value").cast("bigint")).select("event_id", "total")


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(trunc(value) AS BIGINT) END) OVER (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e""")
def reset_accumulator(e: DataFrame) -> DataFrame:
    """``if error: total = 0 else: total += value``"""
    error = F.col("event_type") == "error"
    return state.assign(e, "user_id", ORDER, _day(), F.when(error, 0), F.when(~error, F.col("value").cast("bigint")), "total").select("event_id", "total")


@query("""WITH e AS (SELECT *, event_type = 'purchase' AND value > 30 AS hit FROM events),
p AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM e)
SELECT event_id, CAST(CASE WHEN part = 0 THEN 7 ELSE 0 END + sum(CASE WHEN hit THEN CAST(trunc(value) AS BIGINT) WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS level FROM p""")
def guarded_set(e: DataFrame) -> DataFrame:
    """``if purchase and value > 30: level = value elif click: level += 1``, from 7 on."""
    hit, click = (F.col("event_type") == "purchase") & (F.col("value") > 30), F.col("event_type") == "click"
    return state.assign(e, "user_id", ORDER, _day(), F.when(hit, F.col("value").cast("bigint")), F.when(click, 1), "level", start=7).select("event_id", "level")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CAST(trunc(value) AS BIGINT) AS a,
  CASE event_type WHEN 'click' THEN -1 WHEN 'error' THEN 0 ELSE 1 END AS f FROM events),
x AS (SELECT event_id, user_id, n, 5 * f + a AS level FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.user_id, e.n, x.level * e.f + e.a FROM x JOIN e ON e.user_id = x.user_id AND e.n = x.n + 1)
SELECT event_id, CAST(level AS BIGINT) AS level FROM x""")
def affine_updates(e: DataFrame) -> DataFrame:
    """``level = level * factor + value`` with a factor of -1, 0 or 1."""
    factor = F.when(F.col("event_type") == "click", -1).when(F.col("event_type") == "error", 0).otherwise(1)
    return state.affine(e, "user_id", ORDER, _day(), factor, F.col("value").cast("bigint"), "level", start=5).select("event_id", "level")


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY k) - 1 AS INTEGER) AS seq, kind FROM (
  SELECT event_id, k, ['dw', 'servo', 'print'][k] AS kind FROM events, (SELECT unnest([1, 2, 3]) AS k) WHERE k <> 2 OR value > 50)""")
def statement_chain(e: DataFrame) -> DataFrame:
    rows = ticks.actions(e, ticks.action("dw", 2), ticks.action("servo", 13, when=F.col("value") > 50), ticks.action("print", F.lit(None)))
    return rows.select("event_id", "seq", "kind")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 100 AS t_ms FROM events")
def empty_body(e: DataFrame) -> DataFrame:
    """An empty nested body waits 100 ms."""
    return ticks.clock(e, "user_id", ORDER, _day(), F.lit(100).cast("bigint")).select("event_id", "t_ms")


# Serial text


@table_query("documents", r"""SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) END AS line FROM documents""")
def marker_wait(d: DataFrame) -> DataFrame:
    return d.select("doc_id", serial.before_marker(F.col("text"), "\n").alias("line"))


@table_query("documents", r"""SELECT doc_id, CASE WHEN strpos(text, '.') > 0 THEN substr(text, 1, strpos(text, '.') - 1) END AS first,
  CASE WHEN strpos(rest, ',') > 0 THEN substr(rest, 1, strpos(rest, ',') - 1) END AS second
FROM (SELECT doc_id, text, CASE WHEN strpos(text, '.') > 0 THEN substr(text, strpos(text, '.') + 1) ELSE text END AS rest FROM documents)""")
def marker_waiters(d: DataFrame) -> DataFrame:
    got = serial.waiters(F.col("text"), [".", ","])
    return d.select("doc_id", got[0].alias("first"), got[1].alias("second"))


@table_query("documents", "SELECT doc_id, substr(text, 1, 80) AS head, CAST(length(substr(text, 1, 80)) AS BIGINT) AS n FROM documents")
def wait_chars(d: DataFrame) -> DataFrame:
    """The operator's own limit: it waits for 80 characters."""
    head = serial.first_chars(F.col("text"), 80)
    return d.select("doc_id", head.alias("head"), F.length(head).cast("bigint").alias("n"))


@query("SELECT user_id, time_bucket(INTERVAL '100 milliseconds', ts) AS start, count(*) AS chunks FROM events GROUP BY ALL")
def drain_windows(e: DataFrame) -> DataFrame:
    return streams.drained(e, "user_id", "ts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@table_query("documents", """SELECT doc_id, CASE WHEN lang IS NOT NULL THEN split_part(text, chr(4), 1) END AS out,
CASE WHEN strpos(text, chr(4)) > 0 AND lang IS NOT NULL THEN split_part(text || chr(4), chr(4), 2) WHEN text IS NOT NULL THEN lang END AS err FROM documents""")
def exec_framing(d: DataFrame) -> DataFrame:
    framed = F.concat(F.lit("junk OK"), F.col("text"), F.lit("\x04"), F.col("lang"), F.lit("\x04>"))
    got = serial.exec_frames(framed)
    return d.select("doc_id", got["out"].alias("out"), got["err"].alias("err"))


@table_query("documents", """SELECT doc_id, n AS chunk_no, substr(bytes, n * 512 + 1, 512) AS chunk
FROM (SELECT doc_id, hex(encode(text)) AS bytes, unnest(range(CAST(ceil(octet_length(encode(text)) / 256) AS BIGINT))) AS n FROM documents)""")
def chunker(d: DataFrame) -> DataFrame:
    return serial.chunked(d, "text").select("doc_id", "chunk_no", F.hex("chunk").alias("chunk"))


_RE2 = serial.TOKEN.replace("*+", "*").replace(serial.BEFORE, r"\b").replace(serial.AFTER, r"\b")
_FOUND = ", ".join(f"CAST(len(list_filter(regexp_extract_all(text, $t${_RE2}$t$, {i}), lambda x: x <> '')) AS BIGINT) AS {n}" for i, n in enumerate(("strings", "comments", "keywords", "numbers"), 1))


@table_query("documents", f"SELECT doc_id, {_FOUND} FROM documents")
def token_classes(d: DataFrame) -> DataFrame:
    return d.select("doc_id", serial.token_counts(F.col("text")).alias("n")).select("doc_id", "n.*")


@table_query("documents", """SELECT doc_id, CAST(i - 1 AS BIGINT) AS frame_no, parts[i] AS frame
FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))""")
def stream_frames(d: DataFrame) -> DataFrame:
    """Chunks of bytes, as a sender cuts them, framed by line on a stream that ends."""
    spark, path = d.sparkSession, shared_dir(d.sparkSession, "frames")
    chunks = serial.chunked(d, "text").select(F.col("doc_id").cast("string").alias("port"), F.col("chunk_no").alias("seq"), "chunk")
    chunks.write.parquet(f"{path}/in")
    frames = streams.framed(spark.readStream.schema(chunks.schema).parquet(f"{path}/in"), "\n")
    frames.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frames.schema).parquet(f"{path}/out").select(F.col("port").cast("bigint").alias("doc_id"), "frame_no", "frame")


@table_query("documents", r"""WITH p AS (SELECT doc_id, string_split(text, '.' || chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM p),
s AS (SELECT *, coalesce(sum(strlen(part) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at FROM u)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS frame_no, CAST(begin_at AS BIGINT) AS begin_at, CAST(begin_at + strlen(part) AS BIGINT) AS end_at FROM s WHERE i < n""")
def marker_frames(d: DataFrame) -> DataFrame:
    """Sentences that end a line, found in chunks of 256 bytes."""
    return markers.frames(serial.chunked(d, "text"), "doc_id", "chunk_no", "chunk", ".\n")


#: Milliseconds between two chunks of 256 characters, as a sender paces them.
PACE = serial.CHUNK_PAUSE_MS


def port_rows(d: DataFrame, asks: list[tuple[str, str | None, int | None, int, int]]) -> DataFrame:
    """Each document as the text that comes at a port, and what is asked for there:
    ``kind, text, n``, when, and for how long (ms). A clock of its own goes on to the end."""
    at = lambda ms: F.timestamp_millis(ms.cast("bigint") + 1000)  # a stream's time begins at 0
    port = F.col("doc_id").cast("string").alias("port")
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.length("text") / 256) - 1)))
    chunks = d.where("text is not null").select("doc_id", "text", cut.alias("i")).select(
        port, (F.col("i") * 100 + 50).alias("seq"), at(F.col("i") * PACE).alias("at"), F.lit("chunk").alias("kind"), F.substring("text", (F.col("i") * 256 + 1).cast("int"), F.lit(256)).alias("text"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("timeout_ms")
    )
    out = chunks
    for k, (kind, text, n, ms, timeout) in enumerate(asks):
        row = (port, F.lit(ms // PACE * 100 + k).cast("long"), at(F.lit(ms)), F.lit(kind), F.lit(text).cast("string"), F.lit(n).cast("long"), F.lit(timeout).cast("long"))
        out = out.union(d.select(*row))
    end = d.agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("most")).select(F.lit("clock"), F.lit(0).cast("long"), at(F.col("most") + 10_000), F.lit("clock"), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    return out.union(end)


def run_ports(rows: DataFrame) -> DataFrame:
    """The answers of a stream that reads ``rows`` to its end."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "ports")
    rows.write.option("compression", "zstd").parquet(f"{path}/in")
    with waiters.state_store(spark):
        said = waiters.answered(spark.readStream.schema(waiters.ROWS).parquet(f"{path}/in"))
        said.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(said.schema).parquet(f"{path}/out").select(F.col("port").cast("bigint").alias("doc_id"), "waiter", "status", "text")


@table_query("documents", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, strpos(substr(text, 1, 1536), '.') AS dot FROM d),
b AS (SELECT doc_id, dot, CASE WHEN dot > 0 THEN substr(text, 1, dot - 1) END AS line, substr(text, dot + 1, 2560 - dot) AS rest FROM a)
SELECT doc_id, CAST(0 AS BIGINT) AS waiter, CASE WHEN dot > 0 THEN 'ok' ELSE 'timeout' END AS status, line AS text FROM b
UNION ALL SELECT doc_id, 1, CASE WHEN length(rest) >= 400 THEN 'ok' ELSE 'timeout' END, substr(rest, 1, 400) FROM b""")
def stream_waiters(d: DataFrame) -> DataFrame:
    """A wait for a full stop of 50 ms, then one for 400 characters of 30 ms."""
    return run_ports(port_rows(d, [("marker", ".", None, 0, 50), ("chars", None, 400, 60, 30)]))


@table_query("documents", "SELECT doc_id, CAST(0 AS BIGINT) AS waiter, 'ok' AS status, coalesce(substr(text, 513, 2560), '') AS text FROM documents")
def stream_drain(d: DataFrame) -> DataFrame:
    """At 15 ms what has come is dropped; then the text of the next 100 ms is collected."""
    return run_ports(port_rows(d, [("drain", None, None, 15, 100)]))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '1 hour' AS "end", count(*) AS changes FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events)
) GROUP BY user_id, burst""")
def debounce(e: DataFrame) -> DataFrame:
    """Changes less than an hour apart are one burst."""
    return streams.debounced(e, "user_id", "ts", "1 hour").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "changes")


# Joins by time: for readings beside other tables, not part of block programs

#: The hour of both tables' times; events and orders lie years apart in the given tables, so
#: orders are dated into the time of the events.
_MOVED = "SELECT o_orderkey, 1 + o_custkey % (SELECT max(user_id) FROM events) AS user_id, (SELECT min(ts) FROM events) + to_minutes(CAST(o_orderkey % 60000 AS INTEGER)) AS ts FROM orders"


def multi_query(sql: str) -> Callable[[Query], Query]:
    """Registers a query over several tables."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@multi_query(f"""WITH o AS ({_MOVED}), e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT o_orderkey, e.event_id FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.ts >= e.ts""")
def last_event_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer's last event that is not after it."""
    e, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders"))
    bounds = e.agg(F.min("ts").alias("low"), F.max("user_id").alias("users")).first()  # one row
    low = F.lit(bounds["low"]).cast(e.schema["ts"].dataType)
    moved = o.select("o_orderkey", (F.col("o_custkey") % F.lit(bounds["users"]) + 1).alias("user_id"), (low + F.make_dt_interval(mins=(F.col("o_orderkey") % 60000).cast("int"))).alias("ts"))
    return joins.as_of(moved, e, "user_id", "ts", _day(), ["event_id"], ["event_id"]).select("o_orderkey", "event_id")


@multi_query("""WITH l AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS line, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS day, 1 + l_partkey % 9 AS days FROM lineitem),
r AS (SELECT * FROM l WHERE line % 8 = 1)
SELECT l.l_suppkey, l.line AS left_id, r.line AS right_id FROM l JOIN r ON l.l_suppkey = r.l_suppkey AND l.day < r.day + r.days AND r.day < l.day + l.days""")
def lines_on_the_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of orders, with the lines of their supplier that are on the way on a same
    day; a line is on the way for one to nine days."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400)
    lines = l.select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), day.alias("day"), (day + 1 + F.col("l_partkey") % 9).alias("until"))
    return joins.overlaps(lines, lines.where("line % 8 = 1"), "l_suppkey", "day", "until", ("line", "line"), 10)


# Ranks, cubes and table functions


@table_query("lineitem", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem")
def price_ranks(l: DataFrame) -> DataFrame:  # noqa: E741
    """Each line's place among all by price."""
    return tables.ranked(l.select("l_orderkey", "l_linenumber", "l_extendedprice"), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")).select("l_orderkey", "l_linenumber", "rank")


@table_query("lineitem", "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def top_lines(l: DataFrame) -> DataFrame:  # noqa: E741
    """Each supplier's three dearest lines."""
    return tables.top(l, ["l_suppkey"], 3, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@table_query("lineitem", """SELECT l_returnflag, l_linestatus, tax, GROUPING(l_returnflag, l_linestatus, tax) AS level, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(DISTINCT l_partkey) AS parts
FROM (SELECT *, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem) GROUP BY CUBE (l_returnflag, l_linestatus, tax)""")
def sales_cube(l: DataFrame) -> DataFrame:  # noqa: E741
    rows = l.withColumn("tax", F.round(F.col("l_tax") * 100).cast("bigint"))
    return tables.cube(rows, ["l_returnflag", "l_linestatus", "tax"], "l_partkey", {"quantity": F.col("l_quantity").cast("bigint")}, "parts")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS m FROM events),
r AS (SELECT user_id, event_type, min(n) AS first, count(*) AS rows FROM e GROUP BY user_id, event_type, n - m)
SELECT user_id AS "key", row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS run_no, event_type AS "value", rows AS "rows" FROM r""")
def event_runs(e: DataFrame) -> DataFrame:
    """Stretches of equal events, by a table function."""
    return tables.runs(e.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", "event_type")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_fields(e: DataFrame) -> DataFrame:
    return e.select("event_id", tables.json_field("props", "$.k", "bigint").alias("k"), tables.json_field("props", "$.none", "string").alias("none"))


# Joins with hot keys: a third of all events is moved to one user

_HOT = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id FROM events"


def _hot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("user_id")).alias("user_id"))


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))


@multi_query(f"SELECT event_id, user_id, c_nationkey FROM ({_HOT}) JOIN customer ON user_id = c_custkey")
def hot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their customer's nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return skew.joined(_hot_events(spark, sf_dir), c, ["user_id"], spread=F.col("event_id")).select("event_id", "user_id", "c_nationkey")


@multi_query(f"SELECT event_id, user_id FROM ({_HOT}) WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def hot_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of customers with an urgent order."""
    return skew.joined(_hot_events(spark, sf_dir), _urgent(spark, sf_dir), ["user_id"], "left_semi", spread=F.col("event_id")).select("event_id", "user_id")


@multi_query(f"SELECT event_id, user_id FROM ({_HOT}) h WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = h.user_id AND o_orderpriority = '1-URGENT')")
def hot_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of customers without one."""
    return skew.joined(_hot_events(spark, sf_dir), _urgent(spark, sf_dir), ["user_id"], "left_anti", spread=F.col("event_id")).select("event_id", "user_id")


# Windows over time


@query("""SELECT event_id, quantile_disc(value, 0.5) OVER w AS median, count(value) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7 days' PRECEDING AND CURRENT ROW)""")
def moving_median(e: DataFrame) -> DataFrame:
    """Each event with the median of its user's values over seven days."""
    rows = e.select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return windows.moving_quantile(rows, "user_id", "at", "value", 7 * 86_400_000_000, name="median", number="n").select("event_id", "median", "n")


#: Hours after an event at which it arrives, for every tenth up to four days; arrivals are taken
#: in batches of five days. Times are in hours from the first event.
_ARRIVED = """WITH a AS (SELECT *, ((epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) // 3600000000 + CASE WHEN event_id % 10 = 0 THEN event_id * 37 % 100 ELSE event_id % 10 END) // 120 AS batch,
time_bucket(INTERVAL '6 hours', ts) AS start FROM events),
w AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '24 hours' AS mark FROM a GROUP BY batch),
r AS (SELECT a.*, coalesce(start + INTERVAL '6 hours' <= mark, false) AS late FROM a JOIN w USING (batch))
"""


def _arrivals(e: DataFrame) -> str:
    """The folder of a stream of six-hour windows that took the events batch by batch, and
    was stopped and started from its checkpoint between them."""
    spark, path = e.sparkSession, shared_dir(e.sparkSession, "arrivals")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low = e.agg(F.min(micros)).first()[0]  # one number
    hours = F.floor((micros - F.lit(low)) / 3_600_000_000)
    on_way = F.when(F.col("event_id") % 10 == 0, F.col("event_id") * 37 % 100).otherwise(F.col("event_id") % 10)
    rows = e.select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    rows.withColumn("batch", F.floor((hours + on_way) / 120)).write.partitionBy("batch").parquet(f"{path}/all")
    held = spark.read.parquet(f"{path}/all")
    sink = stream_windows.window_sink(path, ["event_type"], "ts", "6 hours", "24 hours", {"cents": F.col("cents")})
    for n in sorted(r["batch"] for r in held.select("batch").distinct().collect()):  # by time, not by size
        held.where(F.col("batch") == n).drop("batch").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return path


@query(_ARRIVED + "SELECT event_id, start FROM r WHERE late")
def late_events(e: DataFrame) -> DataFrame:
    """Events whose window was over when they arrived."""
    return stream_windows.late_rows(e.sparkSession, _arrivals(e)).select("event_id", F.col("start").cast("timestamp_ntz").alias("start"))


@query(_ARRIVED + """SELECT event_type, start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
start + INTERVAL '6 hours' > (SELECT max(ts) - INTERVAL '24 hours' FROM events) AS still_open FROM r WHERE NOT late GROUP BY event_type, start""")
def window_totals(e: DataFrame) -> DataFrame:
    """Events by kind and six hours as a stream counts them, and whether more may come."""
    spark, path = e.sparkSession, _arrivals(e)
    over = stream_windows.closed_windows(spark, path).drop("batch").withColumn("still_open", F.lit(False))
    out = over.unionByName(stream_windows.open_windows(spark, path).withColumn("still_open", F.lit(True)))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT v.user_id, v.event_id AS first_id, p.event_id AS then_id FROM events v JOIN events p
ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL '2 hours' WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def bought_after_view(e: DataFrame) -> DataFrame:
    """Purchases within two hours of a view, as a join of two streams."""
    spark, path = e.sparkSession, shared_dir(e.sparkSession, "pairs")
    rows = e.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{path}/in")
    side = lambda kind: spark.readStream.schema(rows.schema).parquet(f"{path}/in").where(F.col("event_type") == kind)
    pairs = stream_windows.followed(side("view"), side("purchase"), "user_id", "ts", "2 hours", "1 day", ("event_id", "event_id"))
    pairs.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(pairs.schema).parquet(f"{path}/out")


# Whole programs


def readings(e: DataFrame) -> DataFrame:
    """A button on pin 4, a knob on pin 32 and an echo on pin 14."""
    value = F.col("value")
    reads = F.create_map(F.lit(4), value.cast("bigint") % 2, F.lit(32), (value * 200).cast("bigint"), F.lit(14), (value * 20).cast("bigint"))
    waits = F.create_map(F.lit(14), F.col("event_id") % 7 * 6000)
    return e.select(F.col("user_id").alias("device"), F.col("event_id").alias("tick"), reads.alias("reads"), waits.alias("waits"))


_BASE = """WITH e AS (SELECT user_id AS device, event_id AS tick, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, value FROM events)
, p AS (SELECT DISTINCT device FROM e)
"""
_COLUMNS = "device, tick, CAST(seq AS INTEGER) AS seq, CAST(t AS BIGINT) AS t_ms, kind, CAST(pin AS INTEGER) AS pin, CAST(num AS DOUBLE) AS num_val, CAST(str AS VARCHAR) AS str_val"


def _start(said: str) -> str:
    return f"SELECT device, CAST(-1 AS BIGINT) AS tick, 0 AS seq, 0 AS t, 'print' AS kind, NULL AS pin, NULL AS num, '{said}' AS str FROM p"


def _fixed(acts: list[tuple[int, str, int, int]], length: int) -> str:
    rows = ", ".join(f"({i}, {t}, '{k}', {pin}, {v})" for i, (t, k, pin, v) in enumerate(acts))
    return f"SELECT device, tick, seq, n * {length} + t AS t, kind, pin, num, NULL AS str FROM e, (VALUES {rows}) a(seq, t, kind, pin, num)"


_PROGRAM_SQL = {
    "blink": f"{_BASE} SELECT {_COLUMNS} FROM ({_start('hello')} UNION ALL {_fixed([(0, 'dw', 2, 1), (500, 'dw', 2, 0)], 1000)})",
    "button": f"{_BASE} SELECT {_COLUMNS} FROM ({_start('press')} UNION ALL SELECT device, tick, 0, 0, 'dw', 2, CASE WHEN CAST(trunc(value) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END, NULL FROM e)",
    "traffic": f"{_BASE} SELECT {_COLUMNS} FROM ({_start('lights')} UNION ALL {_fixed([(0, 'dw', 2, 1), (2000, 'dw', 2, 0), (2000, 'dw', 4, 1), (2800, 'dw', 4, 0), (2800, 'dw', 5, 1), (4800, 'dw', 5, 0)], 4800)})",
    "sweep": f"{_BASE} SELECT {_COLUMNS} FROM ({_start('sweep')} UNION ALL SELECT device, tick, k, n * 720 + k * 20, 'servo', 13, 500000 + 100000 * CASE WHEN k < 18 THEN k + 1 ELSE 35 - k END, NULL FROM e, (SELECT unnest(range(36)) AS k))",
    "melody": f"{_BASE} SELECT {_COLUMNS} FROM (SELECT device, CAST(-1 AS BIGINT) AS tick, seq, t, kind, 15 AS pin, num, NULL AS str FROM p, (VALUES (0, 0, 'tone', 262), (1, 300, 'pwm', 0), (2, 300, 'tone', 294), (3, 600, 'pwm', 0), (4, 600, 'tone', 330), (5, 900, 'pwm', 0), (6, 900, 'tone', 392), (7, 1500, 'pwm', 0)) a(seq, t, kind, num))",
    "alarm": f"""{_BASE}, c AS (SELECT *, CASE WHEN (tick % 7) * 6000 > 30000 OR CAST(trunc(value * 20) AS BIGINT) > 30000 THEN 999 ELSE CAST(trunc(value * 20) AS BIGINT) // 58 END < 20 AS near FROM e)
, h AS (SELECT *, sum(CASE WHEN near THEN 150 ELSE 0 END) OVER w AS upto, max(CASE WHEN near THEN 1 ELSE 0 END) OVER w AS handle FROM c WINDOW w AS (PARTITION BY device ORDER BY tick ROWS UNBOUNDED PRECEDING))
SELECT {_COLUMNS} FROM (SELECT device, tick, 0 AS seq, upto - 150 AS t, 'tone' AS kind, 15 AS pin, 900 AS num, NULL AS str FROM h WHERE near
UNION ALL SELECT device, tick, 1, upto, 'pwm', 15, 0, NULL FROM h WHERE near UNION ALL SELECT device, tick, 0, upto, 'pwm', 15, 0, NULL FROM h WHERE NOT near AND handle = 1)""",
    "dimmer": f"{_BASE} SELECT {_COLUMNS} FROM (SELECT device, tick, 0 AS seq, 0 AS t, 'pwm' AS kind, 2 AS pin, greatest(0, least(100, CAST(trunc(CAST(greatest(0, least(65535, CAST(trunc(value * 200) AS BIGINT))) // 64 AS DOUBLE) / 10.23::DOUBLE) AS BIGINT))) * 655 AS num, NULL AS str FROM e)",
}
#: Counts presses, speaks at every third, and ends at the tenth.
COUNTER = workspace(
    [block("variables_set", {"VAR": "n"}, {"VALUE": num(0)})],
    [
        block("eb_wait_until", None, {"COND": compare("EQ", block("eb_dread", {"PIN": "4"}), num(1))}),
        change("n", 1),
        if_else(compare("EQ", block("math_modulo", None, {"DIVIDEND": var("n"), "DIVISOR": num(3)}), num(0)), [say(block("text_join", None, {"ADD0": text("n="), "ADD1": var("n")}))]),
        block("controls_if", None, {"IF0": compare("GTE", var("n"), num(10)), "DO0": block("controls_flow_statements", {"FLOW": "BREAK"})}),
    ],
)
_PROGRAM_SQL["counter"] = f"""WITH e AS (SELECT user_id AS device, event_id AS tick, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE CAST(trunc(value) AS BIGINT) % 2 = 1)
, s AS (SELECT device, tick, 0 AS seq, n // 3 AS k, n AS c FROM e WHERE n % 3 = 0 AND n <= 10)
SELECT device, tick, CAST(0 AS INTEGER) AS seq, CAST(0 AS BIGINT) AS t_ms, 'print' AS kind, CAST(NULL AS INTEGER) AS pin, CAST(NULL AS DOUBLE) AS num_val, 'n=' || CAST(c AS VARCHAR) AS str_val FROM s"""

for _name, _program in {**EXAMPLES, "counter": COUNTER}.items():

    def _run(e: DataFrame, program: dict = _program) -> DataFrame:
        return run_program(readings(e), program)

    _run.__name__ = f"program_{_name}"
    query(_PROGRAM_SQL[_name])(_run)


FLAGSHIP = "change_variable"
