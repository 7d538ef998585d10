"""Whole programs: action logs, waits, loops and warnings."""

import pytest

from tickloom.plans.examples import EXAMPLES, block, change, compare, dwrite, if_else, num, repeat, say, seq, sleep, text, tone, var, workspace
from tickloom.plans.program import compile_program, diagnostics, fold, numbered, read_program, run_program

READINGS = "device long, tick long, reads map<int,long>, waits map<int,long>"


@pytest.fixture(scope="module")
def three(spark):
    """Pin 4 reads 0, the analog value is 600, and there is no echo."""
    return spark.createDataFrame([(1, t, {4: 0, 34: 600}, {}) for t in range(3)], READINGS)


def log(df):
    rows = sorted(df.collect(), key=lambda r: (r.device, r.tick, r.seq))
    return [(r.kind, r.pin, r.str_val if r.kind == "print" else r.num_val) for r in rows]


def test_blink(three):
    got = log(run_program(three, EXAMPLES["blink"]))
    assert got == [("print", None, "hello")] + [("dw", 2, 1.0), ("dw", 2, 0.0)] * 3


def test_button(three):
    assert log(run_program(three, EXAMPLES["button"])) == [("print", None, "press")] + [("dw", 2, 1.0)] * 3


def test_variables_in_loops(three):
    analog = block("eb_aread", {"PIN": "34"})
    angle = block("math_arithmetic", {"OP": "ADD"}, {"A": var("a"), "B": num(2)})
    step = block("math_change", {"VAR": "a"}, {"DELTA": block("math_arithmetic", {"OP": "MULTIPLY"}, {"A": analog, "B": num(4)})})
    program = workspace(
        [block("variables_set", {"VAR": "a"}, {"VALUE": num(50)}), tone(15, 880, 0)],
        [step, repeat(3, block("eb_swrite", {"PIN": "13"}, {"ANGLE": angle})), say(block("text_join", None, {"ADD0": text("d="), "ADD1": block("eb_distance", {"TRIG": "12", "ECHO": "14"})}))],
    )
    got = log(run_program(three, program))
    assert got[0] == ("tone", 15, 880.0)
    assert [x for x in got if x[0] == "servo"] == [("servo", 13, ns) for a in (88, 124, 160) for ns in [500_000.0 + a * 10_000] * 3]
    assert [x[2] for x in got if x[0] == "print"] == ["d=999"] * 3


def test_floored_modulo(three):
    mod = block("math_modulo", None, {"DIVIDEND": num(-7), "DIVISOR": num(3)})
    assert log(run_program(three, workspace(None, [if_else(compare("EQ", mod, num(2)), [dwrite(2, 0)], [dwrite(2, 1)])]))) == [("dw", 2, 0.0)] * 3


def test_clock_and_handles(spark):
    rows = spark.createDataFrame([(1, t, {14: 580 if t in (1, 3) else 5800}, {14: 1}) for t in range(5)], READINGS)
    got = sorted((r.tick, r.seq, r.t_ms, r.kind, r.num_val) for r in run_program(rows, EXAMPLES["alarm"]).collect())
    assert got == [(1, 0, 0, "tone", 900.0), (1, 1, 150, "pwm", 0.0), (2, 0, 150, "pwm", 0.0), (3, 0, 150, "tone", 900.0), (3, 1, 300, "pwm", 0.0), (4, 0, 300, "pwm", 0.0)]


def test_time_of_loops(spark):
    """A loop that takes no time needs no shuffle; a pause inside the start is counted."""
    rows = spark.createDataFrame([(d, t, {4: t % 2}, {}) for d in (1, 2) for t in range(4)], READINGS)
    pressed = compare("EQ", block("eb_dread", {"PIN": "4"}), num(0))
    loop = [if_else(pressed, [dwrite(2, 0)], [dwrite(2, 1)])]
    out = run_program(rows, workspace(None, loop))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.t_ms for r in out.collect()] == [0] * 8
    fields = ["device", "tick", "seq", "t_ms", "kind", "pin", "num_val", "str_val"]
    for start in ([if_else(pressed, [sleep(5)], [sleep(9)])], [if_else(pressed, [], [dwrite(2, 1)])], [sleep(7)], [dwrite(3, 1)]):
        program = workspace(start, [*loop, if_else(pressed, [sleep(3)], [dwrite(4, 1)])])
        expected = numbered(fold(rows, compile_program(read_program(program)))).select(*fields)
        assert sorted(map(str, run_program(rows, program).select("device", "t_ms", "kind", "pin", "num_val").collect())) == sorted(map(str, expected.select("device", "t_ms", "kind", "pin", "num_val").collect()))


def test_fields_that_are_no_numbers(three):
    odd = workspace(None, [block("eb_dwrite", {"PIN": "2", "VAL": "high"}), dwrite("inf", 1), dwrite("nan", 0)])
    assert [w[0] for w in compile_program(read_program(odd)).warnings] == ["dropped_statement", "bad_pin", "bad_pin"]
    assert log(run_program(three, odd)) == [("dw", 2, 1.0), ("dw", 2, 0.0)] * 3


def test_while_break_continue(three):
    flow = lambda k: block("controls_flow_statements", {"FLOW": k})
    body = seq(
        change("i", 1),
        if_else(compare("EQ", var("i"), num(2)), [flow("CONTINUE")]),
        if_else(compare("GT", var("i"), num(4)), [flow("BREAK")]),
        say(var("i")),
    )
    loop = block("controls_whileUntil", {"MODE": "WHILE"}, {"BOOL": block("logic_boolean", {"BOOL": "TRUE"}), "DO": body})
    program = workspace([block("variables_set", {"VAR": "i"}, {"VALUE": num(0)}), loop], [say(text("end")), flow("BREAK"), say(text("never"))])
    assert [x[2] for x in log(run_program(three, program))] == ["1", "3", "4", "end"]


def test_until_and_empty_body(three):
    loop = block("controls_whileUntil", {"MODE": "UNTIL"}, {"BOOL": compare("GTE", var("i"), num(3)), "DO": seq(change("i", 1))})
    empty = block("controls_repeat_ext", None, {"TIMES": num(2)})
    program = workspace([block("variables_set", {"VAR": "i"}, {"VALUE": num(0)}), loop, empty, repeat(0, dwrite(2, 1)), repeat(-3, dwrite(2, 1)), say(var("i"))])
    (row,) = run_program(three, program).collect()
    assert (row.str_val, row.t_ms) == ("3", 200)


def test_wait_until(spark):
    rows = spark.createDataFrame([(d, t, {4: int(t >= d)}, {}) for d in (0, 2, 9) for t in range(4)], READINGS)
    wait = block("eb_wait_until", None, {"COND": compare("EQ", block("eb_dread", {"PIN": "4"}), num(1))})
    got = run_program(rows, workspace([sleep(2, "s"), wait, say(text("go"))], [dwrite(2, 1)])).collect()
    assert sorted((r.device, r.tick) for r in got if r.kind == "dw") == [(0, 0), (0, 1), (0, 2), (0, 3), (2, 2), (2, 3)]
    assert {(r.device, r.t_ms) for r in got if r.kind == "print"} == {(0, 2000), (2, 2000)}


def test_start_only(spark):
    """A program without loop and wait takes the first reading only, and gathers none."""
    rows = spark.createDataFrame([(d, t, {4: 10 * d + t}, {}) for d in (1, 2) for t in (3, 1, 2)], READINGS)
    program = workspace([block("variables_set", {"VAR": "a"}, {"VALUE": block("eb_dread", {"PIN": "4"})}), sleep(5), say(var("a")), tone(15, 262, 300)])
    out = run_program(rows, program)
    fields = ["device", "tick", "seq", "t_ms", "kind", "pin", "num_val", "str_val"]
    assert out.columns == fields
    expected = numbered(fold(rows, compile_program(read_program(program)))).select(*fields)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    assert out.count() == 6
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_warnings(spark, three):
    start, loop = block("eb_on_start", x=0, y=0), block("eb_loop", x=0, y=5)
    space = {"blocks": {"blocks": [start, {**start, "y": 3}, {**loop, "y": 9, "next": {"block": dwrite(3, 1)}}, {**loop, "next": {"block": dwrite(2, 1)}}, dwrite(5, 1)]}}
    program = read_program(space)
    assert [w[0] for w in program.warnings] == ["second_start", "stray_block", "joined_loops"]
    assert [b["fields"]["PIN"] for b in program.loop] == ["2", "3"]
    assert [w[0] for w in read_program({"blocks": {"blocks": []}}).warnings] == ["no_hat"]
    odd = workspace(None, [block("eb_unknown"), dwrite(77, 1), block("eb_sleep", {"UNIT": "ms"}), say(block("math_single", {"OP": "ROOT"}, {"NUM": num(4)})), block("eb_print")])
    assert [w[0] for w in compile_program(read_program(odd)).warnings] == ["dropped_statement", "bad_pin", "missing_value", "dropped_statement"]
    assert log(run_program(three, odd)) == [("dw", 2, 1.0), ("print", None, "0")] * 3
    assert diagnostics(three, odd, "p").count() == 4


def test_examples_compile():
    assert len(EXAMPLES) == 7
    assert all(not compile_program(read_program(w)).warnings for w in EXAMPLES.values())


def test_steady_loops(spark):
    """A loop that changes variables by the same in every tick gathers no device's ticks."""
    rows = spark.createDataFrame([(d, 3 * t, {4: (t + d) % 2}, {}) for d in (1, 2) for t in range(30)], READINGS)
    pressed, flow = compare("EQ", block("eb_dread", {"PIN": "4"}), num(0)), block("controls_flow_statements", {"FLOW": "BREAK"})
    zero = [block("variables_set", {"VAR": "a"}, {"VALUE": num(7)}), say(text("go"))]
    up = [repeat(3, change("a", 2), say(var("a"))), if_else(compare("GT", var("a"), num(40)), [dwrite(2, 1)], [dwrite(2, 0)]), change("a", -1), sleep(20)]
    fields = ["device", "tick", "seq", "t_ms", "kind", "pin", "num_val", "str_val"]
    flat = [repeat(3, change("a", 2), say(var("a")), tone(15, 262, 30)), change("a", -1), sleep(20), repeat(0, change("a", 1)), block("eb_unknown"), dwrite(2, 1)]
    steady, other = [workspace(zero, up), workspace(zero, flat)], [[change("a", 1), if_else(compare("GT", var("a"), num(20)), [flow]), say(var("a"))]]
    sensed = workspace([block("variables_set", {"VAR": "a"}, {"VALUE": block("eb_dread", {"PIN": "4"})})], up)
    for program, gathers in [(p, False) for p in steady] + [(workspace(zero, p), True) for p in other] + [(sensed, True)]:
        out = run_program(rows, program)
        assert ("collect_list" in out._jdf.queryExecution().toString()) == gathers
        expected = numbered(fold(rows, compile_program(read_program(program)))).select(*fields)
        assert sorted(map(repr, out.collect())) == sorted(map(repr, expected.collect()))


def test_fold_of_many_ticks(spark):
    """Ticks of a device fall into several blocks."""
    from tickloom.plans.program import BLOCK

    rows = spark.createDataFrame([(d, t, {4: t % 2}, {}) for d, n in ((1, 2 * BLOCK + 1), (2, 1), (3, BLOCK)) for t in range(n)], READINGS)
    loop = [change("a", 1), if_else(compare("EQ", block("eb_dread", {"PIN": "4"}), num(0)), [say(var("a"))])]
    folded = fold(rows, compile_program(read_program(workspace([block("variables_set", {"VAR": "a"}, {"VALUE": num(0)})], loop))))
    assert {r.device: (len(r.done), [a.str_val for t in r.done for a in t]) for r in folded.collect()} == {d: (n, [str(i + 1) for i in range(0, n, 2)]) for d, n in ((1, 2 * BLOCK + 1), (2, 1), (3, BLOCK))}
