"""Block programs as Spark plans.

A saved workspace is read on the driver, and every statement becomes a function
from one state column to the next: variables, a virtual clock, the pins that have a
handle, and the actions so far. A program whose loop keeps nothing from one tick to
the next, or changes variables by the same in every tick, runs row by row, and a scan
supplies its clock and how many ticks came before. A program that ends at the
first tick runs on each device's first reading. Any other program is folded over each
device's ticks in order. All are built-in expressions only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import board
from ..functions.pysem import BINARY, SPARK_TYPE, KindError, Value, number, py_abs, py_compare, py_join, py_not, py_pow, py_str, py_truthy
from ..operators.ticks import clock

#: Ticks of a device that are folded into one list before the list joins the others.
BLOCK = 256
#: Most actions of a tick that are listed before the readings are known.
STEPS = 1000
#: Most rounds of a while loop in one tick; one that goes on is ended there.
FUEL = 1000
RUN, CONTINUE, BREAK, WAITING, ENDED = range(5)
ACTION = "array<struct<tick:bigint,t_ms:bigint,kind:string,pin:int,num_val:double,str_val:string>>"
ARITHMETIC = {"ADD": "+", "MINUS": "-", "MULTIPLY": "*", "DIVIDE": "/", "POWER": "**"}
COMPARISON = {"EQ": "==", "NEQ": "!=", "LT": "<", "LTE": "<=", "GT": ">", "GTE": ">="}
State = Callable[[Column], Column]


class Unsupported(ValueError):
    """A block that no statement or expression is known for."""


@dataclass
class Program:
    setup: list[dict]
    loop: list[dict]
    has_loop: bool
    warnings: list[tuple[str, str]] = field(default_factory=list)


def chain(block: dict | None) -> list[dict]:
    out = []
    while block:
        out.append(block)
        block = (block.get("next") or {}).get("block")
    return out


def read_program(workspace: str | dict) -> Program:
    """Hats in order of y, then x: the first start hat counts, loops are joined."""
    data = json.loads(workspace) if isinstance(workspace, str) else workspace
    tops = sorted(data.get("blocks", {}).get("blocks", []), key=lambda b: (b.get("y", 0), b.get("x", 0)))
    starts = [b for b in tops if b["type"] == "eb_on_start"]
    loops = [b for b in tops if b["type"] == "eb_loop"]
    warnings = [("second_start", "only the first start is used")] * max(0, len(starts) - 1)
    warnings += [("stray_block", b["type"]) for b in tops if b not in starts and b not in loops]
    if len(loops) > 1:
        warnings.append(("joined_loops", "loops run one after the other"))
    if not starts and not loops:
        warnings.append(("no_hat", "nothing to run"))
    setup = chain(starts[0])[1:] if starts else []
    return Program(setup, [b for hat in loops for b in chain(hat)[1:]], bool(loops), warnings)


def let(value: Column, use: State) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Compiler:
    """Statements and expressions of one program. ``reading`` is a struct ``tick,
    reads, waits`` (maps by pin)."""

    def __init__(self, program: Program, seed: int = 0):
        self.program, self.seed = program, seed
        self.kinds: dict[str, str] = {}
        self.warnings: list[tuple[str, str]] = []
        self.keeps_state = self.takes_time = False

    def warn(self, code: str, message: str) -> None:
        self.warnings.append((code, message))

    # Fields and inputs

    def pin(self, block: dict, name: str = "PIN") -> int:
        raw = block.get("fields", {}).get(name)
        try:
            n = float(raw)
        except (TypeError, ValueError):
            n = -1.0
        if not 0 <= n <= 39 or n != int(n):
            self.warn("bad_pin", str(raw))
            return board.DEFAULT_PIN
        return int(n)

    def input(self, block: dict, name: str) -> dict | None:
        slot = block.get("inputs", {}).get(name) or {}
        return slot.get("block") or slot.get("shadow")

    def number_in(self, block: dict, name: str, default: int, s: Column, r: Column) -> Value:
        if (sub := self.input(block, name)) is None:
            self.warn("missing_value", name)
            return number(default)
        return self.expr(sub, s, r)

    def truth_in(self, block: dict, name: str, s: Column, r: Column) -> Column:
        sub = self.input(block, name)
        return py_truthy(self.expr(sub, s, r)) if sub else F.lit(False)

    def any_in(self, block: dict, name: str, s: Column, r: Column) -> Value:
        sub = self.input(block, name)
        return self.expr(sub, s, r) if sub else number(0)

    @staticmethod
    def variable(block: dict) -> str:
        v = block.get("fields", {}).get("VAR")
        return str(v.get("id") or v.get("name")) if isinstance(v, dict) else str(v)

    @staticmethod
    def literal(block: dict | None) -> int | float | None:
        if not block or block["type"] not in ("math_number", "eb_num"):
            return None
        try:
            v = float(block.get("fields", {}).get("NUM", 0))
        except (TypeError, ValueError):
            return 0
        return 0 if v != v or v in (float("inf"), float("-inf")) else int(v) if v == int(v) else v

    # Expressions

    def expr(self, block: dict, s: Column, r: Column) -> Value:
        kind, fields = block["type"], block.get("fields", {})
        two = lambda a, b: (self.number_in(block, a, 0, s, r), self.number_in(block, b, 0, s, r))
        if kind in ("math_number", "eb_num"):
            return number(self.literal(block))
        if kind == "text":
            return Value(F.lit(str(fields.get("TEXT", ""))), "str")
        if kind == "logic_boolean":
            return Value(F.lit(fields.get("BOOL") == "TRUE"), "bool")
        if kind == "variables_get":
            self.keeps_state = True
            name = self.variable(block)
            return Value(s[f"v_{name}"], self.kinds.setdefault(name, "int"))
        if kind == "eb_dread":
            return Value(board.digital(F.coalesce(F.try_element_at(r["reads"], F.lit(self.pin(block))), F.lit(0))), "int")
        if kind == "eb_aread":
            return Value(board.analog(F.coalesce(F.try_element_at(r["reads"], F.lit(self.pin(block))), F.lit(0))), "int")
        if kind == "eb_distance":
            self.pin(block, "TRIG")
            echo = F.lit(self.pin(block, "ECHO"))
            wait = F.coalesce(F.try_element_at(r["waits"], echo), F.lit(board.ECHO_LIMIT_US + 1))
            return Value(board.distance_cm(wait, F.coalesce(F.try_element_at(r["reads"], echo), F.lit(0))), "int")
        if kind == "math_arithmetic":
            op = ARITHMETIC.get(fields.get("OP"), "+")
            a, b = two("A", "B")
            if op == "**":
                power = self.literal(self.input(block, "B"))
                return py_pow(a, b, power if isinstance(power, int) else None)
            return BINARY[op](a, b)
        if kind == "math_modulo":
            return BINARY["%"](*two("DIVIDEND", "DIVISOR"))
        if kind == "math_single" and fields.get("OP") == "ABS":
            return py_abs(self.number_in(block, "NUM", 0, s, r))
        if kind == "math_random_int":
            a, b = two("FROM", "TO")
            return Value(board.random_int(a.cast("int"), b.cast("int"), self.seed), "int")
        if kind == "logic_compare":
            return py_compare(COMPARISON.get(fields.get("OP"), "=="), *two("A", "B"))
        if kind == "logic_operation":
            return BINARY["or" if fields.get("OP") == "OR" else "and"](*two("A", "B"))
        if kind == "logic_negate":
            return py_not(Value(self.truth_in(block, "BOOL", s, r), "bool"))
        if kind == "text_join":
            items = []
            while f"ADD{len(items)}" in block.get("inputs", {}):
                sub = self.input(block, f"ADD{len(items)}")
                items.append(self.expr(sub, s, r) if sub else Value(F.lit(""), "str"))
            return py_join(items)
        raise Unsupported(kind)

    # Statements

    def emit(self, s: Column, r: Column, kind: str, pin: int | None, num: Column | None = None, text: Column | None = None) -> Column:
        row = F.struct(
            F.when(s["pc"] < len(self.program.setup), F.lit(-1).cast("bigint")).otherwise(r["tick"]).alias("tick"),
            s["t_ms"].alias("t_ms"),
            F.lit(kind).alias("kind"),
            F.lit(pin).cast("int").alias("pin"),
            (F.lit(None) if num is None else num).cast("double").alias("num_val"),
            (F.lit(None) if text is None else text).cast("string").alias("str_val"),
        )
        return s.withField("actions", F.concat(s["actions"], F.array(row)))

    def body(self, blocks: list[dict], s: Column, r: Column) -> Column:
        """Nested statements, each only while nothing has stopped the run."""
        for b in blocks:
            try:
                s = let(s, self.running(self.statement(b, r)))
            except (Unsupported, KindError) as e:
                self.warn("dropped_statement", f"{b['type']}: {e}")
        if blocks:
            return s
        self.takes_time = True
        return s.withField("t_ms", s["t_ms"] + 100)

    @staticmethod
    def running(f: State) -> State:
        return lambda s: F.when(s["flow"] == RUN, f(s)).otherwise(s)

    @staticmethod
    def placed(f: State, i: int) -> State:
        """``f`` as the program's i-th statement."""
        return lambda s: F.when((s["flow"] == RUN) & (s["pc"] <= i), let(s.withField("pc", F.lit(i)), f)).otherwise(s)

    def statement(self, block: dict, r: Column) -> State:
        kind, fields = block["type"], block.get("fields", {})
        if kind == "eb_sleep":
            unit = 1000 if fields.get("UNIT") == "s" else 1
            self.takes_time = True

            def f(s: Column) -> Column:
                ms = self.number_in(block, "MS", 1000, s, r)
                return s.withField("t_ms", s["t_ms"] + (ms.cast("int") if unit == 1 else (ms.cast("float") * 1000).cast("bigint")))

        elif kind == "eb_pin_mode":
            self.pin(block)
            return lambda s: s
        elif kind == "eb_dwrite":
            pin = self.pin(block)
            try:
                v = float(fields.get("VAL", 0))
            except (TypeError, ValueError):
                raise Unsupported("VAL") from None
            return lambda s: self.emit(s, r, "dw", pin, F.lit(v))
        elif kind in ("eb_awrite", "eb_swrite"):
            pin = self.pin(block)
            name, default, form, said = ("DUTY", 50, board.pwm_duty, "pwm") if kind == "eb_awrite" else ("ANGLE", 90, board.servo_ns, "servo")

            def f(s: Column) -> Column:
                out = self.emit(s, r, said, pin, form(self.number_in(block, name, default, s, r).cast("float")))
                return self.handle(out, s, pin) if said == "pwm" else out

        elif kind == "eb_tone":
            pin, length = self.pin(block), self.literal(self.input(block, "DUR"))
            self.takes_time |= bool(length and length > 0)

            def f(s: Column) -> Column:
                out = self.handle(self.emit(s, r, "tone", pin, board.tone_hz(self.number_in(block, "FREQ", 440, s, r).cast("float"))), s, pin)
                if not length or length <= 0:
                    return out
                return let(out.withField("t_ms", s["t_ms"] + int(length)), lambda x: self.emit(x, r, "pwm", pin, F.lit(0)))

        elif kind == "eb_notone":
            pin = self.pin(block)
            self.keeps_state = True
            return lambda s: F.when(F.array_contains(s["handles"], pin), self.emit(s, r, "pwm", pin, F.lit(0))).otherwise(s)
        elif kind == "eb_print":
            f = lambda s: self.emit(s, r, "print", None, text=py_str(self.any_in(block, "VAL", s, r)).col)
        elif kind == "controls_if":

            def f(s: Column) -> Column:
                out, k, last = None, 0, self.input(block, "ELSE")
                while f"IF{k}" in block.get("inputs", {}) or f"DO{k}" in block.get("inputs", {}):
                    cond, then = self.truth_in(block, f"IF{k}", s, r), self.body(chain(self.input(block, f"DO{k}")), s, r)
                    out = F.when(cond, then) if out is None else out.when(cond, then)
                    k += 1
                other = self.body(chain(last), s, r) if last else s
                return other if out is None else out.otherwise(other)

        elif kind == "controls_repeat_ext":

            def f(s: Column) -> Column:
                n = self.number_in(block, "TIMES", 10, s, r).cast("int")
                rounds = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))
                return self.after_loop(F.aggregate(rounds, s, lambda x, _: self.round(block, x, r)))

        elif kind == "controls_whileUntil":
            until = fields.get("MODE") == "UNTIL"

            def f(s: Column) -> Column:
                def step(x: Column, _: Column) -> Column:
                    c = self.truth_in(block, "BOOL", x, r)
                    go = ~c if until else c
                    return F.when((x["flow"] == RUN) & ~go, x.withField("flow", F.lit(BREAK))).otherwise(self.round(block, x, r))

                out = F.aggregate(F.sequence(F.lit(0), F.lit(FUEL)), s, step)
                return let(out, lambda x: x.withField("flow", F.when(x["flow"] == BREAK, RUN).when(x["flow"] == RUN, ENDED).otherwise(x["flow"])))

        elif kind == "controls_flow_statements":
            self.keeps_state = True
            to = CONTINUE if fields.get("FLOW") == "CONTINUE" else BREAK
            return lambda s: s.withField("flow", F.lit(to))
        elif kind == "variables_set":
            name = self.variable(block)
            self.keeps_state = True

            def f(s: Column) -> Column:
                return self.assign(s, name, self.any_in(block, "VALUE", s, r))

        elif kind == "math_change":
            name = self.variable(block)
            self.keeps_state = True

            def f(s: Column) -> Column:
                now = Value(s[f"v_{name}"], self.kinds.setdefault(name, "int"))
                return self.assign(s, name, BINARY["+"](now, self.number_in(block, "DELTA", 1, s, r)))

        else:
            raise Unsupported(kind)
        return f

    def handle(self, out: Column, s: Column, pin: int) -> Column:
        return out.withField("handles", F.array_union(s["handles"], F.array(F.lit(pin))))

    def round(self, block: dict, s: Column, r: Column) -> Column:
        """One round of a nested loop; ``continue`` ends with it."""
        done = F.when(s["flow"] == RUN, self.body(chain(self.input(block, "DO")), s, r)).otherwise(s)
        return let(done, lambda x: x.withField("flow", F.when(x["flow"] == CONTINUE, RUN).otherwise(x["flow"])))

    @staticmethod
    def after_loop(s: Column) -> Column:
        return let(s, lambda x: x.withField("flow", F.when(x["flow"] == BREAK, RUN).otherwise(x["flow"])))

    def assign(self, s: Column, name: str, v: Value) -> Column:
        old = self.kinds.get(name, v.kind)
        kind = old if old == v.kind else "str" if "str" in (old, v.kind) else "float" if "float" in (old, v.kind) else "int"
        self.kinds[name] = kind
        return s.withField(f"v_{name}", v.cast(kind))

    # Whole programs

    def initial(self) -> Column:
        own = [F.lit(None).cast(SPARK_TYPE[k]).alias(f"v_{n}") for n, k in sorted(self.kinds.items())]
        flags = [F.lit(0).cast("bigint").alias("t_ms"), F.lit(RUN).alias("flow"), F.lit(0).alias("pc"), F.array().cast("array<int>").alias("handles"), F.array().cast(ACTION).alias("actions")]
        return F.struct(*own, *flags)

    def tick(self, s: Column, r: Column) -> Column:
        """One reading: what is left of the start, then the loop. A wait that fails
        holds the program at its place until the next reading."""
        m = len(self.program.setup)
        s = let(s, lambda x: x.withField("flow", F.when(x["flow"] == WAITING, RUN).otherwise(x["flow"])))
        for i, b in enumerate([*self.program.setup, *self.program.loop]):
            try:
                s = let(s, self.placed(self.wait(b, r) if b["type"] == "eb_wait_until" else self.statement(b, r), i))
            except (Unsupported, KindError) as e:
                self.warn("dropped_statement", f"{b['type']}: {e}")
        end = ENDED if not self.program.has_loop else RUN
        return let(s, lambda x: x.withField("pc", F.when(x["flow"] == WAITING, x["pc"]).otherwise(F.lit(m))).withField("flow", F.when(x["flow"] == BREAK, ENDED).when(x["flow"].isin(CONTINUE, RUN), end).otherwise(x["flow"])))

    def steady(self, blocks: list[dict]) -> dict[str, int] | None:
        """By how much statements change each variable, and under ``""`` how many ms they
        take, if that is the same in every tick whatever is read; else none. Variables of
        other kinds than integers, jumps, waits and handles are not followed."""
        out: dict[str, int] = {}
        for b in blocks:
            kind, times, own = b["type"], 1, None
            if kind == "eb_wait_until":
                return None
            try:
                self.statement(b, F.col("reading"))(F.col("state"))
            except (Unsupported, KindError):
                continue  # dropped, as in the program itself
            if kind == "math_change":
                by = self.literal(self.input(b, "DELTA"))
                name = self.variable(b)
                own = {name: by} if isinstance(by, int) and self.kinds.get(name) == "int" else None
            elif kind == "eb_sleep":
                ms = self.literal(self.input(b, "MS"))
                own = None if ms is None else {"": int(ms * 1000) if b.get("fields", {}).get("UNIT") == "s" else int(ms)}
            elif kind == "eb_tone":
                own = {"": max(0, int(self.literal(self.input(b, "DUR")) or 0))}
            elif kind == "controls_repeat_ext":
                n, body = self.literal(self.input(b, "TIMES")), chain(self.input(b, "DO"))
                if n is not None:
                    times, own = max(0, int(n)), self.steady(body) if body else {"": 100}
            elif kind == "controls_if":
                k, arms = 0, [chain(self.input(b, "ELSE"))] if self.input(b, "ELSE") else []
                while f"IF{k}" in b.get("inputs", {}) or f"DO{k}" in b.get("inputs", {}):
                    arms.append(chain(self.input(b, f"DO{k}")))
                    k += 1
                own = {} if not any(not a or self.steady(a) != {} for a in arms) else None
            elif kind in ("eb_pin_mode", "eb_dwrite", "eb_awrite", "eb_swrite", "eb_print"):
                own = {}
            if own is None:
                return None
            for name, by in own.items():
                out[name] = out.get(name, 0) + times * by
        return {name: by for name, by in out.items() if by}

    def listed(self, blocks: list[dict]) -> tuple[list[dict], list[tuple[dict, str]]] | None:
        """The actions of a tick of a loop without branches, known before the readings are:
        ``steps`` (when, of which statement, and by how much each variable has changed in the
        tick until then), and the statements with the kinds of their actions. None if there are
        branches or over ``STEPS``."""
        steps: list[dict] = []
        said: list[tuple[dict, str]] = []
        number: dict[tuple[int, str], int] = {}
        dropped: dict[int, bool] = {}
        at, off = 0, {n: 0 for n in self.kinds}

        def say(b: dict, kind: str, pin: int | None) -> None:
            if (id(b), kind) not in number:
                number[id(b), kind] = len(said)
                said.append((b, kind))
            steps.append({"at": at, "of": number[id(b), kind], "kind": kind, "pin": pin, **{f"o_{n}": v for n, v in off.items()}})

        def walk(blocks: list[dict]) -> bool:
            nonlocal at
            for b in blocks:
                kind = b["type"]
                if id(b) not in dropped:
                    try:
                        self.statement(b, F.col("reading"))(F.col("state"))
                        dropped[id(b)] = False
                    except (Unsupported, KindError):
                        dropped[id(b)] = True
                if dropped[id(b)] or kind == "eb_pin_mode":
                    continue
                if kind == "controls_if" or len(steps) > STEPS:
                    return False
                if kind == "math_change":
                    off[self.variable(b)] += self.literal(self.input(b, "DELTA"))
                elif kind == "controls_repeat_ext":
                    body, n = chain(self.input(b, "DO")), max(0, int(self.literal(self.input(b, "TIMES"))))
                    if not body:
                        at += 100 * n
                    elif n > STEPS or not all(walk(body) for _ in range(n)):
                        return False
                elif kind == "eb_sleep":
                    at += self.steady([b]).get("", 0)
                elif kind == "eb_print":
                    say(b, "print", None)
                else:
                    say(b, {"eb_dwrite": "dw", "eb_awrite": "pwm", "eb_swrite": "servo", "eb_tone": "tone"}[kind], self.pin(b))
                    if kind == "eb_tone" and (length := self.literal(self.input(b, "DUR"))) and length > 0:
                        at += int(length)
                        say(b, "off", self.pin(b))
            return len(steps) <= STEPS

        return (steps, said) if walk(blocks) else None

    def shown(self, block: dict, kind: str, s: Column, r: Column) -> tuple[Column, Column]:
        """Number and text of an action of ``listed``."""
        none = F.lit(None)
        if kind == "print":
            return none.cast("double"), py_str(self.any_in(block, "VAL", s, r)).col.cast("string")
        if kind in ("dw", "off"):
            return F.lit(0.0 if kind == "off" else float(block.get("fields", {}).get("VAL", 0))), none.cast("string")
        name, default, form = {"pwm": ("DUTY", 50, board.pwm_duty), "servo": ("ANGLE", 90, board.servo_ns), "tone": ("FREQ", 440, board.tone_hz)}[kind]
        return form(self.number_in(block, name, default, s, r).cast("float")).cast("double"), none.cast("string")

    def wait(self, block: dict, r: Column) -> State:
        self.keeps_state = True
        return lambda s: F.when(self.truth_in(block, "COND", s, r), s).otherwise(s.withField("flow", F.lit(WAITING)))


def compile_program(program: Program, seed: int = 0) -> Compiler:
    """A compiler whose variables' kinds are settled."""
    c = Compiler(program, seed)
    for _ in range(4):
        before = dict(c.kinds)
        c.warnings, c.keeps_state, c.takes_time = [], False, False
        c.tick(F.col("state"), F.col("reading"))
        if c.kinds == before:
            break
    return c


def mentions(blocks: list[dict], kinds: tuple[str, ...]) -> bool:
    inner = [v for b in blocks for slot in b.get("inputs", {}).values() for v in (slot.get("block"), slot.get("shadow")) if v]
    return any(b["type"] in kinds for b in blocks) or any(mentions(chain(v), kinds) for v in inner)


def is_fixed(blocks: list[dict]) -> bool:
    """Whether statements read nothing and run to their end, so that they leave the same
    values on every device."""
    return not mentions(blocks, ("eb_dread", "eb_aread", "eb_distance", "math_random_int", "eb_wait_until", "controls_flow_statements", "controls_whileUntil"))


def _by_tick(a: Column, b: Column) -> Column:
    return F.when(a["tick"] < b["tick"], -1).when(a["tick"] > b["tick"], 1).otherwise(0)


def _started(readings: DataFrame, start: Compiler) -> DataFrame:
    """What runs at the start of each device."""
    first = readings.groupBy("device").agg(F.min(F.struct("tick")).alias("f")).select("device", F.struct(F.col("f.tick").alias("tick"), F.create_map().cast("map<int,bigint>").alias("reads"), F.create_map().cast("map<int,bigint>").alias("waits")).alias("r"))
    acts = first.withColumn("state", start.tick(start.initial(), F.col("r"))).select("device", F.posexplode("state.actions").alias("seq", "a"))
    return acts.select("device", "a.tick", "seq", "a.t_ms", "a.kind", "a.pin", "a.num_val", "a.str_val")


def _by_steps(rows: DataFrame, c: Compiler, steady: dict[str, int], after: Column, steps: list[dict], said: list[tuple[dict, str]]) -> DataFrame:
    """A row for each reading and step of ``listed``; ``__tick`` counts the ticks before."""
    left = rows.sparkSession.range(1).select(after.alias("s")).first()["s"].asDict() if c.kinds else {}  # one row
    types = {"at": "bigint", "of": "int", "kind": "string", "pin": "int", **{f"o_{n}": "bigint" for n in c.kinds}}
    listed = [F.struct(F.lit(i).alias("seq"), *[F.lit(x[k]).cast(kind).alias(k) for k, kind in types.items()]) for i, x in enumerate(steps)]
    if not listed:
        listed = [F.lit(None).cast("struct<seq:int," + ",".join(f"`{k}`:{kind}" for k, kind in types.items()) + ">")]
    rows = rows.withColumn("a", F.explode(F.array(*listed))).where("a is not null")
    now = []
    for n, kind in sorted(c.kinds.items()):
        v = F.lit(left.get(f"v_{n}")).cast(SPARK_TYPE[kind])
        now.append((v + F.col("__tick") * steady.get(n, 0) + F.col("a")[f"o_{n}"] if kind == "int" else v).alias(f"v_{n}"))
    s = F.struct(*now, F.lit(RUN).alias("flow"))
    shown = [c.shown(b, kind, s, F.struct("tick", "reads", "waits")) for b, kind in said]
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    for i, (n, x) in enumerate(shown):
        number, text = F.when(F.col("a.of") == i, n).otherwise(number), F.when(F.col("a.of") == i, x).otherwise(text)
    t_ms = F.col("__tick") * steady.get("", 0) + F.col("a.at")
    kind = F.when(F.col("a.kind") == "off", "pwm").otherwise(F.col("a.kind"))
    return rows.select("device", "tick", F.col("a.seq").alias("seq"), t_ms.alias("t_ms"), kind.alias("kind"), F.col("a.pin").alias("pin"), number.alias("num_val"), text.alias("str_val"))


def run_program(readings: DataFrame, workspace: str | dict, span: Column | None = None, seed: int = 0) -> DataFrame:
    """``device, tick, seq, t_ms, kind, pin, num_val, str_val`` of a program over
    ``readings``: ``device, tick bigint, reads map<int,bigint>`` and, for distances,
    ``waits map<int,bigint>``. What runs at the start has tick -1; ``seq`` numbers a
    tick's actions.

    ``span``, which grows with the tick, cuts a device's ticks into ranges for the
    clock of a program that keeps no state; ticks in ten thousands by default.
    """
    program = read_program(workspace)
    c = compile_program(program, seed)
    if "waits" not in readings.columns:
        readings = readings.withColumn("waits", F.create_map().cast("map<int,bigint>"))
    reading = F.struct("tick", "reads", "waits")
    start = compile_program(Program(program.setup, [], False), seed)
    steady = compile_program(program, seed).steady(program.loop) if not c.keeps_state or is_fixed(program.setup) else None
    if program.has_loop and not start.takes_time and (steady is not None or not c.keeps_state):
        begin = lambda s: s.withField("pc", F.lit(len(program.setup)))
        ranges = F.floor(F.col("tick") / 10_000) if span is None else span
        if steady is None:
            rows = readings.withColumn("state", c.tick(let(c.initial(), begin), reading))
            if compile_program(Program([], program.loop, True), seed).takes_time:
                rows = clock(rows.withColumn("__ms", F.col("state.t_ms")), "device", ["tick"], ranges, F.col("__ms"), "__before")
            else:
                rows = rows.withColumn("__before", F.lit(0).cast("bigint"))
        else:
            # Only readings are scanned, not what is made of them.
            rows = clock(readings, "device", ["tick"], ranges, F.lit(1).cast("bigint"), "__tick") if steady else readings.withColumn("__tick", F.lit(0).cast("bigint"))
            none = F.create_map().cast("map<int,bigint>")
            after = start.tick(c.initial(), F.struct(F.lit(-1).cast("bigint").alias("tick"), none.alias("reads"), none.alias("waits"))) if c.keeps_state else c.initial()
            plan = None if mentions(program.loop, ("math_random_int",)) else c.listed(program.loop)
            if plan is not None:
                out = _by_steps(rows, c, steady, after, *plan)
                return out.unionByName(_started(readings, start)) if program.setup else out

            def from_start(s: Column) -> Column:
                s = begin(s).withField("flow", F.lit(RUN)).withField("actions", F.array().cast(ACTION))
                for name, by in steady.items():
                    if name:
                        s = s.withField(f"v_{name}", s[f"v_{name}"] + F.col("__tick") * by)
                return s

            rows = rows.withColumn("state", c.tick(let(after, from_start), reading)).withColumn("__before", F.col("__tick") * steady.get("", 0))
        rows = rows.select("device", "__before", F.posexplode("state.actions").alias("seq", "a"))
        out = rows.select("device", "a.tick", "seq", (F.col("a.t_ms") + F.col("__before")).alias("t_ms"), "a.kind", "a.pin", "a.num_val", "a.str_val")
        if not program.setup:
            return out
        return out.unionByName(_started(readings, start))
    if not program.has_loop and not any(b["type"] == "eb_wait_until" for b in program.setup):
        first = readings.groupBy("device").agg(F.min_by(reading, "tick").alias("r"))
        acts = first.withColumn("state", c.tick(c.initial(), F.col("r"))).select("device", F.posexplode("state.actions").alias("seq", "a"))
        return acts.select("device", "a.tick", "seq", "a.t_ms", "a.kind", "a.pin", "a.num_val", "a.str_val")
    return numbered(fold(readings, c))


def fold(readings: DataFrame, c: Compiler, before: DataFrame | None = None) -> DataFrame:
    """``device, state, done`` after each device's readings in order of tick;
    ``done`` holds the actions of each tick. ``before``: ``device, state`` from which
    devices go on; others start anew."""
    reading = F.struct("tick", "reads", "waits")
    ticks = readings.groupBy("device").agg(F.array_sort(F.collect_list(reading), _by_tick).alias("ticks"))
    begin = c.initial()
    if before is not None:
        ticks = ticks.join(before.withColumnRenamed("state", "before"), "device", "left")
        begin = F.coalesce(F.col("before"), begin)
    keep = lambda done, s: F.struct(s.withField("actions", F.array().cast(ACTION)).alias("state"), F.concat(done, F.array(s["actions"])).alias("done"))
    empty = lambda s, kind: F.struct(s.alias("state"), F.array().cast(kind).alias("done"))
    one = lambda acc, r: let(c.tick(acc["state"], r), lambda s: keep(acc["done"], s))
    # A list is copied when something is put to its end: so ticks go to short lists, and these to the long one.
    block = lambda acc, i: let(F.aggregate(F.slice("ticks", i * BLOCK + 1, BLOCK), empty(acc["state"], f"array<{ACTION}>"), one), lambda x: F.struct(x["state"].alias("state"), F.concat(acc["done"], F.array(x["done"])).alias("done")))
    blocks = F.sequence(F.lit(0), F.floor((F.size("ticks") - 1) / BLOCK).cast("int"))
    out = F.aggregate(blocks, empty(begin, f"array<array<{ACTION}>>"), block)
    return ticks.select("device", out.alias("out")).select("device", "out.state", F.flatten("out.done").alias("done"))


def numbered(folded: DataFrame) -> DataFrame:
    """The actions of ``fold``, numbered in each tick."""
    rows = folded.select("device", F.posexplode(F.flatten("done")).alias("at", "a"))
    seq = F.row_number().over(W.partitionBy("device", "a.tick").orderBy("at")) - 1
    return rows.withColumn("seq", seq).select("device", "a.tick", "seq", "a.t_ms", "a.kind", "a.pin", "a.num_val", "a.str_val")


def diagnostics(readings: DataFrame, workspace: str | dict, program_id: str) -> DataFrame:
    """``program_id, seq, code, message``."""
    program = read_program(workspace)
    found = program.warnings + compile_program(program).warnings
    rows = [(program_id, i, code, text) for i, (code, text) in enumerate(found)]
    return readings.sparkSession.createDataFrame(rows, "program_id string, seq int, code string, message string")
