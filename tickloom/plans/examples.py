"""The example programs, as saved workspaces."""

from __future__ import annotations


def block(kind: str, fields: dict | None = None, inputs: dict | None = None, **more) -> dict:
    out = {"type": kind, **more}
    if fields:
        out["fields"] = fields
    if inputs:
        out["inputs"] = {k: {"block": v} for k, v in inputs.items() if v is not None}
    return out


def num(v: float) -> dict:
    return block("math_number", {"NUM": v})


def text(v: str) -> dict:
    return block("text", {"TEXT": v})


def var(name: str) -> dict:
    return block("variables_get", {"VAR": name})


def seq(*blocks: dict) -> dict | None:
    """Blocks joined by ``next``."""
    out = None
    for b in reversed(blocks):
        out = {**b, "next": {"block": out}} if out else dict(b)
    return out


def workspace(start: list[dict] | None = None, loop: list[dict] | None = None) -> dict:
    hats = []
    for kind, body, y in (("eb_on_start", start, 20), ("eb_loop", loop, 200)):
        if body is not None:
            hats.append({**block(kind, x=40, y=y), **({"next": {"block": seq(*body)}} if body else {})})
    return {"blocks": {"languageVersion": 0, "blocks": hats}}


def dwrite(pin: int, v: int) -> dict:
    return block("eb_dwrite", {"PIN": str(pin), "VAL": str(v)})


def sleep(ms: float, unit: str = "ms") -> dict:
    return block("eb_sleep", {"UNIT": unit}, {"MS": num(ms)})


def say(value: dict) -> dict:
    return block("eb_print", None, {"VAL": value})


def tone(pin: int, freq: float, ms: float) -> dict:
    return block("eb_tone", {"PIN": str(pin)}, {"FREQ": num(freq), "DUR": num(ms)})


def compare(op: str, a: dict, b: dict) -> dict:
    return block("logic_compare", {"OP": op}, {"A": a, "B": b})


def if_else(cond: dict, then: list[dict], other: list[dict] | None = None) -> dict:
    return block("controls_if", None, {"IF0": cond, "DO0": seq(*then), "ELSE": seq(*(other or []))})


def change(name: str, by: float) -> dict:
    return block("math_change", {"VAR": name}, {"DELTA": num(by)})


def repeat(times: int, *body: dict) -> dict:
    return block("controls_repeat_ext", None, {"TIMES": num(times), "DO": seq(*body)})


def _sweep(by: int) -> dict:
    return repeat(18, change("angle", by), block("eb_swrite", {"PIN": "13"}, {"ANGLE": var("angle")}), sleep(20))


# The pins, tones and delays of the example programs.
EXAMPLES = {
    "blink": workspace([say(text("hello"))], [dwrite(2, 1), sleep(500), dwrite(2, 0), sleep(500)]),
    "button": workspace(
        [block("eb_pin_mode", {"PIN": "4", "MODE": "pullup"}), say(text("press"))],
        [if_else(compare("EQ", block("eb_dread", {"PIN": "4"}), num(0)), [dwrite(2, 1)], [dwrite(2, 0)])],
    ),
    "traffic": workspace(
        [say(text("lights"))],
        [dwrite(2, 1), sleep(2000), dwrite(2, 0), dwrite(4, 1), sleep(800), dwrite(4, 0), dwrite(5, 1), sleep(2000), dwrite(5, 0)],
    ),
    "sweep": workspace([block("variables_set", {"VAR": "angle"}, {"VALUE": num(0)}), say(text("sweep"))], [_sweep(10), _sweep(-10)]),
    "melody": workspace([tone(15, 262, 300), tone(15, 294, 300), tone(15, 330, 300), tone(15, 392, 600)]),
    "alarm": workspace(
        None,
        [if_else(compare("LT", block("eb_distance", {"TRIG": "12", "ECHO": "14"}), num(20)), [tone(15, 900, 150)], [block("eb_notone", {"PIN": "15"})])],
    ),
    "dimmer": workspace(
        None,
        [block("eb_awrite", {"PIN": "2"}, {"DUTY": block("math_arithmetic", {"OP": "DIVIDE"}, {"A": block("eb_aread", {"PIN": "32"}), "B": num(10.23)})})],
    ),
}
