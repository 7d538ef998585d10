"""Serial text: chunks, markers and frames; project files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 256
CHUNK_PAUSE_MS = 10
FRAME_END = "\x04"


def chunked(df: DataFrame, text: str, size: int = CHUNK_BYTES) -> DataFrame:
    """One row per slice of ``size`` bytes of the UTF-8 text: ``chunk_no, chunk``
    (binary) and ``at_ms``, when a sender that pauses after each would send it."""
    # Encoded once a text: below the rows that are made of it.
    out = df.withColumn("__data", F.encode(F.col(text), "UTF-8"))
    n = F.ceil(F.octet_length("__data") / size)
    out = out.withColumn("chunk_no", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))))
    at = (F.col("chunk_no") * size + 1).cast("int")
    return out.withColumn("chunk", F.substring("__data", at, F.lit(size))).withColumn("at_ms", F.col("chunk_no") * CHUNK_PAUSE_MS).drop("__data")


def before_marker(text: Column, marker: str) -> Column:
    """The text before the first marker; null if there is none (a timeout)."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1))


def after_marker(text: Column, marker: str) -> Column:
    return F.when(F.instr(text, marker) > 0, F.substring(text, F.instr(text, marker) + len(marker), F.length(text)))


def waiters(text: Column, markers: list[str]) -> Column:
    """What each of several waiters gets, served in order from one buffer; a waiter
    whose marker does not come gets null, and the ones after it go on."""
    out, rest = [], text
    for m in markers:
        out.append(before_marker(rest, m))
        rest = F.coalesce(after_marker(rest, m), rest)
    return F.array(*out)


def first_chars(text: Column, n: int) -> Column:
    """Up to ``n`` characters; fewer if no more came in time."""
    return F.substring(text, 1, n)


def exec_frames(text: Column) -> Column:
    """(out, err) of ``OK<out>\\x04<err>\\x04``; nulls where a frame is not whole."""
    body = after_marker(text, "OK")
    rest = after_marker(body, FRAME_END)
    return F.struct(before_marker(body, FRAME_END).alias("out"), before_marker(rest, FRAME_END).alias("err"))


# The words that count as keywords.
KEYWORDS = (
    "from", "import", "def", "while", "for", "in", "if", "elif", "else", "True", "False", "not", "and", "or", "break", "continue", "return", "with", "as",
    "print", "range", "int", "str", "abs", "max", "min", "time", "machine", "Pin", "PWM", "ADC", "random",
)
#: Text in double quotes, comment, keyword, number; at each place the first that fits.
#: Quantifiers of texts are possessive: a text of any length is matched without a stack.
#: Words have ASCII letters only, so letters with accents are beside them, not in them.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
TOKEN = "|".join((r'("[^"\\]*+(?:\\.[^"\\]*+)*+")', r"(#[^\n]*+)", BEFORE + "(" + "|".join(KEYWORDS) + ")" + AFTER, BEFORE + r"(\d+(?:\.\d+)?)" + AFTER))


def token_counts(text: Column) -> Column:
    """Number of strings, comments, keywords and numbers in program text."""
    found = lambda i: F.size(F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(i)), lambda t: t != "")).cast("bigint")
    return F.struct(*[found(i).alias(n) for i, n in enumerate(("strings", "comments", "keywords", "numbers"), 1)])


PROJECT = "app string, version int, name string, workspace string"


def read_projects(spark: SparkSession, path: str, app: str, one_a_file: bool = False) -> DataFrame:
    """Projects of ``app``, one a line, or one a file over any number of lines; those of
    other apps are refused."""
    return spark.read.schema(PROJECT).option("multiLine", one_a_file).json(path).where(F.col("app") == app)


def write_projects(df: DataFrame, path: str) -> None:
    df.select("app", "version", "name", "workspace").write.json(path)


def read_or_default(spark: SparkSession, path: str, app: str, default: DataFrame) -> DataFrame:
    """Saved projects, or ``default`` where there are none: no folder, or in it no file
    of ``app`` that is whole. Other failures are raised."""
    try:
        found = read_projects(spark, path, app)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return default
    return default if found.isEmpty() else found


def write_code(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.text(path)
