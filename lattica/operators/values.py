"""Literal values and constants: parsing literals, folding binary operations, resolving names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpoint_folder

#: How many references deep a constant is followed.
DEPTH = 16
NUMBER = r"^[+-]?\d[\d_]*(\.\d[\d_]*)?"


def unquoted(text: Column) -> Column:
    """The value of a quoted literal: quotes and an f, r, b or u before them go, and the escapes of
    newline, tab, quotes and backslash are undone. Null if it isn't a quoted literal."""
    body = F.regexp_extract(text, r"""^[fFrRbBuU]{0,2}(["'`])(.*)\1$""", 2)
    plain = F.replace(body, F.lit("\\\\"), F.lit("\u0000"))
    for escape, value in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'")):
        plain = F.replace(plain, F.lit(escape), F.lit(value))
    return F.when(text.rlike(r"""^[fFrRbBuU]{0,2}(["'`]).*\1$"""), F.replace(plain, F.lit("\u0000"), F.lit("\\")))


def integer(text: Column) -> Column:
    """An integer literal without its digit separators and type suffix (10_000u64, 42L), else null."""
    whole = text.rlike(r"^[+-]?\d[\d_]*([uUlLnN]+|[iu](8|16|32|64|128|size))?$")
    return F.when(whole, F.replace(F.regexp_extract(text, r"^([+-]?\d[\d_]*)", 1), F.lit("_"), F.lit("")).try_cast("bigint"))


def decimal(text: Column) -> Column:
    """A number with a point, without separators and suffix (1_0.5f32, 2.5F), else null."""
    whole = text.rlike(r"^[+-]?\d[\d_]*\.\d[\d_]*([fFdD]|f32|f64)?$")
    return F.when(whole, F.replace(F.regexp_extract(text, r"^([+-]?\d[\d_]*\.\d[\d_]*)", 1), F.lit("_"), F.lit("")).try_cast("double"))


def fold(op: Column, a: Column, b: Column) -> Column:
    """An operation on two integers, as text; null if it has no value (a zero divisor, an overflow).
    Quotients round towards zero and remainders have the dividend's sign."""
    truth = lambda x: F.when(x, "true").otherwise("false")
    divisor = F.when(b != 0, b)
    quotient = F.when(b == -1, F.try_subtract(F.lit(0).cast("bigint"), a)).otherwise(F.call_function("div", a, divisor))
    out = F.when(op == "+", F.try_add(a, b).cast("string")).when(op == "-", F.try_subtract(a, b).cast("string")).when(op == "*", F.try_multiply(a, b).cast("string"))
    out = out.when(op == "/", quotient.cast("string")).when(op == "%", (a % divisor).cast("string"))
    for name, test in (("==", a == b), ("!=", a != b), ("<", a < b), (">", a > b), ("<=", a <= b), (">=", a >= b)):
        out = out.when(op == name, truth(test))
    return out


def resolved(constants: DataFrame, depth: int = DEPTH) -> DataFrame:
    """name, value, hops: constants followed through the names they refer to, up to `depth` steps.
    constants: name, literal (or null), refers_to (or null). A cycle or a name that nobody defines
    leaves a constant without value."""
    checkpoint_folder(constants.sparkSession)
    known = constants.where("literal is not null").select("name", F.col("literal").alias("value"), F.lit(0).cast("long").alias("hops")).checkpoint()
    open_ = constants.where("literal is null and refers_to is not null").select("name", "refers_to").checkpoint()
    fresh = known
    for hop in range(1, depth + 1):
        fresh = open_.join(fresh.select(F.col("name").alias("refers_to"), "value"), "refers_to").select("name", "value", F.lit(hop).cast("long").alias("hops")).checkpoint()
        if fresh.isEmpty():
            break
        known = known.union(fresh)
    return known


def severity_multiplier(role: Column) -> Column:
    return F.when(role == "Utility", 0.5).when(role == "Leaf", 0.7).when(role == "Test", 0.3).when(role == "Hub", 1.2).otherwise(1.0)


def symbol(title: Column) -> Column:
    """The second ':' part of a title, or its only part, in lower case."""
    parts = F.split(title, ":")
    return F.lower(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))))


def thresholds(names: list[str], values: list[Column]) -> Column:
    """Names of thresholds with their values, as a map."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values))
