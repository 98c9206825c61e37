"""Column expressions for calling, scoring and formats. A signal is array<array<double>>: cycles of 4 channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: The knots of the score basis.
KNOTS = [0, 1, 2, 4, 6, 8, 11, 14, 17]


def positive_call(v: Column) -> Column:
    """Argmax over 4 channels that starts from 0: index 0 if none is positive; the first of equals."""
    return F.when(F.array_max(v) > 0, F.array_position(v, F.array_max(v)) - 1).otherwise(0).cast("int")


def purity(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.greatest(F.array_max(v) / F.greatest(total, F.lit(1e-6)), F.lit(0.0))


def call(v: Column) -> Column:
    """Plain argmax: also for channels that are all negative."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def base(index: Column) -> Column:
    return F.substring(F.lit(BASES), 1, 4).substr(index + 1, F.lit(1))


def runner_up(v: Column) -> Column:
    """Index of the best of the other channels."""
    top = call(v)
    rest = F.transform(v, lambda x, i: F.when(i == top, F.lit(-1e5)).otherwise(x))
    return (F.array_position(rest, F.array_max(rest)) - 1).cast("int")


def gap(v: Column) -> Column:
    s = F.sort_array(v, False)
    return s[0] - s[1]


def hat_bin(s: Column) -> Column:
    b = F.when(s >= 8, F.floor((s + 1) / 3 + 2)).when(s >= 2, F.floor(s / 2 + 1)).otherwise(F.floor(s))
    return F.least(b, F.lit(7)).cast("int")


def hat_beta(s: Column, b: Column) -> Column:
    knots = F.array(*[F.lit(float(k)) for k in KNOTS])
    low, high = F.element_at(knots, b + 1), F.element_at(knots, b + 2)
    return 1 - (s - low) / (high - low)


def phred(z: Column) -> Column:
    """Quality from log odds of being right, 52 at most; NaN gives 0."""
    z = F.least(z, F.lit(12.0))
    q = F.floor(10 * F.log10(1 + F.exp(z))).cast("int")
    return F.when(F.isnan(z), 0).otherwise(F.greatest(q, F.lit(0)))


def quality_char(q: Column) -> Column:
    return F.chr((q + 33).cast("int"))


def quantise(v: Column, scale: Column | float = 1.0) -> Column:
    """To int16: upper clamp, half added, truncated toward zero; the lower clamp is ours."""
    x = F.least(v * scale, F.lit(32767.0)) + 0.5
    return F.greatest(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), F.lit(-32768)).cast("int")


def md_flags(md: Column) -> Column:
    """MD tag -> for each base 2 (match) or 1 (mismatch); deletions are skipped."""
    tokens = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), 1)
    one = lambda t: F.when(t.rlike(r"^\d+$"), F.array_repeat(F.lit(2), t.cast("int"))).when(t.startswith("^"), F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return F.flatten(F.transform(tokens, one))


def rotated(signal: Column) -> Column:
    """Channels of cycles instead of cycles of channels, and back."""
    width = F.size(F.element_at(signal, 1))
    return F.transform(F.sequence(F.lit(1), width), lambda c: F.transform(signal, lambda v: F.element_at(v, c)))


def assigned(signal: Column, index: Column | int, value: Column) -> Column:
    """signal with the part at an index (from 0) replaced."""
    at = F.lit(index) if isinstance(index, int) else index
    return F.transform(signal, lambda v, i: F.when(i == at, value).otherwise(v))


def multiplied(signal: Column, matrix: list[list[float]]) -> Column:
    """matrix times the channels of each cycle."""
    rows = [F.array(*[F.lit(float(x)) for x in row]) for row in matrix]
    dot = lambda v, row: F.aggregate(F.zip_with(v, row, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.transform(signal, lambda v: F.array(*[dot(v, row) for row in rows]))


def picked(values: Column, mask: Column) -> Column:
    """The elements where the mask (an array of booleans) is true, in order."""
    both = F.filter(F.zip_with(values, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: x["m"])
    return F.transform(both, lambda x: x["v"])


def gathered(values: Column, indices: Column) -> Column:
    """The elements at the indices (from 0), in their order; null beyond the ends."""
    return F.transform(indices, lambda i: F.try_element_at(values, i + 1))
