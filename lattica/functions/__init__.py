"""Scalar functions shared by plans: paths, ages, decay, sizes and identifiers. All are column
expressions that stay in generated code, but for fnv1a, which has no built-in form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.findings import glob_to_regex, grade
from ..operators.stats import interpolated_percentile, role

__all__ = ["age_days", "decay", "extension", "fnv1a", "glob_to_regex", "grade", "interpolated_percentile", "kebab", "loc", "module_of", "role", "stem"]


def module_of(path):
    """The folder of a path, '.' at the top."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", ".").otherwise(folder)


def stem(path):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kebab(name):
    """DetectorName to detector-name, without a trailing -detector."""
    parts = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2"), r"([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.regexp_replace(F.lower(F.regexp_replace(parts, r"[\s_]+", "-")), r"-detector$", "")


def age_days(ts, now):
    """Days from ts to now as a fraction, not below 0."""
    return F.greatest(F.lit(0.0), (F.unix_timestamp(F.to_timestamp(now)) - F.unix_timestamp(F.to_timestamp(ts))) / 86400.0)


def decay(age, half_life: float):
    return F.exp(F.lit(-math.log(2)) * age / half_life)


def loc(start, end):
    """Lines of a span, 1 if its end is before its start."""
    return F.when(end >= start, end - start + 1).otherwise(1)


def fnv1a(column):
    """The 64-bit FNV-1a hash of a string's UTF-8 bytes as 16 hexadecimal digits (null: null).

    Rows of a batch advance together, a byte at a time."""

    def run(texts: pd.Series) -> pd.Series:
        raw = [t.encode() if t is not None else b"" for t in texts]
        size = np.array([len(r) for r in raw])
        h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
        flat, first = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(size)))[:-1]
        for i in range(int(size.max()) if len(size) else 0):
            live = np.flatnonzero(size > i)
            h[live] = (h[live] ^ flat[first[live] + i].astype(np.uint64)) * np.uint64(0x100000001B3)
        return pd.Series([f"{int(x):016x}" if t is not None else None for x, t in zip(h, texts)])

    return F.pandas_udf(run, "string")(column)
