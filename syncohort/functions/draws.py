"""Draws that depend only on the row they belong to.

A value is a function of (row id, purpose), never of partitioning or task
order, so a recomputed partition repeats exactly the same draws.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from syncohort.functions.columns import as_column

#: Fixed values of the portable generator, shared with the SQL checks.
MODULUS = 2147483647


def hash_uniform(*parts: str | Column | int) -> Column:
    """Uniform on (0, 1) from a 64-bit hash of its arguments."""
    columns = [F.lit(p) if isinstance(p, int) else as_column(p) for p in parts]
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**53))


def hash_normal(*parts: str | Column | int) -> Column:
    """Standard normal from two independent uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(hash_uniform(*parts, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_uniform(*parts, 2))


#: Primes of the hash behind `hash_uniform`, fixed values.
_PRIMES = [
    np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
    )
]


def _turned(bits: np.ndarray, by: int) -> np.ndarray:
    return (bits << np.uint64(by)) | (bits >> np.uint64(64 - by))


def _finished(bits: np.ndarray) -> np.ndarray:
    bits ^= bits >> np.uint64(33)
    bits *= _PRIMES[1]
    bits ^= bits >> np.uint64(29)
    bits *= _PRIMES[2]
    bits ^= bits >> np.uint64(32)
    return bits


def hashed_int(value: int, bits: np.ndarray) -> np.ndarray:
    """`xxhash64` of hashed columns (as uint64) and one more integer, in numpy."""
    own = np.uint64(value & 0xFFFFFFFF) * np.ones(1, np.uint64) * _PRIMES[0]
    bits = (bits + (_PRIMES[4] + np.uint64(4))) ^ own
    return _finished(_turned(bits, 23) * _PRIMES[1] + _PRIMES[2])


def hashed_long(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The same with a column of 64-bit integers."""
    own = _turned(values.astype(np.int64).view(np.uint64) * _PRIMES[1], 31) * _PRIMES[0]
    bits = (bits + np.ones(1, np.uint64) * _PRIMES[4] + np.uint64(8)) ^ own
    return _finished(_turned(bits, 27) * _PRIMES[0] + _PRIMES[3])


def uniform_of(bits: np.ndarray) -> np.ndarray:
    """What `hash_uniform` makes of a hash."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def normal_of(bits: np.ndarray) -> np.ndarray:
    """What `hash_normal` makes of the hash of its arguments."""
    radius = np.sqrt(-2.0 * np.log(uniform_of(hashed_int(1, bits))))
    return radius * np.cos(2.0 * math.pi * uniform_of(hashed_int(2, bits)))


def portable_uniform(row: str | Column, stream: int | Column) -> Column:
    """Uniform on [0, 1) in plain BIGINT arithmetic, the same in any SQL engine."""
    row = as_column(row).cast("bigint")
    s = (F.lit(stream) if isinstance(stream, int) else stream).cast("bigint")
    x = (row * F.lit(48271) + s * F.lit(69621) + F.lit(12345)) % F.lit(MODULUS)
    y = (x * x + s * F.lit(40692) + row) % F.lit(MODULUS)
    z = (y * y + s * F.lit(16807) + row) % F.lit(MODULUS)
    return z.cast("double") / F.lit(float(MODULUS))


def portable_uniform_sql(row: str, stream: str | int) -> str:
    """The text of `portable_uniform` for a SQL check."""
    r, s = f"CAST({row} AS BIGINT)", f"CAST({stream} AS BIGINT)"
    x = f"(({r} * 48271 + {s} * 69621 + 12345) % {MODULUS})"
    y = f"(({x} * {x} + {s} * 40692 + {r}) % {MODULUS})"
    z = f"(({y} * {y} + {s} * 16807 + {r}) % {MODULUS})"
    return f"(CAST({z} AS DOUBLE) / {MODULUS}.0::DOUBLE)"
