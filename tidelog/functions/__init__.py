"""Scalar functions of behaviours, checked, as Spark columns and as Python functions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Ty, key, type_of

MIN, MAX = -(1 << 63), (1 << 63) - 1


class Fault(Exception):
    """An operation without a result; the behaviour that meets one makes no patch."""


def _numbers(a: object, b: object) -> Ty:
    t = type_of(a)
    if t is not type_of(b) or t not in (Ty.INT, Ty.FLOAT):
        raise Fault("arithmetic needs two Ints or two Floats")
    return t


def _int(n: int) -> int:
    if not MIN <= n <= MAX:
        raise Fault("overflow")
    return n


def _float(x: float) -> float:
    if not math.isfinite(x):
        raise Fault("no finite number")
    return x + 0.0


def add(a, b):
    return _int(a + b) if _numbers(a, b) is Ty.INT else _float(a + b)


def sub(a, b):
    return _int(a - b) if _numbers(a, b) is Ty.INT else _float(a - b)


def mul(a, b):
    return _int(a * b) if _numbers(a, b) is Ty.INT else _float(a * b)


def div(a, b):
    """Integers truncate towards zero."""
    t = _numbers(a, b)
    if b == 0:
        raise Fault("division by zero")
    if t is Ty.FLOAT:
        return _float(a / b)
    return _int(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))


def rem(a, b):
    t = _numbers(a, b)
    if b == 0:
        raise Fault("division by zero")
    if t is Ty.FLOAT:
        return _float(math.fmod(a, b))
    if a == MIN and b == -1:
        raise Fault("overflow")
    return int(math.fmod(a, b)) if abs(a) < 1 << 52 and abs(b) < 1 << 52 else (abs(a) % abs(b)) * (-1 if a < 0 else 1)


def neg(a):
    return _int(-a) if _numbers(a, a) is Ty.INT else _float(-a)


def least(a, b):
    _numbers(a, b)
    return min(a, b)


def greatest(a, b):
    _numbers(a, b)
    return max(a, b)


def to_float(a):
    if type_of(a) is not Ty.INT:
        raise Fault("float() takes an Int")
    return float(a)


def equal(a, b):
    if type_of(a) is not type_of(b):
        raise Fault("a comparison of different kinds")
    return key(a) == key(b)


def less(a, b):
    _numbers(a, b)
    return a < b


def word_match(a, b):
    """Text equals, or holds the other as one of its words; other kinds compare."""
    if type_of(a) is Ty.TEXT and type_of(b) is Ty.TEXT:
        return a == b or b in a.split()
    return key(a) == key(b) if type_of(a) is type_of(b) else False


def tokenize(text: str) -> tuple:
    return tuple(text.split())


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


PYTHON: dict[str, Callable] = {
    "add": add, "sub": sub, "mul": mul, "div": div, "rem": rem, "neg": neg, "min": least, "max": greatest, "float": to_float, "eq": equal,
    "ne": lambda a, b: not equal(a, b), "lt": less, "le": lambda a, b: not less(b, a), "gt": lambda a, b: less(b, a), "ge": lambda a, b: not less(a, b), "match": word_match,
}


def draw_below(state: int, bound: int) -> tuple[int, int]:
    """(value in [0, bound), next state) of the xorshift64* generator, by rejection."""
    if bound <= 0 or state == 0:
        raise Fault("a draw needs a bound above 0 and a state other than 0")
    mask = (1 << 64) - 1
    x = state & mask
    limit = (1 << 64) - (1 << 64) % bound
    while True:
        x ^= x >> 12
        x ^= (x << 25) & mask
        x ^= x >> 27
        value = x * 0x2545F4914F6CDD1D & mask
        if value < limit:
            return value % bound, x if x < 1 << 63 else x - (1 << 64)


# --------------------------------------------------------------------------- as Spark columns


def _raise(cond: Column, what: str, otherwise: Column) -> Column:
    return F.when(cond, F.raise_error(F.lit(what)).cast("long")).otherwise(otherwise)


def c_arithmetic(op: str, a: Column, b: Column, ty: Ty = Ty.INT) -> Column:
    """add, sub or mul of two columns of one kind; Spark raises where an Int overflows, a Float must stay finite."""
    out = {"add": a + b, "sub": a - b, "mul": a * b}[op]
    return out if ty is Ty.INT else c_finite(out)


def c_neg(a: Column, ty: Ty = Ty.INT) -> Column:
    return -a if ty is Ty.INT else c_finite(-a)


def c_least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def c_greatest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def c_float(a: Column) -> Column:
    """A Float from an Int."""
    return a.cast("double")


def c_compare(op: str, a: Column, b: Column) -> Column:
    """eq, ne, lt, le, gt or ge of two columns of one kind."""
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]


def c_rem(a: Column, b: Column) -> Column:
    """Integer remainder; MIN % -1 overflows here, where Spark gives 0."""
    return _raise((a == F.lit(MIN)) & (b == -1), "overflow", a % b)


def c_div(a: Column, b: Column) -> Column:
    """Integer quotient towards zero; under ANSI Spark raises for 0 and MIN / -1."""
    return F.call_function("div", a, b)


def c_finite(x: Column) -> Column:
    """A float that must be finite, with -0.0 as 0.0."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("no finite number")).cast("double")).otherwise(x + F.lit(0.0))


def c_and(a: Column, b: Column) -> Column:
    """Left to right: b is looked at only if a holds."""
    return F.when(a, b).otherwise(F.lit(False))


def c_or(a: Column, b: Column) -> Column:
    return F.when(a, F.lit(True)).otherwise(b)


def c_tokenize(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def c_word_match(text: Column, word: Column) -> Column:
    return (text == word) | F.array_contains(c_tokenize(text), word)


def c_sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))
