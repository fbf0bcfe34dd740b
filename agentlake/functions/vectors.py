"""Vectors held as ``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>``; sums run in DOUBLE.

An expression named inside a lambda is evaluated for every element, so whole-vector
values such as norms are bound with ``let`` before a lambda uses them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentlake.functions.binding import let

def _double(vec: Column) -> Column:
    return vec.cast("array<double>")


def total(vec: Column) -> Column:
    return F.aggregate(_double(vec), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(_double(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def scale(vec: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(_double(vec), lambda x: x * f))


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x * y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x - y)


def reject(vec: Column, direction: Column, strength: float = 1.0) -> Column:
    """The vector without (``strength`` of) its component along a unit direction."""
    return subtract(vec, scale(direction, dot(vec, direction) * F.lit(strength)))


def mean_square(vec: Column) -> Column:
    return F.aggregate(_double(vec), F.lit(0.0), lambda acc, x: acc + x * x) / F.size(vec)


def rms_normalize(vec: Column, weight: Column, eps: float) -> Column:
    factor = F.lit(1.0) / F.sqrt(mean_square(vec) + F.lit(eps))
    return let(factor, lambda f: F.zip_with(_double(vec), _double(weight), lambda x, w: x * f * w))


def block_scale(vec: Column, scales: Column, block: int = 128) -> Column:
    """Each block of elements times its own scale; a ragged last block is kept."""
    def scaled(by):
        return F.transform(_double(vec), lambda x, i: x * F.element_at(by, (F.floor(i / block) + 1).cast("int")))

    return let(_double(scales), scaled)


def softmax(vec: Column) -> Column:
    exps = let(F.array_max(_double(vec)), lambda peak: F.transform(_double(vec), lambda x: F.exp(x - peak)))
    return let(exps, lambda e: scale(e, F.lit(1.0) / total(e)))


def sigmoid(vec: Column) -> Column:
    return F.transform(_double(vec), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def top_indices(vec: Column, k: int) -> Column:
    """0-based positions of the ``k`` largest values, ties to the lower position."""
    ranked = F.array_sort(F.transform(_double(vec), lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["i"])


def pick(vec: Column, indices: Column) -> Column:
    return let(vec, lambda v: F.transform(indices, lambda i: F.element_at(v, i + 1)))
