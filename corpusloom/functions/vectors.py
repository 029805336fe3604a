"""Vector and probability expressions over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An expression captured by a lambda is computed again for every element; binding it to the
    variable of a one-element array avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(arr: str | Column) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: str | Column, b: str | Column) -> Column:
    def gap(x: Column, y: Column) -> Column:
        return x.cast("double") - y.cast("double")

    return total(F.zip_with(_c(a), _c(b), lambda x, y: gap(x, y) * gap(x, y)))


def squared_norm(a: str | Column) -> Column:
    return total(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")))


def softmax(arr: str | Column) -> Column:
    exps = let(
        F.array_max(_c(arr)).cast("double"), lambda top: F.transform(_c(arr), lambda x: F.exp(x.cast("double") - top))
    )
    return let(exps, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def sigmoid(arr: str | Column) -> Column:
    return F.transform(_c(arr), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double"))))


def masked_mean(values: str | Column, mask: str | Column) -> Column:
    """Sum(value * mask) / Sum(mask); null when the mask is empty."""
    weight = total(mask)
    return F.when(weight > 0, dot(values, mask) / weight)


def argmax(arr: str | Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(_c(arr), F.array_max(_c(arr))) - 1).cast("int")


def zero_augmented(arr: str | Column, aux: Column | None = None) -> Column:
    """One extra dimension, so that a Euclidean search ranks by inner product.

    Corpus vectors get ``sqrt(phi - |v|^2)`` as ``aux`` (``phi`` = the largest squared norm);
    queries get zero.
    """
    extra = F.lit(0.0) if aux is None else aux
    return F.concat(F.transform(_c(arr), lambda x: x.cast("double")), F.array(extra.cast("double")))


def half_precision(arr: str | Column) -> Column:
    """Round to the nearest half-precision value in the normal range (11 significant bits)."""

    def one(x: Column) -> Column:
        v = x.cast("double")
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - F.lit(10))
        return F.when(v == 0, F.lit(0.0)).otherwise(F.bround(v / step) * step)

    return F.transform(_c(arr), one)
