"""Arrays of logits: softmax, log-sum-exp over groups, argmax, decoding bias."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def logsumexp(values: Column) -> Column:
    m = F.array_max(values).cast("double")
    return m + F.log(total(F.transform(values, lambda x: F.exp(x.cast("double") - m))))


def softmax(values: Column) -> Column:
    m = F.array_max(values).cast("double")
    e = F.transform(values, lambda x: F.exp(x.cast("double") - m))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def argmax(values: Column) -> Column:
    """Index from 0 of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_logits(tags: Column, classes: int) -> Column:
    """Background plus classes from 1 + 4 * classes tag logits: log-sum-exp of each class's four tags."""
    return F.concat(F.array(F.element_at(tags, 1).cast("double")), *(F.array(logsumexp(F.slice(tags, 2 + 4 * k, 4))) for k in range(classes)))


def biased(values: Column, bias: float, index: int = 0) -> Column:
    return F.transform(values, lambda x, i: F.when(i == index, x.cast("double") + bias).otherwise(x.cast("double")))


def safe_log(p: Column, eps: float = 2.220446049250313e-16) -> Column:
    return F.log(F.greatest(p, F.lit(0.0)) + F.lit(eps))
