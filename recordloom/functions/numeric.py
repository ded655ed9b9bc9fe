"""Column functions on numbers, probabilities and byte arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for the logarithm of zero.
NO_PROBABILITY = -9999.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rate(numerator: Column, denominator: Column) -> Column:
    """A share, null where there is nothing to share."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0))


def probability(logprob: Column | str) -> Column:
    c = _col(logprob)
    return F.when(c == NO_PROBABILITY, 0.0).otherwise(F.exp(c))


def mass(logprobs: Column | str) -> Column:
    """Sum of the probabilities of an array of log-probabilities."""
    return F.aggregate(_col(logprobs), F.lit(0.0), lambda s, x: s + probability(x))


def log1mexp(x: Column) -> Column:
    """log(1 - exp(x)) for x < 0, stable at both ends."""
    return F.when(x > -math.log(2), F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def bernoulli_kl(teacher: Column, student: Column, temperature: float = 100.0, epsilon: float = 1e-6) -> Column:
    """Divergence of two events given by log-probabilities that are divided by a temperature.

    Log-probabilities are clipped below -epsilon, so both events and their complements have a chance.
    """
    p = F.least(teacher / temperature, F.lit(-epsilon))
    q = F.least(student / temperature, F.lit(-epsilon))
    return F.exp(p) * (p - q) + (-F.expm1(p)) * (log1mexp(p) - log1mexp(q))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it, lambdas included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax(values: Column) -> Column:
    def with_top(top: Column) -> Column:
        total = top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
        return bound(total, lambda t: F.transform(values, lambda x: x - t))

    return bound(F.array_max(values), with_top)


def sparse_kl(teacher: Column, student: Column) -> Column:
    """Divergence over shared candidates (arrays of log-probabilities in one order) and one bucket for the rest."""
    rest = lambda a: F.log(F.greatest(1.0 - F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x)), F.lit(1e-12)))

    def divergence(p: Column, q: Column) -> Column:
        inner = F.aggregate(F.zip_with(p, q, lambda x, y: F.exp(x) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return bound(rest(p), lambda a: bound(rest(q), lambda b: inner + F.exp(a) * (a - b)))

    return bound(teacher, lambda p: bound(student, lambda q: divergence(p, q)))


def padded(values: Column | str, width: Column | int, fill: Column) -> Column:
    """The array filled up to a width."""
    c, w = _col(values), F.lit(width) if isinstance(width, int) else width
    return F.concat(c, F.array_repeat(fill, F.greatest(w - F.size(c), F.lit(0)).cast("int")))


def round_up(n: Column, step: int) -> Column:
    return (F.ceil(n / step) * step).cast("int")


def bytes_of(arrays: Column | str) -> Column:
    """One binary value of an array of arrays of byte values."""
    digits = F.transform(F.flatten(_col(arrays)), lambda x: F.lpad(F.hex(x), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def bytes_valid(values: Column | str) -> Column:
    return F.forall(_col(values), lambda x: x.isNotNull() & x.between(0, 255))


def bytes_match(arrays: Column | str, text: Column | str) -> Column:
    """Whether the arrays of byte values spell the text; null when any array is null."""
    c = _col(arrays)
    return F.when(F.exists(c, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(
        bytes_of(c) == F.encode(_col(text), "UTF-8")
    )
