"""Numeric arrays as columns: normalisation, rotation, gates, softmax and cross entropy, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import let


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column | str) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def rms_norm(a: Column | str, epsilon: float = 1e-5) -> Column:
    scale = lambda x: 1 / F.sqrt(_sum(F.transform(x, lambda v: v * v)) / F.size(x) + epsilon)
    return let(doubles(a), lambda x: let(scale(x), lambda s: F.transform(x, lambda v: v * s)))


def rotate_half(a: Column | str) -> Column:
    """The second half, negated, before the first."""
    x = doubles(a)
    half = F.ceil(F.size(x) / 2).cast("int")
    return F.concat(F.transform(F.slice(x, half + 1, F.size(x) - half), lambda v: -v), F.slice(x, F.lit(1), half))


def rotary(a: Column | str, position: Column, theta: float = 10_000.0) -> Column:
    """Rotary position embedding: x * cos + rotate_half(x) * sin, the angles repeated over both halves."""

    def turn(x: Column, turned: Column) -> Column:
        half = F.ceil(F.size(x) / 2).cast("int")
        angle = lambda i: position / F.pow(F.lit(theta), 2.0 * F.pmod(i, half) / F.size(x))
        return F.transform(x, lambda v, i: v * F.cos(angle(i)) + F.get(turned, i) * F.sin(angle(i)))

    return let(doubles(a), lambda x: let(rotate_half(a), lambda r: turn(x, r)))


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(doubles(gate), doubles(up), lambda g, u: g / (1 + F.exp(-g)) * u)


def softmax(a: Column | str) -> Column:
    e = let(doubles(a), lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return let(e, lambda y: let(_sum(y), lambda s: F.transform(y, lambda v: v / s)))


def cross_entropy(logits: Column | str, label: Column) -> Column:
    """Of one position; null where the label is ignored (-100)."""
    log_sum = lambda x, top: F.log(_sum(F.transform(x, lambda v: F.exp(v - top)))) + top
    return F.when(label != -100, let(doubles(logits), lambda x: let(F.array_max(x), lambda top: log_sum(x, top) - F.get(x, label))))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def causal_attention(queries: Column, keys: Column, values: Column) -> Column:
    """Attention of one head over a sequence (arrays of vectors): each place sees itself and those before it."""
    weighted = lambda w, vs, d: _sum(F.zip_with(w, vs, lambda a, v: a * F.get(v, d).cast("double")))

    def place(q: Column, i: Column, ks: Column, vs: Column) -> Column:
        scores = F.transform(F.slice(ks, F.lit(1), i + 1), lambda k: dot(q, k) / F.sqrt(F.size(q)))
        return let(softmax(scores), lambda w: F.transform(F.sequence(F.lit(0), F.size(F.get(vs, F.lit(0))) - 1), lambda d: weighted(w, F.slice(vs, F.lit(1), i + 1), d)))

    return F.transform(queries, lambda q, i: place(q, i, keys, values))
