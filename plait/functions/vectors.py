"""Vectors as ARRAY<DOUBLE>: softmax, ranking, mixtures of correlated Gaussians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plait.functions.columns import c


def total(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def logsumexp(v) -> Column:
    m = F.array_max(v)
    return m + F.log(total(F.transform(v, lambda x: F.exp(x - m))))


def softmax(v) -> Column:
    v = c(v)
    m = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - m))
    return F.transform(e, lambda x: x / total(e))


def ranked(p) -> Column:
    """Structs (p, class), best first; ties to the lower class."""
    pairs = F.transform(c(p), lambda x, i: F.struct((-x).alias("n"), i.alias("class"), x.alias("p")))
    return F.array_sort(pairs)


def argmax(p) -> Column:
    return ranked(p)[0]["class"]


def top_classes(p, k: int) -> Column:
    return F.transform(F.slice(ranked(p), 1, k), lambda s: s["class"])


def brier(p, y) -> Column:
    """Sum of squares - 2 p_y + 1."""
    return total(F.transform(c(p), lambda x: x * x)) - 2 * F.get(c(p), c(y)) + 1


def mixture_log_density(x, y, pi, mx, my, sx, sy, rho) -> Column:
    """Log density of a mixture of 2-d Gaussians; arrays of K: logits, means, log deviations, raw correlations (0.95 tanh).

    Deviations are at least 1e-3, correlations within 0.95."""
    x, y = c(x), c(y)
    parts = F.arrays_zip(*[v.alias(n) for v, n in zip(map(c, (pi, mx, my, sx, sy, rho)), ("pi", "mx", "my", "sx", "sy", "rho"))])

    def one(k):
        s, t = F.greatest(F.exp(k["sx"]), F.lit(1e-3)), F.greatest(F.exp(k["sy"]), F.lit(1e-3))
        r = F.lit(0.95) * F.tanh(k["rho"])
        r = F.least(F.greatest(r, F.lit(-0.95)), F.lit(0.95))
        a, b, q = (x - k["mx"]) / s, (y - k["my"]) / t, F.greatest(1 - r * r, F.lit(1e-3))
        return k["pi"] - 0.5 * (a * a + b * b - 2 * r * a * b) / q - F.log(s) - F.log(t) - 0.5 * F.log(q) - math.log(2 * math.pi)

    return logsumexp(F.transform(parts, one)) - logsumexp(c(pi))


def mixture_mean(pi, mu) -> Column:
    return total(F.zip_with(softmax(pi), c(mu), lambda a, b: a * b))


def gaussian_nll(x, mean, log_sigma) -> Column:
    s = F.greatest(F.exp(c(log_sigma)), F.lit(1e-4))
    return 0.5 * F.pow((c(x) - c(mean)) / s, 2) + F.log(s) + 0.5 * math.log(2 * math.pi)
