"""Column functions over array<double>: distances, normalisation and activations, folded in code generation's order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once: inside a lambda over elements an expression is worked out for each of them."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def over(a: Column, b: Column) -> Column:
    """Element-wise quotient, 0 where the divisor is 0."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def cityblock(a: Column, b: Column) -> Column:
    """Mean absolute difference."""
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def canberra(a: Column, b: Column) -> Column:
    """Mean of |x - y| / (|x| + |y|), 0 where both are 0."""
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0)))) / F.size(a)


def sqeuclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    """Also Minkowski of the default power 2."""
    return F.sqrt(sqeuclidean(a, b))


def braycurtis(a: Column, b: Column) -> Column:
    return F.try_divide(total(F.zip_with(a, b, lambda x, y: F.abs(x - y))), total(F.zip_with(a, b, lambda x, y: F.abs(x + y))))


def centred(a: Column) -> Column:
    return bound(total(a) / F.size(a), lambda mean: F.transform(a, lambda x: x - mean))


def correlation(a: Column, b: Column) -> Column:
    return cosine(centred(a), centred(b))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def jensenshannon(a: Column, b: Column) -> Column:
    """Distance of two vectors brought to sum 1, natural logarithm; null if a component is negative or a sum is 0."""
    shares = lambda v: bound(total(v), lambda t: F.transform(v, lambda x: F.try_divide(x, t)))
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))
    bad = lambda p: F.exists(p, lambda x: x.isNull() | (x < 0))
    both = lambda p, q: total(F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2)))
    return bound(shares(a), lambda p: bound(shares(b), lambda q: F.when(~(bad(p) | bad(q)), F.sqrt(F.greatest(both(p, q) / 2, F.lit(0.0))))))


#: The distances of the centroid feature family.
DISTANCES = {
    "cosine": cosine,
    "canberra": canberra,
    "cityblock": cityblock,
    "euclidean": euclidean,
    "minkowski": euclidean,
    "sqeuclidean": sqeuclidean,
    "braycurtis": braycurtis,
    "correlation": correlation,
    "chebyshev": chebyshev,
    "jensenshannon": jensenshannon,
}


#: Distances that need a covariance or variances; where none is given, as in the feature family, they are 0.
UNPARAMETRISED = {"mahalanobis": lambda a, b: F.lit(0.0), "seuclidean": lambda a, b: F.lit(0.0)}


def row_normalised(a: Column) -> Column:
    """x / sum(x), all 0 where the sum is 0."""
    return bound(total(a), lambda t: F.transform(a, lambda x: F.coalesce(F.try_divide(x, t), F.lit(0.0))))


def unit(a: Column) -> Column:
    return bound(norm(a), lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))


def softmax(a: Column) -> Column:
    powers = bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return bound(powers, lambda e: bound(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax_at(a: Column, k: Column) -> Column:
    """Log-probability of element k (from 0)."""
    return bound(F.array_max(a), lambda top: F.get(a, k) - top - F.log(total(F.transform(a, lambda x: F.exp(x - top)))))


def sharpened(p: Column, temperature: float) -> Column:
    return bound(F.transform(p, lambda x: F.pow(x, F.lit(1 / temperature))), row_normalised)


def argmax(a: Column) -> Column:
    """Position from 0 of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("int"))


def multi_hot(labels: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.array_contains(labels, i).cast("int"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


ACTIVATIONS = {
    "linear": lambda x: x,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "relu6": lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(6.0)),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(x * 0.01),
    "sigmoid": sigmoid,
    "tanh": F.tanh,
    "softplus": lambda x: F.log1p(F.exp(x)),
}


def binary_entropy(p: Column, eps: float = 1e-9) -> Column:
    return -p * F.log(p + eps) - (1 - p) * F.log(1 - p + eps)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when(~F.isnan(x) & ~x.isin(math.inf, -math.inf), x)


def geodesic_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    """Haversine distance on a sphere (within about 0.6 % of the ellipsoid's); null coordinates count as 0."""
    a, b, c, d = (F.radians(F.coalesce(x, F.lit(0.0))) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def gaussian_weight(distance: Column, sigma: Column) -> Column:
    return F.exp(-F.pow(distance / sigma, 2))


def shrunk_negatives(a: Column) -> Column:
    """Negative elements times the sigmoid of the row's mean."""
    return bound(sigmoid(total(a) / F.size(a)), lambda k: F.transform(a, lambda x: F.when(x < 0, x * k).otherwise(x)))
