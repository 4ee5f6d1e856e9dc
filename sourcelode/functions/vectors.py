"""Expressions over embedding vectors (arrays of doubles)."""

from pyspark.sql import Column, functions as F

from sourcelode.functions.text import as_column


def _vector(value) -> Column:
    return as_column(value).cast("array<double>")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + x)


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def norm(vector) -> Column:
    return F.sqrt(_sum(F.transform(_vector(vector), lambda x: x * x)))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 for a zero vector and for vectors of unequal length."""
    left, right = _vector(a), _vector(b)
    dot = _sum(F.zip_with(left, right, lambda x, y: x * y))
    lengths = norm(left) * norm(right)
    return F.when((lengths > 0) & (F.size(left) == F.size(right)), dot / lengths).otherwise(0.0)


def _magnitudes(vector) -> Column:
    return F.transform(_vector(vector), F.abs)


def _variance(vector) -> Column:
    """Population variance."""
    values = _vector(vector)
    return F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")),
        lambda acc: acc["q"] / F.size(values) - F.pow(acc["s"] / F.size(values), F.lit(2)),
    )


def entropy(vector) -> Column:
    """Entropy of the magnitudes as shares, relative to its maximum; 0 for a zero vector."""
    sizes = _magnitudes(vector)
    shares = _let(_sum(sizes), lambda total: F.transform(sizes, lambda x: x / total))
    bits = F.aggregate(
        shares, F.lit(0.0), lambda acc, x: acc - x * F.log2(x + F.lit(1e-10))
    )
    most = F.log2(F.size(_vector(vector)).cast("double"))
    return F.when((F.coalesce(F.array_max(sizes), F.lit(0.0)) == 0) | (most <= 0), 0.0).otherwise(
        bits / most
    )


def semantic_complexity(vector) -> Column:
    """Variance, range and share of dimensions that are not close to zero."""
    values = _vector(vector)
    spread = F.array_max(values) - F.array_min(values)
    near_zero = F.size(F.filter(values, lambda x: F.abs(x) < 0.01)) / F.size(values)
    return _clamp((_variance(vector) * 0.4 + spread * 0.4 + (1 - near_zero) * 0.2) / 2.0)


def pattern_diversity(vector) -> Column:
    """One minus the mean cosine between all pairs of chunks (an eighth of the vector each).

    Fewer than two chunks give .5; a shorter last chunk and zero chunks count as unlike every
    other. The pairwise cosines of unit chunks u add up to (|sum u|^2 - sum |u|^2) / 2.
    """
    values = _vector(vector)
    width = F.greatest(F.lit(1), F.floor(F.size(values) / 8).cast("int"))
    count = F.ceil(F.size(values) / width).cast("int")
    full = F.floor(F.size(values) / width).cast("int")

    def unit(chunk: Column) -> Column:
        length = _sum(F.transform(chunk, lambda x: x * x))
        return _let(
            F.sqrt(length),
            lambda size: F.transform(chunk, lambda x: F.when(size > 0, x / size).otherwise(0.0)),
        )

    def total(units: Column) -> Column:
        zero = F.transform(F.get(units, 0), lambda _: F.lit(0.0))
        added = F.aggregate(units, zero, lambda acc, u: F.zip_with(acc, u, lambda x, y: x + y))
        own = F.size(F.filter(units, lambda u: F.exists(u, lambda x: x != 0)))
        return (_sum(F.transform(added, lambda x: x * x)) - own) / 2

    units = F.transform(
        F.sequence(F.lit(0), full - 1), lambda i: unit(F.slice(values, i * width + 1, width))
    )
    pairs = count * (count - 1) / 2
    return F.when(count < 2, 0.5).otherwise(_clamp(1 - _let(units, total) / pairs))


def security_signal(vector) -> Column:
    sizes = _magnitudes(vector)
    mean = _sum(sizes) / F.size(sizes)
    return F.least(
        F.lit(1.0), (F.array_max(sizes) * 0.3 + mean * 0.3 + _variance(vector) * 0.4) / 3.0
    )
