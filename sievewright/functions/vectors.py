"""Vector similarity, softmax pooling and log-probability arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once: within a lambda function an outer expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the length of the shorter vector; 0.0 where a vector is null, empty or of norm zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n)
    dot = _sum(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(_sum(F.transform(x, lambda p: p * p))) * F.sqrt(_sum(F.transform(y, lambda p: p * p)))
    return F.when((n > 0) & (norm > 0), dot / norm).otherwise(F.lit(0.0))


def pair_scores(embedded: Column) -> Column:
    """struct(score1, score2) of four vectors that came as one answer: the first against the second, the third against the fourth.

    An answer without exactly four vectors gives zeros.
    """
    one = lambda i: F.when(F.size(embedded) == 4, cosine(F.get(embedded, F.lit(i)), F.get(embedded, F.lit(i + 1)))).otherwise(0.0)
    return F.struct(one(0).alias("score1"), one(2).alias("score2"))


def softmax(xs: Column, beta: float = 1.0) -> Column:
    """Weights exp(x / beta), shifted by the largest, that sum to 1; an empty array for none."""
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp((x - top) / beta))
    return let(_sum(e), lambda total: F.transform(e, lambda x: x / total))


def adaptive_beta(xs: Column) -> Column:
    """1 less half the range, within 0.5 and 1; 1.0 for no values."""
    return F.when(F.size(xs) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.5), 1 - 0.5 * (F.array_max(xs) - F.array_min(xs))))).otherwise(F.lit(1.0))


def pooled_similarity(sims: Column, beta: float = 1.0) -> Column:
    """The mean of similarities weighted by their own softmax; 0.0 for none."""
    return F.coalesce(_sum(F.zip_with(softmax(sims, beta), sims, lambda w, s: w * s)), F.lit(0.0))


def weighted_sum(vectors: Column, weights: Column, dims: int) -> Column:
    """The sum of the first `dims` dimensions of vectors by weights; each vector is read once. Zeros for no vectors."""
    zero = F.array_repeat(F.lit(0.0), dims)
    pairs = F.zip_with(vectors, weights, lambda v, w: F.struct(F.slice(doubles(v), 1, dims).alias("v"), w.alias("w")))
    return F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + x * p["w"]))


def beta_lookup(scores: Column, beta: float = 1.0) -> Column:
    """The score of a beta from a map keyed by its spellings: 1.0 as "1.0" or "1"; null if there is none."""
    keys = [str(beta)] + ([str(int(beta))] if beta == int(beta) else [])
    return F.coalesce(*[F.try_element_at(scores, F.lit(k)) for k in keys])


def partition_tag(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, "SFT").otherwise("ORPO")


def log1mexp(x: Column) -> Column:
    """log(1 - exp(x)) for x below zero, without loss of digits."""
    y = F.least(x, F.lit(-1e-7))
    return F.when(y < -0.6931471805599453, F.log1p(-F.exp(y))).otherwise(F.log(-F.expm1(y)))


def log_odds(x: Column) -> Column:
    """The log-odds of a mean log-probability."""
    return x - log1mexp(x)


def odds_ratio_loss(win: Column, lose: Column, beta: float = 1.0) -> Column:
    """softplus of minus beta times the difference of the log-odds."""
    z = -beta * (log_odds(win) - log_odds(lose))
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def mean_after(values: Column, start: Column) -> Column:
    """The mean of an array's values from a position on; 0.0 for none."""
    rest = F.slice(values, start + 1, F.greatest(F.size(values) - start, F.lit(0)))
    return F.when(F.size(rest) > 0, _sum(rest) / F.size(rest)).otherwise(F.lit(0.0))


def right_padded(values: Column, to: Column, pad: Column) -> Column:
    """An array filled up to a length at its right."""
    return F.concat(values, F.array_repeat(pad, F.greatest(to - F.size(values), F.lit(0))))
