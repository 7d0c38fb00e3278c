"""Repeated content inside single documents, with risk-controlled cutoffs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievewright.llm.words import Flat, combine, words_of
from sievewright.session import materialize


def shares(flat: Flat, span: int) -> np.ndarray:
    """For each list: how many of its words lie in a stretch of `span` words that already began earlier in the same list."""
    total = len(flat.codes)
    if total < span:
        return np.zeros(len(flat.n), np.int64)
    key = flat.doc[: total - span + 1].astype(np.uint64)
    for k in range(span):
        key = combine(key, flat.codes[k : total - span + 1 + k].astype(np.uint64))
    inside = np.flatnonzero(flat.doc[: total - span + 1] == flat.doc[span - 1 :])
    _, first = np.unique(key[inside], return_index=True)
    again = np.ones(len(inside), bool)
    again[first] = False
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, inside[again], 1)
    np.add.at(edge, inside[again] + span, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return covered[flat.start[1:]] - covered[flat.start[:-1]]


def repeated_share(df: DataFrame, keys: list[str], text: str, span: int = 5, screen: int = 2) -> DataFrame:
    """`keys`, n_words, n_repeated, share (n_repeated / n_words) and screen_share (the same for stretches of `screen` words) of every row.

    A stretch that began earlier is made of shorter ones that did, so screen_share is never below share. Null, empty and blank
    texts have 0 words and share 0.0, texts shorter than `span` words share 0.0. Repeated rows and ties keep a row each. Key
    columns pass through unchanged; other columns are ignored.
    """
    src = df.select(*keys, words_of(text).alias("__words"))
    kinds = src.schema.fields[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds) + "n_words int, n_repeated int, share double, screen_share double"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = Flat(b.column(len(kinds)))
            rep, rough, n = shares(flat, span), shares(flat, screen), np.maximum(flat.n, 1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(flat.n, pa.int32()), pa.array(rep, pa.int32()), pa.array(rep / n), pa.array(rough / n)],
                names=[*(f.name for f in kinds), "n_words", "n_repeated", "share", "screen_share"],
            )

    return src.mapInArrow(measure, schema)


def binomial_upper(errors: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound, at confidence 1 - delta, on the rate behind `errors` in `n` trials."""
    if n == 0 or errors >= n:
        return 1.0

    def tail(p: float) -> float:  # P(X <= errors), summed in logs
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(errors + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    lo, hi = errors / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > delta else (lo, mid)
    return hi


def controlled_cutoffs(scored: DataFrame, strata: list[str], label: str, score: str, grid: list[float], risk: float, confidence: float, holdout: int, seed_keys: list[str]) -> DataFrame:
    """One cutoff for each stratum: the lowest of `grid` for which rejecting what scores at least that much is safe.

    Safe: of the rows not labelled defective, at most `risk` are rejected, with probability `confidence` over all strata at once.
    The holdout of a stratum is the `holdout` rows that come first by a hash of `seed_keys` (a bound of the fit, not of the use).
    Cutoffs are tested from the strictest downwards until the first that fails (fixed-sequence testing, which needs no correction
    within a stratum); across strata the error is divided by their number. A stratum in which no cutoff can be shown safe falls
    back to the strictest of the grid. Result: strata, cutoff, n_holdout, n_good, upper_bound. Null strata form a stratum.
    """
    rank = W.partitionBy(*strata).orderBy(F.xxhash64(*seed_keys), *seed_keys)
    held = scored.withColumn("__rank", F.row_number().over(rank)).filter(F.col("__rank") <= holdout)
    good = ~F.col(label)
    counts = held.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n_holdout"),
        F.count_if(good).alias("n_good"),
        F.array(*[F.count_if(good & (F.col(score) >= c)) for c in grid]).alias("__wrong"),
    )
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counts.schema.fields if f.name != "__wrong") + "cutoff double, upper_bound double"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, bounds = [], []
            for n, wrong, m in zip(b.column("n_good").to_pylist(), b.column("__wrong").to_pylist(), b.column("__strata").to_pylist(), strict=True):
                cut, bound = max(grid), 1.0
                for c, k in sorted(zip(grid, wrong, strict=True), reverse=True):
                    u = binomial_upper(k, n, (1 - confidence) / m)
                    if u > risk:
                        break
                    cut, bound = c, u
                cuts.append(cut)
                bounds.append(bound)
            keep = [c for c in b.schema.names if c not in ("__wrong", "__strata")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(cuts, pa.float64()), pa.array(bounds, pa.float64())], names=[*keep, "cutoff", "upper_bound"])

    return counts.withColumn("__strata", scored.select(*strata).distinct().agg(F.count(F.lit(1))).scalar()).mapInArrow(pick, schema)


@dataclass
class Repetition:
    """rows: keys, strata, shares, rejected (the screen reaches its stratum's cutoff) and repetitive; cutoffs: one for each stratum."""

    rows: DataFrame
    cutoffs: DataFrame
    strata: list[str]

    def report(self) -> DataFrame:
        """Strata, cutoff, n_holdout, n_good, upper_bound and safe of the fit, and what the cutoff does over all rows: n_rows, n_rejected,
        n_false (rejected, but not repetitive by the definition), n_repetitive and n_lost (repetitive, but not rejected)."""
        label = F.col("__label")
        n = self.rows.groupBy(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(self.strata)]).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if("rejected").alias("n_rejected"), F.count_if(F.col("rejected") & ~label).alias("n_false"), F.count_if("repetitive").alias("n_repetitive"), F.count_if(label & ~F.col("rejected")).alias("n_lost")
        )
        on = F.lit(True)
        for i, c in enumerate(self.strata):
            on = on & self.cutoffs[c].eqNullSafe(n[f"__r{i}"])
        return self.cutoffs.join(n, on).drop(*[f"__r{i}" for i in range(len(self.strata))])


def repetition(
    df: DataFrame, keys: list[str], text: str, strata: list[str], span: int = 5, min_words: int = 10, share: float = 0.35, risk: float = 0.05, confidence: float = 0.95, holdout: int = 2000
) -> Repetition:
    """Texts that repeat themselves, screened by risk-controlled cutoffs and then checked by the definition.

    The screen is the share of words in stretches of two words that began earlier. Its cutoff in a stratum is the lowest of a grid
    for which a labelled holdout (`holdout` rows, labelled by the definition: at least `min_words` words, `share` or more of them
    in repeated stretches of `span`) shows that at most `risk` of the sound texts reach it, at `confidence` over all strata at once.
    `rejected` is what reaches the cutoff; `repetitive` is the definition, checked on what is rejected. The grid ends at `share`, and
    the screen is never below the share itself, so no repetitive text is lost wherever a cutoff comes to lie; a stratum that no
    cutoff of the grid is safe for gets the strictest and is marked by safe = false, its falsely rejected texts are sorted out by
    the check as everywhere. `strata` are columns of `df`; null is a stratum of its own. An empty table has no rows and no cutoffs.
    """
    kept = list(dict.fromkeys([*keys, *strata]))
    s = materialize(repeated_share(df, kept, text, span), "shares")
    s = s.withColumn("__label", (F.col("n_words") >= min_words) & (F.col("share") >= share))
    grid = [round(share * k / 7, 6) for k in range(1, 7)] + [share]
    fitted = controlled_cutoffs(s, strata, "__label", "screen_share", grid, risk, confidence, holdout, keys).withColumn("safe", F.col("upper_bound") <= risk)
    cuts = fitted.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)], "cutoff")
    on = F.lit(True)
    for i, c in enumerate(strata):
        on = on & s[c].eqNullSafe(cuts[f"__s{i}"])
    j = s.join(cuts, on, "left").drop(*[f"__s{i}" for i in range(len(strata))])
    j = j.withColumn("rejected", F.col("screen_share") >= F.coalesce("cutoff", F.lit(share)))
    return Repetition(j.withColumn("repetitive", F.col("rejected") & F.col("__label")), fitted, strata)
