"""Texts cut off by field limits or in mid-transfer: length hazards, false-discovery control, and how texts end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievewright.llm.endings import ending
from sievewright.session import materialize


def with_endings(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys`, n_chars and ending of each row whose text isn't null or empty."""
    src = df.select(*keys, F.col(text).alias("__text")).filter("__text IS NOT NULL AND __text != ''")
    kinds = src.schema.fields[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds) + "n_chars int, ending string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(kinds)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(t) for t in texts], pa.int32()), pa.array([ending(t) for t in texts])], names=[*(k.name for k in kinds), "n_chars", "ending"])

    return src.mapInArrow(run, schema)


def poisson_tail(k: int, mean: float) -> float:
    """P(X >= k) of a Poisson variable; exact enough down to 1e-300."""
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    if k <= mean:
        return 1.0 - math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k))
    log = k * math.log(mean) - mean - math.lgamma(k + 1)
    term, total, i = 1.0, 1.0, k
    while term > 1e-17 * total:
        i += 1
        term *= mean / i
        total += term
    return min(1.0, math.exp(log) * total) if log > -700 else 0.0


def length_hazards(lengths: DataFrame, source: list[str], reach: int = 30, gap: int = 5) -> DataFrame:
    """source, n_chars, n_at, n_at_risk, hazard (share of the texts at least so long that end there), expected and p_value.

    The expectation comes from the hazard over the lengths `gap` to `reach` away on both sides; p is the chance of at least n_at
    endings at that rate. One row for each source and length that occurs, from window functions over counts of lengths.
    """
    counts = lengths.groupBy(*source, "n_chars").agg(F.count(F.lit(1)).alias("n_at"))
    by = W.partitionBy(*source).orderBy("n_chars")
    upward = W.partitionBy(*source).orderBy(F.desc("n_chars"))
    c = counts.withColumn("n_at_risk", F.sum("n_at").over(upward.rowsBetween(W.unboundedPreceding, 0)))
    below, above = by.rangeBetween(-reach, -gap), by.rangeBetween(gap, reach)
    near = F.coalesce(F.sum("n_at").over(below), F.lit(0)) + F.coalesce(F.sum("n_at").over(above), F.lit(0))
    c = c.withColumn("__near", near.cast("double")).withColumn("hazard", F.col("n_at") / F.col("n_at_risk"))
    # texts at risk change little over so few lengths, except where a cut ended many of them: those below it are the measure
    c = c.withColumn("expected", (F.col("__near") + 0.5) / F.lit(2.0 * (reach - gap + 1))).drop("__near")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields) + ", p_value double"

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [poisson_tail(k, m) for k, m in zip(b.column("n_at").to_pylist(), b.column("expected").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "p_value"])

    return c.mapInArrow(test, schema)


def significant_lengths(hazards: DataFrame, source: list[str], rate: float = 0.001) -> DataFrame:
    """The lengths at which more texts of a source end than their neighbours let expect: Benjamini-Hochberg within each source."""
    by = W.partitionBy(*source).orderBy("p_value")
    ranked = hazards.withColumn("__rank", F.rank().over(by)).withColumn("__tests", F.count(F.lit(1)).over(W.partitionBy(*source)))
    ok = F.max(F.when(F.col("p_value") <= F.lit(rate) * F.col("__rank") / F.col("__tests"), F.col("p_value"))).over(W.partitionBy(*source))
    return ranked.withColumn("__limit", ok).filter("p_value <= __limit").drop("__rank", "__tests", "__limit")


def truncated(df: DataFrame, keys: list[str], text: str, source: list[str], slack: int = 4, rate: float = 0.001) -> DataFrame:
    """Every non-empty text with `cut_at` (the significant length it ends at, up to `slack` below it since trailing blanks may
    have been stripped; null elsewhere), ending, truncated and cause (`fixed_length`, `mid_transfer` or null).

    Two rules. `fixed_length`: the text ends at a significant length, and its ending isn't a closed one. `mid_transfer`: a transfer
    breaks off at any length, so no hazard shows it, and only endings that nothing complete has count: open tags or fences, half a
    character, escape or entity, or no end of a sentence. Null and empty texts have no rows; blank ones are never truncated. Null
    sources are a source. Repeated rows keep a row each.
    """
    rows = materialize(with_endings(df, list(dict.fromkeys([*keys, *source])), text), "endings")
    caps = significant_lengths(length_hazards(rows, source), source, rate)
    caps = caps.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(source)], F.col("n_chars").alias("__cap"))
    # one row for each source: the significant lengths are few, and the lists of them stay small
    lists = caps.groupBy(*[f"__s{i}" for i in range(len(source))]).agg(F.sort_array(F.collect_set("__cap")).alias("__caps"))
    on = F.lit(True)
    for i, c in enumerate(source):
        on = on & rows[c].eqNullSafe(lists[f"__s{i}"])
    j = rows.join(lists, on, "left")
    j = j.withColumn("cut_at", F.array_max(F.filter("__caps", lambda x: x.between(F.col("n_chars"), F.col("n_chars") + slack))))
    j = j.drop("__caps", *[f"__s{i}" for i in range(len(source))])
    hard = F.col("ending").isin("open", "broken", "cut")
    cause = F.when(F.col("cut_at").isNotNull() & (hard | (F.col("ending") == "weak")), "fixed_length").when(hard, "mid_transfer")
    return j.withColumn("cause", cause).withColumn("truncated", cause.isNotNull())


def truncation_rates(found: DataFrame, source: list[str]) -> DataFrame:
    """For each source: n_texts, n_truncated, n_fixed_length, n_mid_transfer, rate, and the significant lengths."""
    return found.groupBy(*source).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if("truncated").alias("n_truncated"),
        F.count_if(F.col("cause") == "fixed_length").alias("n_fixed_length"),
        F.count_if(F.col("cause") == "mid_transfer").alias("n_mid_transfer"),
        F.round(F.count_if("truncated") / F.count(F.lit(1)), 6).alias("rate"),
        F.sort_array(F.collect_set("cut_at")).alias("lengths"),
    )
