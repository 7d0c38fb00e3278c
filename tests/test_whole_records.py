"""Queries over records that are made of every row."""

import math

from sievewright.plans import catalogue
from sievewright.plans.score_queries import all_queries_and_chunks


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def methods(q, chunks):
    """Pooled similarity, adaptive beta, and the query against the weighted sum of chunks for three betas."""
    if not chunks:
        return [0.0, 1.0, 0.0, 0.0, 0.0]
    sims = [cosine(q, c) for c in chunks]

    def weights(b):
        e = [math.exp(s / b) for s in sims]
        return [x / sum(e) for x in e]

    pooled = sum(w * s for w, s in zip(weights(1.0), sims, strict=True))
    sums = [[sum(w * c[d] for w, c in zip(weights(b), chunks, strict=True)) for d in range(len(q))] for b in (0.5, 1.0, 2.0)]
    return [pooled, min(1.0, max(0.5, 1 - 0.5 * (max(sims) - min(sims)))), *[cosine(q, s) for s in sums]]


def by_label(spark, sf):
    out = {}
    for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        out.setdefault(x["label"], []).append((x["vec_id"], list(x["embedding"])))
    return {k: [e for _, e in sorted(v)] for k, v in out.items()}


def test_softmax_methods_use_every_vector(spark, sf):
    vectors = by_label(spark, sf)
    used = sum(1 + len(x["chunks"]) for x in all_queries_and_chunks(spark, sf).collect())
    assert used == sum(map(len, vectors.values()))
    want = {(k, i // 6): methods(v[i], v[i + 1 : i + 6]) for k, v in vectors.items() for i in range(0, len(v), 6)}
    rows = catalogue.QUERIES["softmax_methods_all"](spark, sf).collect()
    names = ["method_a", "beta", "method_b_0_5", "method_b_1_0", "method_b_2_0"]
    assert len(rows) == len(want) and {(x["label"], x["block"]) for x in rows} == set(want)
    assert all(abs(x[n] - w) < 2e-6 for x in rows for n, w in zip(names, want[x["label"], x["block"]], strict=True))
