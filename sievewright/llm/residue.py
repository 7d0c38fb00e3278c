"""Markup residue: which markup languages each text uses, and its clean text with the structure kept."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.labeller import Labeller, trained
from sievewright.llm.markup import KINDS, MARKUPS, clean, lines_of, paths, signs


def plain_sentences(df: DataFrame, key: str, text: str, most: int = 300) -> list[str]:
    """Sentences to train on, from at most `most` texts (the first by a hash of the key) without any character of markup."""
    plain = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").rlike(r"^[^<>\[\]{}\\$*#`~|=^&'+\r]{40,1500}$"))
    got = plain.orderBy(F.xxhash64("k"), "k").limit(most).toArrow().column("t").to_pylist()
    parts = [s.strip() for t in got for line in t.split("\n") for s in line.replace(". ", ".\n").split("\n")]
    return [s for s in dict.fromkeys(parts) if 20 <= len(s) <= 200 and s[0].isalpha() and s[-1] == "."]


def fit_labeller(df: DataFrame, key: str, text: str) -> Labeller:
    return trained(plain_sentences(df, key, text))


def residues(df: DataFrame, key: str, text: str, labeller: Labeller, sure: float = 0.5) -> DataFrame:
    """`key`, markups (sorted array), clean_text, n_lines and n_marked of every row.

    A line uses a markup language if the labeller says so (probability of at least `sure`, read in the context of the whole
    document) and one of its constructs belongs to that language. Null texts have no markups and a null clean text; empty ones
    an empty text. Headings become `# ` lines, items `- ` lines, code is fenced, table rows become `a | b`, formulas stay. Texts
    without markup come back unchanged but for line ends. Repeated rows get a row each; other columns are ignored.
    """
    src = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = src.schema["key"].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(labeller.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = part.column(1).to_pylist()
                docs = [(ls := lines_of(t or ""), paths(ls)) for t in texts]
                marks, cleaned, n, m = [], [], [], []
                for t, (lines, tag_paths), (p, k) in zip(texts, docs, own.label(docs), strict=True):
                    used = [{x for x, y in zip(MARKUPS, row, strict=True) if y >= sure and signs(path, x)} for row, path in zip(p, tag_paths, strict=True)]
                    found = set().union(*used)
                    marks.append(sorted(found))
                    cleaned.append(None if t is None else clean(lines, tag_paths, used, [KINDS[x] for x in k]) if found else "\n".join(lines))
                    n.append(len(lines) if t else 0)
                    m.append(sum(map(bool, used)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(marks, pa.list_(pa.string())), pa.array(cleaned, pa.string()), pa.array(n, pa.int32()), pa.array(m, pa.int32())], names=["key", "markups", "clean_text", "n_lines", "n_marked"]
                )

    return src.mapInArrow(run, f"key {kind}, markups array<string>, clean_text string, n_lines int, n_marked int").withColumnRenamed("key", key)
