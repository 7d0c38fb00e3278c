"""Token ids of a whole corpus through a table of distinct words.

Spark splits the texts into the tokenizer's own words, each distinct word is encoded once, and the ids go back to their places.
The commonest words, a number fixed by a parameter, travel to the executors as a dictionary; all others come back through a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.words import Flat
from sievewright.session import materialize

#: The split pattern of the byte-level BPE vocabularies, with white space spelled out as the JVM's regex engine needs it. Fixed value.
BYTE_BPE_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


def pretokens(text: str | Column) -> Column:
    """The tokenizer's words of a text, which together are the text; an empty array for null or empty texts."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(BYTE_BPE_WORD), F.lit(0))


def word_table(words: DataFrame, tokenizer_file: str) -> DataFrame:
    """word, n, word_ids: every distinct word of the array column `words`, how often it comes, and its ids, encoded once."""
    counted = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_file)
        t.encode_special_tokens = True
        for b in batches:
            ids = [e.ids for e in t.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "word_ids"])

    return counted.mapInArrow(encode, "word string, n long, word_ids array<int>")


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer_file: str, common_words: int = 50_000, common_chars: int = 48, long_words: int = 2_000, long_chars: int = 1_000) -> DataFrame:
    """`key` and ids (array<int>, never null) of every row, without special tokens.

    Null and empty texts give an empty list; blanks are text; the strings of special tokens are ordinary text. Repeated keys and
    rows keep a row each. Other columns are ignored. The commonest `common_words` words of at most `common_chars` characters, and the
    commonest `long_words` of at most `long_chars` (rules and separators may be in every text), are sent to the executors, some 20
    MB at most; words beyond that are joined, so the result doesn't depend on these figures.
    """
    spark = df.sparkSession
    src = df.select(F.col(key).alias("key"), pretokens(text).alias("words"))
    table = materialize(word_table(src, tokenizer_file), "words")
    size = F.char_length("word")
    short, long = (table.filter(some).orderBy(F.desc("n"), "word").limit(most) for some, most in ((size <= common_chars, common_words), ((size > common_chars) & (size <= long_chars), long_words)))
    common = short.unionByName(long).select("word", "word_ids").toArrow()
    flat_ids = common.column("word_ids").combine_chunks()
    known = spark.sparkContext.broadcast(
        (common.column("word").to_pylist(), pc.list_value_length(flat_ids).to_numpy(zero_copy_only=False).astype(np.int64), flat_ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
    )
    kind = src.schema["key"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n_ids, values = known.value
        place = {w: i for i, w in enumerate(names)}
        first = np.concatenate(([0], np.cumsum(n_ids)))
        for b in batches:
            f = Flat(b.column(1))
            own = f.uniques.to_pylist()
            at = np.fromiter((place.get(w, -1) for w in own), np.int64, len(own))
            rare = at < 0
            slot = np.cumsum(rare) - 1  # a rare word's number within the batch
            lens, begin = np.where(rare, 1, n_ids[at] if len(n_ids) else 0), np.where(rare, -1, first[at])
            n, lo = lens[f.codes], begin[f.codes]
            end = np.cumsum(n)
            inner = np.arange(end[-1] if len(end) else 0) - np.repeat(end - n, n)
            pos = np.repeat(lo, n) + inner
            ids = np.where(np.repeat(lo, n) < 0, 0, values[np.minimum(np.maximum(pos, 0), max(len(values) - 1, 0))] if len(values) else 0)
            hole = np.repeat(np.where(rare, slot, -1)[f.codes], n)
            word_end = np.concatenate(([0], end))
            per = word_end[f.start[1:]] - word_end[f.start[:-1]]
            missing: list[list[str] | None] = [None] * len(f.n)
            if rare.any():  # each text numbers its own rare words: -1, -2, ...
                doc = np.repeat(np.arange(len(per)), per)
                spots = np.flatnonzero(hole >= 0)
                pair, back = np.unique(doc[spots] * np.int64(len(own)) + hole[spots], return_inverse=True)
                owner = pair // len(own)
                number = np.arange(len(pair)) - np.searchsorted(owner, owner)
                ids[spots] = -1 - number[back]
                rare_words = [w for w, r in zip(own, rare, strict=True) if r]
                for d, w in zip(owner, pair % len(own), strict=True):
                    missing[d] = [*(missing[d] or []), rare_words[w]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(ids, pa.int32())), pa.array(missing, pa.list_(pa.string()))],
                names=["key", "ids", "missing"],
            )

    filled = materialize(src.mapInArrow(look_up, f"key {kind}, ids array<int>, missing array<string>").withColumn("row", F.monotonically_increasing_id()), "ids")
    whole = filled.filter(F.col("missing").isNull()).select(F.col("key").alias(key), "ids")
    open_ = filled.filter(F.col("missing").isNotNull())
    back = (
        open_.select("row", F.posexplode("missing").alias("place", "word"))
        .join(table, "word")
        .groupBy("row")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word_ids"))), lambda x: x["word_ids"]).alias("found"))
    )
    joined = open_.join(back, "row").select(
        F.col("key").alias(key), F.flatten(F.transform("ids", lambda x: F.when(x >= 0, F.array(x)).otherwise(F.element_at("found", F.abs(x))))).alias("ids")
    )
    return whole.unionByName(joined)


def piece_table(spark, tokenizer_file: str) -> DataFrame:
    """id, piece_bytes: what each id of a byte-level BPE vocabulary stands for; its size is that of the vocabulary."""
    import json

    with open(tokenizer_file) as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    rows = [(i, bytes(letter[c] for c in w) if all(c in letter for c in w) else w.encode()) for w, i in vocab.items()]
    return spark.createDataFrame(pa.table({"id": pa.array([r[0] for r in rows], pa.int32()), "piece_bytes": pa.array([r[1] for r in rows], pa.binary())}))


def decode_corpus(encoded: DataFrame, key: str, pieces: DataFrame) -> DataFrame:
    """`key` and text of every row of `key`, `ids`: each id is joined with its piece, in place.

    `pieces` has a row for each id of the vocabulary and so a fixed size; it goes to the executors as two arrays, and each batch
    of ids is joined by position, without a shuffle. Empty and null lists give empty texts; ids without a piece are left out;
    bytes that are no UTF-8 become U+FFFD. Repeated rows keep a row each; other columns are ignored.
    """
    table = pieces.select("id", "piece_bytes").toArrow().to_pydict()
    size = max(table["id"], default=-1) + 1
    parts = [b""] * size
    for i, b in zip(table["id"], table["piece_bytes"], strict=True):
        parts[i] = b
    lens = np.array([len(b) for b in parts], np.int64)
    sent = encoded.sparkSession.sparkContext.broadcast((lens, np.frombuffer(b"".join(parts), np.uint8)))
    src = encoded.select(F.col(key).alias("key"), F.col("ids").cast("array<int>").alias("ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, values = sent.value
        first = np.concatenate(([0], np.cumsum(lens)))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lists = part.column(1)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                known = (ids >= 0) & (ids < len(lens))
                width = np.where(known, lens[np.where(known, ids, 0)] if len(lens) else 0, 0)
                end = np.cumsum(width)
                at = np.repeat(first[np.where(known, ids, 0)] - end + width, width) + np.arange(end[-1] if len(end) else 0)
                data = values[at].tobytes() if len(at) else b""
                ends = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(n)))]
                texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return src.mapInArrow(join, f"key {src.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)
