"""Records of evaluation splits that occur, exactly or nearly, in the training split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.nearsets import class_rows, signatures, trie_candidates, verified
from sievewright.session import materialize, release


def normal_id(c: str) -> F.Column:
    """Letters and digits of an id, in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]", "")), F.lit(""))


@dataclass
class CrossSplit:
    """rows: key, side (0 train, 1 evaluation), instance, text; members: key, side, class of every row with enough words; links: a
    (class seen in train), b (class seen in evaluation), similarity."""

    rows: DataFrame
    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """train_key, eval_key, same_instance, similarity of every two rows, copies expanded."""
        x = self.members.filter("side = 0").select(F.col("key").alias("train_key"), F.col("class").alias("a"))
        y = self.members.filter("side = 1").select(F.col("key").alias("eval_key"), F.col("class").alias("b"))
        near = self.links.join(x, "a").join(y, "b").select("train_key", "eval_key", "similarity")
        same = x.join(y, F.col("a") == F.col("b")).select("train_key", "eval_key", F.lit(1.0).alias("similarity"))
        named = self.rows.filter("instance IS NOT NULL")
        by_id = named.filter("side = 0").select("instance", F.col("key").alias("train_key")).join(named.filter("side = 1").select("instance", F.col("key").alias("eval_key")), "instance")
        texts = near.unionByName(same).withColumn("same_instance", F.lit(False))
        ids = by_id.select("train_key", "eval_key", F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("same_instance"))
        return texts.unionByName(ids).groupBy("train_key", "eval_key").agg(F.max("same_instance").alias("same_instance"), F.max("similarity").alias("similarity"))

    def classes(self) -> DataFrame:
        """key, side, class (the least key with the same words; the row itself for short texts), n_links (classes of the other side
        that are near-equal, its own among them where both sides have it), n_same_instance (rows of the other side that name the
        instance). One row for each row; nothing is expanded."""
        both = self.members.groupBy("class").agg(F.count_distinct("side").alias("__sides"))
        ends = self.links.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("class")), F.struct(F.lit(1).alias("side"), F.col("b").alias("class")))).alias("x")).select("x.*")
        n = ends.groupBy("side", "class").agg(F.count(F.lit(1)).alias("__links"))
        m = self.members.join(both, "class").join(n, ["side", "class"], "left").select("key", "class", (F.coalesce("__links", F.lit(0)) + (F.col("__sides") > 1).cast("long")).alias("n_links"))
        named = self.rows.groupBy("instance").agg(F.count_if(F.col("side") == 0).alias("__0"), F.count_if(F.col("side") == 1).alias("__1"))
        r = self.rows.select("key", "side", "instance").join(m, "key", "left").join(named, "instance", "left")
        other = F.when(F.col("side") == 0, F.col("__1")).otherwise(F.col("__0"))
        return r.select("key", "side", F.coalesce("class", "key").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce(other, F.lit(0).cast("long")).alias("n_same_instance"))


def cross_split(
    df: DataFrame, key: str, instance: str, text: str, split: str, train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("valid", "test"), similarity: float = 0.75, min_words: int = 10, budget: int = 34
) -> CrossSplit:
    """Training and evaluation rows that name the same instance or have near-equal texts.

    Near-equal: the words, counted with repeats, are at least `similarity` alike, over texts of at least `min_words` words. Null
    ids, and ids without a letter or digit, never match; null, empty and short texts match by id only. Rows of other or null
    splits are left out. `key` must be unique; repeated rows under other keys are rows of their own. Other columns are ignored.

    Texts with equal words form classes. Their shingles (single words with their number among equal ones, see nearsets) are hashed
    minwise into bands; within a band only classes seen in train meet classes seen in evaluation, in cells of a bounded size, and
    those whose minwise fingerprints are within `budget` bits are checked exactly. A pair at 0.75 is missed with probability 1e-4.
    """
    side = F.when(F.col(split).isin(*train), 0).when(F.col(split).isin(*evaluation), 1)
    rows = df.select(F.col(key).alias("key"), side.alias("side"), normal_id(instance).alias("instance"), F.col(text).alias("text")).filter("side IS NOT NULL")
    classed = materialize(class_rows(rows, "key", "text", min_words, ["side"]), "classes")
    first = classed.groupBy("class_a", "class_b").agg(F.min("key").alias("class"), F.sort_array(F.collect_set("side")).alias("sides"))
    members = materialize(classed.join(first.select("class_a", "class_b", "class"), ["class_a", "class_b"]).select("key", "side", "class"), "members")
    chosen = rows.select("key", "text").join(first.select(F.col("class").alias("key"), "sides"), "key")
    signed = materialize(signatures(chosen, "key", "text", ["sides"], 34, 5), "signatures")
    release(classed)
    pairs = materialize(trie_candidates(signed.withColumn("side", F.explode("sides")), budget, side="side"), "pairs")
    release(signed)
    links = materialize(verified(pairs, rows, "key", "text", similarity), "links")
    release(pairs)
    return CrossSplit(rows, members, links)


def overlap_report(overlaps: DataFrame, df: DataFrame, key: str, split: str, source: str) -> DataFrame:
    """Counts for each evaluation split and source: n_rows, n_overlapping (rows with a pair), n_pairs, and the share overlapping."""
    per = overlaps.groupBy(F.col("eval_key").alias("__key")).agg(F.count(F.lit(1)).alias("__pairs"))
    rows = df.select(F.col(key).alias("__key"), F.col(split).alias("split"), F.col(source).alias("source")).join(per, "__key", "left")
    out = rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("__pairs").alias("n_overlapping"), F.coalesce(F.sum("__pairs"), F.lit(0).cast("long")).alias("n_pairs"))
    return out.withColumn("share", F.round(F.col("n_overlapping") / F.col("n_rows"), 6))
