"""Near-duplicate records with small edits, by a binary trie joined with itself under a Hamming error budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.nearsets import class_rows, components, signatures, trie_candidates, verified
from sievewright.session import materialize, release


@dataclass
class NearDuplicates:
    """rows: key, n_words, representative of every row with enough words; links: a < b, similarity of representatives."""

    rows: DataFrame
    links: DataFrame

    def groups(self) -> DataFrame:
        """key, group_id (the least key linked to it, over any number of links), n_links (texts that its own text is linked to)."""
        comp = components(self.links.select("a", "b"))
        degree = self.links.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count(F.lit(1)).alias("n_links"))
        r = self.rows.join(comp.withColumnRenamed("id", "representative"), "representative", "left").join(degree, "representative", "left")
        return r.select("key", F.coalesce("component", "representative").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))

    def pairs(self) -> DataFrame:
        """a < b, similarity of every two rows, copies expanded."""
        m = self.rows.select("key", "representative")
        x, y = m.select(F.col("key").alias("x"), F.col("representative").alias("a")), m.select(F.col("key").alias("y"), F.col("representative").alias("b"))
        near = self.links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
        same = x.join(y, F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("similarity"))
        return near.unionByName(same)


def near_duplicates(df: DataFrame, key: str, text: str, similarity: float = 0.75, min_words: int = 10, budget: int = 34) -> NearDuplicates:
    """Rows whose words, counted with repeats, are at least `similarity` alike (common / (a + b - common)).

    Null, empty and short texts (under `min_words` words) have no rows. `key` must be unique; repeated rows under other keys are
    copies: they share a representative, the least key of their class. Equal texts always meet; different ones meet when they
    share one of 48 minwise bands, which a pair at 0.75 misses with probability 1e-4, and their fingerprints of 128 bits differ
    in at most `budget` (a pair at 0.75 differs in 16 on average; beyond 34 with probability 1e-6). Every met pair is checked
    exactly. Other columns of `df` are ignored.
    """
    rows = materialize(class_rows(df, key, text, min_words), "classes")
    first = rows.groupBy("class_a", "class_b").agg(F.min("key").alias("representative"))
    members = rows.join(first, ["class_a", "class_b"]).select("key", "n_words", "representative")
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = texts.join(first, F.col("key") == F.col("representative"), "left_semi")
    signed = materialize(signatures(chosen, "key", "text"), "signatures")
    pairs = materialize(trie_candidates(signed, budget), "pairs")
    release(signed)
    links = materialize(verified(pairs, texts, "key", "text", similarity), "links")
    release(pairs)
    return NearDuplicates(members, links)
