"""Texts whose words, counted with repeats, are nearly the same: classes of equal texts, minwise bands, and the exact check.

The similarity of two texts is common / (a + b - common) over their words counted with repeats. Equal multisets of words form
one class; only one row of each class, its representative, goes on, so groups of copies cost no more than one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.words import Flat, combine, list_array, mix, words_of
from sievewright.operators.relational import estimated_bytes
from sievewright.session import materialize, release

#: Bands of rows. At similarity 0.75 a pair shares none of 48 bands of 6 with probability 1e-4, at 0.8 with 2e-7; so it is with 34
#: bands of 5 (at 0.8 1e-6), which cost less to hash and to shuffle, but hold more pairs that are not alike.
BANDS, ROWS = 48, 6
#: How large the table of shared bands may be, as written, to be broadcast.
SMALL_BYTES = 16 << 20
#: One bit of each of the first so many minwise values is the fingerprint of a text.
PRINT_BITS = 128


def element_hashes(flat: Flat) -> np.ndarray:
    """A hash of each one-word shingle together with its number among the equal ones before it: multisets become sets.

    The similarity is defined over words counted with repeats, so the shingles that minwise hashing samples are single words: only
    then is the chance that two texts agree in a minimum their similarity itself, whatever the order of the words.
    """
    return combine(flat.hashes(), flat.occurrences().astype(np.uint64))


def class_rows(df: DataFrame, key: str, text: str, min_words: int, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """key, n_words, class (two hashes of the multiset of words) and the carried columns of each row with enough words."""
    src = df.select(F.col(key).alias("key"), *carry, words_of(text).alias("words")).filter(F.size("words") >= min_words)
    kinds = src.schema.fields[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds) + "n_words int, class_a long, class_b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = Flat(b.column(len(kinds)))
            h = element_hashes(f)
            sums = []
            for part in (h, mix(h + np.uint64(1))):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
                sums.append(pa.array((total[f.start[1:]] - total[f.start[:-1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(f.n, pa.int32()), *sums], names=[*(k.name for k in kinds), "n_words", "class_a", "class_b"])

    return src.mapInArrow(run, schema)


def signatures(df: DataFrame, key: str, text: str, carry: list[str] = [], n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:  # noqa: B006
    """A row for each text: key, its fingerprint (print_hi, print_lo), and bands, a hash of each band's minwise values and number."""
    src = df.select(F.col(key).alias("key"), *carry, words_of(text).alias("words"))
    kinds = src.schema.fields[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds) + "print_hi long, print_lo long, bands array<long>"
    rng = np.random.default_rng(20_240_229)
    mul = rng.integers(1, 1 << 31, n_bands * n_rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, n_bands * n_rows, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                f = Flat(part.column(len(kinds)))
                h, rows = (element_hashes(f) >> np.uint64(32)).astype(np.uint32), len(f.n)  # 32 bits multiply several at once
                keys = np.zeros((rows, n_bands), np.uint64)
                bits = np.zeros((rows, PRINT_BITS), np.uint8)
                starts = np.minimum(f.start[:-1], max(0, len(h) - 1))
                for k in range(n_bands * n_rows):
                    v = h * mul[k] + add[k]
                    low = (np.minimum.reduceat(v, starts) if len(v) else np.zeros(rows, np.uint32)).astype(np.uint64)
                    low[f.n == 0] = 0
                    if k % n_rows == 0:
                        keys[:, k // n_rows] = k // n_rows
                    keys[:, k // n_rows] = combine(keys[:, k // n_rows], low)
                    if k < PRINT_BITS:
                        bits[:, k] = mix(low) & np.uint64(1)
                prints = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(prints[:, 0].copy().view(np.int64)), pa.array(prints[:, 1].copy().view(np.int64)), list_array(keys.ravel().view(np.int64), np.full(rows, n_bands), pa.int64())],
                    names=[*(k.name for k in kinds), "print_hi", "print_lo", "bands"],
                )

    return src.mapInArrow(run, schema)


def elements_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and elements (array<long>): a text's words, counted with repeats, as a set of hashes."""
    src = df.select(F.col(key).alias("key"), words_of(text).alias("words"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = Flat(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(element_hashes(f).view(np.int64), f.n, pa.int64())], names=["key", "elements"])

    return src.mapInArrow(run, f"key {kind}, elements array<long>")


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least as similar, with their similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("__want")).distinct()
    texts = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(wanted, F.col("__key") == F.col("__want"), "left_semi")
    sets = materialize(elements_of(texts, "__key", "__text"), "elements")
    x = sets.select(F.col("key").alias("a"), F.col("elements").alias("xs"))
    y = sets.select(F.col("key").alias("b"), F.col("elements").alias("ys"))
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("xs", "ys")).cast("double"))
    return both.select("a", "b", (F.col("common") / (F.size("xs") + F.size("ys") - F.col("common"))).alias("similarity")).filter(F.col("similarity") >= similarity)


def common_bits(a_hi: np.ndarray, a_lo: np.ndarray, b_hi: np.ndarray, b_lo: np.ndarray) -> np.ndarray:
    """How many leading bits two fingerprints share: the depth at which their paths in the trie part, PRINT_BITS if never."""

    def leading(x: np.ndarray) -> np.ndarray:
        for k in (1, 2, 4, 8, 16, 32):  # all bits below the highest one are set, then the zeros above it are counted
            x = x | (x >> np.uint64(k))
        return np.bitwise_count(~x).astype(np.int64)

    hi, lo = a_hi ^ b_hi, a_lo ^ b_lo
    return np.where(hi != 0, leading(hi), 64 + leading(lo))


def prefix_differences(a_hi: np.ndarray, a_lo: np.ndarray, b_hi: np.ndarray, b_lo: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """In how many of their first `depth` bits two fingerprints differ."""
    high, low = np.minimum(depth, 64), np.maximum(depth - 64, 0)
    cut = lambda x, n: np.where(n > 0, x >> (np.uint64(64) - np.maximum(n, 1).astype(np.uint64)), np.uint64(0))
    return np.bitwise_count(cut(a_hi ^ b_hi, high)).astype(np.int64) + np.bitwise_count(cut(a_lo ^ b_lo, low))


def forest_join(group: np.ndarray, side: np.ndarray, hi: np.ndarray, lo: np.ndarray, budget: int, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose fingerprints differ in at most `budget` bits: a binary trie joined with itself.

    The rows of a group, in the order of their bits, are a trie with compressed paths: a node is the range of rows that share a
    prefix, and its depth is that of the bit at which the range parts. Pairs of nodes go down together, all groups at once: at
    the next depth at which either of a pair parts, the bits in which their prefixes differ so far are counted, and a pair over
    the budget is dropped with all below it. A pair of nodes that part no more holds equal fingerprints on each side, and all of
    it is within the budget. In a group with rows of both sides, only pairs between sides count. `seen` takes the numbers of node
    pairs visited and pruned.
    """
    order = np.lexsort((lo, hi, side, group))
    group, side, hi, lo = group[order], side[order], hi[order], lo[order]
    n = len(group)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    edge = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1]))))
    first, last, g = edge, np.concatenate((edge[1:], [n])), group[edge]
    mate = np.zeros(len(edge), bool)
    mate[:-1] = g[:-1] == g[1:]
    alone = ~mate
    alone[1:] &= ~mate[:-1]
    k = np.flatnonzero(mate)
    waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
    left, right = [], []
    visited = pruned = 0

    def enter(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        """Count what the prefixes of node pairs differ in, prune, and leave the rest to wait for the depth at which they part."""
        nonlocal visited, pruned
        some = (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1 = (x[some] for x in (a0, a1, b0, b1))
        part = np.minimum(*(common_bits(hi[x], lo[x], hi[y - 1], lo[y - 1]) for x, y in ((a0, a1), (b0, b1))))
        ok = prefix_differences(hi[a0], lo[a0], hi[b0], lo[b0], part) <= budget
        visited += len(ok)
        pruned += int((~ok).sum())
        nodes = [x[ok] for x in (a0, a1, b0, b1)]
        part = part[ok]
        by = np.argsort(part, kind="stable")
        depths, at = np.unique(part[by], return_index=True)
        for d, rows in zip(depths.tolist(), np.split(by, at[1:]) if len(by) else (), strict=True):
            waiting.setdefault(d, []).append(tuple(x[rows] for x in nodes))

    enter(np.concatenate((first[alone], first[k])), np.concatenate((last[alone], last[k])), np.concatenate((first[alone], first[k + 1])), np.concatenate((last[alone], last[k + 1])))
    while waiting:
        depth = min(waiting)
        a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*waiting.pop(depth), strict=True))
        if depth == PRINT_BITS:  # equal on each side, and within the budget
            size = (a1 - a0) * (b1 - b0)
            s = np.concatenate(([0], np.cumsum(size)))
            inner, wide = np.arange(s[-1]) - np.repeat(s[:-1], size), np.repeat(b1 - b0, size)
            x, y = np.repeat(a0, size) + inner // wide, np.repeat(b0, size) + inner % wide
            ok = (x < y) | np.repeat(a0 != b0, size)
            left.append(order[x[ok]])
            right.append(order[y[ok]])
            continue
        word, shift = (hi, 63 - depth) if depth < 64 else (lo, 127 - depth)
        ones = np.concatenate(([0], np.cumsum(((word >> np.uint64(shift)) & np.uint64(1)).astype(np.int64))))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        two = a0 != b0  # a node with itself has no fourth pair
        enter(*(np.concatenate(x) for x in zip((a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), (am[two], a1[two], b0[two], bm[two]), strict=True)))
    if seen is not None:
        seen["visited"], seen["pruned"] = seen.get("visited", 0) + visited, seen.get("pruned", 0) + pruned
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def trie_candidates(signed: DataFrame, budget: int, most: int = 2048, side: str | None = None) -> DataFrame:
    """Distinct pairs (a < b) of keys that share a band and whose fingerprints differ in at most `budget` bits.

    With `side`, a column of 0 and 1 (a key may have a row of each), a is a key of side 0, b one of side 1, and only such pairs count.
    Bands are counted first, combined before the shuffle; those with rows to meet are written as a table of their own. Where that
    is small by its size on disk it goes to the rows as a broadcast, and fingerprints come along; beyond, rows and table meet in a
    join, whose hot bands are split by the optimizer, and fingerprints join what is left. A band of more than `most` rows is cut
    into chunks, and every two chunks that have to meet do so in a cell of their own, so that no task holds more than two chunks
    of a band, however many rows share it; no pair is lost.
    """
    sides = [] if side is None else [F.col(side).cast("int").alias("side")]
    bands = signed.select(*sides, F.explode("bands").alias("band"))
    if side is None:
        sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    else:
        sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("side").alias("__low"), F.max("side").alias("__high")).filter("__low < __high").drop("__low", "__high")
    sizes = materialize(sizes, "bands")
    small = estimated_bytes(sizes) <= SMALL_BYTES
    prints = ["print_hi", "print_lo"]
    every = signed.select("key", *sides, *(prints if small else []), F.explode("bands").alias("band"))
    rows = every.join(F.broadcast(sizes) if small else sizes, "band").withColumn("chunks", F.ceil(F.col("size") / most))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    if side is None:
        first, second, at = F.least("chunk", "other"), F.greatest("chunk", "other"), (F.col("chunk") > F.col("other")).cast("int")
    else:  # a cell has a chunk of each side
        of_b = F.col("side") == 1
        first, second, at = F.when(of_b, F.col("other")).otherwise(F.col("chunk")), F.when(of_b, F.col("chunk")).otherwise(F.col("other")), F.col("side")
    cell = F.when(F.col("chunks") == 1, F.col("band")).otherwise(F.xxhash64("band", first, second))
    cells = rows.select(cell.alias("cell"), at.alias("side"), "key", *(prints if small else []))
    if not small:
        own = signed.select("key", *prints)
        cells = cells.join(own if side is None else own.dropDuplicates(["key"]), "key")
    kind = cells.schema["key"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            col = lambda c, k: t.column(c).to_numpy().astype(np.int64).view(k)
            keys = t.column("key").combine_chunks()
            at = col("side", np.int64)
            x, y = forest_join(col("cell", np.int64), at, col("print_hi", np.uint64), col("print_lo", np.uint64), budget)
            if side is not None:
                x, y = x[at[x] != at[y]], y[at[x] != at[y]]
                x, y = np.where(at[x] == 0, x, y), np.where(at[x] == 0, y, x)
            if len(x):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(x)), keys.take(pa.array(y))], names=["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            cell = t.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], "left")) if len(cell) else 0  # the last cell may go on in the next batch
            yield from run(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from run(rest)

    pairs = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(join, f"a {kind}, b {kind}").filter("a != b")
    return (pairs if side is not None else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """id, component (its least id) of every node of the edges (a, b), by alternating large and small stars.

    The rounds needed grow with the logarithm of the longest chain; more than `rounds` is an error, not a partial result.

    Every round is a table in the shared folder; minima are combined before the shuffle, so hubs cost no more than other nodes.
    """
    e = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        old, e = e, materialize(small.filter("u != v").distinct(), "star")
        release(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
