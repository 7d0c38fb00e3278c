"""Passages of held-out texts inside a corpus: SimHash of windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.words import Flat, combine, list_array, slices, words_of

BITS = 64
SHINGLE = 5
#: Words that are hashed into windows at once, which bounds the memory that a very long text takes. A multiple of every stride.
SEGMENT = 1 << 16


def sign_sums(hashes: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the signs of each bit over all pairs of neighbours of a flat array of word hashes; a row of zeros comes first.

    Pairs of words, not words, so that texts of one language are no nearer to each other than chance. The sums are kept modulo 256 (or 65,536): a window's sum is at most its length, so their difference is exact all the same.
    """
    own, codes = np.unique(combine(hashes[:-1], hashes[1:]), return_inverse=True)
    signs = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
    kind = np.int8 if longest < 128 else np.int16
    run = np.zeros((max(1, len(hashes)), BITS), kind)
    if len(own):
        np.cumsum(signs[codes], axis=0, dtype=kind, out=run[1:])
    return run


def prints_at(run: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The SimHash of the `window` words from each position of `at` on, as uint64."""
    return np.packbits((run[at + window - 1] - run[at]) > 0, axis=1).view(np.uint64).ravel()


def ladder(window: int, longest: int, ratio: float = 1.15) -> list[int]:
    """Window sizes from `window` up to `longest`, each about `ratio` times the one before."""
    out = [window]
    while (nxt := max(out[-1] + 1, round(out[-1] * ratio))) <= longest:
        out.append(nxt)
    return out


class HammingIndex:
    """Fingerprints under radius + 1 keys of their own: two within `radius` bits agree in at least one of radius + 1 blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, n = prints, radius, radius + 1
        ends = [round(BITS * k / n) for k in range(n + 1)]
        self.blocks = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            shift, mask = np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)
            key = (prints >> shift) & mask
            order = np.argsort(key, kind="stable")
            key = key[order]
            small = min(hi - lo, 20)
            self.blocks.append((shift, mask, order, key, small, np.bincount((key & np.uint64((1 << small) - 1)).astype(np.int64), minlength=1 << small) > 0))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every pair (index of query, index of fingerprint) within the radius, once."""
        qs, fs = [], []
        for shift, mask, order, key, small, seen in self.blocks:
            k = (queries >> shift) & mask
            hit = np.flatnonzero(seen[(k & np.uint64((1 << small) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(key, k[hit], "left"), np.searchsorted(key, k[hit], "right")
            n = hi - lo
            hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
            for part in np.array_split(np.arange(len(hit)), max(1, int(n.sum()) // 4_000_000 + 1)):  # bounded memory
                m = n[part]
                q = np.repeat(hit[part], m)
                f = order[np.repeat(lo[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                ok = np.bitwise_count(queries[q] ^ self.prints[f]) <= self.radius
                qs.append(q[ok])
                fs.append(f[ok])
        q, f = np.concatenate(qs), np.concatenate(fs)
        both = np.unique(q * np.int64(max(1, len(self.prints))) + f)
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A hash of every SHINGLE consecutive elements."""
    key = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        key = combine(key, hashes[k : k + len(key)])
    return key


def weighted_similarities(a: np.ndarray, b: np.ndarray, known: np.ndarray, weights: np.ndarray, rest: float = 1.0) -> np.ndarray:
    """Weighted Jaccard similarity of each row of `a` with that row of `b`, as sets of shingles.

    `known` are the items' shingles, sorted, and `weights` theirs; any other shingle weighs `rest`.
    """

    def weight(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return np.where(known[at] == x, weights[at], rest)

    def first(x: np.ndarray) -> np.ndarray:
        same = x[:, :, None] == x[:, None, :]
        return ~np.tril(same, -1).any(axis=2)

    out = np.zeros(len(a))
    step = max(1, 4_000_000 // max(1, a.shape[1] ** 2))  # bounded memory
    for lo in range(0, len(a), step):
        x, y = a[lo : lo + step], b[lo : lo + step]
        shared = (x[:, :, None] == y[:, None, :]).any(axis=2)
        wx, wy = weight(x) * first(x), weight(y) * first(y)
        both = (wx * shared).sum(axis=1)
        out[lo : lo + step] = both / np.maximum(wx.sum(axis=1) + wy.sum(axis=1) - both, 1e-12)
    return out


class Block:
    """The items of one block, ready to be searched for: their windows of all sizes under Hamming indexes, and shingle weights.

    Passages are windows of `window` words, at every place of every item. Item-sized windows take the longest size of a ladder
    that leaves `stride` places in the item, and stand at every place; so a document whose windows of that size are read at every
    `stride`-th word only has one that lies exactly on one of the item's.
    """

    def __init__(self, words: list[np.ndarray], window: int, stride: int, radius: int, item_radius: int):
        self.flat = np.concatenate(words)
        n = np.array([len(w) for w in words])
        self.owner = np.repeat(np.arange(len(words)), n)
        start = np.cumsum(n) - n
        self.marks = shingles(self.flat)
        within = self.owner[: len(self.marks)] == self.owner[SHINGLE - 1 :]
        once = np.unique(np.stack((self.owner[: len(self.marks)][within].astype(np.uint64), self.marks[within]), axis=1), axis=0)[:, 1]
        self.known, n_items = np.unique(once, return_counts=True)
        self.weights = 1.0 / n_items
        sizes = np.array(ladder(window, int(n.max())))
        fit = np.searchsorted(sizes, n - stride + 1, "right") - 1  # the ladder's place for each item, -1 if it is too short
        self.longest = int(sizes[max(0, fit.max())])
        run = sign_sums(self.flat, self.longest)
        every = np.flatnonzero(self.owner[: len(self.flat) - window + 1] == self.owner[window - 1 :])
        self.scales = [(window, 1, every, HammingIndex(prints_at(run, every, window), radius))]
        for k in np.unique(fit[fit >= 0]):
            size = int(sizes[k])
            at = np.concatenate([np.arange(start[i], start[i] + n[i] - size + 1) for i in np.flatnonzero(fit == k)])
            self.scales.append((size, stride, at, HammingIndex(prints_at(run, at, size), item_radius)))

    def search(self, doc: np.ndarray, h: np.ndarray, similarity: float) -> dict[tuple[int, int], list]:
        """(row, item) to [best similarity, whether a passage is equal, whether an item-sized window hit, places of windows that hit]."""
        got: dict[tuple[int, int], list] = {}
        for lo in range(0, len(h), SEGMENT):
            self.search_segment(doc[lo : lo + SEGMENT + self.longest - 1], h[lo : lo + SEGMENT + self.longest - 1], lo, similarity, got)
        return got

    def search_segment(self, doc: np.ndarray, h: np.ndarray, lo: int, similarity: float, got: dict[tuple[int, int], list]) -> None:
        run, own = sign_sums(h, self.longest), shingles(h)
        for scale, (size, stride, items, index) in enumerate(self.scales):
            at = np.arange(0, max(0, min(SEGMENT, len(h) - size + 1)), stride)
            at = at[doc[at] == doc[at + size - 1]]
            if not len(at):
                continue
            q, k = index.near(prints_at(run, at, size))
            if not len(q):
                continue
            left, right = at[q], items[k]
            seq, parts = np.arange(size), np.arange(size - SHINGLE + 1)
            step = max(1, 1_000_000 // size)
            same = np.concatenate([(h[left[s : s + step, None] + seq] == self.flat[right[s : s + step, None] + seq]).all(axis=1) for s in range(0, len(q), step)])
            sims = np.ones(len(q))
            sims[~same] = weighted_similarities(own[left[~same, None] + parts], self.marks[right[~same, None] + parts], self.known, self.weights)
            ok = sims >= similarity
            for i, j, eq, sim in zip(left[ok].tolist(), right[ok].tolist(), same[ok].tolist(), sims[ok].tolist(), strict=True):
                x = got.setdefault((int(doc[i]), int(self.owner[j])), [0.0, False, False, set()])
                x[0], x[1], x[2] = max(x[0], sim), x[1] or eq, x[2] or scale > 0
                x[3].add(lo + i)


def find_leaks(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, window: int = 20, radius: int = 3, item_radius: int = 8, similarity: float = 0.8, stride: int = 4, block_words: int = 500_000
) -> DataFrame:
    """Each document and item with a near-equal stretch: a passage of `window` words, or a window about as long as the item.

    Result: `doc_key`, `item_key`, similarity (of the nearest pair of windows: weighted Jaccard over 5-word shingles, weighted by
    rarity among the items), exact (a passage of `window` words occurs word for word), whole (an item-sized window hit), n_windows
    (places of the document whose windows hit). All windows within `radius` bits (`item_radius` for item-sized ones) of an item's
    window are found, and kept when the similarity is at least `similarity`; equal windows always are. One or two edited words
    move an item-sized window by 5 to 8 bits of 64, so `item_radius` finds nearly all that are similar enough; a passage of 20
    words is no longer similar when a word within it is edited, and is there for the equal ones. Null, empty and short texts
    (under `window` words) have no windows and no rows. Repeated keys count as one document or item. Other columns are ignored.

    The items are a stated query set: they go to the executors in blocks of at most `block_words` words (20 MB or so), every
    block against all documents. However many items there are, no block is larger.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_key).alias("doc"), words_of(doc_text).alias("words")).filter(F.size("words") >= window)
    asked = items.select(F.col(item_key).alias("item"), words_of(item_text).alias("words")).filter(F.size("words") >= window)
    doc_kind, item_kind = src.schema["doc"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()
    schema = f"doc {doc_kind}, item {item_kind}, similarity double, exact boolean, whole boolean, n_windows long"

    def search(block: tuple[list, list[np.ndarray]]):
        names, words = block
        sent = spark.sparkContext.broadcast((names, words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, words = sent.value
            own = Block(words, window, stride, radius, item_radius)
            for b in batches:
                for part in slices(b, 1, 40_000):
                    f = Flat(part.column(1))
                    got = own.search(f.doc, f.hashes(), similarity)
                    if got:
                        rows = [*got]
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0).take(pa.array([d for d, _ in rows])),
                                pa.array([names[i] for _, i in rows]),
                                pa.array([got[r][0] for r in rows], pa.float64()),
                                pa.array([got[r][1] for r in rows]),
                                pa.array([got[r][2] for r in rows]),
                                pa.array([len(got[r][3]) for r in rows], pa.int64()),
                            ],
                            names=["doc", "item", "similarity", "exact", "whole", "n_windows"],
                        )

        return src.mapInArrow(run, schema)

    found = None
    for block in item_blocks(asked, block_words):
        part = search(block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.groupBy(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).agg(
        F.max("similarity").alias("similarity"), F.max("exact").alias("exact"), F.max("whole").alias("whole"), F.max("n_windows").alias("n_windows")
    )


def item_blocks(asked: DataFrame, block_words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items' word hashes in blocks, one at a time; the driver holds no more than a block and a partition."""
    kind = asked.schema["item"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = Flat(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(f.hashes().view(np.int64), f.n, pa.int64())], names=["item", "h"])

    names: list = []
    words: list[np.ndarray] = []
    size = 0
    for r in asked.mapInArrow(hashed, f"item {kind}, h array<long>").toLocalIterator():
        w = np.array(r["h"], np.int64).view(np.uint64)
        if names and size + len(w) > block_words:
            yield names, words
            names, words, size = [], [], 0
        names.append(r["item"])
        words.append(w)
        size += len(w)
    if names:
        yield names, words
