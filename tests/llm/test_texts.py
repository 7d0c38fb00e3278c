"""The text operators on small fixtures: nulls, empty and very long texts, ties, repeats, clashing names."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import endings, leaks, markup, mojibake, nearsets, pairs, repetition, splitting, tokens, truncation, words
from sievewright.llm.crosssplit import cross_split, overlap_report
from sievewright.llm.labeller import Labeller, Renderer, PLAIN, pad, trained
from sievewright.llm.neardup import near_duplicates
from sievewright.llm.queries import tokenizer_path
from sievewright.llm.residue import residues

WORD = re.compile(r"\w+")


def texts_df(spark, texts, extra=True):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, body string")
    return df.withColumn("key", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("text", F.lit(None).cast("int")) if extra else df


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n)]


def prose(r, vocab, n):
    return " ".join(r.choice(vocab) for _ in range(n))


# words ---------------------------------------------------------------------------------------------------------------------------
def test_words_are_python_words(spark):
    samples = ["Hello_World 3x", "", None, "ÄÖ ñ çé 一二 ½ x²", "a-b'c", "  ", "Ωμέγα Привет"]
    got = [r[0] for r in texts_df(spark, samples).select(words.words_of("body")).collect()]
    assert got == [WORD.findall((s or "").lower()) for s in samples]


def test_flat_occurrences():
    f = words.Flat(pa.array([["a", "b", "a"], None, [], ["a", "a"]]))
    assert f.occurrences().tolist() == [0, 0, 1, 0, 1] and f.n.tolist() == [3, 0, 0, 2]


# splitting -----------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("limit,overlap", [(50, 10), (300, 0), (80, 79)])
def test_pieces_round_trip(limit, overlap):
    r = random.Random(limit)
    for _ in range(60):
        t = "".join(r.choice(["word ", "x" * r.randint(1, 120), ". ", "\n", "\n\n", "# h\n", "句。", "🙂"]) for _ in range(r.randint(1, 60)))
        got = splitting.pieces(t, limit, overlap)
        ps = [t[s:e] for (s, _), e in zip(got, [x + overlap for x, _ in got[1:]] + [len(t)], strict=True)]
        assert all(len(p) <= limit for p in ps)
        assert all(not overlap or b.startswith(a[-overlap:]) for a, b in zip(ps, ps[1:]))
        assert ps[0] + "".join(p[overlap:] for p in ps[1:]) == t


def test_split_oversized_table(spark):
    long = "Some words here. " * 400
    df = texts_df(spark, [None, "", "short", long, long, "y" * 100_001]).withColumn("piece", F.lit(1))
    out = splitting.split_oversized(df, ["id"], "body", 3000, 200)
    n = {r["id"]: (r["n"], r["m"]) for r in out.groupBy("id").agg(F.count("*").alias("n"), F.max("n_pieces").alias("m")).collect()}
    assert set(n) == {3, 4, 5} and all(a == b for a, b in n.values())
    assert out.filter("id = 3 AND boundary = 'sentence'").count() > 0 and out.filter("id = 5 AND boundary = 'character'").count() > 0
    assert splitting.split_oversized(df.limit(0), ["id"], "body").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, ["id"], "body", 10, 10)


# repetition ----------------------------------------------------------------------------------------------------------------------
def brute_share(t):
    w = WORD.findall((t or "").lower())
    seen, hit = set(), set()
    for i in range(len(w) - 4):
        g = tuple(w[i : i + 5])
        if g in seen:
            hit |= set(range(i, i + 5))
        seen.add(g)
    return len(w), len(hit)


def test_shares_against_brute_force(spark):
    r = random.Random(1)
    samples = [None, "", " ", "a b c", "x " * 50, "a b c d e a b c d e"] + [prose(r, vocabulary(2, 4), r.randint(0, 80)) for _ in range(80)]
    got = {x["id"]: (x["n_words"], x["n_repeated"]) for x in repetition.repeated_share(texts_df(spark, samples), ["id"], "body").collect()}
    assert got == {i: brute_share(s) for i, s in enumerate(samples)}


def test_repetitive_keeps_the_definition(spark):
    r = random.Random(3)
    samples = [prose(r, vocabulary(4, 300), 40) for _ in range(150)] + ["one two three four five six " * k for k in (1, 2, 3, 9)] + [None, "", "a b"]
    df = texts_df(spark, samples).withColumn("stratum", F.when(F.col("id") % 2 == 0, "even"))
    found = repetition.repetition(df, ["id"], "body", ["stratum"])
    out = found.rows
    assert out.count() == len(samples)
    want = {i for i, s in enumerate(samples) if (n := brute_share(s))[0] >= 10 and n[1] / n[0] >= 0.35}
    assert {x["id"] for x in out.filter("repetitive").collect()} == want
    assert out.filter("repetitive AND NOT rejected").count() == 0
    assert out.filter("screen_share < share").count() == 0
    rep = found.report().collect()
    assert sum(x["n_rows"] for x in rep) == out.count() and sum(x["n_repetitive"] for x in rep) == len(want) and {x["n_lost"] for x in rep} == {0}
    none = repetition.repetition(df.limit(0), ["id"], "body", ["stratum"])
    assert none.rows.count() == 0 and none.report().count() == 0


def test_cutoffs_limit_false_rejection(spark):
    """Two strata with different habits get different cutoffs, and neither rejects more sound texts than the risk."""
    r = random.Random(21)
    v, few = vocabulary(22), vocabulary(23, 40)
    rows = []
    for i in range(2400):
        loose = i % 2
        t = prose(r, few if loose else v, r.randint(30, 60))
        rows.append((i, "loose" if loose else None, t + (" " + t) * 3 if i % 9 == 0 else t))
    df = spark.createDataFrame(rows, "id long, stratum string, body string")
    found = repetition.repetition(df, ["id"], "body", ["stratum"], holdout=800)
    rep = {x["stratum"]: x for x in found.report().collect()}
    assert rep[None]["cutoff"] < rep["loose"]["cutoff"]
    for x in rep.values():
        assert x["n_repetitive"] and x["n_lost"] == 0
        if x["safe"]:
            assert x["upper_bound"] <= 0.05 and x["n_false"] / (x["n_rows"] - x["n_repetitive"]) <= 0.05
    assert rep[None]["safe"]


def test_binomial_bound():
    assert repetition.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert repetition.binomial_upper(0, 0, 0.05) == 1.0 and repetition.binomial_upper(5, 5, 0.05) == 1.0
    assert 0.05 < repetition.binomial_upper(5, 100, 0.05) < 0.11


# tokens --------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("common", [0, 3, 50_000])
def test_ids_equal_the_tokenizers_own(spark, common):
    from tokenizers import Tokenizer

    path = tokenizer_path(spark)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    samples = [None, "", "  ", " a", "it's  a\u00a0test\n\n\tof <|endoftext|> 123", "一二 🙂 naïve ½", "x" * 5000, "a a a b", "a a a b", "end \n "]
    out = tokens.encode_corpus(texts_df(spark, samples), "id", "body", path, common_words=common)
    got = {r["id"]: list(r["ids"]) for r in out.collect()}
    assert got == {i: t.encode(s or "", add_special_tokens=False).ids for i, s in enumerate(samples)}
    back = tokens.decode_corpus(out, "id", tokens.piece_table(spark, path))
    assert {r["id"]: r["text"] for r in back.collect()} == {i: s or "" for i, s in enumerate(samples)}


def test_repeated_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "three"), (None, "one")], "id int, body string")
    out = tokens.encode_corpus(df, "id", "body", tokenizer_path(spark), common_words=1)
    assert sorted(len(r["ids"]) for r in out.collect()) == [1, 1, 2]
    assert tokens.encode_corpus(df.limit(0), "id", "body", tokenizer_path(spark)).count() == 0


# leaks ---------------------------------------------------------------------------------------------------------------------------
def test_leaks_against_brute_force(spark):
    r = random.Random(7)
    v = vocabulary(8)
    items = [prose(r, v, r.randint(15, 60)) for _ in range(12)] + [None, ""]
    docs = [None, "", "short"]
    for _ in range(60):
        k = r.randrange(12)
        w = items[k].split()
        n = r.choice([10, 19, 20, 25])
        a = r.randint(0, max(0, len(w) - n))
        docs.append(prose(r, v, r.randint(0, 40)) + " " + ", ".join(w[a : a + n]).upper() + " " + prose(r, v, 5))
    got = leaks.find_leaks(texts_df(spark, docs), "id", "body", texts_df(spark, items).withColumnRenamed("id", "item"), "item", "body", block_words=100)
    grams = lambda t: {tuple(w[i : i + 20]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 19)}
    want = {(i, k) for i, d in enumerate(docs) for k, x in enumerate(items) if grams(d) & grams(x)}
    assert want and {(x["id"], x["item"]) for x in got.filter("exact").collect()} == want
    assert got.filter("similarity < 0.8 OR similarity > 1").count() == 0
    none = texts_df(spark, [None]).withColumnRenamed("id", "item")
    assert leaks.find_leaks(texts_df(spark, docs), "id", "body", none, "item", "body").count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_edited_items_are_found(spark, edits):
    """Whole items of 50 to 120 words with words replaced, inserted or left out: of those that stay similar enough by brute force
    over all windows, at least 0.9 are found."""
    r = random.Random(40 + edits)
    v = vocabulary(41, 3000)
    items = [prose(r, v, r.randint(50, 120)) for _ in range(150)]
    docs = []
    for t in items:
        w = t.split()
        for _ in range(edits):
            i = r.randrange(len(w))
            w[i : i + r.choice((0, 1))] = r.choice(([], [r.choice(v)]))
        docs.append(" ".join([prose(r, v, r.randint(0, 30)), *w, prose(r, v, r.randint(0, 30))]))
    hashes = lambda t: words.Flat(pa.array([WORD.findall(t)])).hashes()
    block = leaks.Block([hashes(t) for t in items], 20, 4, 3, 8)
    similar = set()
    for k, d in enumerate(docs):
        size = next(s for s, _, at, _ in block.scales[1:] if (block.owner[at] == k).any())
        rows = lambda t: np.lib.stride_tricks.sliding_window_view(leaks.shingles(hashes(t)), size - 4)
        a, b = rows(d), rows(items[k])
        if max(leaks.weighted_similarities(a, np.repeat(x[None], len(a), 0), block.known, block.weights).max() for x in b) >= 0.8:
            similar.add(k)
    found = leaks.find_leaks(texts_df(spark, docs), "id", "body", texts_df(spark, items).withColumnRenamed("id", "item"), "item", "body")
    got = {x["id"] for x in found.filter("whole AND id = item").collect()}
    assert len(similar) > 50 and len(got & similar) >= 0.9 * len(similar)
    assert found.filter("id != item").count() == 0


def test_leaks_of_very_long_texts(spark):
    """A text of several segments: the passages at its start, at the edge of a segment and at its end are found."""
    r = random.Random(43)
    v = vocabulary(44, 2000)
    items = [prose(r, v, 60) for _ in range(3)]
    n = leaks.SEGMENT
    long = " ".join([items[0], prose(r, v, n - 90), items[1], prose(r, v, n + 5), items[2]])
    got = leaks.find_leaks(texts_df(spark, [long]), "id", "body", texts_df(spark, items).withColumnRenamed("id", "item"), "item", "body").collect()
    assert {(x["item"], x["exact"], x["whole"], x["similarity"]) for x in got} == {(k, True, True, 1.0) for k in range(3)}


def test_hamming_index_is_exact():
    r = np.random.default_rng(4)
    a = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a[r.integers(0, 300, 400)] ^ (np.uint64(1) << r.integers(0, 63, 400).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 400).astype(np.uint64))
    q, f = leaks.HammingIndex(a, 3).near(b)
    want = {(i, j) for i in range(400) for j in range(300) if bin(int(b[i] ^ a[j])).count("1") <= 3}
    assert set(zip(q.tolist(), f.tolist(), strict=True)) == want


# near duplicates -----------------------------------------------------------------------------------------------------------------
def similarity(a, b):
    x, y = Counter(WORD.findall(a.lower())), Counter(WORD.findall(b.lower()))
    c = sum((x & y).values())
    return c / (sum(x.values()) + sum(y.values()) - c)


def edited(r, v, t, share):
    w = t.split()
    for i in range(len(w)):
        if r.random() < share:
            w[i] = r.choice(v)
    if r.random() < 0.3:
        r.shuffle(w)
    return " ".join(w)


@pytest.fixture(scope="module")
def near_samples():
    r = random.Random(11)
    v = vocabulary(12)
    base = [prose(r, v, r.randint(12, 60)) for _ in range(25)]
    out = [None, "", "too few words", "A b c d e f g h i j", "j I h g f e d c b a"]
    for b in base:
        out += [b, b.upper(), *[edited(r, v, b, s) for s in (0.02, 0.06, 0.1, 0.2, 0.4)]]
    return out


def test_near_duplicates_against_brute_force(spark, near_samples):
    nd = near_duplicates(texts_df(spark, near_samples), "id", "body")
    ok = [i for i, s in enumerate(near_samples) if s and len(WORD.findall(s)) >= 10]
    want = {(i, j) for i in ok for j in ok if i < j and similarity(near_samples[i], near_samples[j]) >= 0.75}
    assert {(x["a"], x["b"]) for x in nd.pairs().collect()} == want
    parent = {i: i for i in ok}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in want:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert {x["key"]: x["group_id"] for x in nd.groups().collect()} == {i: root(i) for i in ok}


def test_near_duplicates_of_nothing(spark):
    nd = near_duplicates(texts_df(spark, [None, "", "x"]), "id", "body")
    assert nd.pairs().count() == 0 and nd.groups().count() == 0


def test_hot_band_is_cut_into_cells_without_loss(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 2, dtype=np.int64)
    rows = []
    for i in range(150):
        hi, lo = base ^ (np.int64(1) << r.integers(0, 62, 2)) if i % 3 else r.integers(0, 1 << 62, 2)
        rows.append((7, i, int(hi), int(lo)))
    rows += [(8, 500, 1, 1), (9, 501, 1, 1), (9, 502, 1, 3)]
    df = spark.createDataFrame([([b], k, hi, lo) for b, k, hi, lo in rows], "bands array<long>, key long, print_hi long, print_lo long")
    want = {
        (min(a[1], b[1]), max(a[1], b[1]))
        for i, a in enumerate(rows)
        for b in rows[:i]
        if a[0] == b[0] and sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a[2:], b[2:], strict=True)) <= 10
    }
    for most in (4, 40, 2048):
        got = [(x["a"], x["b"]) for x in nearsets.trie_candidates(df, 10, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_both_ways_to_the_shared_bands_are_the_same(spark, near_samples, monkeypatch):
    signed = nearsets.signatures(texts_df(spark, [t or "" for t in near_samples]), "id", "body").withColumn("sides", F.when(F.col("key") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("key") % 2).cast("int"))))
    got = []
    for most in (nearsets.SMALL_BYTES, -1):
        monkeypatch.setattr(nearsets, "SMALL_BYTES", most)
        got.append([{(x["a"], x["b"]) for x in f.collect()} for f in (nearsets.trie_candidates(signed, 34, 8), nearsets.trie_candidates(signed.withColumn("side", F.explode("sides")), 34, 8, side="side"))])
    assert got[0] == got[1] and all(got[0])


def test_forest_join_levels():
    r = np.random.default_rng(6)
    n = 400
    hi, lo = r.integers(0, 8, n).astype(np.uint64) << np.uint64(60), r.integers(0, 16, n).astype(np.uint64)
    group = r.integers(0, 3, n)
    x, y = nearsets.forest_join(group, np.zeros(n, np.int64), hi, lo, 2)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and bin(int(hi[i] ^ hi[j])).count("1") + bin(int(lo[i] ^ lo[j])).count("1") <= 2}
    assert got == want and len(x) == len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(3, 3)]
    got = {x["id"]: x["component"] for x in nearsets.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and len(got) == 101


def test_cross_split_against_brute_force(spark, near_samples):
    r = random.Random(13)
    rows = []
    for i, s in enumerate(near_samples):
        rows.append((i, r.choice(["a/b-1", "A_B 1", "x2", None, "--", f"u{i}"]), r.choice(["train", "train", "valid", "test", None, "other"]), r.choice(["s", "t", None]), s))
    df = spark.createDataFrame(rows, "id long, inst string, split string, source string, body string").withColumn("key", F.lit(0)).withColumn("side", F.lit(0)).withColumn("instance", F.lit(0))
    found = cross_split(df, "id", "inst", "body", "split")
    got = found.pairs()
    norm = lambda x: re.sub(r"[\W_]", "", x or "").lower() or None
    long = lambda s: s and len(WORD.findall(s)) >= 10
    want = set()
    for a in rows:
        for b in rows:
            if a[2] == "train" and b[2] in ("valid", "test"):
                if (norm(a[1]) and norm(a[1]) == norm(b[1])) or (long(a[4]) and long(b[4]) and similarity(a[4], b[4]) >= 0.75):
                    want.add((a[0], b[0]))
    assert {(x["train_key"], x["eval_key"]) for x in got.collect()} == want
    rep = overlap_report(got, df.filter("split IN ('valid', 'test')"), "id", "split", "source")
    assert rep.agg(F.sum("n_pairs")).first()[0] == len(want)
    assert cross_split(df.limit(0), "id", "inst", "body", "split").pairs().count() == 0
    # one row for each row, with the number of distinct texts it is linked to on the other side
    cls = {x["key"]: x for x in found.classes().collect()}
    side = {a[0]: 0 if a[2] == "train" else 1 for a in rows if a[2] in ("train", "valid", "test")}
    assert {k: x["side"] for k, x in cls.items()} == side
    body, inst = {a[0]: a[4] for a in rows}, {a[0]: norm(a[1]) for a in rows}
    for k, x in cls.items():
        others = [j for j in side if side[j] != side[k]]
        near = {tuple(sorted(WORD.findall(body[j].lower()))) for j in others if long(body[j]) and long(body[k]) and similarity(body[j], body[k]) >= 0.75}
        assert x["n_links"] == len(near) and x["n_same_instance"] == sum(1 for j in others if inst[k] and inst[j] == inst[k])


def test_hot_band_across_sides_is_cut_into_cells_without_loss(spark):
    r = np.random.default_rng(9)
    rows = [(int(r.choice([7, 7, 7, 8, 9])), i, int(r.integers(0, 3)), int(r.integers(0, 16)), int(r.integers(0, 4))) for i in range(120)]
    df = spark.createDataFrame([([b], k, [s] if s < 2 else [0, 1], hi, lo) for b, k, s, hi, lo in rows], "bands array<long>, key long, sides array<int>, print_hi long, print_lo long")
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and a[0] == b[0] and a[2] != 1 and b[2] != 0 and sum(bin(x ^ y).count("1") for x, y in zip(a[3:], b[3:], strict=True)) <= 2}
    for most in (3, 25, 2048):
        got = [(x["a"], x["b"]) for x in nearsets.trie_candidates(df.withColumn("side", F.explode("sides")), 2, most, side="side").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_trie_visits_few_node_pairs_and_prunes():
    """Fingerprints of 200 sources with 10 near copies each, all in one group: the trie meets under a quarter of two million pairs."""
    r = np.random.default_rng(8)
    n = 2000
    flips = np.zeros((n, 2), np.uint64)
    for _ in range(2):
        flips[np.arange(n), r.integers(0, 2, n)] ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    prints = np.repeat(r.integers(0, 1 << 63, (n // 10, 2), dtype=np.uint64), 10, axis=0) ^ flips
    seen: dict[str, int] = {}
    x, y = nearsets.forest_join(np.zeros(n, np.int64), np.zeros(n, np.int64), prints[:, 0].copy(), prints[:, 1].copy(), 4, seen)
    assert len(x) == n // 10 * 45 and set((x // 10 == y // 10).tolist()) == {True}
    assert seen["visited"] < n * n / 2 / 4 and 0 < seen["pruned"] < seen["visited"]


@pytest.mark.parametrize("edits", [0.02, 0.05, 0.08])
def test_minwise_bands_lose_no_pair_of_small_edits(spark, edits):
    """Recall of the candidates alone, against brute force over every pair at 0.75 or more."""
    r = random.Random(int(edits * 100))
    v = vocabulary(31)
    texts = [t for _ in range(150) for b in [prose(r, v, r.randint(12, 80))] for t in (b, edited(r, v, b, edits))]
    signed = nearsets.signatures(texts_df(spark, texts), "id", "body")
    got = {(x["a"], x["b"]) for x in nearsets.trie_candidates(signed, 34).collect()}
    want = {(i, i + 1) for i in range(0, 300, 2) if similarity(texts[i], texts[i + 1]) >= 0.75 and texts[i] != texts[i + 1]}
    assert want and want <= got


# endings and truncation ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text,kind",
    [("", "blank"), (" \n", "blank"), ("It is done.", "closed"), ("It is done. (optional)", "closed"), ("It is do", "cut"), ("Done.\n2.", "cut"), ("<a>\nx.\n", "open"), ("<a>\nx.\n</a>", "closed"), ("```\nx = 1", "open"), ("```\nx\n```", "closed"),
     ("Pa\ufffd", "broken"), ("fr&am", "broken"), ("rand\\u00", "broken"), ("Done. See a/b.py", "weak"), ("Done.\nprint(f(8), 'x')", "weak"), ("## Sugge", "cut"), ("好的。", "closed"), ("Is it? \u3000", "closed")],
)
def test_endings(text, kind):
    assert endings.ending(text) == kind


def test_truncated_lengths_are_found(spark):
    r = random.Random(17)
    v = vocabulary(18)
    rows = []
    for i in range(900):
        t = ". ".join(prose(r, v, r.randint(5, 12)).capitalize() for _ in range(r.randint(3, 40))) + "."
        rows.append((i, "a" if i % 2 else None, t[:1000] if i % 2 else t))
    rows += [(1000, "a", None), (1001, "a", ""), (1002, None, "It stops in mid"), (1003, None, "x" * 50_000)]
    df = spark.createDataFrame(rows, "id long, model string, body string").withColumn("n_chars", F.lit("clash"))
    out = truncation.truncated(df, ["id"], "body", ["model"])
    got = {x["id"]: x for x in out.collect()}
    cut = {i for i, m, t in rows if t and len(t) == 1000 and not t.rstrip().endswith(".")}
    assert len(cut) > 20 and {i for i, x in got.items() if x["cause"] == "fixed_length"} == cut
    assert got[1002]["cause"] == "mid_transfer" and 1000 not in got and 1001 not in got
    rates = {x["model"]: x for x in truncation.truncation_rates(out, ["model"]).collect()}
    assert rates["a"]["lengths"] == [1000] and rates[None]["lengths"] == []
    assert truncation.truncated(df.limit(0), ["id"], "body", ["model"]).count() == 0


def test_poisson_tail():
    assert truncation.poisson_tail(0, 3.0) == 1.0 and truncation.poisson_tail(1, 0.5) == pytest.approx(1 - np.exp(-0.5))
    assert truncation.poisson_tail(50, 1.0) < 1e-60 and truncation.poisson_tail(2, 5.0) == pytest.approx(1 - 6 * np.exp(-5))


# pairs ---------------------------------------------------------------------------------------------------------------------------
EN = ["The reader stops after the second file and nothing is written.", "A lock is taken twice when two workers share the same queue.", "The value that was set before the call is lost in between."]
DE = ["Der Wert wird nicht gesetzt, weil die Liste leer ist und niemand wartet.", "Wir müssen den Schlüssel prüfen, bevor die Verbindung geschlossen wird.", "Die Ausgabe bleibt unvollständig, obwohl die Größe stimmt."]


@pytest.fixture(scope="module")
def judge(spark):
    docs = spark.createDataFrame([(i, f"{i} " + " ".join(EN if i % 2 else DE), "EN " if i % 2 else "de") for i in range(60)] + [(99, None, None)], "id long, body string, lang string")
    languages = pairs.fit_languages(docs, "body", "lang", "id")
    ends = pairs.fit_ends(docs, "id", "body")
    prompts = spark.createDataFrame([("p", "Do it.\n\n[ISSUE]\n" + " ".join(EN) + "\n\n[CODE]\nx"), ("n", None)], "pid string, ask string").withColumn("raw", F.lit(1))

    def run(rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, pid string, raw string, rc string, rs string").withColumn("key", F.lit(1)).withColumn("prompt", F.lit(1))
        got = pairs.defective_pairs(df, "id", "pid", "raw", ("rc", "rs"), prompts, "ask", languages, ends)
        return [x["defect"] for x in got.orderBy("id").collect()]

    return run


def answer(rc, rs):
    return f"# Root Cause:\n{rc}\n\n# Repair Suggestion:\n{rs}"


GOOD = ("The queue was built before the lock was known to both of them.", "Release the lock in one place, so that nobody waits for it again.")


def test_defects(judge):
    foreign = " ".join(DE)
    rows = [
        ("p", answer(*GOOD), *GOOD),
        ("p", answer("I'm sorry, but I can't help.", GOOD[1]), "I'm sorry, but I can't help.", GOOD[1]),
        ("p", answer(GOOD[0], foreign), GOOD[0], foreign),
        ("p", answer(" ".join(EN), GOOD[1]), " ".join(EN), GOOD[1]),
        ("p", answer(GOOD[0], GOOD[1][:40]), GOOD[0], GOOD[1][:40]),
        ("p", answer(GOOD[0], "N/A"), GOOD[0], "N/A"),
        ("p", None, None, None),
        ("p", "", "", " "),
        ("p", answer(GOOD[0] + " The message is „" + DE[0] + "“.", GOOD[1]), GOOD[0] + " The message is „" + DE[0] + "“.", GOOD[1]),
        ("p", answer("I cannot rule out that it is the lock. " + GOOD[0], GOOD[1]), "I cannot rule out that it is the lock. " + GOOD[0], GOOD[1]),
        ("missing", answer(*GOOD), *GOOD),
        ("n", answer(*GOOD), *GOOD),
        (None, answer(*GOOD), *GOOD),
        ("p", answer(*GOOD), *GOOD),
    ]
    assert judge(rows) == [None, "refusal", "wrong_language", "copied_question", "truncated", "empty", "empty", "empty", None, None, None, None, None, None]


def test_judging_nothing(judge, spark):
    assert judge([("p", answer(GOOD[0], GOOD[1] * 2000), GOOD[0], GOOD[1] * 2000)]) == [None]


# markup --------------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def labeller():
    return trained(PLAIN, documents=500, epochs=8)


def test_gradients_are_right():
    net = Labeller.fresh(1)
    docs = [Renderer(PLAIN, s).document() for s in (1, 2, 3)]
    from sievewright.llm.labeller import vectors
    from sievewright.llm.markup import KINDS, MARKUPS, paths

    x, mask, langs, kinds = pad([(vectors(ls, paths(ls)), np.array([[m in u for m in MARKUPS] for u in us], np.float32), np.array([KINDS.index(k) for k in ks])) for ls, us, ks in docs])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        p, q, _ = net.forward(x, mask)
        n = mask.sum()
        one = np.eye(len(KINDS))[kinds]
        return -(mask[..., None] * (langs * np.log(p + 1e-12) + (1 - langs) * np.log(1 - p + 1e-12))).sum() / n - 0.5 * (mask * np.log((q * one).sum(axis=2) + 1e-12)).sum() / n

    _, g = net.gradients(x, mask, langs, kinds)
    r = np.random.default_rng(2)
    for name in ("xf", "hf", "cb", "hb", "o", "p"):
        flat = net.w[name].reshape(-1)
        for i in r.integers(0, flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[name].reshape(-1)[i], abs=2e-4)


def test_labeller_on_held_out_documents(labeller):
    docs = [Renderer(PLAIN, 50_000 + i).document() for i in range(120)]
    got = labeller.label([(ls, markup.paths(ls)) for ls, _, _ in docs])
    wrong = total = 0
    for (ls, us, _), (p, _) in zip(docs, got, strict=True):
        for u, row in zip(us, p, strict=True):
            total += 1
            wrong += {m for m, v in zip(markup.MARKUPS, row, strict=True) if v >= 0.5} != u
    assert wrong / total < 0.08


CASES = {
    "# Title\n\nSome **bold** words and `code`.\n\n```\nx = 1\n```\n\n- [ ] one": ["markdown"],
    "<h2>Title</h2>\n<p>Some <b>bold</b> words &amp; more.</p>\n<ul>\n<li>one</li>\n</ul>": ["html"],
    "== Title ==\n\nSome '''bold''' words, [[page|link]].\n\n** one\n** two": ["wiki"],
    "\\section{Title}\nSome \\textbf{bold} words and $x^{2}$.\n\\begin{itemize}\n\\item one\n\\end{itemize}": ["latex"],
    "Title:\n\nWe call f(*args, **kwargs) from __init__ and then 2 * 3 * 9 items arrive.\n\n- one\n- two\n\nC:\\temp\\new\\raw, m[[0, 2], [2, 3]], List<int> -> x": [],
}


def test_residues(spark, labeller):
    samples = [*CASES, None, "", "plain\r\nlines", "word " * 3000, "\n".join(["line of text."] * 2000)]
    out = {r["id"]: r for r in residues(texts_df(spark, samples), "id", "body", labeller).collect()}
    assert len(out) == len(samples)
    for i, want in enumerate(CASES.values()):
        assert out[i]["markups"] == want
    n = len(CASES)
    assert out[n]["markups"] == [] and out[n]["clean_text"] is None and out[n + 1]["clean_text"] == "" and out[n + 2]["clean_text"] == "plain\nlines"
    clean = out[0]["clean_text"]
    assert "# Title" in clean and "Some bold words and code." in clean and "```\nx = 1\n```" in clean and "- one" in clean
    assert "Some bold words & more." in out[1]["clean_text"] and "$x^{2}$" in out[3]["clean_text"] and "link" in out[2]["clean_text"]
    assert residues(texts_df(spark, ["x"]).limit(0), "id", "body", labeller).count() == 0


# mojibake ------------------------------------------------------------------------------------------------------------------------
SOUND = ["Müller prüft die Größe der Schlüssel für Köln.", "Déjà vu à la façade près du café.", "Нужен также тест, который вызывает функцию.", "El tamaño del búfer está añadido en la función.", "A naïve “quote” – and ™ or ° or → here…", "NÃO está claro. AÑO NUEVO! MENÜ”", "В файле не проверяется общий буфер.", "这个文件没有校验返回值。", "Plain ASCII."]


@pytest.fixture(scope="module")
def corpus():
    return SOUND * 12


def garble(t, enc):
    return "".join(mojibake.read_byte(b, enc) for b in t.encode())


def test_mojibake_found_and_restored(spark, corpus):
    bad = [garble(t, e) for t in SOUND[:5] for e in ("cp1252", "latin-1", "cp437", "mac_roman")] + [SOUND[0].encode().decode("gbk", "replace"), garble(garble(SOUND[1], "cp1252"), "cp1252"), "Die Gr\ufffd\ufffd\ufffd\ufffde der Schl\ufffd\ufffdssel"]
    wants = [t for t in SOUND[:5] for _ in range(4)] + [SOUND[0], SOUND[1], "Die Größe der Schlüssel"]
    df = texts_df(spark, [*corpus, None, "", *bad])
    got = {r["id"]: r for r in mojibake.restored(df, "id", "body").collect()}
    first = len(corpus) + 2
    assert not [i for i in got if i < first]
    assert set(got) == set(range(first, first + len(bad)))
    same = [got[first + i]["restored"] == w for i, w in enumerate(wants)]
    assert sum(same) >= len(same) - 2


def test_mojibake_empty_and_long(spark):
    assert mojibake.restored(texts_df(spark, [None, "", "ascii"]), "id", "body").count() == 0
    assert mojibake.restored(texts_df(spark, ["ü" * 60_000] * 2), "id", "body").count() == 0
    assert mojibake.restored(texts_df(spark, ["x"]).limit(0), "id", "body").count() == 0
