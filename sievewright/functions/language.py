"""Phrases and actions over annotated tokens, set overlap, and BLEU.

The parser is outside: tokens come as a column array<struct<i, text, lemma, pos, dep, head, is_stop, is_punct, like_num>>.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions.vectors import let

# Verbs by what they mean for a repair, words of absence and failure, words without content, dependencies of objects.
VERBS = {
    "add": "add", "introduce": "add", "append": "add", "insert": "add", "include": "add", "create": "add", "implement": "add", "define": "add", "register": "add", "enable": "add", "inject": "add",
    "remove": "remove", "delete": "remove", "drop": "remove", "strip": "remove", "eliminate": "remove", "purge": "remove", "disable": "remove", "deprecate": "remove",
    "replace": "replace", "swap": "replace", "substitute": "replace", "rename": "replace", "convert": "replace", "migrate": "replace",
    "fix": "fix", "resolve": "fix", "correct": "fix", "repair": "fix", "patch": "fix", "address": "fix", "mitigate": "fix",
    "change": "change", "modify": "change", "adjust": "change", "alter": "change", "refactor": "change", "rewrite": "change", "rework": "change", "restructure": "change",
    "update": "update", "upgrade": "update", "bump": "update", "refresh": "update",
    "validate": "validate", "check": "validate", "verify": "validate", "ensure": "validate", "confirm": "validate", "test": "validate", "assert": "validate", "guard": "validate", "enforce": "validate", "restrict": "validate", "limit": "validate",
    "sanitize": "sanitize", "escape": "sanitize", "encode": "sanitize", "filter": "sanitize", "normalize": "sanitize", "canonicalize": "sanitize",
    "handle": "handle", "support": "handle", "process": "handle", "parse": "handle", "catch": "handle", "avoid": "handle", "prevent": "handle",
    "raise": "raise", "throw": "raise",
    "rely": "depend", "depend": "depend", "require": "depend",
}
NEGATIVE = (
    "no", "not", "none", "without", "lack", "absent", "non", "never", "miss", "missing", "omit", "omitted", "omission", "ignore", "ignored", "fail", "failed", "failure", "wrong", "incorrect", "invalid",
    "inconsistent", "unexpected", "broken", "incomplete", "insufficient", "improper", "mismatch", "unable", "unhandled", "unrecognized", "unsupported", "nonexistent", "undefined", "null", "unsafe",
    "unescaped", "uninitialized", "unsanitized", "unchecked", "unvalidated",
)
ARTICLES = (
    "a", "an", "the",
)
EMPTY_WORDS = (
    "this", "that", "these", "those", "some", "any", "new", "old", "proper", "appropriate", "various",
)
OBJECT_DEPS = (
    "dobj", "iobj", "pobj", "nsubjpass",
)
EXTENSIONS = (
    ".py", ".js", ".ts", ".java", ".c", ".cc", ".cpp", ".h", ".hpp", ".rs", ".go",
)


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Overlap of two arrays as sets; `empty` where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / n)


def numbered(words: Column) -> Column:
    """Each word with its number among equal ones, so that an array with repeats is a set. Sorted, so not quadratic.

    Elements are texts (word, a zero character, number), since sets of texts are hashed and sets of structs are compared pair by
    pair; a null word is an element of its own, the zero character twice.
    """

    def tally(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        sizes = let(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s))), lambda x, y: y - x))
        runs = F.arrays_zip(F.array_distinct(s).alias("word"), sizes.alias("n"))
        return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), r["n"]), lambda k: F.concat(F.coalesce(r["word"], F.lit("\0")), F.lit("\0"), k.cast("string")))))

    return F.when(F.size(words) > 0, let(F.sort_array(words), tally)).otherwise(F.array().cast("array<string>"))


def multiset_jaccard(a: Column, b: Column, empty: float) -> Column:
    """Overlap of two arrays of strings with repeats: the sum of the lesser counts over the sum of the greater."""
    return let(F.struct(numbered(a).alias("a"), numbered(b).alias("b")), lambda x: jaccard(x["a"], x["b"], empty))


def canonical_verb(lemma: Column) -> Column:
    """The group of a verb; verbs of no group stay, in lower case."""
    pairs = [F.lit(x) for pair in VERBS.items() for x in pair]
    low = F.lower(F.trim(lemma))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), low), low)


def is_code_like(c: Column) -> Column:
    return c.rlike(r"[`/_.#]|::|[a-z][A-Z]|\d")


def content_pieces(c: Column) -> Column:
    """The words of a name or path: its last part without an extension, split at separators, without empty words."""
    bare = F.regexp_replace(F.trim(c), r"^[`'\"()\[\]{}]+|[`'\"()\[\]{}]+$", "")
    base = F.substring_index(bare, "/", -1)
    ends = "|".join(re.escape(e) for e in EXTENSIONS)
    words = F.split(F.trim(F.lower(F.regexp_replace(F.regexp_replace(base, f"(?:{ends})$", ""), r"::|[/_\-.(),;:\s]+", " "))), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*ARTICLES, *EMPTY_WORDS))


def preprocessed(c: str | Column) -> Column:
    """struct(text, spans): a text whose code spans are CODETOKEN0, CODETOKEN1, … and whose other signs are blanks; the spans."""
    text = F.col(c) if isinstance(c, str) else c
    parts, spans = F.split(text, "`[^`]+`"), F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"[\p{P}\p{S}]", " "))
    marked = F.transform(bare, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(" CODETOKEN"), i.cast("string"), F.lit(" "))).otherwise(p))
    return F.struct(F.trim(F.regexp_replace(F.array_join(marked, ""), r"\s+", " ")).alias("text"), spans.alias("spans"))


def _children(tokens: Column, head: Column) -> Column:
    return F.filter(tokens, lambda t: (t["head"] == head) & (t["i"] != head))


def _lemma(t: Column) -> Column:
    return F.lower(F.trim(t["lemma"]))


def repair_actions(tokens: Column) -> Column:
    """Sorted distinct `verb<TAB>object` of annotated tokens.

    Objects are a verb's object children and those of its prepositions, without signs and numbers; each gives its phrase with
    its compounds, and its head in a stable form (the last piece of code, else the lemma of the noun).
    """

    def phrases(obj: Column) -> Column:
        parts = F.array_sort(F.filter(_children(tokens, obj["i"]), lambda t: t["dep"] == "compound"), lambda x, y: F.sign(x["i"] - y["i"]).cast("int"))
        whole = F.concat(parts, F.array(obj))
        surface = F.lower(F.trim(F.regexp_replace(F.array_join(F.transform(whole, lambda t: t["text"]), " "), r"\s+", " ")))
        own = F.filter(whole, lambda t: ~t["is_stop"] & ~_lemma(t).isin(*ARTICLES, *EMPTY_WORDS))
        code = F.flatten(F.transform(F.filter(own, lambda t: is_code_like(t["text"])), lambda t: content_pieces(t["text"])))
        noun = F.when(~obj["is_stop"] & obj["pos"].isin("NOUN", "PROPN") & ~_lemma(obj).isin(*ARTICLES, *EMPTY_WORDS), _lemma(obj))
        head = F.coalesce(F.try_element_at(code, F.lit(-1)), noun, F.lit(""))
        return F.filter(F.array(surface, head), lambda p: p != "")

    def of_verb(v: Column) -> Column:
        kids = F.filter(_children(tokens, v["i"]), lambda t: ~t["is_punct"])
        direct = F.filter(kids, lambda t: t["dep"].isin(*OBJECT_DEPS))
        through = F.flatten(F.transform(F.filter(kids, lambda t: t["dep"] == "prep"), lambda p: F.filter(_children(tokens, p["i"]), lambda t: (t["dep"] == "pobj") & ~t["is_punct"])))
        objects = F.filter(F.concat(direct, through), lambda o: ~o["like_num"])
        verb = canonical_verb(v["lemma"])
        return F.flatten(F.transform(objects, lambda o: F.transform(phrases(o), lambda p: F.concat(verb, F.lit("\t"), p))))

    verbs = F.filter(tokens, lambda t: (t["pos"] == "VERB") & (_lemma(t) != ""))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(verbs, of_verb))))


def cause_concepts(tokens: Column) -> Column:
    """Sorted distinct lemmas of nouns, alone and with their compounds, adjectives and words of absence or failure."""

    def of_noun(n: Column) -> Column:
        mods = F.filter(_children(tokens, n["i"]), lambda t: t["dep"].isin("compound", "amod") | F.lower(t["lemma"]).isin(*NEGATIVE))
        mods = F.array_sort(mods, lambda x, y: F.sign(x["i"] - y["i"]).cast("int"))
        phrase = F.array_join(F.concat(F.transform(mods, lambda t: F.lower(t["lemma"])), F.array(F.lower(n["lemma"]))), " ")
        return F.when(F.size(mods) > 0, F.array(phrase, F.lower(n["lemma"]))).otherwise(F.array(F.lower(n["lemma"])))

    nouns = F.filter(tokens, lambda t: t["pos"].isin("NOUN", "PROPN") & ~t["is_stop"])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(nouns, of_noun))))


STRATEGIES = {"actions": repair_actions, "concepts": cause_concepts}


def extracted(tokens: Column, strategy: str) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](tokens)


def evidence_scores(causes_a: Column, causes_b: Column, actions_a: Column, actions_b: Column) -> Column:
    """struct(ess, ras, esra): overlap of concepts (0.0 if both are empty) and of actions (1.0), and their mean."""
    ess, ras = jaccard(causes_a, causes_b, 0.0), jaccard(actions_a, actions_b, 1.0)
    return F.struct(ess.alias("ess"), ras.alias("ras"), ((ess + ras) / 2).alias("esra"))


# BLEU ----------------------------------------------------------------------------------------------------------------------------
def bleu_tokens(text: str) -> list[str]:
    """Tokens by the public 13a rules: entities undone, signs apart, points and commas apart unless between digits."""
    t = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = t.replace(a, b)
    t = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", f" {t} ")
    t = re.sub(r"([^0-9])([.,])", r"\1 \2 ", t)
    t = re.sub(r"([.,])([^0-9])", r" \1 \2", t)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", t).split()


def bleu_counts(candidate: str, reference: str, most: int = 4) -> tuple[list[int], list[int], int, int]:
    """Clipped matches and totals by n, and both lengths."""
    c, r = bleu_tokens(candidate), bleu_tokens(reference)
    grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    both = [(grams(c, n), grams(r, n)) for n in range(1, most + 1)]
    return [sum((a & b).values()) for a, b in both], [sum(a.values()) for a, _ in both], len(c), len(r)


def bleu_of(matches: list[int], totals: list[int], c: int, r: int) -> float:
    """BLEU from 0 to 100 with the brevity penalty and exponential smoothing of counts of zero; n-grams longer than the
    candidate are left out only if none of any length exists."""
    if c == 0 or not any(matches):
        return 0.0
    logs, smooth = 0.0, 1.0
    for m, t in zip(matches, totals, strict=True):
        if t == 0:
            return 0.0
        if m == 0:
            smooth *= 2
            logs += math.log(100.0 / (smooth * t))
        else:
            logs += math.log(100.0 * m / t)
    return math.exp(logs / len(matches)) * (1.0 if c >= r else math.exp(1 - r / c))


@F.pandas_udf(T.DoubleType())
def bleu(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """BLEU-4 of each pair; 0.0 where a text is null or blank."""
    return pd.Series([bleu_of(*bleu_counts(c, r)) if c and r and c.strip() and r.strip() else 0.0 for c, r in zip(candidate, reference, strict=True)])


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("matches", "totals")] + [T.StructField(n, T.LongType()) for n in ("c", "r")]))
def _bleu_parts(candidate: pd.Series, reference: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([bleu_counts(c or "", r or "") for c, r in zip(candidate, reference, strict=True)], columns=["matches", "totals", "c", "r"])


@F.pandas_udf(T.DoubleType())
def _bleu_score(matches: pd.Series, totals: pd.Series, c: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([bleu_of([int(x) for x in m], [int(x) for x in t], int(a), int(b)) for m, t, a, b in zip(matches, totals, c, r, strict=True)], dtype=float)


def corpus_bleu(df: DataFrame, groups: list[str], candidate: str, reference: str, most: int = 4) -> DataFrame:
    """The groups with bleu: BLEU-4 of all their pairs as one corpus, by counts summed over rows; a null text is an empty one."""
    parts = df.select(*groups, _bleu_parts(candidate, reference).alias("p"))
    sums = [F.sum(F.col("p")[k][i]).alias(f"{k}{i}") for k in ("matches", "totals") for i in range(most)]
    g = parts.groupBy(*groups).agg(*sums, F.sum("p.c").alias("c"), F.sum("p.r").alias("r")).filter("c IS NOT NULL")
    return g.select(*groups, _bleu_score(*[F.array(*[f"{k}{i}" for i in range(most)]) for k in ("matches", "totals")], "c", "r").alias("bleu"))


def greedy_match_f1(a: Column, b: Column) -> Column:
    """struct(p, r, f1) of greedy matching between two arrays of token vectors by their best cosine."""
    from sievewright.functions.vectors import cosine

    best = lambda xs, ys: F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: cosine(x, y))))
    mean = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda p, q: p + q) / F.size(v)).otherwise(0.0)
    p, r = mean(best(a, b)), mean(best(b, a))
    return F.struct(p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
