"""Unified diffs: blocks, sides, chunks and segments as array expressions; cleaning that needs a fold as Arrow UDFs."""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import col, formatted_segments, full_trim

LINE_ENDS = r"\r\n|[\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def lines(c: str | Column) -> Column:
    """The lines of a text at every kind of line end; none for null and empty texts, and no empty line after the last end."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), LINE_ENDS, "\n")
    t = F.regexp_replace(t, r"\n\z", "")
    return F.when(F.coalesce(col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n"))


def blocks(c: str | Column, marker: str = "diff ", preamble: bool = True) -> Column:
    """array<array<string>>: runs of lines that begin at a line with the marker. Lines before the first are a block or dropped."""
    text = F.array_join(lines(c), "\n")
    parts = F.split(text, f"\n(?={re.escape(marker)})")
    parts = F.filter(parts, lambda p: (p != "") & (F.lit(preamble) | F.startswith(p, F.lit(marker))))
    return F.transform(parts, lambda p: F.split(p, "\n"))


def joined(ls: Column) -> Column:
    return F.array_join(ls, "\n")


def _starts(x: Column, *marks: str) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.startswith(x, F.lit(m))
    return out


def _first(ls: Column, cond) -> Column:
    return F.try_element_at(F.filter(ls, cond), F.lit(1))


def block_path(block: Column) -> Column:
    """The path of the first file header of a block, cut at a tab; null without one."""
    line = _first(block, lambda x: _starts(x, "--- a/", "+++ b/"))
    return F.split_part(F.substring(line, F.lit(7), F.length(line)), F.lit("\t"), F.lit(1))


def last_path(block: Column) -> Column:
    line = F.try_element_at(F.filter(block, lambda x: _starts(x, "--- a/", "+++ b/")), F.lit(-1))
    return full_trim(F.substring(line, F.lit(7), F.length(line)))


def python_blocks(c: str | Column) -> Column:
    """A diff with only its blocks of Python files whose path has no `test`, in any case."""
    keep = F.filter(blocks(c, "diff", False), lambda b: F.coalesce(F.endswith(block_path(b), F.lit(".py")) & ~F.contains(F.lower(block_path(b)), F.lit("test")), F.lit(False)))
    return F.array_join(F.transform(keep, joined), "\n")


def _side(c: str | Column, mark: str, other: str, own_header: str, other_header: str, title: str | None) -> Column:
    skip = lambda x: _starts(x, "diff ", "index ", other_header, "@@", other) & ~_starts(x, own_header)
    kept = F.filter(lines(c), lambda x: ~skip(x))

    def render(x: Column) -> Column:
        path = full_trim(F.substring(x, F.lit(7), F.length(x)))
        if title is None:
            return F.when(_starts(x, own_header), path).otherwise(x)
        plain = F.when(_starts(x, mark) & ~_starts(x, mark * 3), F.substring(x, F.lit(2), F.length(x)))
        return F.when(_starts(x, own_header), F.concat(path, F.lit(f"\n### {title}"))).otherwise(plain)

    return F.when(full_trim(F.coalesce(col(c), F.lit(""))) == "", "").otherwise(F.array_join(F.filter(F.transform(kept, render), lambda x: x.isNotNull()), "\n"))


def added_side(c: str | Column, titled: bool = False) -> Column:
    """The new side of a diff: paths, added and context lines; titled, only what was added, under a heading for each file."""
    return _side(c, "+", "-", "+++ b/", "--- a/", "After Change" if titled else None)


def removed_side(c: str | Column, titled: bool = False) -> Column:
    """The old side of a diff, as `added_side`."""
    return _side(c, "-", "+", "--- a/", "+++ b/", "Before Change" if titled else None)


def patch_like(c: str | Column) -> Column:
    """A diff without its `diff`, `index` and new-file lines; old-file lines become paths."""
    kept = F.filter(lines(c), lambda x: ~_starts(x, "diff", "index", "+++ b/"))
    return joined(F.transform(kept, lambda x: F.when(_starts(x, "--- a/"), full_trim(F.substring(x, F.lit(7), F.length(x)))).otherwise(x)))


def normalized_patch(c: str | Column) -> Column:
    """A patch without file headers (indented by four or not), its code moved left by four."""
    kept = F.filter(lines(c), lambda x: ~x.rlike(r"^(?: {4})?(?:---|\+\+\+|\*\*\*)"))
    return joined(F.transform(kept, lambda x: F.when(x.rlike(r"^[+-] {4}"), F.concat(F.left(x, F.lit(1)), F.substring(x, F.lit(6), F.length(x)))).when(_starts(x, "    "), F.substring(x, F.lit(5), F.length(x))).otherwise(x)))


def _changed(block: Column, mark: str, header: str) -> Column:
    return F.filter(block, lambda x: _starts(x, mark) & ~_starts(x, header))


def _bare(ls: Column) -> Column:
    return joined(F.transform(ls, lambda x: F.substring(x, F.lit(2), F.length(x))))


def change_chunk(block: Column) -> Column:
    """A block as path, removed and added lines under two headings; empty without a path or a change."""
    old, new = _changed(block, "-", "---"), _changed(block, "+", "+++")
    bare = lambda ls: F.when(F.size(ls) > 0, _bare(ls))
    text = F.concat_ws("\n", last_path(block), F.lit("### Before Change"), bare(old), F.lit("### After Change"), bare(new))
    return F.when(F.coalesce(last_path(block), F.lit("")).eqNullSafe("") | (F.size(old) + F.size(new) == 0), "").otherwise(full_trim(text))


def code_chunk(block: Column) -> Column:
    """A block as path and its hunk headers, changed and context lines; empty without a path or a change."""
    body = F.filter(block, lambda x: _starts(x, "@@", "+", "-", " ") & ~_starts(x, "+++", "---"))
    n = F.size(_changed(block, "-", "---")) + F.size(_changed(block, "+", "+++"))
    return F.when(F.coalesce(last_path(block), F.lit("")).eqNullSafe("") | (n == 0), "").otherwise(F.concat(last_path(block), F.lit("\n"), joined(body)))


def change_chunks(c: str | Column) -> Column:
    return F.filter(F.transform(blocks(c), change_chunk), lambda x: x != "")


def code_chunks(c: str | Column) -> Column:
    return F.filter(F.transform(blocks(c), code_chunk), lambda x: x != "")


def within_budget(chunks: Column, budget: int = 16_000) -> Column:
    """Chunks in order up to a total length: the one that crosses it is cut, those after it are dropped."""
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        part = F.left(x, acc["left"])
        return F.struct((acc["left"] - F.char_length(part)).alias("left"), F.when(acc["left"] > 0, F.concat(acc["got"], F.array(part))).otherwise(acc["got"]).alias("got"))

    return F.aggregate(chunks, start, step, lambda acc: acc["got"])


def remove_add_pairs(c: str | Column) -> Column:
    """Each block's path, removed lines and added lines, blocks apart by a blank line."""
    one = lambda b: F.when(F.coalesce(last_path(b), F.lit("")).eqNullSafe("") | (F.size(_changed(b, "-", "---")) + F.size(_changed(b, "+", "+++")) == 0), "").otherwise(
        F.concat_ws("\n", last_path(b), joined(_changed(b, "-", "---")), joined(_changed(b, "+", "+++")))
    )
    return F.array_join(F.filter(F.transform(blocks(c), one), lambda x: x != ""), "\n\n")


def diff_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, block_no, path, kind and text of every line: the table form of a diff.

    kind: header, hunk, old, new or context. block_no counts `diff ` lines (0 before the first), path is the last old-file
    header so far within the block. Numbers and paths are found within each row, so lines are never shuffled.
    """
    rows = df.select(F.col(key).alias("key"), lines(text).alias("__l")).filter(F.size("__l") > 0)
    parts = rows.select("key", F.transform(F.split(joined(F.col("__l")), "\n(?=diff )"), lambda p: F.split(p, "\n")).alias("__b"))
    b = parts.select("key", "__b", F.startswith(F.col("__b")[0][0], F.lit("diff ")).cast("int").alias("__1"), F.posexplode("__b").alias("__p", "__x"))
    before = F.aggregate(F.slice("__b", F.lit(1), F.col("__p")), F.lit(0), lambda n, x: n + F.size(x))
    heads = F.filter(F.transform("__x", lambda x, i: F.named_struct(F.lit("i"), i, F.lit("x"), x)), lambda h: F.startswith(h["x"], F.lit("--- a/")))
    b = b.select("key", (F.col("__p") + F.col("__1")).cast("long").alias("block_no"), before.alias("__n"), heads.alias("__h"), F.posexplode("__x").alias("__i", "text"))
    head = F.try_element_at(F.filter("__h", lambda h: h["i"] <= F.col("__i")), F.lit(-1))["x"]
    kind = (
        F.when(_starts(F.col("text"), "diff ", "index ", "--- ", "+++ "), "header").when(_starts(F.col("text"), "@@"), "hunk").when(_starts(F.col("text"), "-"), "old").when(_starts(F.col("text"), "+"), "new").otherwise("context")
    )
    return b.select("key", (F.col("__n") + F.col("__i")).alias("line_no"), "block_no", F.substring(head, F.lit(7), F.length(head)).alias("path"), kind.alias("kind"), "text")


def patch_segments(c: str | Column) -> Column:
    """array<struct<file, content>> of a patch's old side: a file at each old-file header, its removed and context lines."""
    empty = F.expr("cast(array() as array<struct<file:string,content:array<string>>>)")
    start = F.struct(F.lit(None).cast("string").alias("file"), F.array().cast("array<string>").alias("body"), empty.alias("done"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["file"].isNotNull() & (F.size(acc["body"]) > 0), F.concat(acc["done"], F.array(F.struct(acc["file"].alias("file"), acc["body"].alias("content"))))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        head = _starts(x, "--- ")
        name = F.when(_starts(x, "--- a/"), F.substring(x, F.lit(7), F.length(x))).otherwise(F.substring(x, F.lit(5), F.length(x)))
        takes = ~_starts(x, "+", "@@", "diff ", "index ", "---") & acc["file"].isNotNull() & _starts(x, "-", " ")
        return F.struct(
            F.when(head, full_trim(name)).otherwise(acc["file"]).alias("file"),
            F.when(head, F.array().cast("array<string>")).when(takes, F.concat(acc["body"], F.array(F.substring(x, F.lit(2), F.length(x))))).otherwise(acc["body"]).alias("body"),
            F.when(head, flushed(acc)).otherwise(acc["done"]).alias("done"),
        )

    return F.transform(F.aggregate(lines(c), start, step, flushed), lambda s: F.struct(s["file"].alias("file"), joined(s["content"]).alias("content")))


def buggy_slice(c: str | Column) -> Column:
    """The old side for evaluation: paths, removed and context lines; blank context is dropped."""
    kept = F.filter(lines(c), lambda x: ~(_starts(x, "diff ", "index ", "+++ b/", "@@", "+")) & (full_trim(x) != ""))
    return joined(F.transform(kept, lambda x: F.when(_starts(x, "--- a/"), F.substring(x, F.lit(7), F.length(x))).otherwise(x)))


def refenced(c: str | Column) -> Column:
    """A buggy slice as fenced segments (see text.formatted_segments): a line with a slash that is no code line begins a file; what
    comes before the first is lost, and a file without lines is left out."""
    none = F.array().cast("array<struct<file:string,content:string>>")
    start = F.struct(F.lit(None).cast("string").alias("file"), F.array().cast("array<string>").alias("body"), none.alias("done"))

    def flushed(acc: Column) -> Column:
        own = F.struct(acc["file"].alias("file"), joined(acc["body"]).alias("content"))
        return F.when(acc["file"].isNotNull() & (F.size(acc["body"]) > 0), F.concat(acc["done"], F.array(own))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        head = ~_starts(x, "-", " ") & F.contains(x, F.lit("/"))
        return F.struct(
            F.when(head, x).otherwise(acc["file"]).alias("file"),
            F.when(head, F.array().cast("array<string>")).when(acc["file"].isNotNull(), F.concat(acc["body"], F.array(x))).otherwise(acc["body"]).alias("body"),
            F.when(head, flushed(acc)).otherwise(acc["done"]).alias("done"),
        )

    segments = F.aggregate(lines(c), start, step, flushed)
    return formatted_segments(F.transform(segments, lambda s: F.struct(s.alias("suspicious"))), supplementary=False)


# cleaning with folds -------------------------------------------------------------------------------------------------------------
SPLIT_LINES = re.compile("\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]")
CODE_MARKS = "+- "
#: Calls that write logs or print, and the structural lines of a diff. Fixed values.
OUTPUT_CALL = re.compile(r"\b(?:print|(?:logger|logging|log)\.\w+)\s*\(", re.IGNORECASE)
STRUCTURE = ("diff ", "index ", "@@ ", "\\ No newline at end of file", "--- ", "+++ ")


def text_lines(text: str) -> list[str]:
    out = SPLIT_LINES.split(text)
    return out[:-1] if out and out[-1] == "" else out


def split_blocks(ls: list[str]) -> list[list[str]]:
    out: list[list[str]] = []
    for x in ls:
        if x.startswith("diff ") or not out:
            out.append([])
        out[-1].append(x)
    return out


def quoted_lines(block: list[str]) -> set[int]:
    """Lines inside triple quotes that open at a line's start and close within the block."""
    marks = [len(re.findall(r'"""|\'\'\'', x[1:])) if x[:1] and x[0] in CODE_MARKS else 0 for x in block]
    opens = [m > 0 and re.match(r'[ \t]*(?:"""|\'\'\')', x[1:]) is not None for x, m in zip(block, marks, strict=True)]
    gone: set[int] = set()
    free = 0
    for i, opening in enumerate(opens):
        if i < free or not opening:
            continue
        end = i if marks[i] >= 2 else next((j for j in range(i + 1, len(block)) if marks[j]), None)
        if end is not None:
            gone |= set(range(i, end + 1))
            free = end + 1
    return gone


def noise_free(text: str | None) -> str | None:
    """A diff without comment lines, paired docstrings, and calls that print or log, over as many lines as their brackets take."""
    if text is None:
        return None
    out: list[str] = []
    for block in split_blocks(text_lines(text)):
        gone, depth = quoted_lines(block), 0
        for i, x in enumerate(block):
            if not x or x.startswith(STRUCTURE) or x[0] not in CODE_MARKS:
                out.append(x)
                continue
            code = x[1:]
            if i in gone or code.lstrip().startswith("#"):
                continue
            if depth > 0:
                depth += code.count("(") - code.count(")")
            elif OUTPUT_CALL.search(code.lstrip()):
                depth = code.count("(") - code.count(")")
            else:
                out.append(x)
    return "\n".join(out)


def statements(entries: list[tuple[int, str]]) -> list[tuple[str, list[int]]]:
    """(text without white space, line numbers) of each statement: lines join while brackets or a backslash are open."""
    out: list[tuple[str, list[int]]] = []
    held: list[tuple[int, str]] = []
    depth = 0
    for i, x in entries:
        if not held and not x.strip():
            continue
        held.append((i, x))
        depth += sum(x.count(a) for a in "([{") - sum(x.count(a) for a in ")]}")
        if depth <= 0 and not x.rstrip().endswith("\\"):
            out.append((re.sub(r"\s+", "", "".join(t for _, t in held)), [k for k, _ in held]))
            held, depth = [], 0
    if held:
        out.append((re.sub(r"\s+", "", "".join(t for _, t in held)), [k for k, _ in held]))
    return out


def unmatched(old: list[str], new: list[str]) -> tuple[list[bool], list[bool]]:
    """Which statements of each side really changed: no counterpart in order, and not moved elsewhere."""
    if not old or not new or old == new:
        return [old != new] * len(old), [old != new] * len(new)
    keep = [[False] * len(old), [False] * len(new)]
    spans = [[], []]
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag != "equal":
            spans[0] += range(i1, i2)
            spans[1] += range(j1, j2)
    moved = Counter(old[i] for i in spans[0]) & Counter(new[i] for i in spans[1])
    for flags, side, s in zip(keep, (old, new), spans, strict=True):
        left = dict(moved)
        for i in s:
            if left.get(side[i], 0) > 0:
                left[side[i]] -= 1
            else:
                flags[i] = True
    return keep[0], keep[1]


def changed_only(text: str | None, reach: int = 5, headers: bool = False) -> str | None:
    """One block with only the lines of statements that really changed, and the runs of context within `reach` lines of them.

    File headers go too, since they look like changes, unless `headers` keeps them. Empty lines are dropped.
    """
    if text is None:
        return None
    ls = text_lines(text)
    sides = {m: statements([(i, x[1:]) for i, x in enumerate(ls) if x[:1] == m and not x.startswith(m * 3)]) for m in "-+"}
    flags = unmatched([s for s, _ in sides["-"]], [s for s, _ in sides["+"]])
    kept = sorted(i for side, f in zip(sides.values(), flags, strict=True) for (_, own), ok in zip(side, f, strict=True) if ok for i in own)
    chosen = set(kept)
    at = 0
    while at < len(ls):
        end = at
        while end < len(ls) and ls[end][:1] == " ":
            end += 1
        if end > at and any(at - reach <= k <= end - 1 + reach for k in kept):
            chosen |= set(range(at, end))
        at = max(end, at + 1)
    return "\n".join(x for i, x in enumerate(ls) if x and (x[0] not in CODE_MARKS or i in chosen or (headers and x.startswith(("--- ", "+++ ")))))


def cleaned(text: str | None, mode: str, headers: bool = False) -> str | None:
    """A diff cleaned by mode: none, noise, semantic, or full (noise first)."""
    if mode not in ("none", "noise", "semantic", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    if text is None or mode == "none":
        return text
    if mode in ("noise", "full"):
        text = noise_free(text)
    if mode in ("semantic", "full"):
        text = "\n".join(changed_only("\n".join(b), headers=headers) for b in split_blocks(text_lines(text)))
    return text


def clean_diff(mode: str = "full", headers: bool = False):
    """`cleaned` as an Arrow-batched UDF."""
    if mode not in ("none", "noise", "semantic", "full"):
        raise ValueError(f"unknown mode {mode!r}")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cleaned(t, mode, headers), na_action="ignore")

    return run
