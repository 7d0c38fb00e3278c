"""Oversized text values cut into overlapping pieces at natural boundaries (recursive separator hierarchy)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a cut may fall, from strong to weak; a cut falls at the end of a match, so that no character is lost.
LEVELS = (
    ("section", re.compile(r"\n(?=diff --git |--- \S.* ---\n|#{1,6} |@@ |\[[A-Z ]+\]\n|=+\s.*\s=+\n)")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\r\n|\n|\r")),
    ("sentence", re.compile(r"[.!?;][\"')\]]*\s+|[。！？；]")),
    ("word", re.compile(r"\s+|[,;:)\]}](?=\S)")),
)

PIECES = "piece_no int, n_pieces int, start_char long, boundary string, piece string"


def parts(text: str, lo: int, hi: int, budget: int, level: int = 0) -> Iterator[tuple[int, str]]:
    """Ends of consecutive parts of text[lo:hi], none longer than `budget`, each with the level at which it was cut.

    A part that fits stays whole; one that doesn't goes down one level. Below words it is cut anywhere.
    """
    if hi - lo <= budget:
        yield hi, ""
        return
    if level == len(LEVELS):
        for at in range(lo + budget, hi, budget):
            yield at, "character"
        yield hi, ""
        return
    name, pattern = LEVELS[level]
    at = lo
    for m in pattern.finditer(text, lo, hi):
        if at < m.end() < hi:
            for end, inner in parts(text, at, m.end(), budget, level + 1):
                yield end, inner or name
            at = m.end()
    yield from parts(text, at, hi, budget, level + 1)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """(start, boundary at the end) of each piece; pieces end where the next begins plus `overlap`. The last ends with the text.

    Parts are packed greedily: a piece takes parts as long as it stays within the limit.
    """
    if len(text) <= limit:
        return [(0, "end")]
    out: list[tuple[int, str]] = []
    start, end, kind = 0, 0, ""
    for at, cut in parts(text, 0, len(text), limit - overlap):
        if at - start > limit:
            out.append((start, kind))
            start = max(0, end - overlap)
        end, kind = at, cut or kind
    out.append((start, "end"))
    return out


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """Numbered pieces of each value of `text` that is longer than `limit` characters.

    Result: `keys`, piece_no (from 1), n_pieces, start_char (from 0), boundary (the kind of place where the piece ends), piece.
    Each piece has at most `limit` characters and begins with the last `overlap` characters of the piece before; joined without
    the overlaps they give the text again. Values within the limit, empty and null ones have no rows; repeated rows are split
    each. Other columns of `df` are ignored; key columns may have any name but those of the result.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    big = df.select(*keys, F.col(text).alias("__text")).filter(F.char_length("__text") > limit)
    names = [f.name for f in big.schema.fields[:-1]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema.fields[:-1]) + ", " + PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                row, cols = [], ([], [], [], [], [])
                for i, t in enumerate(part.column(len(names)).to_pylist()):
                    got = pieces(t, limit, overlap)
                    ends = [s + overlap for s, _ in got[1:]] + [len(t)]
                    for k, ((s, kind), e) in enumerate(zip(got, ends, strict=True)):
                        row.append(i)
                        for c, v in zip(cols, (k + 1, len(got), s, kind, t[s:e]), strict=True):
                            c.append(v)
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(pa.array(row, pa.int64())) for c in range(len(names))] + [pa.array(v, k) for v, k in zip(cols, kinds, strict=True)],
                    names=[*names, "piece_no", "n_pieces", "start_char", "boundary", "piece"],
                )

    return big.mapInArrow(cut, schema)
