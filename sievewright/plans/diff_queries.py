"""Queries over unified diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import diffs as d
from sievewright.plans.text_queries import table


def md5(c):
    return F.md5(c.cast("binary"))


def python_diff_blocks(spark, sf):
    p = table(spark, sf, "flat_pr")
    return p.select("row_id", md5(d.python_blocks("diff_content")).alias("kept"), F.size(d.blocks("diff_content")).cast("long").alias("n_blocks"))


def diff_sides(spark, sf):
    c = table(spark, sf, "cot")
    return c.select("row_id", *[md5(f("raw_diff", x)).alias(n) for n, f, x in (("added", d.added_side, False), ("added_titled", d.added_side, True), ("removed", d.removed_side, False), ("removed_titled", d.removed_side, True))])


def patch_texts(spark, sf):
    c = table(spark, sf, "scored")
    return c.select("row_id", md5(d.patch_like("raw_diff")).alias("patch"), md5(d.normalized_patch("raw_diff")).alias("normalized"), md5(d.buggy_slice("raw_diff")).alias("slice"))


def diff_line_kinds(spark, sf):
    t = d.diff_lines(table(spark, sf, "flat_pr"), "row_id", "diff_content")
    return t.groupBy(F.col("key").alias("row_id"), "block_no", "path").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("header", "hunk", "old", "new", "context")])


def diff_chunks(spark, sf):
    s = table(spark, sf, "scored").select("row_id", d.change_chunks("raw_diff").alias("change"), d.code_chunks("raw_diff").alias("code"))
    cut = d.within_budget(F.col("change"), 2000)
    return s.select(
        "row_id", F.size("change").cast("long").alias("n_change"), md5(F.array_join("change", "\n\n")).alias("change"), md5(F.array_join("code", "\n\n")).alias("code"),
        F.aggregate(F.transform(cut, F.char_length), F.lit(0), lambda a, b: a + b).cast("long").alias("kept_chars"), md5(F.array_join(cut, "")).alias("kept"),
    )


def remove_add_pairs(spark, sf):
    return table(spark, sf, "cot").select("row_id", md5(d.remove_add_pairs("raw_diff")).alias("pairs"))


def patch_segments(spark, sf):
    c = table(spark, sf, "cot").select("row_id", F.posexplode(d.patch_segments("raw_diff")).alias("pos", "s"))
    return c.select("row_id", F.col("pos").cast("long").alias("pos"), "s.file", md5(F.col("s.content")).alias("content"))


def refenced_slices(spark, sf):
    return table(spark, sf, "scored").select("row_id", md5(d.refenced(d.buggy_slice("raw_diff"))).alias("fenced"))


def diff_noise_clean(spark, sf):
    p = table(spark, sf, "flat_pr").withColumn("clean", d.clean_diff("noise")("diff_content"))
    return p.select("row_id", F.size(d.lines("diff_content")).alias("n_lines"), F.size(d.lines("clean")).alias("n_kept"), md5(F.col("clean")).alias("clean"))


def diff_semantic_clean(spark, sf):
    p = table(spark, sf, "flat_pr").withColumn("clean", d.clean_diff("full", True)("diff_content"))
    return p.select("row_id", F.size(d.lines("clean")).alias("n_kept"), md5(F.col("clean")).alias("clean"), F.size(d.change_chunks("clean")).alias("n_chunks"))


QUERIES = {f.__name__: f for f in (python_diff_blocks, diff_sides, patch_texts, diff_line_kinds, diff_chunks, remove_add_pairs, patch_segments, refenced_slices, diff_noise_clean, diff_semantic_clean)}

NL = "chr(10)"
_NORMAL = r"regexp_replace(regexp_replace({}, '\r\n|[\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n$', '')"
_W = r"[\s\x0b\x{85}\p{Z}]"


def ls(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN []::VARCHAR[] ELSE string_split({_NORMAL.replace('{}', c)}, chr(10)) END"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_W}+', ''), '{_W}+$', '')"


def side(mark: str, other: str, own: str, their: str, title: str | None) -> str:
    skip = f"(starts_with(x, 'diff ') OR starts_with(x, 'index ') OR starts_with(x, '{their}') OR starts_with(x, '@@') OR starts_with(x, '{other}'))"
    path = trim("substr(x, 7)")
    r = f"CASE WHEN starts_with(x, '{own}') THEN {path} ELSE x END" if title is None else f"CASE WHEN starts_with(x, '{own}') THEN {path} || chr(10) || '### {title}' WHEN starts_with(x, '{mark}') AND NOT starts_with(x, '{mark * 3}') THEN substr(x, 2) END"
    return f"md5(coalesce(array_to_string(list_filter(list_transform(list_filter(l, lambda x: NOT ({skip} AND NOT starts_with(x, '{own}'))), lambda x: {r}), lambda x: x IS NOT NULL), chr(10)), ''))"


BLOCKS = "list_filter(string_split(replace(chr(10) || array_to_string(l, chr(10)), chr(10) || '{m}', chr(1) || '{m}'), chr(1)), lambda p: p <> '' AND p <> chr(10))"
_CHANGED = "list_filter(b, lambda x: starts_with(x, '{0}') AND NOT starts_with(x, '{0}{0}{0}'))"
_PATH = trim("substr(list_filter(b, lambda x: starts_with(x, '--- a/') OR starts_with(x, '+++ b/'))[-1], 7)")
_BARE = "nullif(array_to_string(list_transform({}, lambda x: substr(x, 2)), chr(10)), NULL)"
#: blocks as rows: row_id, block number, lines, path, removed and added lines
UNNESTED = f"""l AS (SELECT row_id, {ls('raw_diff')} AS l FROM {{t}}), k AS (SELECT row_id, unnest({BLOCKS.replace('{m}', 'diff ')}) AS p, generate_subscripts({BLOCKS.replace('{m}', 'diff ')}, 1) AS n FROM l),
    b AS (SELECT row_id, n, string_split(CASE WHEN n = 1 AND starts_with(p, chr(10)) THEN substr(p, 2) ELSE p END, chr(10)) AS b FROM k), c AS (SELECT row_id, n, b, {_PATH} AS path, {_CHANGED.format('-')} AS old, {_CHANGED.format('+')} AS new FROM b),
    ok AS (SELECT * FROM c WHERE coalesce(path, '') <> '' AND len(old) + len(new) > 0)"""

SQL = {
    "python_diff_blocks": f"""WITH l AS (SELECT row_id, {ls('diff_content')} AS l FROM flat_pr), b AS (SELECT row_id, {BLOCKS.replace('{m}', 'diff')} AS b, {BLOCKS.replace('{m}', 'diff ')} AS b2 FROM l)
        SELECT row_id, md5(coalesce(array_to_string(list_filter(b, lambda p: starts_with(p, 'diff') AND coalesce(ends_with(path_of(p), '.py') AND NOT contains(lower(path_of(p)), 'test'), false)), chr(10)), '')) AS kept, len(b2)::BIGINT AS n_blocks FROM b""".replace(
        "path_of(p)", "split_part(substr(list_filter(string_split(p, chr(10)), lambda x: starts_with(x, '--- a/') OR starts_with(x, '+++ b/'))[1], 7), chr(9), 1)"
    ),
    "diff_sides": f"""WITH l AS (SELECT row_id, CASE WHEN {trim("coalesce(raw_diff, '')")} = '' THEN [] ELSE {ls('raw_diff')} END AS l FROM cot) SELECT row_id, {side('+', '-', '+++ b/', '--- a/', None)} AS added, {side('+', '-', '+++ b/', '--- a/', 'After Change')} AS added_titled,
        {side('-', '+', '--- a/', '+++ b/', None)} AS removed, {side('-', '+', '--- a/', '+++ b/', 'Before Change')} AS removed_titled FROM l""",
    "patch_texts": f"""WITH l AS (SELECT row_id, {ls('raw_diff')} AS l FROM scored) SELECT row_id,
        md5(array_to_string(list_transform(list_filter(l, lambda x: NOT (starts_with(x, 'diff') OR starts_with(x, 'index') OR starts_with(x, '+++ b/'))), lambda x: CASE WHEN starts_with(x, '--- a/') THEN substr(x, 7) ELSE x END), chr(10))) AS patch,
        md5(array_to_string(list_transform(list_filter(l, lambda x: NOT regexp_matches(x, '^( {{4}})?(---|\\+\\+\\+|\\*\\*\\*)')), lambda x: CASE WHEN regexp_matches(x, '^[+-] {{4}}') THEN substr(x, 1, 1) || substr(x, 6) WHEN starts_with(x, '    ') THEN substr(x, 5) ELSE x END), chr(10))) AS normalized,
        md5(array_to_string(list_transform(list_filter(l, lambda x: NOT (starts_with(x, 'diff ') OR starts_with(x, 'index ') OR starts_with(x, '+++ b/') OR starts_with(x, '@@') OR starts_with(x, '+')) AND {trim('x')} <> ''), lambda x: CASE WHEN starts_with(x, '--- a/') THEN substr(x, 7) ELSE x END), chr(10))) AS slice FROM l""",
    "diff_line_kinds": f"""WITH l AS (SELECT row_id, unnest({ls('diff_content')}) AS t, generate_subscripts({ls('diff_content')}, 1) AS i FROM flat_pr), b AS (SELECT *, sum(CASE WHEN starts_with(t, 'diff ') THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i)::BIGINT AS block_no FROM l),
        p AS (SELECT *, last_value(CASE WHEN starts_with(t, '--- a/') THEN substr(t, 7) END IGNORE NULLS) OVER (PARTITION BY row_id, block_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path,
        CASE WHEN starts_with(t, 'diff ') OR starts_with(t, 'index ') OR starts_with(t, '--- ') OR starts_with(t, '+++ ') THEN 'header' WHEN starts_with(t, '@@') THEN 'hunk' WHEN starts_with(t, '-') THEN 'old' WHEN starts_with(t, '+') THEN 'new' ELSE 'context' END AS kind FROM b)
        SELECT row_id, block_no, path, count(*) FILTER (kind = 'header') AS n_header, count(*) FILTER (kind = 'hunk') AS n_hunk, count(*) FILTER (kind = 'old') AS n_old, count(*) FILTER (kind = 'new') AS n_new, count(*) FILTER (kind = 'context') AS n_context FROM p GROUP BY ALL""",
    "diff_chunks": f"""WITH {UNNESTED.replace('{t}', 'scored')}, x AS (SELECT row_id, n, {trim("concat_ws(chr(10), path, '### Before Change', CASE WHEN len(old) > 0 THEN " + _BARE.replace('{}', 'old') + " END, '### After Change', CASE WHEN len(new) > 0 THEN " + _BARE.replace('{}', 'new') + " END)")} AS change,
        path || chr(10) || array_to_string(list_filter(b, lambda x: (starts_with(x, '@@') OR starts_with(x, '+') OR starts_with(x, '-') OR starts_with(x, ' ')) AND NOT (starts_with(x, '+++') OR starts_with(x, '---'))), chr(10)) AS code FROM ok),
        g AS (SELECT row_id, count(*) AS n, string_agg(change, chr(10) || chr(10) ORDER BY n) AS change, string_agg(code, chr(10) || chr(10) ORDER BY n) AS code, string_agg(change, '' ORDER BY n) AS plain FROM x GROUP BY row_id)
        SELECT s.row_id, coalesce(g.n, 0)::BIGINT AS n_change, md5(coalesce(change, '')) AS change, md5(coalesce(code, '')) AS code, least(2000, length(coalesce(plain, '')))::BIGINT AS kept_chars, md5(substr(coalesce(plain, ''), 1, 2000)) AS kept FROM scored s LEFT JOIN g USING (row_id)""",
    "remove_add_pairs": f"""WITH {UNNESTED.replace('{t}', 'cot')}, g AS (SELECT row_id, string_agg(concat_ws(chr(10), path, array_to_string(old, chr(10)), array_to_string(new, chr(10))), chr(10) || chr(10) ORDER BY n) AS t FROM ok GROUP BY row_id)
        SELECT s.row_id, md5(coalesce(t, '')) AS pairs FROM cot s LEFT JOIN g USING (row_id)""",
    "refenced_slices": f"""WITH l AS (SELECT row_id, unnest({ls('raw_diff')}) AS x, generate_subscripts({ls('raw_diff')}, 1) AS i FROM scored),
        k AS (SELECT row_id, i, CASE WHEN starts_with(x, '--- a/') THEN {trim('substr(x, 7)')} ELSE x END AS x FROM l WHERE NOT (starts_with(x, 'diff ') OR starts_with(x, 'index ') OR starts_with(x, '@@') OR starts_with(x, '+')) AND {trim('x')} <> ''),
        h AS (SELECT *, NOT starts_with(x, '-') AND NOT starts_with(x, ' ') AND contains(x, '/') AS head FROM k), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY row_id ORDER BY i) AS seg FROM h),
        f AS (SELECT row_id, seg, max(x) FILTER (head) AS file, string_agg(x, {NL} ORDER BY i) FILTER (NOT head) AS content FROM s WHERE seg > 0 GROUP BY row_id, seg),
        n AS (SELECT row_id, seg, '--- Segment Group ' || row_number() OVER (PARTITION BY row_id ORDER BY seg) || ' ---' || {NL} || '[Suspicious] file: ' || file || {NL} || '```' || {NL} || regexp_replace(content, '{_W}+$', '') || {NL} || '```' || {NL} AS t FROM f WHERE content IS NOT NULL),
        g AS (SELECT row_id, string_agg(t, {NL} ORDER BY seg) AS t FROM n GROUP BY row_id) SELECT scored.row_id, md5(coalesce(t, '')) AS fenced FROM scored LEFT JOIN g USING (row_id)""",
    "patch_segments": f"""WITH l AS (SELECT row_id, unnest({ls('raw_diff')}) AS t, generate_subscripts({ls('raw_diff')}, 1) AS i FROM cot), s AS (SELECT *, sum(CASE WHEN starts_with(t, '--- ') THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS seg FROM l),
        f AS (SELECT row_id, seg, max(CASE WHEN starts_with(t, '--- a/') THEN {trim('substr(t, 7)')} WHEN starts_with(t, '--- ') THEN {trim('substr(t, 5)')} END) AS file, string_agg(substr(t, 2), chr(10) ORDER BY i) FILTER ((starts_with(t, '-') OR starts_with(t, ' ')) AND NOT starts_with(t, '---')) AS content FROM s WHERE seg > 0 GROUP BY row_id, seg)
        SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY seg) - 1)::BIGINT AS pos, file, md5(content) AS content FROM f WHERE content IS NOT NULL""",
}
