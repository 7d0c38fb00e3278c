"""The pN_ queries over the test tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 1 ---------------------------------------------------------------------------------------------------------------------------
def p1_judged(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.pairs import defective_pairs, fit_ends, fit_languages

    answers = table(spark, sf, "prediction")
    languages = fit_languages(table(spark, sf, "documents"), "text", "lang", "doc_id")
    # a first section that a second one follows is whole
    ends = fit_ends(answers.filter("char_length(repair_suggestion) > 20"), "row_id", "root_cause")
    return defective_pairs(answers, "row_id", "instance_id", "raw_output", ("root_cause", "repair_suggestion"), table(spark, sf, "eval_prompt"), "prompt", languages, ends)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_judged(spark, sf).filter("defect IS NOT NULL")


# 2 ---------------------------------------------------------------------------------------------------------------------------
def near_issues(spark: SparkSession, sf: str):
    from sievewright.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf, "mined_issue"), "row_id", "problem_statement")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_issues(spark, sf).pairs().select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_issues(spark, sf).groups().withColumnRenamed("key", "row_id")


# 3 ---------------------------------------------------------------------------------------------------------------------------
def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.residue import fit_labeller, residues

    prs = table(spark, sf, "flat_pr")
    return residues(prs, "row_id", "problem_statement", fit_labeller(prs, "row_id", "problem_statement"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_clean(spark, sf).select("row_id", F.explode("markups").alias("markup"))


# 4 ---------------------------------------------------------------------------------------------------------------------------
P4_FIELDS = (("final_row", "buggy_slice"), ("final_row", "problem_statement"), ("scored", "raw_diff"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.splitting import split_oversized

    out = None
    for tbl, field in P4_FIELDS:
        one = split_oversized(table(spark, sf, tbl), ["row_id"], field).select(F.lit(tbl).alias("tbl"), "row_id", F.lit(field).alias("field_name"), "piece_no", "n_pieces", "start_char", "boundary", "piece")
        out = one if out is None else out.unionByName(one)
    return out


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pieces(spark, sf).filter("piece_no = 1").select("tbl", "row_id", "field_name")


def p4_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """Each oversized value put together again from its pieces, without their overlaps, and whether all pieces keep the limit."""
    after = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.expr("substring(piece, 201)"))
    parts = F.sort_array(F.collect_list(F.struct("piece_no", after.alias("text"))))
    g = p4_pieces(spark, sf).groupBy("tbl", "row_id", "field_name").agg(F.max(F.char_length("piece")).alias("longest"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    return g.select("tbl", "row_id", "field_name", F.md5(F.col("text").cast("binary")).alias("text"), (F.col("longest") <= 3000).alias("fits"))


# 5 ---------------------------------------------------------------------------------------------------------------------------
def overlaps(spark: SparkSession, sf: str):
    from sievewright.llm.crosssplit import cross_split

    return cross_split(table(spark, sf, "final_row"), "row_id", "instance_id", "problem_statement", "split")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps(spark, sf).pairs().select(F.least("train_key", "eval_key").alias("row_id_a"), F.greatest("train_key", "eval_key").alias("row_id_b"))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps(spark, sf).classes().select(F.col("key").alias("row_id"), "side", "class", "n_links", "n_same_instance")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.crosssplit import overlap_report

    return overlap_report(overlaps(spark, sf).pairs(), table(spark, sf, "final_row").filter("split IN ('valid', 'test')"), "row_id", "split", "source")


# 6 ---------------------------------------------------------------------------------------------------------------------------
def p6_truncated(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.truncation import truncated

    texts = (
        table(spark, sf, "cot")
        .select(F.lit("cot").alias("tbl"), "row_id", "model", F.col("gen_text").alias("text"))
        .unionByName(table(spark, sf, "refined").select(F.lit("refined").alias("tbl"), "row_id", "model", F.col("refined_repair_suggestion").alias("text")))
    )
    return truncated(texts, ["tbl", "row_id"], "text", ["tbl", "model"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_truncated(spark, sf).filter("truncated").select("tbl", "row_id")


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.truncation import truncation_rates

    return truncation_rates(p6_truncated(spark, sf), ["tbl", "model"])


# 7 ---------------------------------------------------------------------------------------------------------------------------
def repeated(spark: SparkSession, sf: str):
    from sievewright.llm.repetition import repetition

    texts = (
        table(spark, sf, "cot")
        .select(F.lit("cot").alias("tbl"), "row_id", "model", F.col("gen_text").alias("text"))
        .unionByName(table(spark, sf, "prediction").select(F.lit("prediction").alias("tbl"), "row_id", "model", F.col("raw_output").alias("text")))
    )
    return repetition(texts, ["tbl", "row_id"], "text", ["tbl", "model"])


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return repeated(spark, sf).rows.select("tbl", "row_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_repeated").cast("long").alias("n_repeated"), "share")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated(spark, sf).rows.filter("repetitive").select("tbl", "row_id")


def p7_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return repeated(spark, sf).report()


# 8 ---------------------------------------------------------------------------------------------------------------------------
def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """A file of the tokenizers' folder, which a session may name in sievewright.tokenizers."""
    return f"{spark.conf.get('sievewright.tokenizers', '/opt/tokenizers')}/{name}"


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.tokens import encode_corpus

    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text", tokenizer_path(spark))


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.tokens import decode_corpus, piece_table

    return decode_corpus(p8_ids(spark, sf), "doc_id", piece_table(spark, tokenizer_path(spark)))


# 9 ---------------------------------------------------------------------------------------------------------------------------
def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.leaks import find_leaks

    return find_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "test_passage"), "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).filter("exact").select("doc_id", "item_id")


# 10 --------------------------------------------------------------------------------------------------------------------------
def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    from sievewright.llm.mojibake import restored

    return restored(table(spark, sf, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_restored(spark, sf).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_judged": p1_judged,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_rejoined": p4_rejoined,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_cutoffs": p7_cutoffs,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _near(table: str, where: str = "true", more: str = "") -> str:
    """Common table expressions `w` (words), `e` (each word with its number among equal ones) and `near` (a, b, similarity)."""
    return f"""w AS (SELECT row_id, {_WORDS.format("problem_statement")} AS w{more} FROM {table} WHERE {where}), big AS (SELECT *, len(w) AS n FROM w WHERE len(w) >= 10),
        u AS (SELECT row_id, unnest(w) AS x FROM big), e AS (SELECT row_id, x, row_number() OVER (PARTITION BY row_id, x) AS k FROM u)"""


_P5 = (
    "WITH "
    + _near("final_row", "split IN ('train', 'valid', 'test')", ", split = 'train' AS train")
    + """, common AS (SELECT a.row_id AS t, b.row_id AS v, count(*) AS c FROM e a JOIN e b USING (x, k) JOIN big p ON p.row_id = a.row_id AND p.train JOIN big q ON q.row_id = b.row_id AND NOT q.train GROUP BY 1, 2),
        near AS (SELECT t, v FROM common JOIN big p ON p.row_id = t JOIN big q ON q.row_id = v WHERE c / (p.n + q.n - c) >= 0.75),
        ids AS (SELECT row_id, split = 'train' AS train, nullif(lower(regexp_replace(instance_id, '[^\\p{L}\\p{N}]', '', 'g')), '') AS i FROM final_row WHERE split IN ('train', 'valid', 'test')),
        same AS (SELECT a.row_id AS t, b.row_id AS v FROM ids a JOIN ids b USING (i) WHERE a.train AND NOT b.train), every AS (SELECT * FROM near UNION SELECT * FROM same)
    """
)


_CLASSES = "cls AS (SELECT row_id, min(row_id) OVER (PARTITION BY array_to_string(list_sort(w), ' ')) AS class FROM big)"


def _repeated(tbl: str, field: str) -> str:
    words = _WORDS.format(f"coalesce({field}, '')")
    return f"SELECT '{tbl}' AS tbl, row_id, {words} AS w FROM {tbl}"


SQL: dict[str, str] = {
    "p2_found": "WITH " + _near("mined_issue") + """ SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM e a JOIN e b USING (x, k) JOIN big p ON p.row_id = a.row_id JOIN big q ON q.row_id = b.row_id
        WHERE a.row_id < b.row_id GROUP BY a.row_id, b.row_id, p.n, q.n HAVING count(*) / (p.n + q.n - count(*)) >= 0.75""",
    "p2_groups": "WITH RECURSIVE " + _near("mined_issue") + f""", near AS (SELECT a.row_id AS a, b.row_id AS b FROM e a JOIN e b USING (x, k) JOIN big p ON p.row_id = a.row_id JOIN big q ON q.row_id = b.row_id
        WHERE a.row_id <> b.row_id GROUP BY a.row_id, b.row_id, p.n, q.n HAVING count(*) / (p.n + q.n - count(*)) >= 0.75), comp AS (SELECT row_id AS id, row_id AS c FROM big UNION SELECT near.b, comp.c FROM comp JOIN near ON comp.id = near.a),
        {_CLASSES}, links AS (SELECT near.a AS row_id, count(DISTINCT q.class) AS n FROM near JOIN cls p ON p.row_id = near.a JOIN cls q ON q.row_id = near.b WHERE p.class <> q.class GROUP BY near.a), m AS (SELECT id AS row_id, min(c) AS group_id FROM comp GROUP BY id)
        SELECT row_id, group_id, coalesce(n, 0)::BIGINT AS n_links FROM m LEFT JOIN links USING (row_id)""",
    "p4_rejoined": """
        SELECT 'final_row' AS tbl, row_id, 'buggy_slice' AS field_name, md5(buggy_slice) AS text, true AS fits FROM final_row WHERE length(buggy_slice) > 3000
        UNION ALL SELECT 'final_row', row_id, 'problem_statement', md5(problem_statement), true FROM final_row WHERE length(problem_statement) > 3000
        UNION ALL SELECT 'scored', row_id, 'raw_diff', md5(raw_diff), true FROM scored WHERE length(raw_diff) > 3000
    """,
    "p4_found": """
        SELECT 'final_row' AS tbl, row_id, 'buggy_slice' AS field_name FROM final_row WHERE length(buggy_slice) > 3000
        UNION ALL SELECT 'final_row', row_id, 'problem_statement' FROM final_row WHERE length(problem_statement) > 3000
        UNION ALL SELECT 'scored', row_id, 'raw_diff' FROM scored WHERE length(raw_diff) > 3000
    """,
    "p5_found": _P5 + "SELECT least(t, v) AS row_id_a, greatest(t, v) AS row_id_b FROM every",
    "p5_classes": _P5
    + f""", {_CLASSES}, l AS (SELECT t AS row_id, v AS other FROM near UNION ALL SELECT v, t FROM near), n AS (SELECT l.row_id, count(DISTINCT class) AS n FROM l JOIN cls ON cls.row_id = l.other GROUP BY l.row_id),
        c AS (SELECT i, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_eval FROM ids GROUP BY i)
        SELECT ids.row_id, CASE WHEN train THEN 0 ELSE 1 END AS side, coalesce(class, ids.row_id) AS class, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(CASE WHEN train THEN n_eval ELSE n_train END, 0)::BIGINT AS n_same_instance
        FROM ids LEFT JOIN cls USING (row_id) LEFT JOIN n ON n.row_id = ids.row_id LEFT JOIN c ON c.i = ids.i""",
    "p5_report": _P5
    + """, per AS (SELECT v AS row_id, count(*) AS n FROM every GROUP BY v)
        SELECT split, source, count(*) AS n_rows, count(n) AS n_overlapping, coalesce(sum(n), 0)::BIGINT AS n_pairs, round(count(n) / count(*), 6) AS share FROM final_row LEFT JOIN per USING (row_id) WHERE split IN ('valid', 'test') GROUP BY split, source""",
    "p7_found": f"""WITH t AS ({_repeated("cot", "gen_text")} UNION ALL {_repeated("prediction", "raw_output")}), g AS (SELECT tbl, row_id, len(w) AS n, unnest(range(1, len(w) - 3)) AS i, w FROM t WHERE len(w) >= 10),
        k AS (SELECT tbl, row_id, n, i, row_number() OVER (PARTITION BY tbl, row_id, w[i:i + 4] ORDER BY i) > 1 AS again FROM g), c AS (SELECT DISTINCT tbl, row_id, n, unnest(range(i, i + 5)) AS at FROM k WHERE again)
        SELECT tbl, row_id FROM c GROUP BY tbl, row_id, n HAVING count(*) / n >= 0.35""",
    "p7_shares": f"""WITH t AS ({_repeated("cot", "gen_text")} UNION ALL {_repeated("prediction", "raw_output")}), g AS (SELECT tbl, row_id, unnest(range(1, len(w) - 3)) AS i, w FROM t WHERE len(w) >= 5),
        k AS (SELECT tbl, row_id, i, row_number() OVER (PARTITION BY tbl, row_id, w[i:i + 4] ORDER BY i) > 1 AS again FROM g), c AS (SELECT DISTINCT tbl, row_id, unnest(range(i, i + 5)) AS at FROM k WHERE again), r AS (SELECT tbl, row_id, count(*) AS n FROM c GROUP BY ALL)
        SELECT tbl, row_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(n, 0) / greatest(len(w), 1) AS share FROM t LEFT JOIN r USING (tbl, row_id)""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM test_passage),
        dw AS (SELECT doc_id, unnest([array_to_string(w[k:k + 19], ' ') for k in range(1, len(w) - 18)]) AS x FROM d WHERE len(w) >= 20), iw AS (SELECT item_id, unnest([array_to_string(w[k:k + 19], ' ') for k in range(1, len(w) - 18)]) AS x FROM i WHERE len(w) >= 20)
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x)""",
}
