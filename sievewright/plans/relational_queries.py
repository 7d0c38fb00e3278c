"""Queries of joins, deduplication, ordered prefixes and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions.text import clone_dir, judgement_state, large_and_starred, present
from sievewright.functions.vectors import beta_lookup, partition_tag
from sievewright.operators import relational as r
from sievewright.operators import statistics as st
from sievewright.operators.training import tag_of, usable_for_training
from sievewright.plans.text_queries import table


def normal(c: str):
    return F.lower(F.trim(c))


def flagship_training_rows(spark, sf):
    """Usable training rows, without held-out instances, one for each instance (the latest), counted by split and tag."""
    f = table(spark, sf, "final_row").filter("instance_id IS NOT NULL").withColumn("instance", normal("instance_id")).withColumn("tag", tag_of("fine_tuning"))
    f = f.filter(usable_for_training("fine_tuning", "win_rc", "win_rs", "lose_rc", "lose_rs"))
    held = table(spark, sf, "test_passage").select(normal("instance_id").alias("instance"))
    f = r.last_wins(r.without(f, held, ["instance"]), ["instance"], ["built_at", "row_id"])
    return f.groupBy("split", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("problem_statement")).alias("chars"), F.min("row_id").alias("first_row"))


def clean_merge_reasons(spark, sf):
    """Why changes are left out, the first reason counting: no diff, held out, too short or too few stars, already there, or a repeat
    of one that has none of these. Keys are repository, issue, pull request and base commit; what is already there has all four."""
    p = table(spark, sf, "flat_pr").withColumns({"k1": normal("repo"), "k2": F.col("issue_id").cast("string"), "k3": F.col("merged_pr_num"), "k4": F.col("true_base_sha")})
    keys = ["k1", "k2", "k3", "k4"]
    held = table(spark, sf, "scored").select(normal("repo").alias("k1"), F.col("base_commit").alias("k4"), F.lit(True).alias("held")).filter("k1 <> '' AND k4 <> ''").distinct()
    done = table(spark, sf, "cot").select(normal("repo").alias("k1"), F.col("issue_id").cast("string").alias("k2"), F.col("pr_num").alias("k3"), F.col("base_commit").alias("k4"), F.lit(True).alias("done")).dropna().distinct()
    j = p.join(held, ["k1", "k4"], "left").join(done, keys, "left")
    reasons = [("empty_diff", present("diff_content").isNull()), ("held_out", F.col("held")), ("unusable", ~large_and_starred("body_length", "star")), ("history", F.col("done"))]
    j = r.with_reason(j, reasons)
    first = j.filter("reason = 'kept'").groupBy(*keys).agg(F.min("row_id").alias("first_row"))
    same = F.lit(True)
    for k in keys:
        same = same & j[k].eqNullSafe(first[k])
    j = j.join(first.select("first_row", *keys), same, "left").select(j["row_id"], "reason", "first_row")
    return r.reason_counts(j.withColumn("reason", F.when((F.col("reason") == "kept") & (F.col("row_id") > F.col("first_row")), "repeat").otherwise(F.col("reason"))))


def first_and_last(spark, sf):
    f = table(spark, sf, "final_row").withColumn("instance", normal("instance_id"))
    a = r.first_wins(f, ["instance"], ["built_at", "row_id"]).select("instance", F.col("row_id").alias("first_row"))
    b = r.last_wins(f, ["instance"], ["built_at", "row_id"]).select(F.col("instance").alias("i2"), F.col("row_id").alias("last_row"))
    return a.join(b, F.col("instance").eqNullSafe(F.col("i2"))).select("instance", "first_row", "last_row")


def present_key_antijoin(spark, sf):
    m = table(spark, sf, "mined_issue").withColumn("issue", F.col("issue_id").cast("string"))
    p = table(spark, sf, "flat_pr").withColumn("issue", F.col("issue_id").cast("string"))
    return r.without(m, p, ["repo", "issue"], fold_case=True).select("row_id", "repo", "issue_id")


def clone_plan(spark, sf):
    c = table(spark, sf, "cot").filter("repo IS NOT NULL AND issue_id IS NOT NULL AND pr_num IS NOT NULL AND base_commit <> ''")
    d = c.withColumn("dir", clone_dir(F.trim("repo"), "issue_id", "pr_num", F.substring("base_commit", 1, 8)))
    return d.groupBy("dir").agg(F.min_by("row_id", "row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))


def valid_prefix_by_scores(spark, sf):
    """The rows before the first one whose scores are invalid, wherever that is."""
    ok = F.col("score1").between(0, 1) & F.col("score2").between(0, 1)
    return r.valid_prefix(table(spark, sf, "scored"), ok, "row_id").agg(F.count(F.lit(1)).alias("n"), F.max("row_id").alias("last_row"), F.max("next_start").alias("next_start"))


def judgement_states(spark, sf):
    """Each judged row as valid, invalid or of zero scores; half of the scores are set to 0 where both are small, to have some of each."""
    s = table(spark, sf, "scored").withColumns({c: F.when((F.col("score1") < 0.4) & (F.col("score2") < 0.4), 0.0).otherwise(F.col(c)) for c in ("score1", "score2")})
    return s.select("row_id", judgement_state("gemini_judgement", "score1", "score2").alias("state"))


def top_commented(spark, sf):
    m = table(spark, sf, "mined_issue").select("query_type", "comments_count", "row_id")
    return r.top_n(m, ["query_type"], "comments_count", 6, ["row_id"])


def row_slices(spark, sf):
    d = r.row_numbers(table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"])
    return r.row_slice(d, 101, 250).select("doc_id", F.col("idx").cast("long").alias("idx"))


def missing_predictions(spark, sf):
    return r.missing_ids(table(spark, sf, "eval_prompt"), table(spark, sf, "prediction"), "instance_id")


def overlay_rows(spark, sf):
    n = table(spark, sf, "refined").select("row_id", "repo", "fine_tuning", "score")
    old = n.filter("row_id % 3 = 0").select("row_id", F.lit("kept").alias("fine_tuning"), (F.coalesce("score", F.lit(0.0)) + 1).alias("score"))
    return r.overlay(n, old, "row_id", ["fine_tuning", "score"])


def partition_by_score(spark, sf):
    s = table(spark, sf, "scored").withColumn("combined", (beta_lookup(F.col("new_score1_b_by_beta")) + F.col("score2")) / 2).filter("combined IS NOT NULL")
    t = s.withColumn("tag", partition_tag(F.col("combined"), 0.6))
    return st.tag_stats(t, "tag", "combined").withColumn("mean_score", F.round("mean_score", 6))


def union_in_order(spark, sf):
    m = table(spark, sf, "mined_issue").select(normal("repo").alias("repo"), "issue_id", "row_id")
    p = table(spark, sf, "flat_pr").select(normal("repo").alias("repo"), "issue_id", "row_id")
    u = r.union_ordered(p, m)
    return r.first_wins(u, ["repo", "issue_id"], ["src_ord", "row_id"]).groupBy("src_ord").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("rows"))


def answers_with_prompts(spark, sf):
    p, e = table(spark, sf, "prediction"), table(spark, sf, "eval_prompt").select("instance_id", F.lit(True).alias("known"))
    j = p.join(e, "instance_id", "left")
    return j.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("n_missing"), F.count_if(F.col("retry_count") > 0).alias("n_retried"))


QUERIES = {
    f.__name__: f for f in (flagship_training_rows, clean_merge_reasons, first_and_last, present_key_antijoin, clone_plan, valid_prefix_by_scores, judgement_states, top_commented, row_slices, missing_predictions, overlay_rows, partition_by_score, union_in_order, answers_with_prompts)
}

_USABLE = "(upper(trim(coalesce(fine_tuning, ''))) = 'SFT' AND trim(coalesce(win_rc, '')) <> '' AND trim(coalesce(win_rs, '')) <> '') OR (upper(trim(coalesce(fine_tuning, ''))) = 'ORPO' AND trim(coalesce(win_rc, '')) <> '' AND trim(coalesce(win_rs, '')) <> '' AND trim(coalesce(lose_rc, '')) <> '' AND trim(coalesce(lose_rs, '')) <> '')"

SQL = {
    "flagship_training_rows": f"""WITH f AS (SELECT *, lower(trim(instance_id)) AS instance, upper(trim(coalesce(fine_tuning, ''))) AS tag FROM final_row WHERE instance_id IS NOT NULL AND ({_USABLE})),
        g AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY built_at DESC NULLS LAST, row_id DESC) AS k FROM f WHERE instance NOT IN (SELECT lower(trim(instance_id)) FROM test_passage))
        SELECT split, tag, count(*) AS n, sum(length(problem_statement))::BIGINT AS chars, min(row_id) AS first_row FROM g WHERE k = 1 GROUP BY split, tag""",
    "clean_merge_reasons": """WITH p AS (SELECT row_id, lower(trim(repo)) AS k1, issue_id::VARCHAR AS k2, merged_pr_num AS k3, true_base_sha AS k4, diff_content, coalesce(body_length, 0) > 100 AND coalesce(star, 0) >= 30 AS ok FROM flat_pr),
        h AS (SELECT DISTINCT lower(trim(repo)) AS k1, base_commit AS k4 FROM scored WHERE trim(repo) <> '' AND base_commit <> ''), d AS (SELECT DISTINCT lower(trim(repo)) AS k1, issue_id::VARCHAR AS k2, pr_num AS k3, base_commit AS k4 FROM cot),
        w AS (SELECT p.*, CASE WHEN trim(coalesce(diff_content, '')) = '' THEN 'empty_diff' WHEN h.k1 IS NOT NULL THEN 'held_out' WHEN NOT ok THEN 'unusable' WHEN d.k1 IS NOT NULL THEN 'history' ELSE 'kept' END AS why
        FROM p LEFT JOIN h ON p.k1 = h.k1 AND p.k4 = h.k4 LEFT JOIN d ON p.k1 = d.k1 AND p.k2 = d.k2 AND p.k3 = d.k3 AND p.k4 = d.k4), x AS (SELECT *, row_number() OVER (PARTITION BY why, k1, k2, k3, k4 ORDER BY row_id) AS n FROM w)
        SELECT CASE WHEN why = 'kept' AND n > 1 THEN 'repeat' ELSE why END AS reason, count(*) AS n FROM x GROUP BY 1""",
    "first_and_last": "SELECT lower(trim(instance_id)) AS instance, first(row_id ORDER BY built_at, row_id) AS first_row, last(row_id ORDER BY built_at, row_id) AS last_row FROM final_row GROUP BY 1",
    "present_key_antijoin": "SELECT row_id, repo, issue_id FROM mined_issue m WHERE NOT EXISTS (SELECT 1 FROM flat_pr p WHERE lower(trim(p.repo)) = lower(trim(m.repo)) AND p.issue_id = m.issue_id)",
    "clone_plan": "SELECT replace(trim(repo), '/', '_') || '_' || issue_id || '_' || pr_num || '_' || substr(base_commit, 1, 8) AS dir, min(row_id) AS row_id, count(*) AS n FROM cot WHERE repo IS NOT NULL AND issue_id IS NOT NULL AND pr_num IS NOT NULL AND base_commit <> '' GROUP BY 1",
    "judgement_states": """WITH s AS (SELECT row_id, gemini_judgement AS g, CASE WHEN score1 < 0.4 AND score2 < 0.4 THEN 0.0 ELSE score1 END AS a, CASE WHEN score1 < 0.4 AND score2 < 0.4 THEN 0.0 ELSE score2 END AS b FROM scored)
        SELECT row_id, CASE WHEN g IS NULL OR a IS NULL OR b IS NULL OR NOT (a BETWEEN 0 AND 1) OR NOT (b BETWEEN 0 AND 1) THEN 'invalid' WHEN a = 0 AND b = 0 THEN 'zero' ELSE 'valid' END AS state FROM s""",
    "valid_prefix_by_scores": "WITH b AS (SELECT min(row_id) AS stop FROM scored WHERE NOT coalesce(score1 BETWEEN 0 AND 1 AND score2 BETWEEN 0 AND 1, false)) SELECT count(*) AS n, max(row_id) AS last_row, CASE WHEN count(*) > 0 THEN 1 + count(*) END AS next_start FROM scored, b WHERE stop IS NULL OR row_id < stop",
    "top_commented": "SELECT query_type, comments_count, row_id, row_number() OVER (PARTITION BY query_type ORDER BY comments_count DESC NULLS LAST, row_id)::INT AS place FROM mined_issue QUALIFY place <= 6",
    "row_slices": "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS idx FROM documents) SELECT doc_id, idx FROM d WHERE idx >= 101 AND idx < 351",
    "missing_predictions": "SELECT DISTINCT instance_id FROM eval_prompt WHERE instance_id NOT IN (SELECT instance_id FROM prediction WHERE instance_id IS NOT NULL)",
    "overlay_rows": "SELECT row_id, repo, CASE WHEN row_id % 3 = 0 THEN 'kept' ELSE fine_tuning END AS fine_tuning, CASE WHEN row_id % 3 = 0 THEN coalesce(score, 0) + 1 ELSE score END AS score, row_id % 3 = 0 AS replaced FROM refined",
    "partition_by_score": """WITH s AS (SELECT (coalesce(new_score1_b_by_beta['1.0'], new_score1_b_by_beta['1']) + score2) / 2 AS c FROM scored), t AS (SELECT c, CASE WHEN c >= 0.6 THEN 'SFT' ELSE 'ORPO' END AS tag FROM s WHERE c IS NOT NULL)
        SELECT coalesce(tag, 'ALL') AS tag, count(*) AS n, round(coalesce(avg(c), 0), 6) AS mean_score FROM t GROUP BY ROLLUP (tag)""",
    "union_in_order": """WITH u AS (SELECT lower(trim(repo)) AS repo, issue_id, row_id, 0 AS src_ord FROM flat_pr UNION ALL SELECT lower(trim(repo)), issue_id, row_id, 1 FROM mined_issue),
        f AS (SELECT *, row_number() OVER (PARTITION BY repo, issue_id ORDER BY src_ord, row_id) AS k FROM u) SELECT src_ord, count(*) AS n, sum(row_id)::BIGINT AS rows FROM f WHERE k = 1 GROUP BY src_ord""",
    "answers_with_prompts": "SELECT model, count(*) AS n, count(*) FILTER (e.instance_id IS NULL) AS n_missing, count(*) FILTER (retry_count > 0) AS n_retried FROM prediction p LEFT JOIN eval_prompt e USING (instance_id) GROUP BY model",
}
