"""Queries of vector similarity, statistics, calibration, training rows and language metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import language as lang
from sievewright.functions import vectors as v
from sievewright.functions.text import task_rows
from sievewright.operators import statistics as st
from sievewright.operators import training as tr
from sievewright.plans.text_queries import GIVEN, NL, ROLE, table, trim_sql


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# vectors -------------------------------------------------------------------------------------------------------------------------
def cosine_pairs(spark, sf):
    """Each vector against the first of its label."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.join(q, "label").select("vec_id", F.round(v.cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))


def pair_scores(spark, sf):
    """Answers made of every four vectors of a label; the last of a label may be incomplete."""
    from pyspark.sql import Window as W

    e = table(spark, sf, "embeddings").select("label", "vec_id", "embedding").withColumn("k", F.floor((F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1) / 4))
    g = e.groupBy("label", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("v"))
    return rounded(g.select("label", "k", v.pair_scores(F.col("v")).alias("s")).select("label", "k", "s.score1", "s.score2"), "score1", "score2")


def all_queries_and_chunks(spark, sf):
    """Records out of all vectors: a label's vectors by vec_id in blocks of six, the first as the query, the rest as its chunks.

    Every vector is in one record; a label's last block may be short, down to a query without chunks. The lists are bounded by
    six. Numbering sorts each label in one task.
    """
    from pyspark.sql import Window as W

    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    k = e.withColumn("block", F.floor((F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1) / 6))
    g = k.groupBy("label", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "e"))).alias("a"))
    return g.select("label", "block", F.col("a")[0]["e"].alias("q"), F.transform(F.slice("a", 2, 5), lambda x: x["e"]).alias("chunks"))


def softmax_methods_all(spark, sf):
    """Both ways of pooling, and the adaptive beta, over records made of all vectors."""
    g = all_queries_and_chunks(spark, sf).withColumn("sims", F.transform("chunks", lambda c: v.cosine(F.col("q"), c)))
    w = [(b, v.cosine(F.col("q"), v.weighted_sum(F.col("chunks"), v.softmax(F.col("sims"), b), 64))) for b in (0.5, 1.0, 2.0)]
    out = g.select("label", "block", F.size("chunks").cast("long").alias("n_chunks"), v.pooled_similarity(F.col("sims")).alias("method_a"), v.adaptive_beta(F.col("sims")).alias("beta"), *[c.alias(f"method_b_{str(b).replace('.', '_')}") for b, c in w])
    return rounded(out, "method_a", "beta", "method_b_0_5", "method_b_1_0", "method_b_2_0")


# statistics ------------------------------------------------------------------------------------------------------------------------
def judged(spark, sf):
    return table(spark, sf, "scored").filter("gemini_judgement IS NOT NULL AND score1 IS NOT NULL AND score2 IS NOT NULL").select("row_id", F.col("gemini_judgement").alias("label"), "score1", "score2")


def configs(spark, sf):
    j = judged(spark, sf)
    return j.select("row_id", "label", F.explode(F.array(F.struct(F.lit("base").alias("config"), F.col("score1").alias("score")), F.struct(F.lit("alt").alias("config"), F.col("score2").alias("score")))).alias("x")).select("row_id", "label", "x.config", "x.score")


def group_means(spark, sf):
    s = table(spark, sf, "scored").withColumn("b", v.beta_lookup(F.col("new_score1_b_by_beta")))
    out = st.group_means(s, F.col("gemini_judgement"), ["score1", "score2"], {"improved": F.col("b") > F.col("score1")})
    return rounded(out, "mean_score1", "mean_score2", "rate_improved")


def roc_auc(spark, sf):
    return rounded(st.roc_auc(configs(spark, sf), ["config"], "label", "score"), "auc")


def precision_thresholds(spark, sf):
    return rounded(st.precision_threshold(configs(spark, sf), ["config"], "label", "score", 0.7, 5), "threshold", "precision")


def threshold_scan(spark, sf):
    return rounded(st.threshold_scan(configs(spark, sf), ["config"], "label", "score"), "threshold", "precision")


def cv_threshold(spark, sf):
    j = judged(spark, sf).withColumn("fold", (F.col("row_id") % 5).cast("int"))
    return rounded(st.cross_validated_threshold(j, "fold", "label", "score1", 5, 0.6, 3), "threshold", "precision")


def cv_threshold_max(spark, sf):
    j = judged(spark, sf).withColumn("fold", (F.col("row_id") % 5).cast("int"))
    return rounded(st.cross_validated_threshold(j, "fold", "label", "score1", 5, 0.6, 3, combine="max"), "threshold", "precision")


def config_gaps(spark, sf):
    """Class gaps of all eight configurations; configuration k of the grid has k / 7 of the second score and the rest of the first."""
    grid = [x["config"] for x in st.config_grid(spark).collect()]  # eight literals
    mixed = F.array(*[F.struct(F.lit(c).alias("config"), (F.col("score1") * (1 - k / 7) + F.col("score2") * (k / 7)).alias("score")) for k, c in enumerate(sorted(grid))])
    c = judged(spark, sf).select("label", F.explode(mixed).alias("x")).select("label", "x.config", "x.score")
    return rounded(st.class_gap(c, ["config"], "label", "score"), "gap")


def class_gaps(spark, sf):
    g = st.ranked(st.class_gap(configs(spark, sf), ["config"], "label", "score"), "gap", "config")
    return rounded(g, "gap")


def paired_wins(spark, sf):
    p = st.paired_configs(configs(spark, sf), ["row_id", "label"], "config", "base", "score")
    return rounded(st.paired_wins(p, "label", "base_value", "value"), "rate_all", "rate_moved")


def pass_counts(spark, sf):
    return st.scored_pass(judged(spark, sf), "score1", 0.5)


def length_histogram(spark, sf):
    return rounded(st.histogram(table(spark, sf, "documents"), "n_chars", 50), "left_edge")


def length_percentiles(spark, sf):
    return rounded(st.percentiles(table(spark, sf, "documents"), ["lang"], "n_chars"), "mean", "p80", "p99")


def answer_lengths(spark, sf):
    p = table(spark, sf, "prediction").withColumn("status", F.lower(F.trim("status")))
    return p.select("model", "status", F.char_length("root_cause").alias("rc"), F.char_length("repair_suggestion").alias("rs"), F.char_length("raw_output").alias("raw"))


def metric_stats(spark, sf):
    out = answer_lengths(spark, sf).groupBy("model").agg(*st.described("rc"))
    return rounded(out, "mean", "variance", "stdev")


def status_pivot(spark, sf):
    return rounded(st.status_pivot(answer_lengths(spark, sf), ["model"], "status", ["rc", "rs", "raw"], "resolved", "failed"), "mean_resolved", "mean_failed", "difference")


def model_pivot(spark, sf):
    return rounded(st.best_by_metric(answer_lengths(spark, sf), "model", ["rc", "rs", "raw"]), "mean")


# training --------------------------------------------------------------------------------------------------------------------------
def token_budget(spark, sf):
    cols = {"problem": "problem_statement", "slice": "buggy_slice", "win_rc": "win_rc", "win_rs": "win_rs", "lose_rc": "lose_rc", "lose_rs": "lose_rs"}
    f = tr.within_tokens(table(spark, sf, "final_row"), cols, "fine_tuning", 400, 60)
    return f.select("row_id", "fitted.original_total", "fitted.final_total", F.array_join("fitted.actions", ",").alias("actions"), F.md5(F.col("fitted.problem").cast("binary")).alias("problem"))


#: The wording that the test queries train with.
TASKS = {"A": "Name the root cause.", "B": "Name the repair.", "C": "Name cause and repair."}


def train_rows_abc(spark, sf):
    f = table(spark, sf, "final_row").filter(tr.usable_for_training("fine_tuning", "win_rc", "win_rs", "lose_rc", "lose_rs"))
    t = f.select("row_id", F.explode(task_rows(*[F.col(c) for c in ("problem_statement", "buggy_slice", "win_rc", "win_rs", "lose_rc", "lose_rs")], ROLE, GIVEN, TASKS)).alias("x"))
    return t.select("row_id", "x.task", F.md5(F.col("x.input").cast("binary")).alias("input"), F.md5(F.col("x.win").cast("binary")).alias("win"), F.md5(F.col("x.lose").cast("binary")).alias("lose"))


def preference_loss(spark, sf):
    """Losses over log-probabilities that stand in for a model's: they follow from the lengths of the texts."""
    p = lambda c: -((F.char_length(F.coalesce(c, F.lit(""))) % 17) + 1) / F.lit(4.0)
    f = table(spark, sf, "final_row").select("split", "fine_tuning", p("win_rc").alias("w"), p("lose_rc").alias("l"))
    out = tr.loss_report(tr.preference_losses(f, "fine_tuning", "w", "l"), "split", "fine_tuning")
    return rounded(out, "sft_loss", "ratio_loss", "total_loss", "accuracy", "margin")


def preference_loss_by_task(spark, sf):
    """The roll-up by task, over log-probabilities that follow from the lengths of each task's answers."""
    p = lambda *cs: -((sum((F.char_length(F.coalesce(c, F.lit(""))) for c in cs), F.lit(0)) % 17) + 1) / F.lit(4.0)
    tasks = (("A", ("rc",)), ("B", ("rs",)), ("C", ("rc", "rs")))
    rows = F.array(*[F.struct(F.lit(t).alias("task"), p(*[f"win_{c}" for c in cs]).alias("w"), p(*[f"lose_{c}" for c in cs]).alias("l")) for t, cs in tasks])
    f = table(spark, sf, "final_row").select("fine_tuning", F.explode(rows).alias("x")).select("fine_tuning", "x.*")
    out = tr.task_loss_report(tr.preference_losses(f, "fine_tuning", "w", "l"), "task")
    return rounded(out, "sft_loss", "ratio_loss", "total_loss", "accuracy", "margin", "chosen", "rejected", "log_odds")


def exact_split_shares(spark, sf):
    return tr.exact_split(table(spark, sf, "final_row").select("row_id"), "row_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_rows"))


def split_shares(spark, sf):
    return tr.hash_split(table(spark, sf, "final_row"), "row_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# language --------------------------------------------------------------------------------------------------------------------------
def jaccard_family(spark, sf):
    p = table(spark, sf, "prediction").filter("root_cause IS NOT NULL AND repair_suggestion IS NOT NULL")
    w = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda x: x != "")
    q = p.select("row_id", w("root_cause").alias("a"), w("repair_suggestion").alias("b"))
    out = q.select("row_id", F.size(F.array_union("a", "b")).cast("long").alias("n_union"), F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), lang.jaccard(F.col("a"), F.col("b"), 1.0).alias("jaccard"), lang.multiset_jaccard(F.col("a"), F.col("b"), 1.0).alias("with_repeats"))
    return rounded(out, "jaccard", "with_repeats")


def bleu_pairs(spark, sf):
    r = table(spark, sf, "refined")
    return r.select("row_id", F.round(lang.bleu("refined_root_cause", "old_root_cause"), 4).alias("bleu"))


def evidence_overlap(spark, sf):
    """Concepts and actions over tokens annotated by position and length, which exercise the rules without a parser."""
    p = table(spark, sf, "prediction").filter("root_cause IS NOT NULL AND repair_suggestion IS NOT NULL")

    def tokens(c):
        ws = F.filter(F.split(F.lower(c), r"[^A-Za-z0-9_]+"), lambda x: x != "")
        n = F.size(ws)

        def one(x, i):
            k = i % 4
            pos = F.when(k == 0, "VERB").when(k == 3, "NOUN").when(k == 2, F.lit("NOUN")).otherwise("DET")
            dep = F.when(k == 3, "dobj").when(k == 2, "compound").otherwise("det")
            head = F.when(k == 3, i - 3).when(k == 2, F.least(i + 1, n - 1)).otherwise(i)
            return F.struct(i.alias("i"), x.alias("text"), x.alias("lemma"), pos.alias("pos"), dep.alias("dep"), head.alias("head"), (F.length(x) < 3).alias("is_stop"), F.lit(False).alias("is_punct"), x.rlike(r"^\d+$").alias("like_num"))

        return F.transform(ws, one)

    q = p.select("row_id", tokens("root_cause").alias("a"), tokens("repair_suggestion").alias("b"))
    s = q.select("row_id", lang.evidence_scores(lang.cause_concepts(F.col("a")), lang.cause_concepts(F.col("b")), lang.repair_actions(F.col("a")), lang.repair_actions(F.col("b"))).alias("s"))
    return rounded(s.select("row_id", "s.ess", "s.ras", "s.esra"), "ess", "ras", "esra")


QUERIES = {
    f.__name__: f
    for f in (
        cosine_pairs, pair_scores, softmax_methods_all, config_gaps, group_means, roc_auc, precision_thresholds, threshold_scan, cv_threshold, cv_threshold_max, class_gaps, paired_wins, pass_counts, length_histogram, length_percentiles, metric_stats, status_pivot, model_pivot,
        token_budget, train_rows_abc, preference_loss, preference_loss_by_task, split_shares, exact_split_shares, jaccard_family, bleu_pairs, evidence_overlap,
    )
}

_J = "j AS (SELECT row_id, gemini_judgement AS label, score1, score2 FROM scored WHERE gemini_judgement IS NOT NULL AND score1 IS NOT NULL AND score2 IS NOT NULL)"
_C = _J + ", c AS (SELECT row_id, label, 'base' AS config, score1 AS score FROM j UNION ALL SELECT row_id, label, 'alt', score2 FROM j)"
_S = _C + ", t AS (SELECT i * 0.01::DOUBLE AS threshold FROM range(101) r(i)), s AS (SELECT config, threshold, count(*) FILTER (score >= threshold) AS n_selected, count(*) FILTER (score >= threshold AND label) AS n_correct FROM c, t GROUP BY config, threshold)"
_Q = "q AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label)"
_L = "l AS (SELECT model, lower(trim(status)) AS status, length(root_cause) AS rc, length(repair_suggestion) AS rs, length(raw_output) AS raw FROM prediction)"
_LONG = _L + ", x AS (SELECT model, status, 'rc' AS metric, rc AS v FROM l UNION ALL SELECT model, status, 'rs', rs FROM l UNION ALL SELECT model, status, 'raw', raw FROM l)"
_U = "upper(trim(coalesce(fine_tuning, '')))"
_OK = f"trim(coalesce(win_rc, '')) <> '' AND trim(coalesce(win_rs, '')) <> '' AND ({_U} = 'SFT' OR ({_U} = 'ORPO' AND trim(coalesce(lose_rc, '')) <> '' AND trim(coalesce(lose_rs, '')) <> ''))"


def _ask(task: str, extra: str = "") -> str:
    head = f"'<|im_start|>system' || {NL} || '{ROLE}' || {NL} || '<|im_end|>' || {NL} || '<|im_start|>user' || {NL} || '{GIVEN}' || {NL} || {NL} || 'Perform the following Task:' || {NL} || '{TASKS[task]}' || {NL} || {NL}"
    return f"md5({head} || '# GitHub Issue Description:' || {NL} || p || {NL} || {NL} || '# Segments Groups:' || {NL} || s{extra} || {NL} || {NL} || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL})"


def _answers(task: str) -> str:
    def one(side: str) -> str:
        rc, rs = (f"'# {h}:' || {NL} || {trim_sql(f'coalesce({side}_{c}, {chr(39) * 2})')}" for h, c in (("Root Cause", "rc"), ("Repair Suggestion", "rs")))
        return {"A": rc, "B": rs, "C": f"{rc} || {NL} || {NL} || {rs}"}[task]

    return ", ".join(f"md5({one(side)} || '<|im_end|>') AS {side}" for side in ("win", "lose"))


def _b(beta: float) -> str:
    w = f"[exp((x - list_max(sims)) / {beta}::DOUBLE) for x in sims]"
    dim = f"list_sum([{w}[k] * chunks[k][d] for k in range(1, len(chunks) + 1)]) / list_sum({w})"
    return f"round(list_cosine_similarity(q, [{dim} for d in range(1, 65)]), 6)"


def _log_odds(x: str) -> str:
    return f"({x} - CASE WHEN least({x}, -1e-7) < -ln(2) THEN ln(1 - exp(least({x}, -1e-7))) ELSE ln(1 - exp(least({x}, -1e-7))) END)"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda v: v <> '')"


_BUDGET = 340


SQL = {
    "token_budget": f"""WITH w AS (SELECT row_id, {_U} = 'ORPO' AS orpo, problem_statement, {_words('problem_statement')} AS pw, len({_words('buggy_slice')}) AS s0, len({_words('win_rc')}) AS wc, len({_words('win_rs')}) AS ws, len({_words('lose_rc')}) AS lc, len({_words('lose_rs')}) AS ls FROM final_row),
        a AS (SELECT *, len(pw) AS p0, CASE WHEN orpo THEN wc + ws ELSE (CASE WHEN wc > 0 THEN wc ELSE lc END) + (CASE WHEN ws > 0 THEN ws ELSE ls END) END AS won FROM w),
        b AS (SELECT *, p0 + s0 + won + CASE WHEN orpo THEN lc + ls ELSE 0 END AS total0, p0 / nullif(p0 + s0, 0) AS r0 FROM a), c AS (SELECT *, total0 > {_BUDGET} AND p0 + s0 > 0 AS soft, total0 - {_BUDGET} AS over0 FROM b),
        d AS (SELECT *, CASE WHEN soft THEN least(floor(over0 * r0), floor(p0 * 0.3::DOUBLE))::BIGINT ELSE 0 END AS cp, CASE WHEN soft THEN least(floor(over0 * (1 - r0)), floor(s0 * 0.3::DOUBLE))::BIGINT ELSE 0 END AS cs FROM c),
        e AS (SELECT *, p0 - cp AS p1, s0 - cs AS s1, total0 - cp - cs AS total1 FROM d), f AS (SELECT *, CASE WHEN orpo AND total1 > {_BUDGET} THEN least(total1 - {_BUDGET}, floor((lc + ls) * 0.3::DOUBLE)::BIGINT) ELSE 0 END AS losing FROM e),
        g AS (SELECT *, total1 - losing AS total2, p1 / nullif(p1 + s1, 0) AS r1 FROM f), h AS (SELECT *, total2 > {_BUDGET} AND p1 + s1 > 0 AS force, total2 - {_BUDGET} AS over2 FROM g),
        i AS (SELECT *, CASE WHEN force THEN floor(over2 * r1)::BIGINT + 1 ELSE 0 END AS fp, CASE WHEN force THEN floor(over2 * (1 - r1))::BIGINT + 1 ELSE 0 END AS fs FROM h), j AS (SELECT *, greatest(p1 - fp, 0) AS p2, greatest(s1 - fs, 0) AS s2 FROM i)
        SELECT row_id, total0::INT AS original_total, (total2 - p1 - s1 + p2 + s2)::INT AS final_total, coalesce(nullif(concat_ws(',', CASE WHEN soft THEN 'soft_context(' || (cp + cs) || ')' END, CASE WHEN losing > 0 THEN 'soft_losing(' || losing || ')' END, CASE WHEN force THEN 'force_context(' || (fp + fs) || ')' END), ''), 'none') AS actions,
        md5(CASE WHEN p2 = p0 THEN coalesce(problem_statement, '') ELSE array_to_string(pw[1:p2], ' ') END) AS problem FROM j""",
    "cosine_pairs": f"WITH {_Q} SELECT vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS similarity FROM embeddings JOIN q USING (label)",
    "pair_scores": """WITH n AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 4 AS k FROM embeddings), g AS (SELECT label, k, list(e ORDER BY vec_id) AS v FROM n GROUP BY ALL)
        SELECT label, k, CASE WHEN len(v) = 4 THEN round(list_cosine_similarity(v[1], v[2]), 6) ELSE 0 END AS score1, CASE WHEN len(v) = 4 THEN round(list_cosine_similarity(v[3], v[4]), 6) ELSE 0 END AS score2 FROM g""",
    "softmax_methods_all": f"""WITH n AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings), q AS (SELECT label, k // 6 AS block, e AS q FROM n WHERE k % 6 = 0),
        g AS (SELECT label, k // 6 AS block, list(e ORDER BY vec_id) AS chunks FROM n WHERE k % 6 > 0 GROUP BY ALL), h AS (SELECT label, block, q, chunks, [list_cosine_similarity(q, c) for c in chunks] AS sims FROM q LEFT JOIN g USING (label, block))
        SELECT label, block, coalesce(len(chunks), 0)::BIGINT AS n_chunks, coalesce(round(list_sum([exp(x - list_max(sims)) * x for x in sims]) / list_sum([exp(x - list_max(sims)) for x in sims]), 6), 0) AS method_a,
        CASE WHEN chunks IS NULL THEN 1.0 ELSE round(least(1.0, greatest(0.5, 1 - 0.5 * (list_max(sims) - list_min(sims)))), 6) END::DOUBLE AS beta,
        {", ".join(f"CASE WHEN chunks IS NULL THEN 0.0::DOUBLE ELSE {_b(b)} END AS method_b_{str(b).replace('.', '_')}" for b in (0.5, 1.0, 2.0))} FROM h""",
    "group_means": """WITH s AS (SELECT *, coalesce(new_score1_b_by_beta['1.0'], new_score1_b_by_beta['1']) AS b, CASE WHEN gemini_judgement THEN 'true' ELSE 'false' END AS g FROM scored)
        SELECT coalesce(g, 'all') AS "group", count(*) AS n, round(coalesce(avg(score1), 0), 6) AS mean_score1, round(coalesce(avg(score2), 0), 6) AS mean_score2, count(*) FILTER (b > score1) AS n_improved, round(count(*) FILTER (b > score1) / greatest(count(*), 1), 6) AS rate_improved FROM s GROUP BY ROLLUP (g)""",
    "roc_auc": f"""WITH {_C} SELECT p.config, (SELECT count(*) FROM j WHERE label) AS n_positive, (SELECT count(*) FROM j WHERE NOT label) AS n_negative, round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auc
        FROM c p JOIN c n ON p.config = n.config AND p.label AND NOT n.label GROUP BY p.config""",
    "precision_thresholds": f"WITH {_S}, ok AS (SELECT *, n_correct / n_selected AS precision FROM s WHERE n_selected >= 5 AND n_correct / n_selected >= 0.7) SELECT config, round(min(threshold), 6) AS threshold, arg_min(n_selected, threshold) AS n_selected, round(arg_min(precision, threshold), 6) AS precision FROM ok GROUP BY config",
    "threshold_scan": f"WITH {_S} SELECT config, round(threshold, 6) AS threshold, n_selected, n_correct, CASE WHEN n_selected > 0 THEN round(n_correct / n_selected, 6) END AS precision FROM s",
    "cv_threshold": f"""WITH {_J}, f AS (SELECT *, row_id % 5 AS fold FROM j), t AS (SELECT i * 0.01::DOUBLE AS t FROM range(101) r(i)), h AS (SELECT i AS held FROM range(5) r(i)),
        p AS (SELECT held, t, count(*) AS n, count(*) FILTER (label) AS k FROM f, t, h WHERE fold <> held AND score1 >= t GROUP BY held, t), m AS (SELECT held, min(t) AS t FROM p WHERE n >= 3 AND k / n >= 0.6 GROUP BY held),
        v AS (SELECT m.held, m.t, count(*) FILTER (score1 >= m.t) AS n, count(*) FILTER (score1 >= m.t AND label) AS k FROM m JOIN f ON f.fold = m.held GROUP BY m.held, m.t)
        SELECT count(*) AS n_folds, CASE WHEN count(*) = 5 THEN round(avg(t), 6) END AS threshold, CASE WHEN count(*) = 5 THEN round(avg(CASE WHEN n > 0 THEN k / n ELSE 0.0 END), 6) END AS precision FROM v""",
    "cv_threshold_max": f"""WITH {_J}, f AS (SELECT *, row_id % 5 AS fold FROM j), t AS (SELECT i * 0.01::DOUBLE AS t FROM range(101) r(i)), h AS (SELECT i AS held FROM range(5) r(i)),
        p AS (SELECT held, t, count(*) AS n, count(*) FILTER (label) AS k FROM f, t, h WHERE fold <> held AND score1 >= t GROUP BY held, t), m AS (SELECT held, min(t) AS t FROM p WHERE n >= 3 AND k / n >= 0.6 GROUP BY held),
        v AS (SELECT m.held, m.t, count(*) FILTER (score1 >= m.t) AS n, count(*) FILTER (score1 >= m.t AND label) AS k FROM m JOIN f ON f.fold = m.held GROUP BY m.held, m.t)
        SELECT count(*) AS n_folds, CASE WHEN count(*) = 5 THEN round(max(t), 6) END AS threshold, CASE WHEN count(*) = 5 THEN round(avg(CASE WHEN n > 0 THEN k / n ELSE 0.0 END), 6) END AS precision FROM v""",
    "config_gaps": f"""WITH {_J}, k AS (SELECT unnest(['full_block', 'full_legacy', 'noise_block', 'noise_legacy', 'none_block', 'none_legacy', 'semantic_block', 'semantic_legacy']) AS config, unnest(range(8)) AS i), c AS (SELECT config, label, score1 * (1 - i / 7.0::DOUBLE) + score2 * (i / 7.0::DOUBLE) AS score FROM j, k)
        SELECT config, round(avg(score) FILTER (label) - avg(score) FILTER (NOT label), 6) AS gap FROM c GROUP BY config""",
    "class_gaps": f"WITH {_C}, g AS (SELECT config, avg(score) FILTER (label) - avg(score) FILTER (NOT label) AS gap FROM c GROUP BY config) SELECT config, round(gap, 6) AS gap, row_number() OVER (ORDER BY gap DESC, config)::INT AS place FROM g",
    "paired_wins": f"""WITH {_J}, w AS (SELECT (label AND score2 > score1) OR (NOT label AND score2 < score1) AS win, score1 <> score2 AS moved FROM j)
        SELECT count(*) AS n_pairs, count(*) FILTER (win) AS n_wins, count(*) FILTER (moved) AS n_moved, round(count(*) FILTER (win) / count(*), 6) AS rate_all, round(count(*) FILTER (win) / nullif(count(*) FILTER (moved), 0), 6) AS rate_moved FROM w""",
    "pass_counts": f"WITH {_J} SELECT count(*) FILTER (score1 >= 0.5) AS n_pass, count(*) AS n FROM j",
    "length_histogram": """WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, (max(n_chars) - min(n_chars)) / 50.0::DOUBLE AS w FROM documents), b AS (SELECT least(floor((n_chars - lo) / w), 49)::INT AS bin, lo, w FROM documents, e WHERE n_chars IS NOT NULL)
        SELECT bin, round(lo + bin * w, 6) AS left_edge, count(*) AS n FROM b GROUP BY bin, lo, w""",
    "length_percentiles": "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, max(n_chars)::DOUBLE AS max, round(quantile_cont(n_chars, 0.8), 6) AS p80, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY lang",
    "metric_stats": f"WITH {_L} SELECT model, coalesce(max(rc), 0)::DOUBLE AS max, coalesce(min(rc), 0)::DOUBLE AS min, round(coalesce(avg(rc), 0), 6) AS mean, round(coalesce(var_samp(rc), 0), 6) AS variance, round(coalesce(stddev_samp(rc), 0), 6) AS stdev FROM l GROUP BY model",
    "status_pivot": f"WITH {_LONG} SELECT model, metric, round(avg(v) FILTER (status = 'resolved'), 6) AS mean_resolved, round(avg(v) FILTER (status = 'failed'), 6) AS mean_failed, round(avg(v) FILTER (status = 'resolved') - avg(v) FILTER (status = 'failed'), 6) AS difference FROM x GROUP BY model, metric",
    "model_pivot": f"WITH {_LONG}, m AS (SELECT metric, model, coalesce(avg(v), 0) AS mean FROM x GROUP BY metric, model) SELECT metric, model, round(mean, 6) AS mean, mean = max(mean) OVER (PARTITION BY metric) AND max(mean) OVER (PARTITION BY metric) > 0 AS best FROM m",
    "train_rows_abc": f"""WITH f AS (SELECT *, coalesce(problem_statement, '') AS p, coalesce(buggy_slice, '') AS s FROM final_row WHERE {_OK})
        SELECT row_id, 'A' AS task, {_ask('A')} AS input, {_answers('A')} FROM f
        UNION ALL SELECT row_id, 'B', {_ask('B', f" || {NL} || {NL} || '# Root Cause:' || {NL} || win_rc")}, {_answers('B')} FROM f
        UNION ALL SELECT row_id, 'C', {_ask('C')}, {_answers('C')} FROM f""",
    "preference_loss_by_task": f"""WITH n AS (SELECT {_U} = 'ORPO' AS orpo, length(coalesce(win_rc, '')) AS wc, length(coalesce(win_rs, '')) AS ws, length(coalesce(lose_rc, '')) AS lc, length(coalesce(lose_rs, '')) AS ls FROM final_row),
        t AS (SELECT orpo, 'A' AS task, wc AS a, lc AS b FROM n UNION ALL SELECT orpo, 'B', ws, ls FROM n UNION ALL SELECT orpo, 'C', wc + ws, lc + ls FROM n), f AS (SELECT orpo, task, -((a % 17) + 1) / 4.0::DOUBLE AS w, -((b % 17) + 1) / 4.0::DOUBLE AS l FROM t),
        g AS (SELECT *, {_log_odds('w')} - {_log_odds('l')} AS o FROM f), p AS (SELECT task, count(*) AS n, count(*) FILTER (orpo) AS n_orpo, avg(-w) AS sft, coalesce(sum(ln(1 + exp(-o))) FILTER (orpo), 0) / count(*) AS ratio FROM g GROUP BY task)
        SELECT task, n, n_orpo, round(sft, 6) AS sft_loss, round(ratio, 6) AS ratio_loss, round(sft + 0.1::DOUBLE * ratio, 6) AS total_loss, NULL::DOUBLE AS accuracy, NULL::DOUBLE AS margin, NULL::DOUBLE AS chosen, NULL::DOUBLE AS rejected, NULL::DOUBLE AS log_odds FROM p
        UNION ALL SELECT 'all', (SELECT sum(n)::BIGINT FROM p), (SELECT sum(n_orpo)::BIGINT FROM p), round((SELECT avg(sft) FROM p), 6), round((SELECT avg(ratio) FROM p), 6), round((SELECT avg(sft) + 0.1::DOUBLE * avg(ratio) FROM p), 6),
        round(count(*) FILTER (w > l) / count(*), 6), round(avg(w - l), 6), round(avg(w), 6), round(avg(l), 6), round(avg(o), 6) FROM g WHERE orpo""",
    "preference_loss": f"""WITH f AS (SELECT split, {_U} = 'ORPO' AS orpo, -((length(coalesce(win_rc, '')) % 17) + 1) / 4.0::DOUBLE AS w, -((length(coalesce(lose_rc, '')) % 17) + 1) / 4.0::DOUBLE AS l FROM final_row),
        g AS (SELECT *, CASE WHEN orpo THEN ln(1 + exp(-({_log_odds('w')} - {_log_odds('l')}))) ELSE 0.0 END AS ratio FROM f)
        SELECT split, count(*) AS n, count(*) FILTER (orpo) AS n_orpo, round(avg(-w), 6) AS sft_loss, round(avg(ratio), 6) AS ratio_loss, round(avg(-w) + 0.1::DOUBLE * avg(ratio), 6) AS total_loss, round(count(*) FILTER (orpo AND w > l) / nullif(count(*) FILTER (orpo), 0), 6) AS accuracy,
        round(avg(w - l) FILTER (orpo), 6) AS margin FROM g GROUP BY split""",
    "exact_split_shares": "WITH n AS (SELECT count(*) AS n, floor(count(*) * 0.85::DOUBLE)::BIGINT AS k FROM final_row) SELECT 'train' AS part, k AS n, k AS n_rows FROM n UNION ALL SELECT 'held_out', n - k, n - k FROM n",
    "jaccard_family": """WITH q AS (SELECT row_id, list_filter(regexp_split_to_array(lower(root_cause), '[^a-z0-9_]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(repair_suggestion), '[^a-z0-9_]+'), lambda x: x <> '') AS b FROM prediction WHERE root_cause IS NOT NULL AND repair_suggestion IS NOT NULL),
        u AS (SELECT row_id, a, b, list_distinct(list_concat(a, b)) AS u FROM q)
        SELECT row_id, len(u)::BIGINT AS n_union, len(list_intersect(list_distinct(a), list_distinct(b)))::BIGINT AS n_both, CASE WHEN len(u) = 0 THEN 1.0 ELSE round(len(list_intersect(list_distinct(a), list_distinct(b))) / len(u), 6) END::DOUBLE AS jaccard,
        CASE WHEN len(u) = 0 THEN 1.0 ELSE round(list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) for x in u]) / list_sum([greatest(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) for x in u]), 6) END::DOUBLE AS with_repeats FROM u""",
}
