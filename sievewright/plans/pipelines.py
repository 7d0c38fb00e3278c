"""The stages of the pipeline as functions from frames to frames; services stay outside as request and response tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import diffs as d
from sievewright.functions import language as lang
from sievewright.functions import text as t
from sievewright.functions import vectors as v
from sievewright.operators import relational as r
from sievewright.operators import statistics as st
from sievewright.operators import training as tr
from sievewright.sources.exchange import answered
from sievewright.sources.records import conformed, nested_metrics


def prepare_prompts(tasks: DataFrame, model: str, system: str, order: list[str], limit: int = 0, **options) -> DataFrame:
    """custom_id and line (JSON) of a chat request for each failed task with a text, the first `limit` of them in input order.

    `order` are the columns of that order (such as file and line_no); tasks without an id are named by their 1-based place in it.
    """
    rows = r.row_numbers(tasks.filter(t.is_failed_with_text("status", "problem_statement")), order, "__n")
    rows = r.row_slice(rows, 1, limit, "__n") if limit else rows
    return rows.select(t.chat_request(F.col("instance_id"), F.col("__n"), model, system, F.col("problem_statement"), **options).alias("r")).select("r.custom_id", F.to_json("r").alias("line"))


def extract_keywords(requests: DataFrame, responses: DataFrame, keep_empty: bool = False) -> DataFrame:
    """The keyword record of each answered request; those without behaviours only on demand."""
    k = answered(requests, responses).filter(t.present("content").isNotNull()).select(t.keyword_sections("content").alias("key_words"), F.col("custom_id").alias("source_custom_id"))
    return k if keep_empty else k.filter(F.size("key_words.problem_behaviors") > 0)


def plan_searches(keywords: DataFrame, prefix: str, most: int = 15) -> DataFrame:
    """source_custom_id, ordinal, keywords and both queries of each search to make."""
    k = F.col("key_words")
    sets = r.keyword_combinations([k["problem_behaviors"], k["error_patterns"], k["code_elements"], k["domain_context"]], most)
    return keywords.select("source_custom_id", F.posexplode(sets).alias("ordinal", "keywords")).withColumns({"q_and": t.search_query(prefix, F.col("keywords"), "AND"), "q_or": t.search_query(prefix, F.col("keywords"), "OR")})


def mine_issues(found: DataFrame, history: DataFrame | None = None, most: int = 30) -> DataFrame:
    """Search results (source, ordinal, rank and the item's columns) as mined issues: each issue once, the first `most` good ones
    of a source. An issue counts as seen before it is judged, so a bad one isn't judged again."""
    from pyspark.sql import Window as W

    rows = found.withColumn("repo", t.repo_of_url("repository_url")).withColumn("issue_id", F.col("number"))
    rows = r.first_wins(rows, ["repo", "issue_id"], ["source", "ordinal", "rank"])
    if history is not None:
        rows = r.without(rows, history, ["repo", "issue_id"])
    good = rows.filter(t.good_body("body"))
    ranked = good.withColumn("__k", F.row_number().over(W.partitionBy("source").orderBy("ordinal", "rank"))).filter(F.col("__k") <= most).drop("__k")
    return conformed(ranked, "mined_issue", url=F.col("html_url"), comments_count=F.col("comments"))


def merge_changes(changes: DataFrame, held_out: DataFrame, history: DataFrame, usable: Column, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Kept changes, with only their Python diffs, and counts of why others weren't: no diff, held out, unusable, known, repeated.

    A change is repeated if one with the same keys that has none of the other reasons comes before it by `order`, a total order.
    """
    c = changes.withColumn("diff_content", d.python_blocks("diff_content"))
    mark = lambda name, other, ks: other.select(*ks).dropna().distinct().withColumn(name, F.lit(True))
    j = c.join(mark("__held", held_out, keys[:2]), keys[:2], "left").join(mark("__known", history, keys), keys, "left")
    j = r.with_reason(j, [("empty_diff", t.present("diff_content").isNull()), ("held_out", F.col("__held")), ("unusable", ~F.coalesce(usable, F.lit(False))), ("known", F.col("__known"))])
    place = F.struct(*order)
    first = j.filter("reason = 'kept'").groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(place).alias("__first"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & j[k].eqNullSafe(first[f"__k{i}"])
    j = j.join(first, on, "left").withColumn("reason", F.when((F.col("reason") == "kept") & (place > F.col("__first")), "repeated").otherwise(F.col("reason")))
    return j.filter("reason = 'kept'").select(*changes.columns), r.reason_counts(j)


def read_generations(rows: DataFrame, text: str) -> DataFrame:
    """Root cause, suggestion and patch of tagged generations; valid rows have both texts."""
    out = rows.withColumns({"root_cause": t.tagged_section(text, "root cause"), "repair_suggestion": t.tagged_section(text, "suggestion", True), "repair_code": t.tagged_section(text, "patch")})
    return out.withColumn("valid", (F.col("root_cause") != "") & (F.col("repair_suggestion") != ""))


def read_judgements(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("__v", t.verdict(text)).withColumns({"judgement": F.col("__v.verdict"), "reasoning": F.col("__v.reason")}).drop("__v")


def scored_rows(rows: DataFrame, baseline: float = 1.0) -> DataFrame:
    """Rows with both scores by both methods (score1_a, score2_a, score1_b_by_beta, score2_b_by_beta) as scored records.

    The scores stand under their record names, with whether method B at the baseline beta beats method A for each score (a beta
    that a map lacks counts 0.0), and attempts_used, 1 where it isn't given.
    """
    b = lambda c: F.coalesce(v.beta_lookup(F.col(c), baseline), F.lit(0.0))
    out = rows.withColumns({f"score{k}_B_vs_A_improved": b(f"score{k}_b_by_beta") > F.col(f"score{k}_a") for k in (1, 2)})
    if "attempts_used" not in rows.columns:
        out = out.withColumn("attempts_used", F.lit(1))
    return out.withColumnsRenamed({"score1_a": "new_score1_A", "score2_a": "new_score2_A", "score1_b_by_beta": "new_score1_B_by_beta", "score2_b_by_beta": "new_score2_B_by_beta"})


def score_inputs(rows: DataFrame, diff: str, mode: str = "full", headers: bool = False, budget: int = 16_000, as_list: bool = True) -> DataFrame:
    """new_diff and the chunks to embed, of changes and of code, within a budget; as lists or joined by blank lines."""
    out = rows.withColumn("new_diff", d.clean_diff(mode, headers)(diff))
    chunks = {"change_chunks": d.within_budget(d.change_chunks("new_diff"), budget), "code_chunks": d.within_budget(d.code_chunks("new_diff"), budget)}
    return out.withColumns(chunks if as_list else {k: F.array_join(c, "\n\n") for k, c in chunks.items()})


def semantic_scores(embedded: DataFrame, query: str, chunks: str, dims: int, betas: tuple[float, ...] = (0.5, 0.75, 1.0, 1.5, 2.0)) -> DataFrame:
    """score_a (similarities pooled by their softmax) and score_b (a map by beta: the query against the weighted sum of chunks)."""
    out = embedded.withColumn("__s", F.transform(chunks, lambda c: v.cosine(F.col(query), c)))
    pairs = [x for b in betas for x in (F.lit(str(b)), v.cosine(F.col(query), v.weighted_sum(F.col(chunks), v.softmax(F.col("__s"), b), dims)))]
    return out.withColumns({"score_a": v.pooled_similarity(F.col("__s")), "score_b_by_beta": F.create_map(*pairs)}).drop("__s")


def analyse(scored: DataFrame, labels: DataFrame, key: str, score: str, target: float = 0.8) -> dict[str, DataFrame]:
    """AUC, class gap, threshold and pass counts of labelled scores."""
    j = r.castable(scored, [score]).join(labels, key).withColumn("__all", F.lit("all"))
    return {"auc": st.roc_auc(j, ["__all"], "label", score), "gap": st.class_gap(j, ["__all"], "label", score), "threshold": st.precision_threshold(j, ["__all"], "label", score, target), "scan": st.threshold_scan(j, ["__all"], "label", score)}


def partition(new: DataFrame, old: DataFrame | None, threshold: float = 0.776, key: str = "index", order: list[str] | None = None) -> DataFrame:
    """Rows with score (the mean of both at beta 1) and fine_tuning; old rows take the place of new ones whole.

    Of old rows with the same key the last by `order` counts (columns of the input order, such as file and line_no); without an
    order the keys must be unique.
    """
    cols = [c for c in new.columns if c != key]
    rows = new if old is None else r.overlay(new, r.last_wins(old, [key], order) if order else old, key, cols).drop("replaced")
    s = (v.beta_lookup(F.col("new_score1_b_by_beta")) + v.beta_lookup(F.col("new_score2_b_by_beta"))) / 2
    return rows.withColumn("score", s).withColumn("fine_tuning", v.partition_tag(F.col("score"), threshold))


def build_dataset(refined: DataFrame, max_tokens: int = 6144, tokenizer: Callable[[], object] = tr.Blanks) -> tuple[DataFrame, DataFrame]:
    """Training rows within the budget, and their log."""
    rows = refined.withColumn("__slice", t.formatted_segments(F.col("segments"), supplementary=False))
    cols = {"problem": "problem_statement", "slice": "__slice", "win_rc": "new_root_cause", "win_rs": "new_repair_suggestion", "lose_rc": "old_root_cause", "lose_rs": "old_repair_suggestion"}
    f = tr.within_tokens(rows, cols, "fine_tuning", max_tokens, tokenizer=tokenizer)
    x = F.col("fitted")
    train = conformed(f, "train", problem_statement=x["problem"], buggy_slice=x["slice"], **{k: x[k] for k in ("win_rc", "win_rs", "lose_rc", "lose_rs")})
    log = f.select("index", tr.tag_of("fine_tuning").alias("type"), "fitted.original_total", "fitted.final_total", "fitted.actions")
    return train.filter(tr.usable_for_training("fine_tuning", "win_rc", "win_rs", "lose_rc", "lose_rs")), log


def prepare_evaluation(tasks: DataFrame, role: str, given: str, task: str, template: str, order: list[str] | None = None) -> DataFrame:
    """The evaluation prompt of each task: issue and fenced old side of its patch, in the caller's wording (see analysis_prompt).

    One row for each instance: the first by `order`, or by status without one.
    """
    one = r.first_wins(tasks, ["instance_id"], order or ["status"])
    return conformed(one, "eval_prompt", prompt=t.analysis_prompt(F.col("problem_statement"), d.refenced(d.buggy_slice("golden_patch")), role, given, task, template))


def read_predictions(rows: DataFrame, least: int = 20) -> DataFrame:
    out = rows.withColumn("__s", t.headed_sections("raw_output")).withColumns({"root_cause": F.col("__s.root_cause"), "repair_suggestion": F.col("__s.repair_suggestion")}).drop("__s")
    return out.withColumn("valid", t.valid_answer("root_cause", "repair_suggestion", least))


def evaluate(predictions: DataFrame, references: DataFrame, done: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """BLEU of both texts of each prediction against its reference; models that are done are left out. Where tokens are given
    (rc_tokens, rs_tokens on both sides), the overlap of concepts and actions too. Of references to one instance the last by `order`
    (columns of the input order) counts; without an order they must be unique."""
    p = predictions if done is None else r.without(predictions, done, ["model"])
    ref = (r.last_wins(references, ["instance_id"], order) if order else references).select("instance_id", *[F.col(c).alias(f"ref_{c}") for c in references.columns if c != "instance_id"])
    j = p.join(ref, "instance_id")
    j = j.withColumns({"rc_bleu4": lang.bleu("root_cause", "ref_root_cause"), "rs_bleu4": lang.bleu("repair_suggestion", "ref_repair_suggestion")})
    names = ["rc_bleu4", "rs_bleu4"]
    if "rc_tokens" in predictions.columns:
        e = lang.evidence_scores(lang.cause_concepts(F.col("rc_tokens")), lang.cause_concepts(F.col("ref_rc_tokens")), lang.repair_actions(F.col("rs_tokens")), lang.repair_actions(F.col("ref_rs_tokens")))
        j = j.withColumn("__e", e).withColumns({"rc_ess": F.col("__e.ess"), "rs_ras": F.col("__e.ras"), "esra": F.col("__e.esra")}).drop("__e")
        names += ["rc_ess", "rs_ras", "esra"]
    return nested_metrics(j.select("instance_id", "model", "status", *names), names)


def report(metrics: DataFrame, names: list[str]) -> str:
    """A Markdown report: each model's mean by metric, the best marked, and the means by status."""
    best = st.best_by_metric(metrics, "model", names).orderBy("metric", "model").collect()
    status = st.status_pivot(metrics, ["model"], "status", names, "resolved", "failed").orderBy("metric", "model").collect()
    rows = [{**x.asDict(), "mean": f"**{x['mean']:.4f}**" if x["best"] else x["mean"]} for x in best]
    return "# Metrics\n\n" + st.markdown_table(rows, ["metric", "model", "mean"]) + "\n\n# By status\n\n" + st.markdown_table([x.asDict() for x in status], ["metric", "model", "mean_resolved", "mean_failed", "difference"]) + "\n"
