"""The records of the pipeline as schemas, and frames brought into their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTS = "array<struct<suspicious:struct<file:string,content:string>,supplementary:struct<file:string,content:string>>>"

RECORDS: dict[str, str] = {
    "keywords": "key_words struct<problem_behaviors:array<string>,error_patterns:array<string>,code_elements:array<string>,domain_context:array<string>>, source_custom_id string",
    "mined_issue": "repo string, issue_id long, created_at string, instance_time string, url string, title string, body string, comments_count long, query_used string, query_type string, keywords_used array<string>, found_in_query_count long",
    "flat_pr": "repo string, url string, issue_id long, body_length long, has_code_example boolean, has_error_message boolean, star long, archived boolean, merged_pr_num string, has_code_changes boolean, if_file_ok boolean, "
    "true_base_sha string, created_at string, instance_time string, title string, body string, base_sha string, head_sha string, merged_sha string, diff_content string, diff_length long",
    "localized": f"issue_id long, repo string, base_commit string, raw_diff string, url string, title string, problem_statement string, file_search_response string, bug_localization_response string, segments {SEGMENTS}, if_ok boolean, usage_tokens long",
    "cot": f"index long, repo string, issue_id long, pr_num string, base_commit string, problem_statement string, segments {SEGMENTS}, raw_diff string, root_cause string, repair_suggestion string, repair_code string, gen_text string",
    "judged": f"index long, repo string, issue_id long, pr_num string, base_commit string, problem_statement string, segments {SEGMENTS}, raw_diff string, root_cause string, repair_suggestion string, repair_code string, "
    "judgement boolean, reasoning string, score1 double, score2 double",
    "scored": "index long, repo string, issue_id long, raw_diff string, new_diff string, judgement boolean, score1 double, score2 double, new_score1_a double, new_score2_a double, new_score1_b_by_beta map<string,double>, "
    "new_score2_b_by_beta map<string,double>, score1_b_vs_a_improved boolean, score2_b_vs_a_improved boolean, attempts_used int",
    "partitioned": f"index long, repo string, issue_id long, pr_num string, base_commit string, reasoning string, root_cause string, repair_suggestion string, problem_statement string, segments {SEGMENTS}, new_diff string, score double, fine_tuning string",
    "refined": f"index long, repo string, issue_id long, pr_num string, base_commit string, problem_statement string, segments {SEGMENTS}, new_diff string, score double, fine_tuning string, old_root_cause string, new_root_cause string, "
    "old_repair_suggestion string, new_repair_suggestion string, reasoning string, gen_text string",
    "train": "problem_statement string, buggy_slice string, fine_tuning string, win_rc string, lose_rc string, win_rs string, lose_rs string, index long",
    "eval_prompt": "instance_id string, prompt string, status string",
    "prediction": "instance_id string, root_cause string, repair_suggestion string, status string",
    "metrics": "instance_id string, model string, status string, rc_bleu4 double, rs_bleu4 double, rc_ess double, rs_ras double, esra double",
}


def schema(record: str) -> T.StructType:
    return T.StructType.fromDDL(RECORDS[record])


def conformed(df: DataFrame, record: str, **given: Column) -> DataFrame:
    """The columns of a record, in order and of its types: given expressions, else the frame's columns, else nulls.

    Texts that can't be cast become null; other columns of the frame are left out.
    """
    have = {c.lower() for c in df.columns}

    def one(f: T.StructField) -> Column:
        c = given[f.name] if f.name in given else F.col(f.name) if f.name.lower() in have else F.lit(None)
        safe = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) or not (f.name in given or f.name.lower() in have)
        return (c.cast(f.dataType) if safe else c.try_cast(f.dataType)).alias(f.name)

    return df.select(*[one(f) for f in schema(record).fields])


def nested_metrics(df: DataFrame, names: list[str]) -> DataFrame:
    """The metrics once more as a struct beside their columns."""
    return df.withColumn("metrics", F.struct(*names))
