"""Model, search and embedding services as request and response tables: the engine writes the one and reads the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import message_content

CHAT_REQUEST = "custom_id string, method string, url string, body struct<model:string, messages:array<struct<role:string,content:string>>, temperature:double, top_p:double, max_tokens:int, stream:boolean>"
SEARCH_ITEM = "repository_url string, html_url string, title string, body string, created_at string, number bigint, comments bigint"
TIMELINE_EVENT = "event string, source struct<issue:struct<number:bigint, body:string, pull_request:struct<merged_at:string>>>"
PULL_FILE = "filename string, additions bigint, deletions bigint"
#: What a comparison of two commits answers, as JSON; asked for as a diff it is a text.
COMPARISON = "status string, ahead_by bigint, behind_by bigint, merge_base_commit struct<sha:string>, files array<struct<filename:string, status:string, additions:bigint, deletions:bigint, patch:string>>"
BATCH_STATE = "batch int, id string, status string, output_file_id string, error_file_id string"
CLONE_RESULT = "dir string, repo string, sha string, code int, error string, tries int, complete boolean"
#: States in which a batch of requests stays. Fixed values.
TERMINAL_STATES = ("completed", "failed", "cancelled", "expired")
EMBEDDING = "text_id string, ordinal int, embedding array<double>"


def batches(requests: DataFrame, most_rows: int = 5000, most_bytes: int = 1_000_000_000) -> DataFrame:
    """Requests (custom_id, line) with `batch`, a number so that no batch has more rows or bytes than a service takes.

    Rows are hashed into as many batches as the larger of both needs asks for, with a tenth to spare; counts are one aggregate.
    """
    rows, size = F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("line")), F.lit(0))
    need = requests.agg(F.greatest(F.ceil(rows * 1.1 / most_rows), F.ceil(size * 1.1 / most_bytes), F.lit(1))).scalar()
    return requests.withColumn("batch", F.pmod(F.xxhash64("custom_id"), need))


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each request with the text of its response (a JSON line by custom_id), or null; the first response by text counts."""
    texts = responses.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), message_content("value").alias("content"))
    return requests.join(texts.groupBy("custom_id").agg(F.min("content").alias("content")), "custom_id", "left")


def settled(states: DataFrame, status: str = "status") -> DataFrame:
    """Batches with `done` (the state is one in which they stay, whatever its case) and `good` (it is `completed`); null is neither."""
    low = F.lower(F.trim(F.coalesce(F.col(status), F.lit(""))))
    return states.withColumn("done", low.isin(*TERMINAL_STATES)).withColumn("good", low == "completed")


def comparison_requests(changes: DataFrame, repo: str, base: str, head: str) -> DataFrame:
    """The distinct comparisons to ask for; changes without repository or commits need none."""
    return changes.select(F.col(repo).alias("repo"), F.col(base).alias("base"), F.col(head).alias("head")).filter("repo <> '' AND base <> '' AND head <> ''").distinct()


def merge_bases(answers: DataFrame) -> DataFrame:
    """repo, base, head and merge_base of answered comparisons (repo, base, head, value: the JSON text); null where it can't be read."""
    return answers.select("repo", "base", "head", F.from_json("value", COMPARISON)["merge_base_commit"]["sha"].alias("merge_base"))


def last_attempts(attempts: DataFrame, key: str, attempt: str, scores: list[str], most: int = 3) -> DataFrame:
    """Of the attempts at each key the first with a score other than 0, else the last of the first `most`; attempts_used is its number.

    Null scores count as 0. Ties in `attempt` can't be told apart and must not occur.
    """
    from sievewright.operators.relational import first_wins

    some = F.lit(False)
    for c in scores:
        some = some | (F.coalesce(F.col(c), F.lit(0.0)) != 0)
    rows = attempts.filter(F.col(attempt) <= most).withColumn("__empty", ~some)
    order = [F.col("__empty").cast("int"), F.when(F.col("__empty"), -F.col(attempt)).otherwise(F.col(attempt))]
    return first_wins(rows, [key], order).withColumn("attempts_used", F.col(attempt)).drop("__empty")
