"""Queries through files: JSON lines written and read again, bad lines, line numbers, resumed runs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievewright.plans.text_queries import table
from sievewright.session import run_dir
from sievewright.sources import jsonl
from sievewright.streaming import incremental

PROMPT = "instance_id string, prompt string, status string"


def folder(spark, name: str) -> str:
    """A new folder in the shared one; it goes with the application's other tables."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hashed(df):
    return df.select("instance_id", F.md5(F.coalesce("prompt", F.lit("")).cast("binary")).alias("prompt"), "status")


def json_lines_round_trip(spark, sf):
    """All prompts as JSON lines, nulls kept, and read again."""
    path = folder(spark, "lines")
    jsonl.write_lines(table(spark, sf, "eval_prompt"), path)
    return hashed(jsonl.tolerant(spark, path, PROMPT))


def tolerant_lines(spark, sf):
    """Good and bad lines of a file in which rows without a status are broken, null, blank or no object, by turns."""
    path = folder(spark, "mixed")
    p = table(spark, sf, "eval_prompt")
    turn = F.pmod(F.char_length("instance_id"), F.lit(4))
    broken = F.when(turn == 0, '{"instance_id": ').when(turn == 1, "null").when(turn == 2, " ").otherwise("[1, 2]")
    p.select(F.when(F.col("status").isNull(), broken).otherwise(F.to_json(F.struct(*p.columns))).alias("value")).write.text(path)
    good, counts = jsonl.with_rejects(spark, path, PROMPT)
    return counts.withColumn("n_ids", good.agg(F.count_distinct("instance_id")).scalar())


def ordered_lines(spark, sf):
    """Scores in the order of their rows as lines, those without a verdict as null lines, with the number of each line."""
    path = folder(spark, "ordered")
    s = table(spark, sf, "scored").select("row_id", "score1", "gemini_judgement")
    jsonl.write_ordered(s, path, "row_id", F.col("gemini_judgement").isNotNull())
    lines = jsonl.numbered_lines(spark, path)
    return lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == "null").alias("n_null"), F.sum(F.get_json_object("value", "$.score1").cast("double")).alias("total")).withColumn("total", F.round("total", 6))


def resumed_run(spark, sf):
    """A run over half of the rows, and one over all that goes on where the first ended: each key once."""
    path = folder(spark, "resumed")
    p = table(spark, sf, "prediction").select("row_id", "model")
    step = lambda df: df.withColumn("n_chars", F.char_length("model"))
    jsonl.resume(p.filter("row_id % 2 = 0"), path, "row_id", step)
    return jsonl.resume(p, path, "row_id", step).select("row_id", "model", "n_chars")


def incremental_run(spark, sf):
    """Files of JSON lines as a stream, in two runs: every prompt comes out once, those with a known status not at all."""
    source, out, state = folder(spark, "incoming"), folder(spark, "appended"), folder(spark, "state")
    p = table(spark, sf, "eval_prompt")
    known = p.filter("status = 'resolved'").select("instance_id")
    for part in (p.filter("char_length(instance_id) % 2 = 0"), p):  # the second delivery repeats the first
        part.coalesce(2).write.mode("append").option("ignoreNullFields", "false").json(source)
        stream = incremental.fresh(incremental.incoming(spark, source, PROMPT), ["instance_id"], "instance_id", "0 seconds", known)
        incremental.append_each(stream, out, state).awaitTermination()
    return hashed(spark.read.parquet(out))


QUERIES = {f.__name__: f for f in (json_lines_round_trip, tolerant_lines, ordered_lines, resumed_run, incremental_run)}

_HASHED = "SELECT instance_id, md5(coalesce(prompt, '')) AS prompt, status FROM eval_prompt"

SQL = {
    "json_lines_round_trip": _HASHED,
    "tolerant_lines": "SELECT count(*) FILTER (status IS NOT NULL) AS ok, count(*) FILTER (status IS NULL AND length(instance_id) % 4 IN (0, 3)) AS bad, count(DISTINCT instance_id) FILTER (status IS NOT NULL) AS n_ids FROM eval_prompt",
    "ordered_lines": "SELECT count(*) AS n, count(*) FILTER (gemini_judgement IS NULL) AS n_null, round(sum(score1) FILTER (gemini_judgement IS NOT NULL), 6) AS total FROM scored",
    "resumed_run": "SELECT row_id, model, length(model)::INT AS n_chars FROM prediction",
    "incremental_run": _HASHED + " WHERE coalesce(status, '') <> 'resolved'",
}
