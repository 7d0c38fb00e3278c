import json

from pyspark.sql import functions as F

from sievewright.functions import language as lang
from sievewright.operators import relational as r
from sievewright.operators import training as tr
from sievewright.plans import pipelines as p
from sievewright.sources import jsonl, records


def test_keywords_end_to_end(spark):
    tasks = spark.createDataFrame([("i1", "Failed", "It breaks.", 1), (None, "failed", "Also.", 3), ("i3", "ok", "x", 2), ("i4", "failed", " ", 4), ("a0", "failed", "Last.", 5)], "instance_id string, status string, problem_statement string, line_no int")
    req = p.prepare_prompts(tasks, "m", "Say keywords.", ["line_no"], 2)
    lines = {x["custom_id"]: json.loads(x["line"]) for x in req.collect()}
    assert set(lines) == {"i1", "req-2"} and p.prepare_prompts(tasks, "m", "s", ["line_no"]).count() == 3 and lines["i1"]["body"]["messages"][1]["content"] == "It breaks."
    answer = {"custom_id": "i1", "content": "# problem_behaviors\ncrash, hang\n# error_patterns\nKeyError.\n"}
    resp = spark.createDataFrame([(json.dumps(answer),)], "value string")
    k = p.extract_keywords(req, resp)
    assert k.first()["key_words"]["problem_behaviors"] == ["crash", "hang"]
    assert [x["keywords"] for x in p.plan_searches(k, "is:issue ").orderBy("ordinal").collect()] == [["crash", "KeyError"], ["hang", "KeyError"], ["crash"], ["hang"]]  # no code and no domain: pairs, then single ones


def test_mining_and_merging(spark):
    body = "x" * 120 + "\n    code"
    rows = [("s", 0, i, f"https://api.example/repos/o/r{i % 2}", f"u{i}", f"t{i}", body if i != 1 else "short", "2024-01-01", i // 2, 1) for i in range(6)]
    found = spark.createDataFrame(rows, "source string, ordinal int, rank int, repository_url string, html_url string, title string, body string, created_at string, number long, comments long")
    mined = p.mine_issues(found, spark.createDataFrame([("o/r0", 0)], "repo string, issue_id long"), 3)
    assert mined.count() == 3 and mined.columns == [f.name for f in records.schema("mined_issue").fields]
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n-x\n+y"
    rows = [("o/a", "s1", 1, ""), ("o/a", "s1", 1, diff), ("o/a", "s1", 1, diff), ("o/c", "s3", 3, diff), ("o/d", "s4", 4, diff), (None, None, None, diff)]
    ch = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "repo string, sha string, issue long, diff_content string, line_no int")
    kept, why = p.merge_changes(ch, spark.createDataFrame([("o/c", "s3")], "repo string, sha string"), spark.createDataFrame([("o/d", "s4", 4)], "repo string, sha string, issue long"), F.col("issue") > 0, ["repo", "sha", "issue"], ["line_no"])
    assert {x["reason"]: x["n"] for x in why.collect()} == {"kept": 1, "repeated": 1, "empty_diff": 1, "held_out": 1, "known": 1, "unusable": 1} and [x["line_no"] for x in kept.collect()] == [1] and kept.columns == ch.columns


def test_scores_partition_and_training(spark):
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-x = 1\n+x = 2"
    s = p.score_inputs(spark.createDataFrame([(1, diff), (2, None)], "i int, d string"), "d", headers=True)
    assert {x["i"]: len(x["change_chunks"] or []) for x in s.collect()} == {1: 1, 2: 0}
    e = spark.createDataFrame([([1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]])], "q array<double>, c array<array<double>>")
    got = p.semantic_scores(e, "q", "c", 2).first()
    assert 0.5 < got["score_a"] < 1 and set(got["score_b_by_beta"]) == {"0.5", "0.75", "1.0", "1.5", "2.0"}
    new = spark.createDataFrame([(1, {"1.0": 0.9}, {"1": 0.8}), (2, {"1.0": 0.1}, {"1.0": 0.2})], "index long, new_score1_b_by_beta map<string,double>, new_score2_b_by_beta map<string,double>")
    old = spark.createDataFrame([(2, {"1.0": 1.0}, {"1.0": 1.0})], new.schema)
    assert [x["fine_tuning"] for x in p.partition(new, None).orderBy("index").collect()] == ["SFT", "ORPO"]
    assert [x["fine_tuning"] for x in p.partition(new, old).orderBy("index").collect()] == ["SFT", "SFT"]
    ref = records.conformed(spark.createDataFrame([(1, "p", "sft ", "c", "s")], "index long, problem_statement string, fine_tuning string, old_root_cause string, old_repair_suggestion string"), "refined")
    train, log = p.build_dataset(ref)
    assert train.first()["win_rc"] == "c" and log.first()["actions"] == ["none"]


def test_evaluation_and_report(spark):
    tasks = spark.createDataFrame([("i", "It fails.", "--- a/src/a.py\n+++ b/src/a.py\n-x\n y", "failed")] * 2, "instance_id string, problem_statement string, golden_patch string, status string")
    prompts = p.prepare_evaluation(tasks, "R", "G", "T", "A").collect()
    assert len(prompts) == 1 and "--- Segment Group 1 ---\n[Suspicious] file: src/a.py\n```\n-x\n y\n```\n" in prompts[0]["prompt"]
    raw = spark.createDataFrame([("i", "m", "failed", "# Root Cause:\nthe lock is held too long\n\n# Repair Suggestion:\nrelease the lock in time now"), ("i", "n", "resolved", None)], "instance_id string, model string, status string, raw_output string")
    pred = p.read_predictions(raw)
    assert {x["model"]: x["valid"] for x in pred.collect()} == {"m": True, "n": False}
    refs = spark.createDataFrame([("i", "the lock is held too long", "release it")], "instance_id string, root_cause string, repair_suggestion string")
    m = p.evaluate(pred, refs)
    assert {x["model"]: round(x["rc_bleu4"]) for x in m.collect()} == {"m": 100, "n": 0} and m.first()["metrics"]["rs_bleu4"] is not None
    assert p.evaluate(pred, refs, spark.createDataFrame([("m",)], "model string")).count() == 1
    assert "| rc_bleu4 | m | **100.0000** |" in p.report(m, ["rc_bleu4", "rs_bleu4"])


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "1.5"), (2, "x"), (3, None)], "i int, s string")
    assert r.castable(df, ["s"]).count() == 1 and r.first_n(df, 2, ["i"]).count() == 2 and r.first_n(df, 0, ["i"]).count() == 3
    got, gone = r.restricted(df, spark.createDataFrame([(1,), (9,)], "i int"), "i")
    assert got.count() == 1 and [x[0] for x in gone.collect()] == [9]
    counts, failed = r.run_summary(df, F.col("s").isNotNull(), "i", "i")
    assert tuple(counts.first()) == (3, 2, 6) and [x["i"] for x in failed.collect()] == [3]
    parts = df.limit(1).select(*r.positional_slices(F.array(*[F.lit(x) for x in range(5)]), [F.lit(2), F.lit(3)])).first()
    assert list(parts) == [[0, 1], [2, 3, 4]]
    assert tr.exact_split(spark.range(101), "id").filter("part = 'train'").count() == 85
    x = spark.createDataFrame([("a b", "c d"), (None, "e")], "a string, b string").select(tr.tokenized("a", "b", 3, lambda s: [len(w) for w in s.split()]).alias("t")).select("t.*").collect()
    assert [tuple(y) for y in x] == [([1, 1, 1], 2), ([1], 0)]
    t = spark.createDataFrame([("Fix `a.b` and `c`, (now)!",)], "s string").select(lang.preprocessed("s").alias("x")).first()["x"]
    assert (t["text"], t["spans"]) == ("Fix CODETOKEN0 and CODETOKEN1 now", ["a.b", "c"])


def test_last_of_two_files_wins(spark, tmp_path):
    """Ties in a key go by the order of files and lines, not by chance."""
    for k, name in enumerate(("a.jsonl", "b.jsonl")):
        lines = [json.dumps({"index": i % 7, "new_score1_B_by_beta": {"1.0": (10 * k + i) / 100}, "new_score2_B_by_beta": {"1": (10 * k + i) / 100}}) for i in range(10)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = jsonl.parsed(jsonl.numbered_lines(spark, str(tmp_path)), "index long, new_score1_B_by_beta map<string,double>, new_score2_B_by_beta map<string,double>").select("file", "line_no", "row.*")
    new = old.select("index", "new_score1_B_by_beta", "new_score2_B_by_beta").dropDuplicates(["index"])
    want = {i: (10 + (i + 7 if i < 3 else i)) / 100 for i in range(7)}
    for partitions in (1, 5):
        got = p.partition(new, old.repartition(partitions), order=["file", "line_no"])
        assert {x["index"]: round(x["score"], 6) for x in got.collect()} == want
    refs = old.select(F.lit("i").alias("instance_id"), F.concat_ws(" ", "file", "line_no").alias("root_cause"), F.lit("r").alias("repair_suggestion"), "file", "line_no")
    pred = spark.createDataFrame([("i", "m", "failed", "x", "y")], "instance_id string, model string, status string, root_cause string, repair_suggestion string")
    assert p.evaluate(pred, refs.repartition(3), order=["file", "line_no"]).count() == 1


def test_scored_rows(spark):
    m = "map<string,double>"
    df = spark.createDataFrame([(1, "d", 0.4, 0.5, {"1.0": 0.45}, {"1": 0.5}), (2, None, 0.1, -0.1, {"2.0": 0.9}, None)], f"index long, new_diff string, score1_a double, score2_a double, score1_b_by_beta {m}, score2_b_by_beta {m}")
    got = {x["index"]: x for x in p.scored_rows(df).collect()}
    assert (got[1]["score1_B_vs_A_improved"], got[1]["score2_B_vs_A_improved"], got[1]["attempts_used"]) == (True, False, 1)
    assert (got[2]["score1_B_vs_A_improved"], got[2]["score2_B_vs_A_improved"], got[2]["new_score1_A"]) == (False, True, 0.1)


def test_losses_of_no_rows(spark):
    df = spark.createDataFrame([], "t string, w double, l double, task string")
    got = tr.task_loss_report(tr.preference_losses(df, "t", "w", "l"), "task").collect()
    assert len(got) == 1 and got[0]["task"] == "all" and got[0]["n"] == 0 and got[0]["total_loss"] == 0.0 and got[0]["accuracy"] == 0.0


def test_numbered_words(spark):
    df = spark.createDataFrame([(["b", "a", "b", None, None],), ([],), (None,), (["x"] * 300,)], "w array<string>")
    got = [sorted(tuple(y.split("\0")) if y[0] != "\0" else ("", y[2:]) for y in x["n"]) for x in df.select(lang.numbered(F.col("w")).alias("n")).collect()]
    assert got == [[("", "1"), ("", "2"), ("a", "1"), ("b", "1"), ("b", "2")], [], [], sorted(("x", str(i)) for i in range(1, 301))]
