"""Items of the survey that the inventory of the README names."""

import numpy as np
from pyspark.sql import functions as F

from sievewright.functions import language as lang
from sievewright.functions import text as t
from sievewright.operators import statistics as st


def test_corpus_bleu_sums_counts(spark):
    pairs = [("the lock is held too long here", "the lock is held for too long here"), ("release it", "release it in time now"), (None, "a b"), ("x y z u v", "x y z u v")]
    df = spark.createDataFrame([("m", *p) for p in pairs] + [("n", "a b c d e", "a b c d e"), ("o", None, None)], "g string, c string, r string")
    parts = [lang.bleu_counts(c or "", r or "") for c, r in pairs]
    want = lang.bleu_of(*[[sum(x) for x in zip(*[p[k] for p in parts], strict=True)] for k in (0, 1)], sum(p[2] for p in parts), sum(p[3] for p in parts))
    got = {x["g"]: x["bleu"] for x in lang.corpus_bleu(df, ["g"], "c", "r").collect()}
    assert abs(got["m"] - want) < 1e-9 and 0 < want < 100 and abs(got["n"] - 100) < 1e-9 and got["o"] == 0.0
    mean = df.filter("g = 'm'").agg(F.avg(lang.bleu("c", "r"))).first()[0]
    assert abs(got["m"] - mean) > 1  # not the mean of pairs
    assert lang.corpus_bleu(df.limit(0), [], "c", "r").count() == 0


def test_limited_histogram_against_numpy(spark):
    r = np.random.default_rng(3)
    for limit, xs in ((40.0, [*r.integers(-3, 90, 2000).tolist(), 60, 0]), (10.0, r.integers(0, 5000, 2000).tolist()), (66.0, list(range(0, 100)))):
        df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
        edges = np.linspace(0, max(1.5 * limit, np.percentile(xs, 99)), 100)
        n = np.histogram(xs, bins=edges)[0]
        got = {x["bin"]: (x["left_edge"], x["n"]) for x in st.limited_histogram(df, "x", limit).collect()}
        assert {k: v[1] for k, v in got.items()} == {i: c for i, c in enumerate(n.tolist()) if c}
        assert all(abs(v[0] - edges[k]) < 1e-9 for k, v in got.items())


def test_config_grid(spark):
    got = [x["config"] for x in st.config_grid(spark).collect()]
    assert len(set(got)) == 8 and "semantic_block" in got


def test_prompts(spark):
    c = [F.lit(x) for x in ("i", "a", "b", "d", "e", "f")]
    null = F.lit(None).cast("string")
    got = spark.range(1).select(
        t.judge_prompt(*c[:3], null).alias("j"), t.refine_prompt(*c).alias("r"), t.guidance_prompt(c[0], c[1], "Do it.").alias("g"), t.guidance_prompt(c[0], F.lit(" "), "Do it.").alias("bad"), t.analysis_prompt(c[0], null, "R", "G", "T", "A").alias("p"),
        t.task_rows(c[0], c[1], F.lit(" rc "), F.lit("rs"), null, F.lit("lrs"), "R", "G", {"A": "ta", "B": "tb", "C": "tc"}).alias("t"),
    ).first()
    assert got["j"] == "Issue Description:\ni\n\nRoot Cause:\na\n\ndiff_remove:\nb\n\ndiff_add:\n\n"
    assert got["r"] == "Issue Description:\ni\ndiff_remove:\na\ndiff_add:\nb\nroot_cause:\nd\ngemini_reasoning:\ne\nrepair_suggestion:\nf\n"
    assert got["g"] == "Do it.\\n# GitHub Issue Description:\\ni\\n# Segments Groups:\\na\\n" and got["bad"] == "user prompt build error"
    assert got["p"] == "\nR\n\nG\n\nPerform the following Task:\nT\n\n# GitHub Issue Description:\ni\n\n# Segments Groups:\n\n\nA\n"
    a, b, both = got["t"]
    assert (a["task"], a["win"], a["lose"]) == ("A", "# Root Cause:\nrc<|im_end|>", "# Root Cause:\n<|im_end|>")
    assert (b["win"], b["lose"]) == ("# Repair Suggestion:\nrs<|im_end|>", "# Repair Suggestion:\nlrs<|im_end|>") and "a\n\n# Root Cause:\n rc \n\n<|im_end|>\n<|im_start|>assistant\n" in b["input"]
    assert both["win"] == "# Root Cause:\nrc\n\n# Repair Suggestion:\nrs<|im_end|>" and both["input"].startswith("<|im_start|>system\nR\n<|im_end|>\n<|im_start|>user\nG\n\nPerform the following Task:\ntc\n\n# GitHub")


def test_segments(spark):
    seg = "array<struct<suspicious:struct<file:string,content:string>,supplementary:struct<file:string,content:string>>>"
    s = F.from_json(F.lit('[{"suspicious":{"file":"a.py","content":"x \\n\\n"}},{"suspicious":null,"supplementary":{"file":"b.py","content":"y"}}]'), seg)
    got = spark.range(1).select(t.formatted_segments(s).alias("both"), t.formatted_segments(s, False).alias("one"), t.formatted_segments(s, only_present=True).alias("some"), t.formatted_segments(F.lit(None).cast(seg)).alias("none"), t.formatted_segments(F.array().cast(seg)).alias("empty")).first()
    one = ["--- Segment Group 1 ---\n[Suspicious] file: a.py\n```\nx\n```\n", "--- Segment Group 2 ---\n[Suspicious] file: \n```\n\n```\n"]
    extra = ["[Supplementary] file: \n```\n\n```\n", "[Supplementary] file: b.py\n```\ny\n```\n"]
    assert got["one"] == "\n".join(one) and got["both"] == one[0] + extra[0] + "\n" + one[1] + extra[1] and got["some"] == one[0] + "\n" + one[1] + extra[1]
    assert got["none"] == "" and got["empty"] == ""
