from pyspark.sql import functions as F

from sievewright.functions import text as t


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or ["id"]).select(expr.alias("x")).first()[0]


def test_tiered_trim_steps(spark):
    df = spark.createDataFrame([("x" * n,) for n in (0, 2999, 3000, 3001, 10000, 10001, 33047)], "s string")
    assert [r[0] for r in df.select(F.char_length(t.tiered_trim("s"))).collect()] == [0, 2999, 3000, 3000, 6500, 6800, 11409]


def test_middle_elision(spark):
    df = spark.createDataFrame([("x" * n,) for n in (9999, 10000, 12000)], "s string")
    rows = [tuple(r[0]) for r in df.select(t.middle_elided("s")).collect()]
    assert [(len(a), len(b), n) for a, b, n in rows] == [(9999, 0, 0), (5000, 5000, 0), (5000, 5000, 2000)]


def test_sections_open_and_closed(spark):
    assert one(spark, t.tagged_section("s", "suggestion", True), s="<suggestion>abc") == "abc"
    assert one(spark, t.tagged_section("s", "suggestion"), s="<suggestion>abc") == ""
    assert one(spark, t.tagged_section("s", "root cause"), s="x <Root Cause>\n a\nb </root cause> y") == "a\nb"


def test_verdicts(spark):
    texts = ["<Yes>", "<no>, because", "<yes><no>", "maybe", None]
    got = spark.createDataFrame([(x,) for x in texts], "s string").select(t.verdict("s").alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [(True, ""), (False, ", because"), (False, "<BOTH_YES_NO>\n<yes><no>"), (None, "maybe"), (None, None)]


def test_date_window(spark):
    assert one(spark, t.date_window("s"), s="2024-02-29") == "created:2019-02-28..2024-02-29"
    assert one(spark, t.date_window("s"), s="garbage") == "created:>2020-01-01"


def test_headed_sections_and_thoughts(spark):
    s = "<think>no\n# Root Cause: x</think># Root Cause:\nA\n\n# Repair Suggestion:\nB\n"
    assert tuple(one(spark, t.headed_sections("s"), s=s)) == ("A", "B")
    assert tuple(one(spark, t.headed_sections("s"), s="nothing")) == ("", "")


def test_code_and_errors(spark):
    assert one(spark, t.has_code_example("s"), s="a\n\n    b") and one(spark, t.has_code_example("s"), s="```x")
    assert not one(spark, t.has_code_example("s"), s="a\n   b")
    assert one(spark, t.has_error_message("s"), s="A KeyError") and not one(spark, t.has_error_message("s"), s="fine")
    assert one(spark, t.good_body(F.lit(None).cast("string"))) is False


def test_docs_and_code_files(spark):
    f = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    assert [one(spark, t.docs_only(f(x))) for x in ([], ["README.md"], ["README.md", "src/a.py"], ["docs/a.py"])] == [True, True, False, True]
    file = lambda p, a, d: F.struct(F.lit(p).alias("path"), F.lit(a).alias("additions"), F.lit(d).alias("deletions"))
    assert one(spark, t.code_changes(F.array(file("a.py", 5, 3), file("b.py", 5, 3)))) is True
    assert one(spark, t.code_changes(F.array(file("a.py", 5, 3), file("b.py", 5, 2)))) is False


def test_keyword_sections_consume_headers(spark):
    s = "# problem_behaviors\n# error_patterns\nx, 'y'.\n# code_elements\n\n`a  b`, c..\n# code_elements\nlast"
    got = one(spark, t.keyword_sections("s"), s=s)
    assert got["problem_behaviors"] == ["# error_patterns"] and got["error_patterns"] is None and got["code_elements"] == ["last"]


def test_relevant_entries_cascade(spark):
    df = spark.sql("""SELECT array(named_struct('number', 1, 'body', 'see #7', 'merged_at', '2024-01-01T00:00:00Z', 'merged', timestamp'2024-01-01'),
        named_struct('number', 2, 'body', 'Fixes #7', 'merged_at', '2024-01-03T00:00:00Z', 'merged', timestamp'2024-01-03')) AS e""")
    pick = lambda closed, issue: [x["number"] for x in df.select(t.relevant_entries(F.col("e"), F.lit(issue), F.lit(closed)).alias("x")).first()[0]]
    assert pick("2024-01-01T00:00:00Z", 7) == [1] and pick("2024-01-09T00:00:00Z", 7) == [2] and pick("2024-01-02T00:00:00Z", 8) == [1] and pick("2023-01-01T00:00:00Z", 8) == [1]


def test_message_forms(spark):
    rows = ['{"response":{"body":{"choices":[{"message":{"content":"a"}}]}}}', '{"response":{"body":"{\\"choices\\":[{\\"message\\":{\\"content\\":\\"b\\"}}]}"}}', '{"content":"c"}', "not json"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    assert [r[0] for r in df.select(t.message_content("s")).collect()] == ["a", "b", "c", None]


def test_agent_messages(spark):
    lines = [
        "not json", '{"type":"item.started","item":{"type":"agent_message","text":"early"}}', '{"type":"item.completed","item":{"item_type":"assistant_message","content":["a",{"text":"b"},{"x":1}]}}',
        '{"type":"item.completed","item":{"type":"agent_message","text":""}}', '{"type":"item.completed","item":{"type":"reasoning","text":"no"}}', '{"type":"turn.completed","item":{"type":"agent_message","text":"no"}}',
    ]
    df = spark.createDataFrame([(lines,), (lines[:2],), (lines[3:],), ([],), (None,), ([*lines, '{"type":"error","message":"Usage LIMIT hit"}'],), (['{"type":"error","message":null}'],)], "e array<string>")
    got = df.select(t.last_message(F.col("e")).alias("m"), t.usage_limited(F.col("e")).alias("u")).collect()
    assert [(r["m"], r["u"]) for r in got] == [("ab", False), ("early", False), (None, False), (None, False), (None, False), ("ab", True), (None, False)]


def test_files_of_nothing_and_other_case(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, t.docs_only(none)) is True
    file = lambda p: F.struct(F.lit(p).alias("path"), F.lit(9).alias("additions"), F.lit(9).alias("deletions"))
    assert one(spark, t.code_changes(F.array(file("a.PY"), file("b.py")))) is True
    assert one(spark, t.code_changes(F.lit(None).cast("array<struct<path:string,additions:int,deletions:int>>"))) is False


def test_fractions_of_seconds(spark):
    rows = ["2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05.123456+02:00", "2024-01-02T03:04:05.25", "2024-01-02T03:04:05", "2024-01-02"]
    got = [str(r[0]) for r in spark.createDataFrame([(x,) for x in rows], "s string").select(F.date_format(t.iso_timestamp("s"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).collect()]
    assert got == ["2024-01-02 03:04:05.500000", "2024-01-02 01:04:05.123456", "2024-01-02 03:04:05.250000", "2024-01-02 03:04:05.000000", "2024-01-02 00:00:00.000000"]


def test_stars_and_states(spark):
    df = spark.createDataFrame([(101, 30), (100, 30), (101, 29), (None, 50), (500, None)], "n long, s long")
    assert [r[0] for r in df.select(t.large_and_starred("n", "s")).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([(True, 0.5, 1.0), (None, 0.5, 0.5), (False, 0.0, 0.0), (True, 0.0, 0.1), (True, 1.1, 0.5), (True, None, 0.5), (True, float("nan"), 0.5)], "j boolean, a double, b double")
    assert [r[0] for r in df.select(t.judgement_state("j", "a", "b")).collect()] == ["valid", "invalid", "zero", "valid", "invalid", "invalid", "invalid"]
    assert one(spark, t.retryable("s"), s="fatal: Early EOF") and one(spark, t.retryable("s"), s="git: exit status 128") and not one(spark, t.retryable("s"), s="fatal: no such file")


def test_guidance_labels(spark):
    s = "```\r\n # Root  Cause \r\nThe ```x``` lock.\n\n#repair suggestion\nWait.\n## Root Cause\n```"
    assert one(spark, t.guidance("s"), s=s) == "ROOT_CAUSE:\nThe x lock.\nREPAIR_SUGGESTION:\nWait.\n## Root Cause"
    assert spark.range(1).select(t.guidance(F.lit(None).cast("string"))).first()[0] == ""
