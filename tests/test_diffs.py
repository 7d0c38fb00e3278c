import random

from pyspark.sql import functions as F

from sievewright.functions import diffs as d

BLOCK = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-x = 1\n+x = 2"


def one(spark, expr, s):
    return spark.createDataFrame([(s,)], "s string").select(expr.alias("x")).first()[0]


def test_lines_of_every_end(spark):
    for s in ("", "a", "a\n", "a\r\nb\rc d\x0be", "\n", "a\n\n"):
        assert one(spark, d.lines("s"), s) == s.splitlines()
        assert d.text_lines(s) == s.splitlines()


def test_block_dialects(spark):
    s = "pre\ndiff --git a b\nx\ndiffuse y"
    assert one(spark, d.blocks("s"), s) == [["pre"], ["diff --git a b", "x", "diffuse y"]]
    assert one(spark, d.blocks("s", "diff", False), s) == [["diff --git a b", "x"], ["diffuse y"]]


def test_python_blocks(spark):
    make = lambda p: f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n-x"
    assert one(spark, d.python_blocks("s"), "\n".join(map(make, ("src/a.py", "tests/b.py", "c.md")))) == make("src/a.py")


def test_chunks_and_sides(spark):
    assert one(spark, d.change_chunks("s"), BLOCK) == ["m.py\n### Before Change\nx = 1\n### After Change\nx = 2"]
    assert one(spark, d.code_chunks("s"), BLOCK) == ["m.py\n@@ -1 +1 @@\n-x = 1\n+x = 2"]
    assert one(spark, d.added_side("s", True), BLOCK) == "m.py\n### After Change\nx = 2"
    assert one(spark, d.removed_side("s"), BLOCK) == "m.py\n-x = 1"
    assert one(spark, d.added_side("s"), "  ") == ""


def test_budget(spark):
    arr = lambda *n: F.array(*[F.lit("x" * k) for k in n])
    assert [len(x) for x in one(spark, d.within_budget(arr(5, 4, 6), 10), "")] == [5, 4, 1]
    assert [len(x) for x in one(spark, d.within_budget(arr(5, 4, 6), 9), "")] == [5, 4]


def test_semantic_clean_drops_headers_unless_kept():
    assert d.changed_only(BLOCK) == "diff --git a/m.py b/m.py\n@@ -1 +1 @@\n-x = 1\n+x = 2"
    assert d.changed_only(BLOCK, headers=True) == BLOCK


def test_noise():
    assert d.noise_free("+# c\n+logger.info(\n+  x\n+)\n+y = 1") == "+y = 1"
    assert d.noise_free('+"""open\n+z = 1') == '+"""open\n+z = 1'
    assert d.noise_free('+"""doc\n+more\n+"""\n+z = 1') == "+z = 1"
    assert d.noise_free('+"""one"""\n+z') == "+z" and d.noise_free(None) is None and d.noise_free("") == ""


def test_statements_and_moves():
    assert [len(ls) for _, ls in d.statements([(0, "foo("), (1, "  1,"), (2, ")"), (3, "y")])] == [3, 1]
    assert d.unmatched(["a", "b"], ["b", "a"]) == ([False, False], [False, False])
    assert d.unmatched(["a", "c"], ["b", "a"])[0] == [False, True]


def test_moves_cancel_in_random_blocks():
    r = random.Random(3)
    for _ in range(50):
        old = [r.choice("abcd") for _ in range(6)]
        new = old[:]
        r.shuffle(new)
        assert not any(d.unmatched(old, new)[0]) and not any(d.unmatched(old, new)[1])


def test_segments_and_table(spark):
    s = BLOCK + "\ndiff --git a/n.py b/n.py\n--- a/n.py\n+++ b/n.py\n y\n-z"
    got = one(spark, d.patch_segments("s"), s)
    assert [(x["file"], x["content"]) for x in got] == [("m.py", "x = 1"), ("n.py", "y\nz")]
    t = d.diff_lines(spark.createDataFrame([(1, s), (2, None), (3, "")], "k int, s string"), "k", "s")
    assert {(r["block_no"], r["path"], r["kind"]) for r in t.filter("kind = 'old'").collect()} == {(1, "m.py", "old"), (2, "n.py", "old")}
    assert t.filter("key <> 1").count() == 0


def test_clean_diff_udf_handles_nulls(spark):
    df = spark.createDataFrame([(BLOCK,), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(d.clean_diff("none")("s")).collect()] == [BLOCK, None, ""]
    assert df.select(d.clean_diff("full", True)("s").alias("x")).filter("x IS NULL").count() == 1
