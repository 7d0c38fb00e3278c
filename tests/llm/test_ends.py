"""The end-of-text model on texts held out from its fit."""

import random

import duckdb

from sievewright.llm.pairs import Ends


def test_held_out_cuts_are_told_from_whole_texts(sf):
    rows = duckdb.sql(f"select root_cause from '{sf.replace('0.001', '0.01')}/prediction.parquet' where length(root_cause) >= 60 and length(repair_suggestion) > 20 order by row_id").fetchall()
    texts = [t for (t,) in rows]
    half = len(texts) // 2
    model = Ends.fit(texts[:half])
    r = random.Random(3)
    whole = [t for t in texts[half:] if t.rstrip()[-1] in ".。!?"]
    cut = [t[: r.randrange(len(t) // 4, len(t) - 3)] for t in whole]
    cut = [t for t in cut if t.rstrip()[-1].isalnum()]
    assert len(whole) > 300
    assert sum(model.ratio(t) < 0 for t in whole) <= 0.01 * len(whole)
    assert sum(model.ratio(t) < 0 for t in cut) >= 0.99 * len(cut)


def test_what_is_open_counts():
    whole = [f"Text number {i} says so.\n```\nx = {i}.\n```\nThat is all of it." for i in range(200)]
    model = Ends.fit(whole)
    assert model.ratio(whole[0]) > 0
    assert model.ratio("Text number 3 says so.\n```\nx = 3.") < 0
    assert model.ratio("<think>It is so.") < 0


def test_unseen_and_empty():
    model = Ends.fit(["It ends here."] * 30)
    assert model.ratio("") < 0 and model.ratio("...ж") < 0 and Ends({}).ratio("»") == 0.0 and Ends.fit([]).ratios == {}
    assert model.ratio("x" * 100_000 + ".") > 0
