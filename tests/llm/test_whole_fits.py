"""The models of p1 come from all texts, not from a sample of them."""

from collections import Counter

import numpy as np
import pytest

from sievewright.llm import pairs
from sievewright.llm.pairs import Ends

TEXTS = [
    "  It ends here. ", "\t x", "a", "", " \n", "Σας ΣΑΣ İstanbul 12 ² ٣.", "Say so.\n```\nx = 1\n\n```\nDone.", "<think>Hm, 5 < 6.</think> Yes 🙂🙂 句。", "```\nopen  \n", "\x00\x04\x05ab\x04", "<think>```\nboth",
]


@pytest.mark.parametrize("repeat", [1, 30_000])
def test_all_places_are_counted(repeat):
    texts = TEXTS if repeat == 1 else ["x" * repeat + " y.", "z" * 600_000, *TEXTS[:4]]
    ends, mids = Counter(), Counter()
    for t in (x.rstrip(pairs.SPACE) for x in texts):
        opened = Ends.openings(t)
        if t:
            ends.update(["", *Ends.contexts(t, len(t), opened[-1][1])])
        for i in range(1, len(t)):
            at = len(t[max(0, i - 9) : i].rstrip(pairs.SPACE)) + max(0, i - 9)
            for c in ["", *Ends.contexts(t, at, [o for k, o in opened if k <= at][-1])]:
                mids[c] += 20 * Ends.UNIT // (len(t) - 1)
    got = Ends.counted(texts, 20)
    assert got == {c: (ends[c] * Ends.UNIT, mids[c]) for c in {"", *ends, *mids}}


def test_many_openings_take_little_time():
    assert Ends.counted(["<think>" * 100_000 + "x."], 20)[""] == (Ends.UNIT, 700_001 * (20 * Ends.UNIT // 700_001))


def test_ends_come_from_all_texts(spark):
    texts = [f"The value of entry {i} is lost before the call, so nothing is written{'¶' if i % 250 == 0 else '.'}" for i in range(20_000)]
    texts += ["```\n" + "x = 1.\n" * 500 + "```\nThe fence was closed far from where it opened; that is all" + c for c in ".!?"] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "N/A"])], "id long, body string").repartition(5)
    got = pairs.fit_ends(df, "id", "body")
    assert got.ratios == Ends.fit(texts).ratios and got.ratio("Nothing is written¶") > 0 > got.ratio("Nothing is wri")
    assert pairs.fit_ends(df.repartition(2), "id", "body").ratios == got.ratios
    assert pairs.fit_ends(df.limit(0), "id", "body").ratios == pairs.fit_ends(df.filter("id >= 20120"), "id", "body").ratios


def test_the_support_follows_the_texts():
    few, many = ([f"Number {i % 40} is set{'!' if i % 10 == 0 else '.'}" for i in range(n)] for n in (2_000, 20_000))
    assert Ends.fit(few).ratios.keys() == Ends.fit(many).ratios.keys()


def test_languages_come_from_all_texts(spark):
    rows = [(i, f"Text {i} of many: " + "the value is lost. " * (i % 9), "en") for i in range(900)] + [(1000 + i, "Wert " + "verloren ист " * (800 if i == 7 else 3), " DE") for i in range(450)]
    rows += [(2000, "rare", "fr"), (2001, None, "en"), (2002, "  ", "de"), (2003, "no label", None), (2004, "no label", "und")]
    got = pairs.fit_languages(spark.createDataFrame(rows, "id long, body string, lang string").repartition(4), "body", "lang", "id")
    assert got.names == ["de", "en"]
    for k, name in enumerate(got.names):
        counts = np.bincount(pairs.grams([pairs.plain(t.rstrip()) for _, t, x in rows if t and t.strip() and x and x.strip().lower() == name])[0], minlength=pairs.TABLE) + 0.5
        assert np.allclose(got.logs[:, k], np.log(counts / counts.sum()), atol=1e-5)
    with pytest.raises(ValueError):
        pairs.fit_languages(spark.createDataFrame(rows[-5:], "id long, body string, lang string"), "body", "lang", "id")
