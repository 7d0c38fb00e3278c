"""The lattice of bytes: wildcards, words that are judged whole, and runs of any length."""

import pytest

from sievewright.llm.mojibake import LOST, Channel, read_byte

WORDS = {"größe": 400, "grüße": 30, "schlüssel": 200, "café": 90, "über": 300}
CHARS = {c: 1000 for c in "öüßéä“”’–"} | {"ö": 500}


@pytest.fixture(scope="module")
def channel():
    return Channel(CHARS, WORDS)


def garbled(text, encoding):
    return "".join(read_byte(b, encoding) for b in text.encode())


def test_words_decide_where_characters_would_not(channel):
    """The second byte of the vowel is lost: ü is the commoner letter, but the word with ö is the commoner word."""
    lattice = [*b"Gr", 0xC3, None, *"ße".encode()]
    cost, text = channel.viterbi(lattice)[len(lattice)]
    assert text == "Größe" and cost < channel.spelt_cost("Größe")
    assert channel.viterbi([0xC3, None, *b"ber"])[5][1] == "über"


def test_letters_around_the_lattice_belong_to_its_word(channel):
    assert channel.viterbi([0xC3, None], "schl", "ssel")[2][1] == "ü"
    assert channel.viterbi([0xC3, None], "caf", "")[2][1] == "é"


def test_no_way_through(channel):
    assert channel.viterbi([0xC3, 0x41]) == {} and channel.viterbi([0x80]) == {} and channel.viterbi([]) == {}


def test_costs_of_all_ends_in_one_pass(channel):
    lattice = [*"“über”".encode()]
    got = channel.viterbi(lattice, ends=[3, 4, 5, 8, len(lattice)])
    assert {k: t for k, (_, t) in got.items()} == {3: "“", 5: "“ü", 8: "“über", len(lattice): "“über”"}


@pytest.mark.parametrize("encoding", ["cp1252", "cp437", "cp850", "mac_roman"])
def test_quoted_words(channel, encoding):
    found, text, left = channel.restore(f"It says {garbled('’digest’ and “über”', encoding)}.")
    assert found == [encoding] and text == "It says ’digest’ and “über”." and left == 0


def test_bytes_that_the_encoding_lacks(channel):
    shown = "“Schlüssel”".encode().decode("cp1252", "replace")
    assert LOST in shown
    found, text, left = channel.restore(f"Der {shown} fehlt.")
    assert "lost" in found and text == "Der “Schlüssel” fehlt." and left == 0


@pytest.mark.parametrize("shown", ["Gr" + LOST * 2 + LOST * 2 + "e", "gr" + LOST * 2 + "e"])
def test_lost_letters_stay_lost_where_words_are_not_sure(shown):
    even = Channel(CHARS, {"größe": 30, "grüße": 30})
    assert even.restore(shown)[1] == shown
    assert Channel(CHARS, WORDS).restore(shown)[1].lower() == "größe"


def test_long_runs_are_whole_and_cheap():
    text = "Schlüssel “über” " * 400
    ch = Channel(CHARS | {c: 50 for c in "漢字" * 2}, WORDS)
    shown = text.encode().decode("gbk", "replace")
    found, got, left = ch.restore(shown)
    assert "gbk" in found and got.count("über") >= 390
    assert ch.restore("漢字" * 20_000)[0] == []
