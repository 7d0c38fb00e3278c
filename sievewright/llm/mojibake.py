"""Text garbled by decoding with a wrong encoding: found and, where possible, restored by noisy-channel decoding.

The channel: a text's UTF-8 bytes were read in another encoding, so every character became one to four others; bytes that the
encoding lacks were lost (U+FFFD). Restoring goes back to a lattice of bytes, with wildcards for lost ones, and looks for the
likeliest text under the corpus' own word frequencies by Viterbi search: its states are the place in the lattice and the word that
is open there, so a path is judged by whole words; characters that are in no word go by their own frequency.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Encodings that texts are taken to have been read in. Fixed value.
SINGLE = ("cp1252", "latin-1", "cp437", "cp850", "cp1251", "mac_roman", "koi8-r")
#: (written in, read in) of texts that never were UTF-8. Fixed value.
LEGACY = (
    ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp866", "latin-1"), ("koi8-r", "latin-1"),
    ("gbk", "latin-1"), ("gbk", "cp1252"), ("shift_jis", "latin-1"), ("shift_jis", "cp1252"), ("euc_jp", "latin-1"), ("big5", "latin-1"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"),
)
LOST = "�"
ANY = frozenset(range(128, 256))
FOREIGN = re.compile(r"[^\x00-\x7f]")
# Patterns start at the beginning of a run only and give nothing back, so that very long runs cost no more than their length.
FOREIGN_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]*+[^\W\d_A-Za-z⺀-\U0003ffff][^\W\d_⺀-\U0003ffff]*")
LETTERS = re.compile(r"[^\W\d_]+")
WIDE = re.compile("[⺀-\ud7ff\ue000-\uf8ff]")
WIDE_RUN = re.compile("[⺀-\uffff\u0370-\u04ff\u2010-\u2040\u2100-\u27bf\xa0-\xff]+")
FOREIGN_RUN = re.compile(r"[^\x00-\x7f]+")
LOST_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]*+�[^\W\d_�]*(?:�[^\W\d_�]*)*")


def read_byte(b: int, encoding: str) -> str:
    """What one byte shows in an encoding; a byte it lacks shows as the control character of that number, as browsers do."""
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def corpus_tables(df: DataFrame, text: str, most_words: int = 500_000) -> tuple[dict[str, int], dict[str, int]]:
    """How often each non-ASCII character, and each word with a non-ASCII letter (CJK aside), occurs in the whole corpus.

    Counted over all texts; what occurs once is no evidence and stays behind. Characters are at most as many as Unicode has; of the
    words the commonest `most_words` form the model, some 20 MB.
    """
    src = df.select(F.col(text).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7F]"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys = [*chars, *words]
            return pa.RecordBatch.from_arrays([pa.array([True] * len(chars) + [False] * len(words)), pa.array(keys, pa.string()), pa.array([*chars.values(), *words.values()], pa.int64())], names=["is_char", "token", "n"])

        chars: Counter = Counter()
        words: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                chars.update(t)
                words.update(w.lower() for w in FOREIGN_WORD.findall(t))
            if len(words) > 200_000:
                yield out()
                chars, words = Counter(), Counter()
        yield out()

    counted = src.mapInArrow(count, "is_char boolean, token string, n long").filter("token > '\x7f' OR NOT is_char").groupBy("is_char", "token").agg(F.sum("n").alias("n"))
    often = counted.filter("n > 1")
    words = often.filter("NOT is_char").orderBy(F.desc("n"), "token").limit(most_words)
    got = often.filter("is_char").unionByName(words).toArrow().to_pydict()
    rows = list(zip(got["is_char"], got["token"], got["n"], strict=True))
    return {t: n for c, t, n in rows if c}, {t: n for c, t, n in rows if not c}


@dataclass
class Channel:
    """The tables of the noisy channel; built in each worker from the corpus' frequencies."""

    chars: dict[str, int]
    words: dict[str, int]
    encodings: tuple[str, ...] = SINGLE
    least: int = 5
    forms: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick

        self.total = sum(self.chars.values()) + 1
        known = [c for c, n in self.chars.items() if n >= self.least and c != LOST and not "\x80" <= c < "\xa0"]
        self.known = {*known}
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for c in known:
            self.by_length[len(c.encode())].append(c)
        forms: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for e in self.encodings:
            for c in known:
                forms["".join(read_byte(b, e) for b in c.encode())].append((e, c))
        self.forms = dict(forms)
        self.automaton = ahocorasick.Automaton()
        for f, v in self.forms.items():
            self.automaton.add_word(f, (len(f), v))
        if self.forms:
            self.automaton.make_automaton()
        self.vocabulary = sorted(w for w, n in self.words.items() if n >= self.least and LOST not in w)  # its prefix ranges are a trie
        self.filled: dict[str, list[tuple[int, str]]] = {}
        self.leads = {c for a in range(0xC2, 0xF5) for b in range(0x80, 0xC0) for c in bytes((a, b)).decode("gbk", "ignore")}
        self.total_words = sum(self.words.values()) + 1
        self.lacks = {e: frozenset(b for b in range(128, 256) if not bytes([b]).decode(e, "ignore")) for e in self.encodings}
        self.bytes_of = {e: {read_byte(b, e): b for b in range(128, 256)} for e in self.encodings}
        self.common = max(self.least, 2e-5 * sum(self.words.values()))
        self.back = {r: {read_byte(b, r): b for b in range(128, 256)} for r in {r for _, r in LEGACY}}
        self.signs: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for c in known:
            if not c.isalpha():
                self.signs[len(c.encode())].append((self.chars[c], c))

    def cost(self, c: str) -> float:
        """Minus the logarithm of a character's frequency; ASCII is cheap."""
        return 1.0 if c < "\x80" else math.log(self.total / (self.chars.get(c, 0) + 0.05))

    def word_cost(self, word: str) -> float:
        """Minus the logarithm of a word's frequency; words that the corpus lacks, and ASCII ones, go by their characters."""
        spelt = sum(map(self.cost, word))
        n = 0 if word.isascii() else self.words.get(word.lower(), 0)
        return min(spelt, math.log(self.total_words / n)) if n >= self.least else spelt

    def spelt_cost(self, shown: str) -> float:
        """The cost of what stands there, by characters alone: its words are no evidence, since garbled ones are counted like others."""
        return sum(map(self.cost, shown))

    # the lattice -----------------------------------------------------------------------------------------------------------
    def begins_word(self, prefix: str) -> bool:
        low = prefix.lower()
        at = bisect_left(self.vocabulary, low)
        return at < len(self.vocabulary) and self.vocabulary[at].startswith(low)

    def options(self, lattice: list[int | None], i: int, prefix: str, lost: frozenset[int]) -> Iterator[tuple[int, str]]:
        """(bytes taken, character) that may stand at place i, after the letters `prefix` of an open word.

        A lost byte is one of `lost`, the bytes that the channel loses. Where bytes are lost, a letter must go on a word of the corpus; besides, the commonest character that fits is an option.
        """
        b = lattice[i]
        if b is not None and b < 0x80:
            yield 1, chr(b)
            return
        for size in (2, 3, 4) if b is None else ((2,) if 0xC2 <= b < 0xE0 else (3,) if 0xE0 <= b < 0xF0 else (4,) if 0xF0 <= b < 0xF5 else ()):
            part = lattice[i : i + size]
            if len(part) < size:
                continue
            if None not in part:
                try:
                    c = bytes(part).decode()
                except UnicodeDecodeError:
                    continue
                if c in self.known:
                    yield size, c
            elif part.count(None) < size:
                fits = [c for c in self.by_length[size] if all(x in lost if p is None else p == x for p, x in zip(part, c.encode(), strict=True))]
                if fits:
                    top = max(fits, key=lambda c: self.chars[c])
                    yield from ((size, c) for c in fits if c == top or (c.isalpha() and self.begins_word(prefix + c)))

    def viterbi(self, lattice: list[int | None], left: str = "", right: str = "", ends: list[int] | None = None, lost: frozenset[int] = ANY) -> dict[int, tuple[float, str]]:
        """For each of `ends` (the whole lattice if not given) that some text reaches: the cost and the likeliest text up to there.

        The lattice holds bytes, None for lost ones; `left` and `right` are the letters around it, which belong to its words.
        """
        n = len(lattice)
        states: dict[int, dict[str, tuple[float, int, str, str]]] = {0: {left: (0.0, -1, "", "")}}
        last = 0
        for i in range(n):
            if i > last:
                break
            for prefix, (cost, *_) in states.get(i, {}).items():
                for size, c in self.options(lattice, i, prefix, lost):
                    new, word = (cost, prefix + c) if c.isalpha() else (cost + self.word_cost(prefix) + self.cost(c), "")
                    there = states.setdefault(i + size, {})
                    if word not in there or new < there[word][0]:
                        there[word] = (new, i, prefix, c)
                        last = max(last, i + size)
        out = {}
        for end in ends or [n]:
            if end and end in states:
                tail = right if end == n else ""
                word = min(states[end], key=lambda w: states[end][w][0] + self.word_cost(w + tail))
                cost, at, parts = states[end][word][0] + self.word_cost(word + tail), end, []
                while at > 0:
                    _, before, prefix, c = states[at][word]
                    parts.append(c)
                    at, word = before, prefix
                out[end] = (cost, "".join(reversed(parts)))
        return out

    # single-byte encodings -------------------------------------------------------------------------------------------------
    def hits(self, text: str) -> list[tuple[int, int, list[tuple[str, str]]]]:
        """(start, end, readings) of leftmost longest garbled forms that don't overlap."""
        if not self.forms:
            return []
        out: list[tuple[int, int, list]] = []
        for end, (n, v) in self.automaton.iter_long(text):
            out.append((end - n + 1, end + 1, v))
        return out

    def undo(self, text: str) -> tuple[str, dict[str, int]]:
        """One layer of wrong decoding undone, and how many characters each encoding explains."""
        hits = self.hits(text)
        if not hits:
            return text, {}
        votes: Counter = Counter(e for _, _, v in hits for e in {e for e, _ in v})
        out, used, at = [], Counter(), 0
        groups: list[list] = []
        for h in hits:  # adjacent forms are read together
            if groups and groups[-1][-1][1] == h[0]:
                groups[-1].append(h)
            else:
                groups.append([h])
        chunks: list[list] = []
        for g in groups:  # groups with nothing but plain letters between them are one word, or words in quotes
            between = text[chunks[-1][-1][-1][1] : g[0][0]] if chunks else ""
            if between.isascii() and between.isalpha():
                chunks[-1].append(g)
            else:
                chunks.append([g])
        for chunk in chunks:
            whole = [h for g in chunk for h in g]
            for part in ([whole, *chunk] if len(chunk) > 1 else chunk):
                lo, hi = part[0][0], part[-1][1]
                read = self.best_reading(text, part, votes)
                if read:
                    out += [text[at:lo], read[1]]
                    used[read[0]] += len(part)
                    at = hi
                    if part is whole:
                        break
        out.append(text[at:])
        return "".join(out), dict(used)

    def best_reading(self, text: str, group: list, votes: Counter) -> tuple[str, str] | None:
        """(encoding, text) of a group of adjacent forms, if the likeliest original is likelier than what stands there."""
        lo, hi = group[0][0], group[-1][1]
        shown = text[lo:hi]
        left = re.search(r"[^\W\d_]*$", text[max(0, lo - 80) : lo])[0]
        right = re.match(r"[^\W\d_]*", text[hi : hi + 80])[0]
        sign = any(not c.isalpha() for c in shown)  # letters with signs among them are no words
        as_shown = None
        best = None
        for e in sorted({e for _, _, v in group for e, _ in v}, key=lambda e: -votes[e]):
            lattice = [ord(c) if c < "\x80" else self.bytes_of[e].get(c) for c in shown]
            got = None if None in lattice else self.viterbi(lattice, left, right).get(len(lattice))
            if got is None:
                continue
            cost, word = got
            if word.isspace() and (e == "cp1251" or not sign) and votes[e] < 2:
                continue
            if not sign or not self.marked(shown, e):
                whole = (left + word + right).lower()
                if any(c >= "⺀" for c in word):
                    if len(word) < 2 and votes[e] < 3:
                        continue
                elif not all(self.words.get(w, 0) > self.words.get((left + shown + right).lower(), 0) for w in LETTERS.findall(whole) if not w.isascii()):
                    continue
                elif not LETTERS.search(whole) and votes[e] < 2:
                    continue
            as_shown = self.spelt_cost(left + shown + right) if as_shown is None else as_shown
            gain = as_shown - cost
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, e, word)
        return best and (best[1], best[2])

    @staticmethod
    def marked(shown: str, encoding: str) -> bool:
        """Whether the shown characters look like nothing that is written: a letter of the lead bytes, then signs."""
        return encoding != "cp1251" or len(shown) > 2 or not shown[1].isspace()

    # GBK -------------------------------------------------------------------------------------------------------------------
    def undo_wide(self, text: str) -> tuple[str, int]:
        """Runs of Chinese characters that are UTF-8 read as GBK, undone; and how many characters that explains."""
        out, at, n = [], 0, 0
        for m in WIDE_RUN.finditer(text) if WIDE.search(text) else ():
            run, i = m[0], 0
            if not WIDE.search(run):
                continue
            while i < len(run):
                got = self.wide_prefix(run, i) if run[i] in self.leads else None
                if got:
                    end, word = got
                    out += [text[at : m.start() + i], word]
                    at, n, i = m.start() + end, n + len(word), end
                else:
                    i += 1
        return ("".join([*out, text[at:]]), n) if n else (text, 0)

    def wide_prefix(self, run: str, start: int) -> tuple[int, str] | None:
        """(end, original) of the longest stretch from `start` that is likelier garbled than meant."""
        try:
            after = run[start + 1 : start + 2].replace(LOST, "").encode("gbk") if run[start].encode("gbk")[0] >= 0xE0 else b""
        except UnicodeEncodeError:
            return None
        if after and not 0x80 <= after[0] < 0xC0:
            return None
        size = 32
        while True:  # the lattice grows as long as paths reach its end
            lattice: list[int | None] = []
            ends = [0]
            for c in run[start : start + size]:
                if c == LOST:
                    lattice.append(None)
                else:
                    try:
                        lattice += c.encode("gbk")
                    except UnicodeEncodeError:
                        if c != "€":
                            break
                        lattice.append(0x80)
                ends.append(len(lattice))
            read = self.viterbi(lattice, ends=ends) if lattice and lattice[0] is not None else {}
            if len(ends) <= size or start + size >= len(run) or max(read, default=0) < len(lattice) - 8:
                break
            size *= 4
        for k in range(len(ends) - 1, 0, -1):
            cost, word = read.get(ends[k], (0.0, ""))
            if word.isascii():
                continue
            shown = run[start : start + k]
            if self.spelt_cost(shown) - cost > 2.0 * (1 if LOST in shown else k):
                return start + k, word
        return None

    # bytes lost on the way -------------------------------------------------------------------------------------------------
    def undo_lossy(self, text: str) -> tuple[str, dict[str, int]]:
        """Runs of UTF-8 read in an encoding that lacks some of its bytes, which show as U+FFFD: the lattice has wildcards there."""
        used: Counter = Counter()

        def read(m: re.Match) -> str:
            shown = m[0]
            if LOST not in shown or shown.strip(LOST) == "":
                return shown
            best = None
            left = re.search(r"[^\W\d_]*$", text[max(0, m.start() - 80) : m.start()])[0]
            right = re.match(r"[^\W\d_]*", text[m.end() : m.end() + 80])[0]
            for e in self.encodings:
                back = self.bytes_of[e]
                if self.lacks[e] and all(c == LOST or c in back for c in shown):
                    got = self.viterbi([back.get(c) for c in shown], left, right, lost=self.lacks[e]).get(len(shown))
                    if got and (best is None or got[0] < best[0]):
                        best = (*got, e)
            if best is None or self.spelt_cost(left + shown + right) - best[0] <= 2.0:
                return shown
            used[best[2]] += len(best[1])
            return best[1]

        return FOREIGN_RUN.sub(read, text), dict(used)

    # encodings other than UTF-8 --------------------------------------------------------------------------------------------
    def undo_legacy(self, text: str) -> tuple[str, list[str]]:
        """Lines of unknown words that some other pair of encodings turns into known ones, undone; and the pairs."""
        out, found = [], []
        for line in re.split(r"(?<=\n)", text):
            if line.isascii() or len(wide := FOREIGN.findall(line)) < 3 or sum(c >= "⺀" for c in wide) * 2 > len(wide):
                out.append(line)
                continue
            if 2 * sum(end - start for start, end, _ in self.hits(line)) >= len(wide):  # UTF-8 explains it
                out.append(line)
                continue
            shown, _ = self.known_share(line)
            best = None
            if shown < 0.6:
                for wrote, read in LEGACY:
                    back = self.back[read]
                    try:
                        new = bytes(ord(c) if c < "\x80" else back[c] for c in line).decode(wrote)
                    except (KeyError, UnicodeDecodeError):
                        continue
                    share, judged = self.known_share(new)
                    if 2 * judged >= len(FOREIGN.findall(new)) > 0 and share >= 0.8 and share > shown + 0.3 and (best is None or share > best[0]):
                        best = (share, new, f"{wrote}>{read}")
            out.append(best[1] if best else line)
            found += [best[2]] if best else []
        return "".join(out), found

    def known_share(self, line: str) -> tuple[float, int]:
        """The share of a line's words with non-ASCII letters, by letters, that are common in the corpus, and how many letters
        that is of; CJK counts by character. A line without any has nothing unknown."""
        words = [w for w in FOREIGN_WORD.findall(line)]
        wide = [c for c in line if c >= "⺀"]
        odd = sum(1 for c in line if "\x80" <= c < "\xa0" or c in "¤¦§¨©ª¬®¯±²³´¶·¸¹º¼½¾\xad")
        total = sum(map(len, words)) + len(wide) + odd
        good = sum(len(w) for w in words if self.words.get(w.lower(), 0) >= self.common) + sum(1 for c in wide if self.chars.get(c, 0) >= self.common)
        return (good / total if total else 1.0), total

    # lost bytes ------------------------------------------------------------------------------------------------------------
    def fits(self, shown: str) -> list[tuple[int, str]]:
        """(frequency, word) of the corpus' words that a word with lost bytes may have been: each U+FFFD stands for a whole character,
        or each for one of its bytes. A walk through the prefix ranges of the sorted vocabulary."""
        out = []
        for per_byte in (False, True):
            open_: set[tuple[str, int]] = {("", 0)}
            while open_:
                prefix, at = open_.pop()
                if at == len(shown):
                    if (n := self.words.get(prefix, 0)) >= self.least and prefix in self.spelt(prefix):
                        out.append((n, prefix))
                    continue
                if shown[at] != LOST:
                    if self.begins_word(prefix + shown[at]):
                        open_.add((prefix + shown[at], at + 1))
                    continue
                for c in self.next_letters(prefix):
                    size = len(c.encode()) if per_byte else 1
                    if shown[at : at + size] == LOST * size:
                        open_.add((prefix + c, at + size))
        return sorted(set(out))

    def spelt(self, word: str) -> list[str]:
        at = bisect_left(self.vocabulary, word)
        return self.vocabulary[at : at + 1]

    def next_letters(self, prefix: str) -> Iterator[str]:
        """The non-ASCII letters that go on a prefix in the vocabulary."""
        at = bisect_left(self.vocabulary, prefix + "\x80")
        while at < len(self.vocabulary) and self.vocabulary[at].startswith(prefix):
            c = self.vocabulary[at][len(prefix)]
            yield c
            at = bisect_left(self.vocabulary, prefix + chr(ord(c) + 1), at)

    def fill_lost(self, text: str, sure: float = 0.8) -> tuple[str, int]:
        """Words with lost bytes, filled where one word of the corpus is likely enough among all that fit; and what stays lost."""

        def fill(m: re.Match) -> str:
            s = m[0]
            low = s.lower()
            if low not in self.filled:
                if len(self.filled) > 20_000:
                    self.filled.clear()
                self.filled[low] = self.fits(low)
            fits = self.filled[low]
            if fits:
                n, w = max(fits)
                if n >= sure * sum(x for x, _ in fits):
                    return w.upper() if s.isupper() and len(s.strip(LOST)) > 1 else w[0].upper() + w[1:] if s[0].isupper() else w
                return s
            core = s.strip(LOST)
            head, tail = len(s) - len(s.lstrip(LOST)), len(s) - len(s.rstrip(LOST))
            if LOST in core or max(head, tail) > 3:
                return s
            signs = [max(self.signs[k], default=(0, LOST * k)) if k > 1 else (0, LOST * k) for k in (head, tail)]
            for k, (f, _) in zip((head, tail), signs, strict=True):
                if k and f < sure * sum(x for x, _ in self.signs[k]):
                    return s
            return signs[0][1] + core + (signs[1][1] if core else "")

        out = LOST_WORD.sub(fill, text)
        return out, out.count(LOST)

    def restore(self, text: str) -> tuple[list[str], str, int]:
        """(encodings found, restored text, characters still lost); no encodings for a sound text."""
        now, found = self.undo_legacy(text)
        for _ in range(3):  # a text may have been garbled more than once
            new, used = self.undo(now)
            if not used:
                break
            found += sorted(used, key=lambda e: -used[e])
            now = new
        wide, n = self.undo_wide(now)
        if n:
            found.append("gbk")
            now = wide
        left = 0
        if LOST in now:
            now, used = self.undo_lossy(now)
            found += sorted(used, key=lambda e: -used[e])
            found.append("lost")
            now, left = self.fill_lost(now)
        elif LOST in text:
            found.append("lost")
        return [*dict.fromkeys(found)], now, left


def restored(df: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """`key`, encodings (array, in the order found), restored and status of every garbled row.

    status: `restored` (nothing is left to undo) or `partial` (lost characters that no word of the corpus explains remain as
    U+FFFD). Sound texts, null, empty and pure ASCII ones have no rows. Repeated rows get a row each; other columns are ignored.
    An original is only accepted if its characters, and for letters its words, are known to the corpus and likelier than what
    stands there, so signs, accents and emoji that are meant stay as they are.
    """
    chars, words = corpus_tables(df, text)
    sent = df.sparkSession.sparkContext.broadcast((chars, words))
    src = df.select(F.col(key).alias("key"), F.col(text).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7F]"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ch = Channel(*sent.value, least=least)
        for b in batches:
            rows, encodings, texts, status = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found, new, left = ch.restore(t)
                if found:
                    rows.append(i)
                    encodings.append(found)
                    texts.append(new)
                    status.append("partial" if left else "restored")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(encodings, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array(status, pa.string())], names=["key", "encodings", "restored", "status"]
            )

    return src.mapInArrow(run, f"key {kind}, encodings array<string>, restored string, status string").withColumnRenamed("key", key)
