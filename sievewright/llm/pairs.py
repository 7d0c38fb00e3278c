"""Defective prompt and response pairs: language posteriors, wording shared with the prompt, and how the response ends."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.endings import SPACE
from sievewright.session import materialize, release

TABLE = 1 << 16
BLOCK = 1 << 10
WORD = re.compile(r"\w+")
FENCED = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.DOTALL)
LOGGED = re.compile(r"^(?:\d{4}-\d\d-\d\d.*|\s*File \".*|Traceback .*|\s{2,}\S.*|\w+(?:Error|Exception|Iteration)\b:.*)$", re.MULTILINE)
NAMES = re.compile(r"(?<![A-Za-z0-9./\\-])[A-Za-z0-9./\\-]*[A-Za-z0-9][_/\\=][\w./\\=-]*|\b[A-Z][a-z]+[A-Z]\w*|\b\w+\(.*?\)|(?<![A-Za-z])[A-Za-z]*+\d[\w.]*|<[^>\n]{1,30}>", re.ASCII)
NOT_LETTERS = re.compile(r"[\W\d_]+")
SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？\n]*")
#: A passage that the response quotes: in quotation marks, after a colon that says so, or as a quoted line.
QUOTED = re.compile(
    r"„[^“”]*[“”]|“[^”]*”|«[^»]*»|「[^」]*」|『[^』]*』|\"[^\"\n]{12,}\"|^>.*$|(?:^|(?<=[.!?。！？\n] )|(?<=\n))(?:Quote|The report states|Reported|Quoted|Citation|Zitat|Cita|Цитата|引用)\s?[:：][^.!?。！？\n]*(?:\.(?=\S)[^.!?。！？\n]*)*[.!?。！？]?", re.MULTILINE
)
THOUGHT = re.compile(r"<think>.*?(?:</think>|\Z)", re.DOTALL | re.IGNORECASE)

#: How a sentence begins that declines to answer, by language. Fixed value.
REFUSALS = re.compile(
    "^(?:"
    + "|".join(
        (
            r"(?:I'?m|I am|We are)?\s*(?:very |truly |really |so )?(?:sorry|afraid)\b,?(?! state)",
            r"(?:I|We)(?: must| have to| am going to| will)?(?: respectfully| politely)? (?:apologi[sz]e|decline|refuse)\b",
            r"(?:I|We) (?:can ?not|can['’]t|won['’]t|will not|am unable to|am not able to|['’]m unable to|['’]m not able to|do not wish to) (?:comply|help|assist|provide|answer|give|analy[sz]e|diagnose|support|fulfil|continue|respond|do that|discuss|offer|propose|complete|process|handle)",
            r"(?:I|We) (?:won['’]t|will not) be able to\b",
            r"I'?m (?:unable|not able) to\b",
            r"As an? (?:AI|large language|language|artificial)\b",
            r"(?:My|The|Our) (?:guidelines|policies|policy|instructions|rules) (?:prevent|do not allow|don['’]t allow|forbid|prohibit)",
            r"Unfortunately,? (?:I|we|this request|that request|no)\b",
            r"Regrettably\b.*\b(?:assist|help|answer|decline|offer|provide|unable|not)",
            r"It (?:would|is) not (?:be )?(?:appropriate|possible) for me\b",
            r"(?:This|That|Your) (?:request|question|task) (?:falls|lies|is) outside\b",
            r"(?:I|We) (?:do not|don['’]t) have (?:enough |the )?(?:permission|authori[sz]ation|access)\b",
            r"No (?:answer|assistance|help) can be (?:given|offered|provided)\b",
            r"(?:Es tut mir (?:sehr )?leid|Tut mir leid|Leider kann ich|Leider darf ich|Ich kann (?:dabei|dazu|damit|Ihnen|dir|hier|diese[nmrs]?|das)\b.*\bnicht|Ich muss .*ablehnen|Entschuldigung)",
            r"(?:Je suis )?(?:vraiment )?(?:Désolée?|désolée?)\b|Je ne (?:peux|suis|puis) pas\b|Malheureusement,? je\b|Je dois (?:décliner|refuser)",
            r"Lo siento\b|Lamento\b|Disculp|Lamentablemente,? no\b|No puedo (?:ayudar|responder|cumplir|proporcionar|atender|asistir)",
            r"Desculp|Sinto muito\b|Infelizmente,? não\b|Não posso (?:ajudar|responder|atender|cumprir|fornecer)|Peço desculpa",
            r"Извините|Простите|К сожалению,? я\b|Я не могу (?:помочь|ответить|выполнить|предоставить)|Сожалею",
            r"(?:很|非常|十分)?(?:抱歉|遗憾)|对不起|我(?:无法|不能)(?:协助|帮助|提供|回答|处理|完成)",
            r"申し訳|すみません|恐れ入り|残念ながら|お(?:手伝い|答え|力になる).*(?:できません|できない)",
        )
    )
    + ")",
    re.IGNORECASE,
)
#: What stands for an answer that says nothing, without its punctuation. Fixed value.
NOTHING = {"", "na", "n a", "none", "tbd", "todo", "null", "nil", "nan", "no answer", "not available", "not applicable", "nothing", "unknown", "empty", "pending", "no response", "no output", "keine", "aucune", "ninguna", "nenhuma", "нет", "无", "なし"}


def plain(text: str) -> str:
    """A text without code, logs and names, in lower case: letters and single blanks."""
    t = FENCED.sub(" ", text) if "```" in text or "~~~" in text else text
    return NOT_LETTERS.sub(" ", NAMES.sub(" ", LOGGED.sub(" ", t)).lower())


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of all character 1-, 2- and 3-grams of each text, and the text of each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    slots, rows = [], []
    for n in (1, 2, 3):
        if len(flat) < n:
            continue
        key = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (flat[k : len(flat) - n + 1 + k] * np.uint64(0xC2B2AE3D27D4EB4F))
            key ^= key >> np.uint64(29)
        same = owner[: len(flat) - n + 1] == owner[n - 1 :]
        slots.append((key[same] & np.uint64(TABLE - 1)).astype(np.int64))
        rows.append(owner[: len(flat) - n + 1][same])
    return (np.concatenate(slots), np.concatenate(rows)) if slots else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class NaiveBayes:
    """Log-probabilities of slots by class, with add-half smoothing."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs

    @classmethod
    def of_counts(cls, names: list[str], counts: np.ndarray) -> NaiveBayes:
        """From how often each slot (rows) occurs in each class (columns)."""
        smooth = counts + 0.5
        return cls(names, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text under each class."""
        slots, rows = grams(texts)
        out = np.zeros((len(texts), len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = np.bincount(rows, weights=self.logs[slots, k], minlength=len(texts))
        return out


def portions(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in order, in lists of at least `chars` characters each but the last."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def fit_languages(df: DataFrame, text: str, lang: str, key: str, least: int = 20, most_languages: int = 200) -> NaiveBayes:
    """A model of the languages that `lang` names, from the n-grams of all their texts; `key` names the rows, no choice is made by it.

    The `most_languages` commonest labels count (more than there are two-letter codes of languages, 26 MB of model a hundred); those with fewer than `least` texts, blank and undetermined ones are left out.
    Each task adds up its slots by language, and blocks of `BLOCK` slots are added up across tasks.
    """
    rows = df.select(F.lower(F.trim(lang)).alias("l"), F.col(text).alias("t")).filter("trim(t) != '' AND l IS NOT NULL AND l NOT IN ('', 'und')")
    common = rows.groupBy("l").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "l").limit(most_languages)
    names = sorted(r["l"] for r in common.collect())
    if not names:
        raise ValueError("no labelled texts to fit the languages on")

    def batch(sums: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in sums], pa.string()), pa.array([k for _, k in sums], pa.int32()), pa.array([n.tobytes() for n in sums.values()], pa.binary())], names=["l", "block", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts: dict[str, list[str]] = {}
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(x, []).append(plain(t.rstrip()))
            for x, own in texts.items():
                total = sums.setdefault(x, np.zeros(TABLE, np.int64))
                for part in portions(own, 200_000):
                    total += np.bincount(grams(part)[0], minlength=TABLE)
        for x, total in sums.items():
            yield batch({(x, k): n for k, n in enumerate(total.reshape(-1, BLOCK))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for x, k, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums[x, k] = sums.get((x, k), 0) + np.frombuffer(n, np.int64)
        yield batch(sums)

    kind = "l string, block int, counts binary"
    got = rows.filter(F.col("l").isin(names)).mapInArrow(count, kind).repartition("l", "block").mapInArrow(add, kind).toArrow()
    counts = np.zeros((TABLE, len(names)))
    for x, k, n in zip(*(c.to_pylist() for c in got.columns), strict=True):
        counts[k * BLOCK : (k + 1) * BLOCK, names.index(x)] = np.frombuffer(n, np.int64)
    return NaiveBayes.of_counts(names, counts)


def shape(c: str) -> str:
    """The class of a character, for endings that were never seen: a letter, a digit, a blank, or the character itself."""
    return "\x01" if c.isalpha() else "\x02" if c.isdigit() else "\x03" if c.isspace() else c


@cache
def folded(c: str) -> str:
    """A character in lower case, digits alike, and so those that mark contexts; always one character."""
    low = c.lower()
    return "0" if c.isdecimal() else "\x06" if c < "\x06" else low if len(low) == 1 else c


class Ends:
    """How much likelier a text ends after its last n-gram than it goes on: an end-of-text n-gram model with backing off.

    A context is what is open (a fence, a thought) and the last up to `ORDER` characters, in lower case, digits alike. Contexts
    that were seen too rarely give way to shorter ones, at last to the class of the last character.
    """

    ORDER = 4
    #: Units of a place's weight. Weights are whole numbers, so sums don't depend on the order of tasks.
    UNIT = 10**8
    #: A context counts if it was seen so often, and once in so many texts: with more texts the contexts don't get rarer, which
    #: would set apart the wordings of the texts that the model is fitted on from those it judges.
    LEAST, RARE = 20, 400
    STATES = ("", "\x04", "\x05", "\x04\x05")
    OPENING = re.compile(r"^[ \t]*(?:```|~~~)|<think>|</think>", re.MULTILINE | re.IGNORECASE)

    def __init__(self, ratios: dict[str, float]):
        self.ratios = ratios

    @classmethod
    def contexts(cls, text: str, at: int, open_: str) -> list[str]:
        """The contexts of a place in a text, from the longest to the shortest."""
        tail = "".join(map(folded, text[max(0, at - cls.ORDER) : at]))
        return [*(open_ + tail[k:] for k in range(len(tail))), open_ + "\x00" + (shape(tail[-1]) if tail else "")]

    @classmethod
    def openings(cls, text: str) -> list[tuple[int, str]]:
        """(place, what is open from there on), in order."""
        fence = thought = False
        out = [(0, "")]
        for m in cls.OPENING.finditer(text) if "```" in text or "~~~" in text or "<" in text else ():
            x = m[0].strip().lower()
            if x.startswith("<"):
                thought = x == "<think>"
            else:
                fence = not fence
            out.append((m.end(), cls.STATES[thought + 2 * fence]))
        return out

    @classmethod
    def places(cls, texts: list[str], cuts: int) -> dict[tuple[str, str], int]:
        """Weight of all places within the texts by (the `ORDER` characters before it, what is open). Blanks before a place don't count; a text's places weigh `cuts` units together."""
        tables = []
        for part in portions(texts, 500_000):
            flat = np.frombuffer("".join(part).encode("utf-32-le", "replace"), np.uint32)
            n = np.array([len(t) for t in part])
            starts = np.cumsum(n) - n
            start, weight = np.repeat(starts, n), np.repeat(cuts * cls.UNIT // np.maximum(n - 1, 1), n)
            state = np.zeros(len(flat), np.int64)
            for s, t in zip(starts.tolist(), part, strict=True):
                for (k, open_), (e, _) in pairwise([*cls.openings(t), (len(t), "")]):
                    state[s + k : s + e] = cls.STATES.index(open_)
            chars, which = np.unique(flat, return_inverse=True)
            low = np.array([ord(folded(chr(c))) for c in chars.tolist()], np.int64)[which]
            black = ~np.isin(chars, [ord(c) for c in SPACE])[which]
            # texts end in a character that isn't blank, so this never falls below a text's start
            at = np.concatenate(([0], np.maximum.accumulate(np.where(black, np.arange(1, len(flat) + 1), 0))[:-1]))
            inner = np.arange(len(flat)) > start
            at, start, weight = at[inner], start[inner], weight[inner]
            back = [np.where(at - k >= start, low[np.maximum(at - k, 0)] + 1, 0) for k in range(1, cls.ORDER + 1)]
            tables.append(pa.table({"a": back[0] << 22 | back[1], "b": back[2] << 24 | back[3] << 2 | state[at], "n": weight}))
            tables[-1] = tables[-1].group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])
        if not tables:
            return {}
        out, mask = {}, (1 << 22) - 1
        for a, b, n in zip(*(c.to_pylist() for c in pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).columns), strict=True):
            out["".join(chr(c - 1) for c in (b >> 2 & mask, b >> 24, a & mask, a >> 22) if c), cls.STATES[b & 3]] = n
        return out

    @classmethod
    def counted(cls, whole: list[str], cuts: int) -> dict[str, tuple[int, int]]:
        """For each context the weight of the texts that end after it, and of the places within texts that follow it. The empty one has the totals."""
        texts = [t for t in (x.rstrip(SPACE) for x in whole) if t]
        ends = Counter((t[-cls.ORDER :], cls.openings(t)[-1][1]) for t in texts)
        out = {"": (0, 0)}
        for inner, found in enumerate(({x: n * cls.UNIT for x, n in ends.items()}, cls.places(texts, cuts))):
            for (tail, open_), n in found.items():
                for c in ("", *cls.contexts(tail, len(tail), open_)):
                    e, m = out.get(c, (0, 0))
                    out[c] = (e, m + n) if inner else (e + n, m)
        return out

    @classmethod
    def support(cls, n_ends: int) -> int:
        """The least weight of a context that counts: `LEAST` sights, and one in `RARE` texts."""
        return max(cls.LEAST * cls.UNIT, n_ends // cls.RARE)

    @classmethod
    def fit(cls, whole: list[str], cuts: int = 20) -> Ends:
        """From whole texts: where they end, against all places within them, which count as `cuts` a text."""
        return cls.of_counts(cls.counted(whole, cuts))

    @classmethod
    def of_counts(cls, counts: dict[str, tuple[int, int]]) -> Ends:
        """From `counted`, whatever it was added up over; contexts without `support` are left out."""
        (n_ends, n_mids), u = counts[""], cls.UNIT
        seen = {c: x for c, x in counts.items() if c and sum(x) >= cls.support(n_ends)}
        return cls({c: math.log((e / u + 0.2) / max(1, n_ends / u)) - math.log((m / u + 0.2) / max(1, n_mids / u)) for c, (e, m) in seen.items()})

    def ratio(self, text: str) -> float:
        """Log-ratio of ending to going on after the text's last characters; below 0 for a text that was cut."""
        t = text.rstrip(SPACE)
        for c in self.contexts(t, len(t), self.openings(t)[-1][1]):
            if c in self.ratios:
                return self.ratios[c]
        return -1.0 if not t or self.openings(t)[-1][1] or t[-1].isalnum() else 0.0


def fit_ends(df: DataFrame, key: str, text: str, cuts: int = 20) -> Ends:
    """A model of how whole texts end, from all texts of `df`, which are known to be whole; `key` names the rows, no choice is made by it.

    Texts under 60 characters are left out, since placeholders are among them. Contexts are counted in each batch and added up by
    a shuffle of contexts; those with support come to the driver, 5 · `RARE` · (`cuts` + 1) at most however many texts there are.
    """
    rows = df.select(F.col(text).alias("t")).filter("char_length(t) >= 60")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Ends.counted(b.column(0).to_pylist(), cuts)
            ends, mids = zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), pa.array(ends, pa.int64()), pa.array(mids, pa.int64())], names=["context", "ends", "mids"])

    seen = materialize(rows.mapInArrow(count, "context string, ends long, mids long").groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("mids").alias("mids")), "contexts")
    total = seen.filter("context = ''").first()
    least = Ends.support(total["ends"]) if total else 0
    got = seen.filter(F.col("ends") + F.col("mids") >= least).toArrow().to_pydict()
    release(seen)
    if not total or not total["ends"]:
        return Ends.fit(["It ends here.", "So does this."])
    return Ends.of_counts(dict(zip(got["context"], zip(got["ends"], got["mids"], strict=True), strict=True)))


def issue_of(prompt: str) -> str:
    """The issue inside a prompt: what follows its heading, up to the code."""
    m = re.search(r"^(?:\[ISSUE\]|#+ *Issue\b[^\n]*|Issue(?: Description)?:|Problem(?: Statement)?:)[ \t]*\r?\n", prompt, re.MULTILINE | re.IGNORECASE)
    body = prompt[m.end() :] if m else prompt
    e = re.search(r"^(?:\[[A-Z ]*CODE[A-Z ]*\]|#+ *(?:Code|Suspicious)\b.*)\s*$", body, re.MULTILINE | re.IGNORECASE)
    return body[: e.start()] if e else body


def declines(section: str) -> bool:
    """A section that declines: one of its first two sentences says so, outside of quotations."""
    first = 0
    for m in SENTENCE.finditer(section):
        s = m[0].strip(" \t\r\n-*>#\"'")
        if not s:
            continue
        if REFUSALS.match(s):
            return True
        first += 1
        if first == 2:
            break
    return False


def says_nothing(section: str | None) -> bool:
    return section is None or " ".join(WORD.findall(section.lower().replace("/", ""))) in NOTHING


def copied_share(section: str, issue_grams: set[tuple[str, ...]], span: int) -> float:
    """The share of a section's words that lie in stretches of `span` words that the issue has too."""
    w = WORD.findall(section.lower())
    end, covered = 0, 0
    for i in range(len(w) - span + 1):
        if tuple(w[i : i + span]) in issue_grams:
            covered += i + span - max(i, end)
            end = i + span
    return covered / len(w) if w else 0.0


def likeliest(issues: list[str | None], model: NaiveBayes) -> dict[str, int]:
    """The language of each distinct issue."""
    asked = [*dict.fromkeys(x for x in issues if x)]
    return dict(zip(asked, model.scores([plain(x) for x in asked]).argmax(axis=1).tolist(), strict=True)) if asked else {}


def foreign(sections: list[str], issues: list[str | None], best: dict[str, int], model: NaiveBayes, margin: float) -> list[bool]:
    """For each section, whether more than half of it is in another language than its issue: posteriors of issue and sentences."""
    texts, place, letters = [], [], []
    for i, s in enumerate(sections):
        if issues[i]:
            for m in SENTENCE.finditer(QUOTED.sub(" ", FENCED.sub(" ", s))):
                p = plain(m[0]).strip()
                if len(p) - p.count(" ") + (0 if p.isascii() else sum(c >= "⺀" for c in p)) >= 8:
                    texts.append(p)
                    place.append(i)
                    letters.append(len(p))
    scores = model.scores(texts)
    other, total, sums = [0] * len(sections), [0] * len(sections), np.zeros((len(sections), len(model.names)))
    for i, n, sc in zip(place, letters, scores, strict=True):
        total[i] += n
        sums[i] += sc
        other[i] += n * (sc.max() - sc[best[issues[i]]] > margin)
    return [total[i] > 0 and other[i] > 0.5 * total[i] and sums[i].argmax() != best[issues[i]] for i in range(len(sections))]


DEFECTS = ("refusal", "wrong_language", "copied_question", "truncated", "empty")


def defective_pairs(
    responses: DataFrame, key: str, prompt_key: str, raw: str, sections: tuple[str, str], prompts: DataFrame, prompt: str, languages: NaiveBayes, ends: Ends, share: float = 0.8, span: int = 5, margin: float = 6.0
) -> DataFrame:
    """`key` and defect of every response; null where there is none.

    `refusal`: the answer or a section declines. `wrong_language`: a section's sentences, by weight of letters, are mostly in
    another language than the prompt's issue (naive Bayes over character n-grams, quotations aside). `copied_question`: at least
    `share` of a section's words lie in stretches of `span` words of the issue. `truncated`: after the raw output's last n-gram a
    whole text more likely goes on than ends. `empty`: a section is null, blank or a placeholder. The first in this order
    counts. Responses without a prompt, or with a null one, are judged without it. Repeated rows get a row each; null raw outputs
    with two sections are judged by the sections alone. Other columns are ignored; prompts must have one row for each key.
    """
    asked = prompts.select(F.col(prompt_key).alias("__pk"), F.col(prompt).alias("prompt"))
    rows = responses.select(F.col(key).alias("key"), F.col(prompt_key).alias("__k"), F.col(raw).alias("raw"), *[F.col(s).alias(f"s{i}") for i, s in enumerate(sections)])
    joined = rows.join(asked, rows["__k"] == asked["__pk"], "left").select("key", "raw", "s0", "s1", "prompt")
    kind = joined.schema["key"].dataType.simpleString()
    sent = responses.sparkSession.sparkContext.broadcast((languages.names, languages.logs, ends.ratios))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs, ratios = sent.value
        languages, ends = NaiveBayes(names, logs), Ends(ratios)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                raws, s0, s1, prompts_ = (b.column(k).to_pylist() for k in range(1, 5))
                found: list[str | None] = [None] * b.num_rows
                issues = [issue_of(p) if p else None for p in prompts_]
                said = [THOUGHT.sub(" ", r) if r else "" for r in raws]
                known: dict[str, set] = {}
                best = likeliest(issues, languages)
                foreign0, foreign1 = (foreign([s or "" for s in part], issues, best, languages, margin) for part in (s0, s1))
                for i in range(b.num_rows):
                    parts = [s for s in (s0[i], s1[i]) if s]
                    if declines(said[i]) or any(declines(s) for s in parts):
                        found[i] = "refusal"
                    elif foreign0[i] or foreign1[i]:
                        found[i] = "wrong_language"
                    else:
                        if issues[i]:
                            if issues[i] not in known:
                                w = WORD.findall(issues[i].lower())
                                known[issues[i]] = {tuple(w[k : k + span]) for k in range(len(w) - span + 1)}
                            if any(copied_share(s, known[issues[i]], span) >= share for s in parts):
                                found[i] = "copied_question"
                        if not found[i] and raws[i] and raws[i].strip() and not says_nothing(last_section(raws[i])) and ends.ratio(raws[i]) < 0:
                            found[i] = "truncated"
                        if not found[i] and (says_nothing(s0[i]) or says_nothing(s1[i])):
                            found[i] = "empty"
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["key", "defect"])

    return joined.mapInArrow(judge, f"key {kind}, defect string").withColumnRenamed("key", key)


def last_section(raw: str) -> str:
    """What follows the last heading, where there is one."""
    m = None
    for m in re.finditer(r"^#+[^\n]*$", raw, re.MULTILINE):
        pass
    return raw[m.end() :] if m else raw
