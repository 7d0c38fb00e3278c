"""A recurrent labeller of text blocks: a bidirectional LSTM in numpy that reads a document's lines in order.

Each line comes as its tag path (which constructs it shows and which containers are open) and a vector of hashed words; the
network gives the markup languages the line uses and what kind of block it is. It is trained here, on documents that are
rendered from plain sentences into each language, with look-alikes among them.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np

from sievewright.llm.markup import INDEX, KINDS, MARKUPS, paths

WORDS, HIDDEN = 24, 24
INPUT = len(INDEX) + WORDS


WORD = re.compile(r"\w+")


@lru_cache(maxsize=50_000)
def slot(word: str) -> tuple[int, float]:
    """Where a word goes in a line's vector, and its sign."""
    h = zlib.crc32(word.encode())
    return len(INDEX) + h % WORDS, 1.0 if h & 0x8000 else -1.0


def vectors(lines: list[str], tag_paths: list[set[str]]) -> np.ndarray:
    """One row for each line: its tag path, and all of its hashed words as a bag of signs."""
    at, values = [], []
    for i, (line, path) in enumerate(zip(lines, tag_paths, strict=True)):
        base = i * INPUT
        for p in path:
            at.append(base + INDEX[p])
            values.append(1.0)
        words = WORD.findall(line.lower())
        scale = (2 + len(words)) ** -0.5
        for w in words:
            k, sign = slot(w)
            at.append(base + k)
            values.append(sign * scale)
    return np.bincount(np.array(at, np.int64), weights=np.array(values), minlength=len(lines) * INPUT).astype(np.float32).reshape(len(lines), INPUT)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one in each direction, and two heads: languages (independent) and kinds (one of)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {}
        for d in ("f", "b"):
            w["x" + d], w["h" + d], w["c" + d] = n(INPUT, 4 * HIDDEN), n(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            w["c" + d][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        w["o"], w["p"] = n(2 * HIDDEN + INPUT, len(MARKUPS) + len(KINDS)), np.zeros(len(MARKUPS) + len(KINDS), np.float32)
        return cls(w)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """Hidden states over time of one direction; x: batch, time, input. Steps outside the mask leave the state alone. What the
        gradients need of each step is kept on demand only."""
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        pre = x @ self.w["x" + d] + self.w["c" + d]
        h = c = np.zeros((x.shape[0], HIDDEN), np.float32)
        out, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            z = pre[:, t] + h @ self.w["h" + d]
            i, f, o, g = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            c2 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c2)
            h2 = m * (o * tc) + (1 - m) * h
            if keep:
                kept.append((t, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[:, t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple[np.ndarray, np.ndarray, tuple]:
        f, kf = self.run(x, mask, "f", keep)
        b, kb = self.run(x, mask, "b", keep)
        both = np.concatenate((f, b, x), axis=2)
        y = both @ self.w["o"] + self.w["p"]
        e = np.exp(y[..., len(MARKUPS) :] - y[..., len(MARKUPS) :].max(axis=2, keepdims=True))
        return sigmoid(y[..., : len(MARKUPS)]), e / e.sum(axis=2, keepdims=True), (both, kf, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, langs: np.ndarray, kinds: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, q, (both, kf, kb) = self.forward(x, mask)
        n = max(1.0, mask.sum())
        onehot = np.eye(len(KINDS), dtype=np.float32)[kinds]
        loss = -(mask[..., None] * (langs * np.log(p + 1e-7) + (1 - langs) * np.log(1 - p + 1e-7))).sum() / n - (mask * np.log((q * onehot).sum(axis=2) + 1e-7)).sum() / n
        dy = np.concatenate((p - langs, 0.5 * (q - onehot)), axis=2) * mask[..., None] / n
        g = {"o": np.einsum("bti,btj->ij", both, dy), "p": dy.sum(axis=(0, 1))}
        dboth = dy @ self.w["o"].T
        for d, kept, dh_all in (("f", kf, dboth[..., :HIDDEN]), ("b", kb, dboth[..., HIDDEN : 2 * HIDDEN])):
            gx, gh, gc = (np.zeros_like(self.w[k + d]) for k in "xhc")
            dh = dc = np.zeros((x.shape[0], HIDDEN), np.float32)
            for t, h, c, i, f, o, gg, tc, m in reversed(kept):
                dh = dh + dh_all[:, t]
                do = m * dh * tc
                dc2 = dc + m * dh * o * (1 - tc * tc)
                dz = np.concatenate((m * dc2 * gg * i * (1 - i), m * dc2 * c * f * (1 - f), do * o * (1 - o), m * dc2 * i * (1 - gg * gg)), axis=1)
                gx += x[:, t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(axis=0)
                dc = dc2 * (m * f + (1 - m))
                dh = dz @ self.w["h" + d].T + (1 - m) * dh
            g |= {"x" + d: gx, "h" + d: gh, "c" + d: gc}
        return float(loss), g

    @classmethod
    def fit(cls, documents: list[tuple[list[str], list[set[str]], list[str]]], epochs: int = 8, batch: int = 32, rate: float = 0.015, seed: int = 5) -> Labeller:
        """Adam on documents of (lines, languages of each, kind of each)."""
        own = cls.fresh(seed)
        data = [(vectors(ls, paths(ls)), np.array([[m in u for m in MARKUPS] for u in used], np.float32), np.array([KINDS.index(k) for k in kinds])) for ls, used, kinds in documents]
        first, second, step = ({k: np.zeros_like(v) for k, v in own.w.items()} for _ in range(2)).__iter__(), None, 0
        m1, m2 = first
        r = np.random.default_rng(seed)
        for e in range(epochs):
            order = sorted(r.permutation(len(data)), key=lambda i: len(data[i][0]) // 8)
            for at in r.permutation(range(0, len(order), batch)):
                x, mask, langs, kinds = pad([data[i] for i in order[at : at + batch]])
                _, g = own.gradients(x, mask, langs, kinds)
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    own.w[k] = own.w[k] - rate * (1 - e / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return own

    def label(self, documents: list[tuple[list[str], list[set[str]]]], batch: int = 64, cells: int = 40_000) -> list[tuple[np.ndarray, np.ndarray]]:
        """(probability of each language, kind) of every line of each document; documents are whole, however long.

        Documents of like length are read together: at most `batch` of them, and at most `cells` lines with the padding, so that a
        long one is alone and takes no more memory than its own lines.
        """
        out: list = [None] * len(documents)
        order = sorted(range(len(documents)), key=lambda i: len(documents[i][0]))
        at = 0
        while at < len(order):
            some = order[at : at + batch]
            while len(some) > 1 and len(documents[some[-1]][0]) * len(some) > cells:
                some.pop()
            at += len(some)
            data = [(vectors(*documents[i]), np.zeros((len(documents[i][0]), len(MARKUPS)), np.float32), np.zeros(len(documents[i][0]), np.int64)) for i in some]
            x, mask, _, _ = pad(data)
            p, q, _ = self.forward(x, mask, keep=False)
            for k, i in enumerate(some):
                n = len(documents[i][0])
                out[i] = (p[k, :n], q[k, :n].argmax(axis=1))
        return out


def pad(data: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(x) for x, _, _ in data)
    x, mask = np.zeros((len(data), t, INPUT), np.float32), np.zeros((len(data), t), np.float32)
    langs, kinds = np.zeros((len(data), t, len(MARKUPS)), np.float32), np.zeros((len(data), t), np.int64)
    for i, (a, b, c) in enumerate(data):
        x[i, : len(a)], mask[i, : len(a)], langs[i, : len(a)], kinds[i, : len(a)] = a, 1, b, c
    return x, mask, langs, kinds


class Renderer:
    """Documents for training: sentences set in one or more languages, with labels for each line, and plain look-alikes."""

    def __init__(self, sentences: list[str], seed: int):
        self.s = sentences
        self.r = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def sentence(self) -> str:
        return self.pick(self.s)

    def name(self) -> str:
        return "_".join(self.pick(("read", "load", "item", "size", "old", "next", "cell", "node")) for _ in range(int(self.r.integers(2, 4))))

    def title(self) -> str:
        return self.pick(("Overview", "How to repeat it", "Result", "What should happen", "Setup", "Remarks", f"Study of {self.name()}", "Open questions", " ".join(self.sentence().split()[:4])))

    def code(self) -> list[str]:
        n, m = self.name(), self.name()
        pool = (f"x = {n}(*args, **kwargs)", f"if {m} is None:", f"    raise KeyError('{n}')", f"for a in {n}(b):", f"    {m}[0][1] = a", f"print({n}(3), 'x')", f"# {self.sentence()}", f"d = {{'a': {{1: 2}}}}", f"assert {n}(x) == 8", "- y", f"s = '''{m}'''", f"def __init__(self): return {m} < 3 > x")
        return [self.pick(pool) for _ in range(int(self.r.integers(2, 7)))]

    def inline(self, lang: str | None, text: str) -> tuple[str, bool]:
        """A sentence with one of its words set in a language; whether anything was set."""
        w = text.split()
        if lang is None or self.chance(0.45) or len(w) < 3:
            return text, False
        k = int(self.r.integers(len(w)))
        n, u = w[k].strip(",.:;"), f"https://docs.example/{self.name()}/{int(self.r.integers(99))}"
        tail = w[k][len(n) :] if w[k].startswith(n) else ""
        forms = {
            "markdown": (f"**{n}**", f"`{self.name()}`", f"*{n}*", f"__{n}__", f"[{n}]({u})", f"![{n}]({u})", f"~~{n}~~", f"[{n}][1]"),
            "html": (f"<b>{n}</b>", f"<code>{self.name()}</code>", f"<i>{n}</i>", f'<a href="{u}">{n}</a>', f"{n}<br>", f"{n}&nbsp;", f"<em>{n}</em>", f"{n} &amp; {n}", f"<!-- {n} -->", f"&lt;{n}&gt;"),
            "wiki": (f"'''{n}'''", f"''{n}''", f"{{{{{self.name()}}}}}", f"[[{n}|{n}]]", f"[{u} {n}]", f"[{n}|{u}]", f"[[{n}]]"),
            "latex": (f"\\textbf{{{n}}}", f"\\emph{{{n}}}", f"\\texttt{{{self.name().replace('_', chr(92) + '_')}}}", self.name().replace("_", "\\_"), f"$n^{{{k}}} + x_1$", f"\\href{{{u}}}{{{n}}}", "\\(O(n \\log n)\\)", f"{k}\\% of"),
        }[lang]
        w[k] = self.pick(forms) + tail
        return " ".join(w), True

    def lookalike(self) -> str:
        n, m = self.name(), self.name()
        return self.pick(
            (
                f"It calls {n}(*args, **kwargs) from __init__ and then 3 * 4 * 5 items come.", f"Compare a == b with m[[1, 2], [3, 4]] or m[0](x).", f"The path C:\\temp\\new_{n}\\raw is used.", f"The pattern \\d+\\s*(\\w+) is used for {n} && nothing else.",
                f"It costs from $3 to $7 a month, see ${n.upper()}/.cache.", f"std::vector<int> -> {n} gives {m} and ~/{n}.", f"cc @bot, run 3 | lane 4 | retry off.", f"The value is <class '{n}'> and not List<{m}>.", f"#{int(self.r.integers(9000))} is the same.", f"Only if a < {n} and b > 3.",
                f"a_{n}_b, {n}_ and _{m} stay.", "f'{x}' and {y} are dicts: {'a': {1: 2}}.", f"see https://docs.example/{n}/3", f"x = 3; y = 4; {n} = {m}", "10 % of 3 & 4 ^ 2 = ~5", "In <module> and <lambda> it fails.", "Say '' or '' for nothing, it's ''.", f"key: value; {n}: '{m}'", "--- a/x.py", "@@ -1,2 +3,4 @@",
            )
        )

    def block(self, lang: str | None) -> tuple[list[str], list[bool], list[str]]:
        """Lines of one block, whether each uses the language, and the kind of each."""
        r = self.r
        kind = self.pick(("heading", "paragraph", "paragraph", "list", "code", "table", "quote", "formula", "odd"))
        t, out = self.title(), []
        add = lambda line, uses, k: out.append((line, uses, k))
        if kind == "heading":
            if lang == "markdown":
                if self.chance(0.3):
                    add(t, True, "heading")
                    add(self.pick("=-") * len(t), True, "heading")
                elif self.chance(0.8):
                    add("#" * int(r.integers(1, 5)) + " " + t, True, "heading")
                else:
                    add(t + ".", False, "paragraph")
            elif lang == "html":
                h = int(r.integers(1, 5))
                add(self.pick((f"<h{h}>{t}</h{h}>", f"<p>{t}.</p>", f"{t}.<br>", f"<h{h}>{t}</h{h}>")), True, "heading")
            elif lang == "wiki":
                e = "=" * int(r.integers(1, 5))
                x = self.pick((f"{e} {t} {e}", f"h{int(r.integers(1, 4))}. {t}", f"{e}{t}{e}", ""))
                add(x or t + ".", bool(x), "heading" if x else "paragraph")
            elif lang == "latex":
                add(self.pick(("\\section{%s}", "\\subsection*{%s}", "\\paragraph{%s}", "\\subsection{%s}")) % t.replace("_", "\\_"), True, "heading")
            else:
                x = self.pick((":", ".", ""))
                add(t + x, False, "heading" if x == ":" else "paragraph")
        elif kind in ("paragraph", "quote"):
            body, uses = zip(*[self.inline(lang, self.sentence()) for _ in range(int(r.integers(1, 4)))], strict=True)
            line = " ".join(body)
            if lang == "html" and self.chance(0.6):
                add(f"<p>{line}</p>" if self.chance(0.8) else f"<blockquote>{line}</blockquote>", True, "paragraph")
            elif lang == "markdown" and kind == "quote":
                add("> " + line, True, "quote")
            elif lang == "wiki" and kind == "quote" and self.chance(0.5):
                add("bq. " + line, True, "quote")
            else:
                add(line, any(uses), "paragraph")
        elif kind == "list":
            items = [self.inline(lang, self.sentence()) if self.chance(0.2) else (self.sentence(), False) for _ in range(int(r.integers(2, 5)))]
            if lang == "html":
                tag = self.pick(("ul", "ol"))
                add(f"<{tag}>", True, "list")
                for s, _ in items:
                    add(self.pick(("  ", "")) + f"<li>{s}</li>", True, "list")
                add(f"</{tag}>", True, "list")
            elif lang == "latex":
                env = self.pick(("itemize", "enumerate"))
                add(f"\\begin{{{env}}}", True, "list")
                for s, _ in items:
                    add("\\item " + s, True, "list")
                add(f"\\end{{{env}}}", True, "list")
            elif lang == "wiki":
                deep, number = self.chance(0.4), self.chance(0.3)
                for s, u in items:
                    mark = ("#" if number else "*") * (2 if deep and self.chance(0.5) else 1)
                    add(f"{mark} {s}", u or len(mark) > 1 or number, "list")
            elif lang == "markdown":
                marks = self.pick((("- ",), ("* ",), ("1. ",), ("- ", "* "), ("- [ ] ", "- [x] "), ("- [ ] ", "- ", "1. ")))
                for s, u in items:
                    mark = self.pick(marks)
                    add(mark + s, u or "[" in mark, "list")
            else:
                style = self.pick(("- ", "* ", "%d) ", "%d. ", "  - "))
                for i, (s, _) in enumerate(items):
                    add((style % (i + 1) if "%" in style else style) + s, False, "list")
        elif kind == "code":
            body = self.code()
            if lang == "markdown":
                f = self.pick(("```", "~~~", "```python", "```text"))
                body = [f, *body, f[:3]]
            elif lang == "html":
                body = self.pick(([f"<pre><code>{body[0]}", *body[1:-1], f"{body[-1]}</code></pre>"], ["<pre>", *body, "</pre>"], [f"<details><summary>code</summary><pre>{body[0]}", *body[1:-1], f"{body[-1]}</pre></details>"]))
            elif lang == "wiki":
                body = self.pick((["{code:python}", *body, "{code}"], ["{{Code|lang=py|", *body, "}}"], ["{noformat}", *body, "{noformat}"], ['<syntaxhighlight lang="python">', *body, "</syntaxhighlight>"]))
            elif lang == "latex":
                e = self.pick(("verbatim", "lstlisting"))
                body = [f"\\begin{{{e}}}", *body, f"\\end{{{e}}}"]
            else:
                body = self.pick(([*["    " + x for x in body]], ["Traceback (most recent call last):", '  File "x.py", line 3, in <module>', *["  " + x for x in body], "KeyError: 3"], ["2024-01-02 03:04:05 WARN " + self.name() + " x=3"]))
            for x in body:
                add(x, lang is not None, "code")
        elif kind == "table":
            rows = [(self.name(), str(int(r.integers(999)))) for _ in range(int(r.integers(2, 5)))]
            if lang == "markdown":
                lines = ["| item | count |", self.pick(("|---|---:|", "| --- | --- |")), *[f"| {a} | {b} |" for a, b in rows]]
            elif lang == "html":
                lines = ["<table>", *[f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows], "</table>"]
            elif lang == "wiki":
                lines = ["||item||count||", *[f"|{a}|{b}|" for a, b in rows]] if self.chance(0.5) else ['{| class="x"', "! item !! count", *[x for a, b in rows for x in ("|-", f"| {a} || {b}")], "|}"]
            elif lang == "latex":
                lines = ["\\begin{tabular}{lr}", *[f"{a.replace('_', chr(92) + '_')} & {b} \\\\" for a, b in rows], "\\end{tabular}"]
            else:
                lines = [f"{a}  {b}" for a, b in rows] if self.chance(0.5) else [f"{a} = {b}; {a}2 = {b}" for a, b in rows]
            for x in lines:
                add(x, lang is not None, "table" if lang else "paragraph")
        elif kind == "formula" and lang == "latex":
            add(self.pick(("\\[ \\frac{1}{n+2} \\]", "\\[ \\sum_{i=1}^{4} w_i x_{i-1} \\]", "$$ a^2 + b_{3} $$", "\\[ O(n^{2} \\log n) \\]")), True, "formula")
        elif kind == "odd" and lang == "markdown" and self.chance(0.5):
            add(self.pick((f"[1]: https://docs.example/{self.name()}", f"see [{self.name()}][1]", f"see ![x](https://docs.example/{self.name()})")), True, "paragraph")
        else:
            add(self.lookalike(), False, "paragraph")
        lines, uses, kinds = (list(x) for x in zip(*out, strict=True))
        return lines, uses, kinds

    def document(self) -> tuple[list[str], list[set[str]], list[str]]:
        lines, used, kinds = [], [], []
        langs = [None if self.chance(0.4) else self.pick(MARKUPS)] + [self.pick((None, *MARKUPS)) for _ in range(int(self.r.integers(0, 3))) if self.chance(0.5)]
        for lang in langs:
            tight = self.chance(0.35)
            for _ in range(int(self.r.integers(2, 6))):
                ls, us, ks = self.block(lang)
                lines += ls
                used += [{lang} if u and lang else set() for u in us]
                kinds += ks
                if not tight or self.chance(0.2):
                    lines.append("")
                    used.append(set())
                    kinds.append("blank")
        while lines and not lines[-1]:
            lines.pop()
            used.pop()
            kinds.pop()
        return lines, used, kinds


#: Sentences to fall back on where a corpus has no plain ones.
PLAIN = ["The reader stops after the second file.", "Nothing is written when the list is empty.", "We saw it on two machines since last week.", "A restart helps, but only for an hour.", "The same steps worked before."]


def trained(sentences: list[str], documents: int = 1500, epochs: int = 10, seed: int = 11) -> Labeller:
    """A labeller trained on rendered documents made of the given sentences."""
    return Labeller.fit([Renderer(sentences or PLAIN, seed + i).document() for i in range(documents)], epochs, seed=seed)
