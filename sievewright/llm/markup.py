"""What each line of a text shows of HTML, Markdown, wiki and LaTeX: its constructs and the containers it lies in."""

from __future__ import annotations

import html
import re

MARKUPS = ("html", "markdown", "wiki", "latex")
KINDS = ("blank", "paragraph", "heading", "list", "code", "table", "formula", "quote")

#: Names of HTML elements, of character entities, and of LaTeX commands and Python's own double-underscore names. Fixed values.
HTML_TAGS = frozenset(
    "a abbr b big blockquote body br button caption center cite code col dd del details dfn div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol p pre q s samp script section small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var video".split()
)
ENTITY = re.compile(r"&(?:nbsp|lt|gt|amp|quot|apos|hellip|mdash|ndash|copy|reg|trade|laquo|raquo|ldquo|rdquo|lsquo|rsquo|middot|bull|times|deg|euro|rarr|larr|[aeiou](?:acute|grave|circ|uml)|[AEIOU](?:acute|grave|circ|uml)|ntilde|ccedil|szlig|#\d{2,5}|#[xX][0-9a-fA-F]{2,5});")
TEX_COMMANDS = r"(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph|textbf|textit|textsc|texttt|emph|underline|href|url|cite|ref|label|footnote|title|author|caption|documentclass|usepackage|newcommand|includegraphics|mathrm|mathbf|frac|sqrt|text)"
DUNDERS = frozenset("init main name file doc all call repr str iter next len enter exit getitem setitem delitem contains eq hash new del dict class slots module version path import builtins getattr setattr add sub mul".split())

TAG = re.compile(r"(?<!\w)<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>|</([a-zA-Z][a-zA-Z0-9]*)\s*>|<(br|sub|sup|code|b|i|em|strong|a)(?:\s[^<>]*)?/?>", re.IGNORECASE)
#: construct, the markups that have it, and how it looks within a line
INLINE = tuple(
    (name, kinds, re.compile(p, re.MULTILINE))
    for name, kinds, p in (
        ("comment", ("html",), r"<!--"),
        ("md_code", ("markdown",), r"(?<!`)`[^`\n]+`(?!`)"),
        ("md_bold", ("markdown",), r"(?:^|(?<=[\s>|_\"“]))\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*(?!\w)"),
        ("md_link", ("markdown",), r"(?<![\w!])\[[^\]\n]+\]\([^()\s]+(?: \"[^\"\n]*\")?\)"),
        ("md_image", ("markdown",), r"!\[[^\]\n]*\]\([^()\s]+\)"),
        ("md_reflink", ("markdown",), r"(?<!\w)\[[^\]\n]+\]\[\w*\]"),
        ("md_refdef", ("markdown",), r"^\[[^\]\n]+\]: \S"),
        ("md_strike", ("markdown",), r"(?<!~)~~(?=[^\s~])[^~\n]+~~(?!~)"),
        ("star_span", ("markdown", "wiki"), r"(?<![\w*])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])"),
        ("under_span", ("markdown", "wiki"), r"(?<![\w_])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_])"),
        ("escape", ("latex", "markdown"), r"\\[_#&%$]"),
        ("wiki_bold", ("wiki",), r"(?<!')'''?(?=\w)[^'\n]+'''?(?!')"),
        ("wiki_link", ("wiki",), r"\[\[(?![\s\d\[\"'])[^\[\]\n]+\]\]"),
        ("wiki_extlink", ("wiki",), r"\[https?://\S+ [^\]\n]+\]"),
        ("wiki_pipelink", ("wiki",), r"(?<!\[)\[[^\[\]|\n]+\|(?:https?|mailto)[^\]\n]+\]"),
        ("wiki_brace", ("wiki",), r"\{\{[^{}\n]+\}\}"),
        ("tex_command", ("latex",), rf"\\{TEX_COMMANDS}\*?(?:\[[^\]\n]*\])?\{{"),
        ("tex_inline", ("latex",), r"\\\((?=.*\\\))|\\\[|\\\]"),
        ("tex_dollar", ("latex", "markdown"), r"(?<![\w\\$])\$(?=[^\s$])(?=[^$\n]*[\\^_={}])[^$\n]*[^\s$\\]\$(?!\w)|^\$\$"),
    )
)
LINES = tuple(
    (name, kinds, re.compile(p))
    for name, kinds, p in (
        ("hash_1", ("markdown", "wiki"), r" {0,3}# \S"),
        ("hash_2", ("markdown", "wiki"), r" {0,3}#{2,6} \S"),
        ("md_quote", ("markdown",), r" {0,3}>(?!>>) ?\S"),
        ("md_task", ("markdown",), r"\s*(?:[-*+]|\d+[.)]) \[[ xX]\] "),
        ("md_rule", ("markdown",), r"\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"),
        ("bar_row", ("markdown", "wiki"), r"\s*\|[^|\-+}{].*\|\s*$"),
        ("wiki_head", ("wiki",), r"(={1,6})\s?[^=\s][^=]*\1\s*$"),
        ("wiki_h", ("wiki",), r"h[1-6]\. \S"),
        ("wiki_bq", ("wiki",), r"bq\. \S"),
        ("wiki_deep", ("wiki",), r"(?:\*{2,}|#{2,}|[*#]+[*#:]+) \S"),
        ("wiki_define", ("wiki",), r"[;:]+ ?\w"),
        ("wiki_header", ("wiki",), r"\|\|.*\|\|\s*$"),
        ("wiki_row", ("wiki",), r"[|!] .*(?:\|\||!!) "),
        ("wiki_table", ("wiki",), r"\{\||\|\}\s*$|\|-"),
        ("tex_item", ("latex",), r"\s*\\item\b"),
        ("tex_row", ("latex",), r".* & .*\\\\\s*(?:\\hline)?\s*$|\s*\\hline"),
        ("star", (), r"\s*\* \S"),
        ("dash", (), r"\s*[-+] \S"),
        ("number", (), r"\s*\d{1,3}[.)] \S"),
        ("indent", (), r"(?: {4}|\t)\S"),
        ("trace", (), r"Traceback |\s+File \"|\d{4}-\d\d-\d\d[ T]\d"),
        ("label", (), r"[A-Z][\w ]{2,60}:\s*$"),
        ("title", (), r"[A-Z][\w ]{2,60}\.?\s*$"),
    )
)
#: What a line must hold for an inline construct, and what its first character that isn't blank must be for a line's construct: cheap
#: tests before the patterns. Constructs that aren't named here are always looked for.
NEEDS = {
    "comment": "<!--", "md_code": "`", "md_bold": "**", "md_link": "](", "md_image": "](", "md_reflink": "][", "md_refdef": "]:", "md_strike": "~~", "star_span": "*", "under_span": "_", "escape": "\\",
    "wiki_bold": "''", "wiki_link": "[[", "wiki_extlink": "[http", "wiki_pipelink": "|", "wiki_brace": "{{", "tex_command": "\\", "tex_inline": "\\", "tex_dollar": "$",
}
STARTS = {
    "hash_1": "#", "hash_2": "#", "md_quote": ">", "md_task": "-*+0123456789", "md_rule": "|:-", "bar_row": "|", "wiki_head": "=", "wiki_h": "h", "wiki_bq": "b", "wiki_deep": "*#", "wiki_define": ";:",
    "wiki_header": "|", "wiki_row": "|!", "wiki_table": "{|", "tex_item": "\\", "star": "*", "dash": "-+", "number": "0123456789",
}
BY_START = {c: tuple(x for x in LINES if c in STARTS.get(x[0], c)) for c in {*"".join(STARTS.values())}}
BY_START_ELSE = tuple(x for x in LINES if x[0] not in STARTS)
FENCE = re.compile(r"\s*(```|~~~)")
TEX_BEGIN, TEX_END = re.compile(r"\\begin\{([a-zA-Z*]+)\}"), re.compile(r"\\end\{([a-zA-Z*]+)\}")
WIKI_CODE = re.compile(r"\{(code|noformat|panel|quote)(?:[:|][^}\n]*)?\}|<(?:syntaxhighlight|source|nowiki)\b", re.IGNORECASE)
WIKI_CALL = re.compile(r"\{\{[A-Za-z][^{}\n]*\|\s*$|\{\{\{\s*$")
SETEXT = re.compile(r"(=+|-+)\s*$")

#: All features of a line's tag path; a feature's markups are those it may be a sign of.
PATHS: dict[str, tuple[str, ...]] = {
    **{f"html_{t}": ("html",) for t in ("block", "inline", "list", "table", "code", "break", "head", "entity")},
    **{n: k for n, k, _ in INLINE},
    **{n: k for n, k, _ in LINES},
    "md_fence": ("markdown",), "in_fence": ("markdown",), "md_setext": ("markdown",), "in_setext": ("markdown",), "md_bold_under": ("markdown",), "in_html_code": ("html",), "in_html_list": ("html",), "in_html_table": ("html",),
    "tex_begin": ("latex",), "tex_end": ("latex",), "in_tex_code": ("latex",), "in_tex_list": ("latex",), "in_tex_table": ("latex",), "in_tex_math": ("latex",),
    "wiki_code": ("wiki",), "in_wiki_code": ("wiki",), "wiki_call": ("wiki",), "in_wiki_call": ("wiki",), "wiki_call_end": ("wiki",), "in_wiki_table": ("wiki",),
    "blank": (), "after_blank": (), "before_blank": (), "short": (), "sentence": (),
}
INDEX = {n: i for i, n in enumerate(PATHS)}
GROUP = {t: g for g, ts in {"list": "ul ol li dl dt dd", "table": "table thead tbody tfoot tr td th caption", "code": "pre code kbd samp tt var", "break": "br hr", "head": "h1 h2 h3 h4 h5 h6 title summary", "inline": "a b i em strong s u span sub sup del ins small mark img font big cite q strike abbr"}.items() for t in ts.split()}


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def paths(lines: list[str]) -> list[set[str]]:
    """The tag path of each line: its own constructs and the containers that are open there. Code isn't searched for constructs."""
    out: list[set[str]] = []
    fence = tex = wiki = None
    html_code = html_list = html_table = wiki_table = 0
    for i, line in enumerate(lines):
        f: set[str] = set()
        bare = line.strip()
        if fence:
            f.add("in_fence")
            if FENCE.match(line) and bare.startswith(fence):
                f.add("md_fence")
                fence = None
        elif tex in ("verbatim", "lstlisting", "minted"):
            f.add("in_tex_code")
            if TEX_END.search(line):
                f.add("tex_end")
                tex = None
        elif wiki:
            f.add("in_wiki_call" if wiki == "}}" else "in_wiki_code")
            if (wiki in line if wiki == "}}" else re.search(wiki, line, re.IGNORECASE)):
                f.add("wiki_call_end" if wiki == "}}" else "wiki_code")
                wiki = None
        elif html_code:
            f.add("in_html_code")
            html_code += len(re.findall(r"<pre\b", line, re.IGNORECASE)) - len(re.findall(r"</pre>", line, re.IGNORECASE))
            html_code = max(0, html_code)
            if "</" in line:
                f |= {"html_code"}
        elif not bare:
            f.add("blank")
        elif m := FENCE.match(line):
            if not (len(bare) > 6 and bare.endswith(m[1]) and bare.count(m[1]) == 2):
                fence = m[1]
            f.add("md_fence")
        else:
            # a number may be written in any digits, so it isn't told by its first character
            for name, _, p in BY_START.get(bare[0], LINES if bare[0].isdigit() else BY_START_ELSE):
                if p.match(line):
                    f.add(name)
            for name, _, p in INLINE:
                if NEEDS[name] in line and p.search(line):
                    f.add(name)
            if "__" in line:
                for m in re.finditer(r"(?<![\w_])__(?=[^\s_])([^_\n]*[^\s_])__(?![\w_])", line):
                    if m[1] not in DUNDERS:
                        f.add("md_bold_under")
            if "<" in line:
                for m in TAG.finditer(line):
                    t = (m[1] or m[2] or m[3]).lower()
                    if t in HTML_TAGS:
                        f.add("html_" + GROUP.get(t, "block"))
                low = line.lower()
                if "<pre" in low:
                    html_code = max(0, len(re.findall(r"<pre\b", low)) - low.count("</pre>"))
                html_list = max(0, html_list + len(re.findall(r"<[uo]l\b", low)) - len(re.findall(r"</[uo]l>", low)))
                html_table = max(0, html_table + len(re.findall(r"<table\b", low)) - low.count("</table>"))
            if "&" in line and ENTITY.search(line):
                f.add("html_entity")
            if "\\" in line:
                if m := TEX_BEGIN.search(line):
                    f.add("tex_begin")
                    tex = None if TEX_END.search(line) else m[1].rstrip("*")
                elif TEX_END.search(line):
                    f.add("tex_end")
                    tex = None
            if bare.startswith("{|"):
                wiki_table = 1
            elif bare == "|}":
                wiki_table = 0
            if ("{" in line or "<" in line) and (m := WIKI_CODE.search(line)):
                f.add("wiki_code")
                closing = r"\{" + m[1] + r"\}" if m[1] else r"</(?:syntaxhighlight|source|nowiki)>"
                if not re.search(closing, line[m.end() :], re.IGNORECASE):
                    wiki = closing
            elif "{{" in line and WIKI_CALL.search(line) and "}}" not in line:
                f.add("wiki_call")
                wiki = "}}"
            if tex:
                f.add({"itemize": "in_tex_list", "enumerate": "in_tex_list", "description": "in_tex_list", "tabular": "in_tex_table", "table": "in_tex_table"}.get(tex, "in_tex_math") if tex not in ("verbatim", "lstlisting", "minted") else "in_tex_code")
            if wiki_table:
                f.add("in_wiki_table")
            if html_list:
                f.add("in_html_list")
            if html_table:
                f.add("in_html_table")
            if bare[0] in "=-" and SETEXT.match(bare) and len(bare) >= 3 and i and lines[i - 1].strip() and abs(len(lines[i - 1].strip()) - len(bare)) <= 2 and not out[-1] & {"dash", "bar_row", "md_rule", "wiki_table"}:
                f.add("md_setext")
                out[-1].add("in_setext")
            if len(bare) < 60:
                f.add("short")
            if bare[-1] in ".!?。":
                f.add("sentence")
        if not i or not lines[i - 1].strip():
            f.add("after_blank")
        if i + 1 == len(lines) or not lines[i + 1].strip():
            f.add("before_blank")
        out.append(f)
    return out


def signs(path: set[str], markup: str) -> bool:
    """The exact check of a line: one of its constructs belongs to that markup."""
    return any(markup in PATHS[p] for p in path)


def strip_inline(line: str, used: set[str]) -> str:
    """A line without the inline markup of the given languages; text, code and formulas stay."""
    if "html" in used:
        line = re.sub(r"<!--.*?(?:-->|$)", "", line)
        line = TAG.sub(lambda m: "" if (m[1] or m[2] or m[3]).lower() in HTML_TAGS else m[0], line)
        line = html.unescape(line)
    if "latex" in used:
        line = re.sub(r"\\href\{[^{}]*\}\{", "{", line)
        for _ in range(3):
            line = re.sub(r"\\(?:textbf|textit|textsc|texttt|emph|underline|url|footnote|caption|paragraph|(?:sub)*section|chapter|title)\*?\{([^{}]*)\}", r"\1", line)
        line = re.sub(r"\\item\s*(?:\[[^\]]*\])?\s*", "", line)
        line = re.sub(r"(?<!\\)\{([^{}\\^_]*)\}", r"\1", line) if "\\" not in line and "$" not in line else line
        line = re.sub(r"\\([_#&%$])", r"\1", line)
    if "markdown" in used:
        line = re.sub(r"!\[([^\]\n]*)\]\([^()\s]+\)", r"\1", line)
        line = re.sub(r"(?<!\w)\[([^\]\n]+)\](?:\([^()\n]+\)|\[\w*\])", r"\1", line)
        line = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", line)
        line = re.sub(r"(?:^|(?<=[\s>|\"“]))\*\*(?=[^\s*])([^*\n]*[^\s*])\*\*(?!\w)", r"\1", line)
        line = re.sub(r"(?<![\w_])__(?=[^\s_])([^_\n]*[^\s_])__(?![\w_])", lambda m: m[0] if m[1] in DUNDERS else m[1], line)
        line = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])", r"\1", line)
        line = re.sub(r"~~([^~\n]+)~~", r"\1", line)
    if "wiki" in used:
        line = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", line)
        line = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", line)
        line = re.sub(r"(?<!\[)\[([^\[\]|\n]+)\|(?:https?|mailto)[^\]\n]+\]", r"\1", line)
        line = re.sub(r"'''?(?=\w)([^'\n]+)'''?", r"\1", line)
        line = re.sub(r"\{\{([^{}|\n]+)\}\}", r"\1", line)
    return line


def clean(lines: list[str], tag_paths: list[set[str]], used: list[set[str]], kinds: list[str]) -> str:
    """Text with its structure in one plain form: `# ` headings, `- ` items, fenced code, `a | b` rows, `$$` formulas."""
    out: list[str] = []
    in_code = False
    doc = set().union(*used) if used else set()
    for line, path, own, kind in zip(lines, tag_paths, used, kinds, strict=True):
        code = bool(path & {"in_fence", "in_tex_code", "in_wiki_code", "in_wiki_call", "in_html_code"}) or "md_fence" in path
        if code != in_code:
            out.append("```")
            in_code = code
        if code:
            if path & {"md_fence", "wiki_call_end"} or (path & {"tex_end", "wiki_code"} and "in_html_code" not in path) or ("tex_begin" in path):
                continue
            out.append(TAG.sub(lambda m: "" if (m[1] or m[2] or m[3]).lower() in HTML_TAGS else m[0], line) if "in_html_code" in path else line)
            continue
        if path & {"md_rule", "wiki_table", "tex_begin", "tex_end", "wiki_call", "md_setext", "md_refdef"} and own:
            continue
        if "wiki_code" in path and own:
            continue
        t = line
        if own:
            t = re.sub(r"^\s*(?:#{1,6}|={1,6}|h[1-6]\.|bq\.)\s+|\s+={1,6}\s*$", "", t) if kind == "heading" or path & {"wiki_head", "wiki_h"} else t
            t = re.sub(r"^\s*>\s?", "", t) if "md_quote" in path else t
        t = strip_inline(t, own | (doc & {"latex"} if "escape" in path else set()) or set())
        if "html_code" in path and "html" in own and html_opens(line):
            out.append("```")
            in_code = True
        if kind == "heading" and t.strip():
            t = "# " + t.strip()
        elif kind == "list" and t.strip():
            t = "- " + re.sub(r"^\s*(?:[*#+-]+|\d+[.)])\s+(?:\[[ xX]\] )?", "", t).strip()
        elif kind == "table" and own:
            t = " | ".join(c.strip() for c in re.split(r"\|\||!!|\||&", re.sub(r"\\\\\s*(?:\\hline)?\s*$", "", t).strip().strip("|!")) if c.strip())
        elif kind == "formula" and own:
            t = re.sub(r"\\\[\s*(.*?)\s*\\\]", r"$$\1$$", t)
        if own and not t.strip() and line.strip():
            continue
        out.append(t)
    if in_code:
        out.append("```")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def html_opens(line: str) -> bool:
    low = line.lower()
    return len(re.findall(r"<pre\b", low)) > low.count("</pre>")
