"""How a text ends: closed, open, or cut off.

Only the last line and counts of tags and fences are looked at; whole texts are read once, from the JVM in Arrow batches.
"""

from __future__ import annotations

import re

SPACE = " \t\r\n\v\f 　"
#: The end of a sentence, with what may close after it. Fixed value.
CLOSED = re.compile(r"[.!?。！？…][\"'”’」』»)\]*_`]*$")
#: An entity, escape or character that stops half way. Fixed value.
BROKEN = re.compile(r"(?:�|&#?[A-Za-z0-9]{0,8}|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2})?)$")
STUB = re.compile(r"^\s*(?:\d{1,3}[.)]|[-*+•#>|]+)\s*(?:\*\*|`)?$")
REMARK = re.compile(r"[.!?。！？]\s?[(（][^()（）]{1,40}[)）]$")
POINTER = re.compile(r"(?:^|[.!?。！？]\s?|\n)(?:[A-Z]\w+:|See|see|Cf\.|cf\.) (?:https?://\S*\w/?|[\w./-]+\.\w{1,4}(?::\d+)?)$")
CODE = re.compile(r"^\s*(?:[+-]\s*)?(?:[A-Za-z_][\w.]*(?:\[[^\]]*\])? ?(?:[-+*/]?=|\()|assert |raise |return |import |from |del |yield )")
OPENER = re.compile(r"^<([A-Za-z][A-Za-z _]{0,30})>", re.MULTILINE)
CLOSER = re.compile(r"</([A-Za-z][A-Za-z _]{0,30})>")
FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.MULTILINE)
TAG_END = re.compile(r"</[A-Za-z][A-Za-z _]{0,30}>$")


def ending(text: str) -> str:
    """One of `blank`, `closed`, `weak` (closed, unless there is reason to doubt it: code, paths, addresses), `open` (a tag or
    fence stays open), `broken` (half an entity, escape or character) and `cut` (anything else)."""
    t = text.rstrip(SPACE)
    if not t:
        return "blank"
    if BROKEN.search(t[-12:]):
        return "broken"
    counts: dict[str, int] = {}
    for m in OPENER.finditer(t):
        counts[m[1].lower()] = counts.get(m[1].lower(), 0) + 1
    if counts:
        for m in CLOSER.finditer(t):
            k = m[1].lower()
            if k in counts:
                counts[k] -= 1
        if any(v > 0 for v in counts.values()):
            return "open"
    if "```" in t or "~~~" in t:
        if len(FENCE.findall(t)) % 2:
            return "open"
        if t.endswith(("```", "~~~")):
            return "closed"
    line = t[t.rfind("\n") + 1 :]
    if STUB.match(line) or line.startswith("#"):
        return "cut"
    tail = t[-300:]
    if CLOSED.search(tail) or TAG_END.search(tail) or REMARK.search(tail):
        return "closed"
    if POINTER.search(tail):
        return "weak"
    if CODE.match(line) and line[-1] in ")]}\"'0123456789" and all(line.count(a) == line.count(b) for a, b in ("()", "[]", "{}")) and line.count("'") % 2 == 0 and line.count('"') % 2 == 0:
        return "weak"
    return "cut"
