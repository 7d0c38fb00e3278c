"""Column functions over issue texts, model outputs and prompts. All are built-in expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by which an error report is known, and keywords by which a commit closes an issue. Fixed values.
ERROR_NAMES = "exception|error|traceback|typeerror|valueerror|assertionerror|indexerror|keyerror"
ERROR_WORDS = "bug|error|issue|problem|bug report|error report|issue report"
CLOSING_WORDS = r"close[sd]?|fix(?:e[sd])?|resolve[sd]?"
#: Sections of a keyword answer, in order. Fixed value.
KEYWORD_SECTIONS = ("problem_behaviors", "error_patterns", "code_elements", "domain_context")
#: Parts of an error text after which a transfer is worth another try. Fixed values.
RETRY_PHRASES = ("gnutls recv error", "early eof", "connection timed out", "invalid index-pack", "unexpected disconnect while reading sideband packet", "error in the pull function", "exit status 128")
#: Headings and markers of prompts and answers. Fixed values.
ISSUE_HEADING, CODE_HEADING, CAUSE_HEADING, REPAIR_HEADING = "# GitHub Issue Description:\n", "# Segments Groups:\n", "# Root Cause:\n", "# Repair Suggestion:\n"
TURN_BEGINS, TURN_ENDS = "<|im_start|>", "<|im_end|>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_trim(c: str | Column) -> Column:
    """A text without white space at both ends; white space as Unicode has it."""
    return F.regexp_replace(col(c), r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def present(c: str | Column) -> Column:
    """Null for null, empty and blank texts; else the text."""
    return F.when(full_trim(c) != "", col(c))


def first_present(*cs: str | Column) -> Column:
    """The first text that isn't null or empty; the empty text if there is none."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


# filters -----------------------------------------------------------------------------------------------------------------------
def is_failed_with_text(status: str, text: str) -> Column:
    return (F.lower(F.coalesce(status, F.lit(""))) == "failed") & present(text).isNotNull()


def has_code_example(c: str | Column) -> Column:
    """A fence, or a line (after blank ones, too) that is indented by four or more."""
    return F.coalesce(F.contains(col(c), F.lit("```")) | col(c).rlike(r"\n\s{4,}\S"), F.lit(False))


def has_error_message(c: str | Column) -> Column:
    return F.coalesce(F.lower(col(c)).rlike(f"{ERROR_NAMES}|{ERROR_WORDS}"), F.lit(False))


def good_body(c: str | Column, least: int = 100) -> Column:
    """A body of at least `least` characters with a code example; null is no good body."""
    return F.coalesce((F.char_length(col(c)) >= least) & has_code_example(c), F.lit(False))


def docs_only(files: Column) -> Column:
    """Whether all files of an array of paths are documents; true for no files and for null."""
    return F.forall(F.coalesce(files, F.array().cast("array<string>")), lambda f: F.lower(f).rlike(r"\.(md|rst|txt|adoc|docx|doc|pdf)$") | F.startswith(F.lower(f), F.lit("docs/")) | F.contains(F.lower(f), F.lit("/docs/")))


def code_changes(files: Column, least: int = 2, additions: int = 5, deletions: int = 3) -> Column:
    """Whether at least `least` Python files (structs of path, additions, deletions) changed that much; false for null."""
    ok = F.filter(files, lambda f: F.endswith(F.lower(f["path"]), F.lit(".py")) & (f["additions"] >= additions) & (f["deletions"] >= deletions))
    return F.coalesce(F.size(ok) >= least, F.lit(False))


def large_and_starred(body_length: str, star: str, longer: int = 100, stars: int = 30) -> Column:
    """A body longer than `longer` in a repository with at least `stars` stars; null and what is no number count as 0 or fail."""
    n, m = (F.coalesce(F.col(c), F.lit(0)).cast("string").try_cast("long") for c in (body_length, star))
    return F.coalesce((n > longer) & (m >= stars), F.lit(False))


def judgement_state(judgement: str, score1: str, score2: str) -> Column:
    """`invalid` without a verdict or with a score that is null, NaN or beyond 0 and 1; `zero` where both scores are 0; else `valid`."""
    ok = F.col(judgement).isNotNull() & F.col(score1).between(0, 1) & F.col(score2).between(0, 1)
    return F.when(~F.coalesce(ok, F.lit(False)), "invalid").when((F.col(score1) == 0) & (F.col(score2) == 0), "zero").otherwise("valid")


def retryable(message: str | Column, phrases: tuple[str, ...] = RETRY_PHRASES) -> Column:
    """Whether an error text has one of the phrases, in any case; null has none."""
    low = F.lower(F.coalesce(col(message), F.lit("")))
    return F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(low, p))


def usable_change(merged: str, shas: list[str], diff: str) -> Column:
    """Merged, with every sha and a diff that isn't blank."""
    out = F.coalesce(F.col(merged), F.lit(False)) & present(diff).isNotNull()
    for s in shas:
        out = out & present(s).isNotNull()
    return out


# trims ---------------------------------------------------------------------------------------------------------------------
def tiered_length(n: Column, steps: tuple[tuple[int, int, float], ...] = ((3000, 3000, 0.5), (10001, 6000, 0.2))) -> Column:
    """How many of n characters to keep: for each step (from, base, share) the base and that share of what lies beyond it."""
    keep = n
    for start, base, share in steps:
        keep = F.when(n >= start, base + F.floor((n - base) * F.lit(share)).cast("int")).otherwise(keep)
    return keep


def tiered_trim(c: str | Column) -> Column:
    return F.substring(col(c), F.lit(1), tiered_length(F.char_length(col(c))).cast("int"))


def head_cut(c: str | Column, most: int = 16_000) -> Column:
    """The first `most` characters of a text."""
    return F.substring(col(c), 1, most)


def middle_elided(c: str | Column, most: int = 10_000, half: int = 5_000) -> Column:
    """struct(head, tail, elided): the whole text as head below `most` characters, else both ends and how much is left out."""
    n = F.char_length(col(c))
    return F.when(n < most, F.struct(col(c).alias("head"), F.lit("").alias("tail"), F.lit(0).cast("long").alias("elided"))).otherwise(
        F.struct(F.left(col(c), F.lit(half)).alias("head"), F.right(col(c), F.lit(half)).alias("tail"), (n - 2 * half).cast("long").alias("elided"))
    )


# keywords ------------------------------------------------------------------------------------------------------------------
def keyword_item(c: str | Column) -> Column:
    """A keyword without quotes and blanks around it, single blanks within, and no trailing dots."""
    bare = F.regexp_replace(full_trim(c), r"^[\"'` \t]+|[\"'` \t]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"\.+$", "")


def keyword_sections(c: str | Column) -> Column:
    """struct of KEYWORD_SECTIONS: of each `# section` header the next line that isn't blank, split at commas.

    That line belongs to the header even if it is a header itself; a later header of the same section wins.
    """
    arrays = ", ".join(f"cast(null as array<string>) as {s}" for s in KEYWORD_SECTIONS)
    start = F.expr(f"named_struct('open', cast(null as string), 'got', struct({arrays}))")

    def step(acc: Column, line: Column) -> Column:
        header = F.lower(F.regexp_extract(line, r"(?i)^\s*#\s*(" + "|".join(KEYWORD_SECTIONS) + r")\b", 1))
        items = F.filter(F.transform(F.split(line, ","), keyword_item), lambda x: x != "")
        blank = full_trim(line) == ""
        takes = acc["open"].isNotNull() & ~blank
        got = F.struct(*[F.when(takes & (acc["open"] == s), items).otherwise(acc["got"][s]).alias(s) for s in KEYWORD_SECTIONS])
        still = F.when(acc["open"].isNotNull(), F.when(blank, acc["open"])).otherwise(F.nullif(header, F.lit("")))
        return F.struct(still.alias("open"), got.alias("got"))

    return F.aggregate(F.split(F.coalesce(col(c), F.lit("")), r"\r\n|\n|\r"), start, step, lambda acc: acc["got"])


def keyword_signature(items: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.transform(items, F.lower), lambda x: x != "")), "|")


def search_query(prefix: str, items: Column, word: str) -> Column:
    """The prefix and the items that aren't blank, joined by a word."""
    return F.concat(F.lit(prefix), F.array_join(F.filter(F.transform(items, full_trim), lambda x: x != ""), f" {word} "))


def fallback_query(n_and: Column, items: Column) -> Column:
    """The kind of query whose result counts: OR where AND found nothing and there is more than one keyword."""
    return F.when((n_and == 0) & (F.size(items) > 1), "OR").otherwise("AND")


def date_window(day: str | Column, years: int = 5, default: str = "created:>2020-01-01") -> Column:
    """A search window that ends on a day and reaches back some years; the default where it is no date."""
    d = F.try_to_timestamp(F.substring(col(day), 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.concat(F.lit("created:"), F.date_format(F.add_months(d, -12 * years), "yyyy-MM-dd"), F.lit(".."), F.date_format(d, "yyyy-MM-dd")), F.lit(default))


def iso_timestamp(c: str | Column) -> Column:
    """A timestamp without zone from the ISO spellings of dates and times; null for what is none. Offsets are applied."""
    t = full_trim(c)
    day = F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))
    full = F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]xxx"))
    plain = F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"))
    return F.coalesce(full, plain, day)


def repo_of_url(c: str | Column, mark: str = "/repos/") -> Column:
    """owner/name after the last mark of an address; null where there is none."""
    rest = F.substring_index(col(c), mark, -1)
    return F.when(F.contains(col(c), F.lit(mark)), F.nullif(F.regexp_extract(rest, r"^([^/]+/[^/]+)", 1), F.lit("")))


def clone_dir(*parts: str | Column) -> Column:
    return F.concat_ws("_", *[F.regexp_replace(col(p).cast("string"), "/", "_") for p in parts])


# references --------------------------------------------------------------------------------------------------------------------
def closes_issue(body: Column, issue: Column) -> Column:
    """Whether a text closes an issue by its number, on one line."""
    numbers = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(rf"(?i)\b(?:{CLOSING_WORDS})\b[^\S\r\n]*#\s*(\d+)\b"), F.lit(1))
    return F.array_contains(numbers, issue.cast("string"))


def relevant_entries(entries: Column, issue: Column, closed_at: Column) -> Column:
    """The entries (structs of number, body, merged_at as text, merged as timestamp) that are taken to have closed an issue.

    First the one merged at the very text of the closing time; else all that say they close the issue; else the latest merged
    no later; else the first of all.
    """
    same = F.filter(entries, lambda e: e["merged_at"] == closed_at)
    said = F.filter(entries, lambda e: closes_issue(e["body"], issue))
    before = F.filter(entries, lambda e: e["merged"] <= iso_timestamp(closed_at))
    latest = F.array_sort(before, lambda x, y: F.when(x["merged"] > y["merged"], -1).when(x["merged"] < y["merged"], 1).otherwise(0))
    one = lambda a: F.slice(a, 1, 1)
    return F.when(F.size(same) > 0, one(same)).when(F.size(said) > 0, said).when(F.size(latest) > 0, one(latest)).otherwise(one(entries))


# model outputs -----------------------------------------------------------------------------------------------------------------
def message_content(line: str | Column) -> Column:
    """The text of a chat response: within body.choices[0].message, the body an object or a JSON text, else the top content."""
    body = F.get_json_object(col(line), "$.response.body")
    inner = F.get_json_object(body, "$.choices[0].message.content")
    return F.coalesce(F.nullif(inner, F.lit("")), F.get_json_object(col(line), "$.content"))


def last_message(events: Column) -> Column:
    """The text of the last assistant message among JSON lines of events: of items that began or ended and are a message, what
    their text, else their content, says; content may be a list of texts and of objects with a text. Null if there is none."""

    def said(x: Column) -> Column:
        at = lambda p: F.get_json_object(x, p)
        mine = at("$.type").isin("item.completed", "item.started") & F.coalesce(F.nullif(at("$.item.type"), F.lit("")), at("$.item.item_type")).isin("assistant_message", "agent_message")
        content = F.coalesce(F.nullif(at("$.item.text"), F.lit("")), at("$.item.content"))
        parts = F.transform(F.from_json(content, "array<string>"), lambda p: F.when(F.startswith(p, F.lit("{")), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p))
        return F.when(mine, F.nullif(F.when(F.startswith(content, F.lit("[")) & parts.isNotNull(), F.array_join(parts, "")).otherwise(content), F.lit("")))

    return F.try_element_at(F.filter(F.transform(events, said), lambda x: x.isNotNull()), F.lit(-1))


def usage_limited(events: Column) -> Column:
    """Whether an event is an error that names a usage limit, after which no more is to be asked."""
    hit = lambda x: (F.get_json_object(x, "$.type") == "error") & F.contains(F.lower(F.get_json_object(x, "$.message")), F.lit("usage limit"))
    return F.coalesce(F.exists(events, lambda x: F.coalesce(hit(x), F.lit(False))), F.lit(False))


def tagged_section(c: str | Column, tag: str, to_end: bool = False) -> Column:
    """What stands in the first <tag>…</tag>, trimmed; empty if there is none. With `to_end`, an open tag takes the rest."""
    closed = F.regexp_extract(col(c), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    if not to_end:
        return F.coalesce(full_trim(closed), F.lit(""))
    has = col(c).rlike(rf"(?is)<{tag}[^>]*>.*?</{tag}>")
    return F.coalesce(full_trim(F.when(has, closed).otherwise(F.regexp_extract(col(c), rf"(?is)<{tag}[^>]*>(.*)", 1))), F.lit(""))


def verdict(c: str | Column) -> Column:
    """struct(verdict, reason) of <yes> / <no>: both give false and a marked reason, neither gives null and the whole text."""
    yes, no = col(c).rlike(r"(?i)<\s*yes\s*>"), col(c).rlike(r"(?i)<\s*no\s*>")
    without = full_trim(F.regexp_replace(col(c), r"(?i)<\s*(yes|no)\s*>", ""))
    v = F.when(yes & no, False).when(yes, True).when(no, False)
    return F.struct(v.alias("verdict"), F.when(yes & no, F.concat(F.lit("<BOTH_YES_NO>\n"), col(c))).when(yes | no, without).otherwise(col(c)).alias("reason"))


def tagged_verdict(c: str | Column) -> Column:
    """struct(verdict, reason) of <judgement> and <reasoning>."""
    word = F.lower(tagged_section(c, "judgement"))
    return F.struct(F.when(word == "yes", True).when(word == "no", False).alias("verdict"), tagged_section(c, "reasoning").alias("reason"))


def without_thoughts(c: str | Column) -> Column:
    return full_trim(F.regexp_replace(col(c), r"(?is)<think>.*?</think>", ""))


def headed_sections(c: str | Column) -> Column:
    """struct(root_cause, repair_suggestion) under the two Markdown headings, trimmed; empty where a heading is missing."""
    t = without_thoughts(c)
    rc = F.regexp_extract(t, r"(?is)#\s*root cause:\s*(.*?)(?=#\s*repair suggestion:|\z)", 1)
    rs = F.regexp_extract(t, r"(?is)#\s*repair suggestion:\s*(.*)\z", 1)
    return F.struct(F.coalesce(full_trim(rc), F.lit("")).alias("root_cause"), F.coalesce(full_trim(rs), F.lit("")).alias("repair_suggestion"))


def guidance(c: str | Column) -> Column:
    """Guidance with plain line ends, without the marks of fences, and with its two headings as labels; null gives an empty text."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?", "\n"), "```", "")
    t = F.regexp_replace(t, r"(?imd)^\s*#\s*root\s*cause\s*$", "ROOT_CAUSE:")
    return full_trim(F.regexp_replace(t, r"(?imd)^\s*#\s*repair\s*suggestion\s*$", "REPAIR_SUGGESTION:"))


def valid_answer(rc: str, rs: str, least: int = 20) -> Column:
    return F.coalesce((F.char_length(rc) >= least) & (F.char_length(rs) >= least), F.lit(False))


# prompts -----------------------------------------------------------------------------------------------------------------------
def right_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\x{85}\p{Z}]+$", "")


def formatted_segments(segments: Column, supplementary: bool = True, only_present: bool = False) -> Column:
    """Segments as text: each under a numbered header, the file and the fenced content of its suspicious part and, if asked for, of
    its supplementary part (with `only_present` not where that has neither file nor content). Every segment ends with an empty line."""

    def part(title: str, p: Column) -> Column:
        return F.concat(F.lit(f"[{title}] file: "), F.coalesce(p["file"], F.lit("")), F.lit("\n```\n"), right_trim(F.coalesce(p["content"], F.lit(""))), F.lit("\n```"))

    def one(s: Column, i: Column) -> Column:
        extra = []
        if supplementary:
            p = s["supplementary"]
            there = (F.coalesce(p["file"], F.lit("")) != "") | (F.coalesce(p["content"], F.lit("")) != "")
            extra = [F.when(there, part("Supplementary", p)) if only_present else part("Supplementary", p)]
        return F.concat_ws("\n", F.concat(F.lit("--- Segment Group "), (i + 1).cast("string"), F.lit(" ---")), part("Suspicious", s["suspicious"]), *extra, F.lit(""))

    return F.coalesce(F.array_join(F.transform(segments, one), "\n"), F.lit(""))


def task_context(issue: Column, code: Column) -> Column:
    """Issue and code under their headings; nulls as empty texts."""
    return F.concat(F.lit(ISSUE_HEADING), F.coalesce(issue, F.lit("")), F.lit("\n\n" + CODE_HEADING), F.coalesce(code, F.lit("")))


def analysis_prompt(issue: Column, code: Column, role: str, given: str, task: str, template: str) -> Column:
    """What an evaluated model is asked: its role, what it is given, its task, issue and code, and the template of the answer, each
    apart by an empty line. The wording is up to the caller."""
    return F.concat(F.lit(f"\n{role}\n\n{given}\n\nPerform the following Task:\n{task}\n\n"), task_context(issue, code), F.lit(f"\n\n{template}\n"))


def _fields(ends: str, *named: tuple[str, Column]) -> Column:
    """Titled fields one after another, nulls as empty texts, each with the given end."""
    return F.concat(*[x for title, c in named for x in (F.lit(f"{title}:\n"), F.coalesce(c, F.lit("")), F.lit(ends))])


def reasoning_prompt(issue: Column, segments: Column) -> Column:
    """What the first analysis is asked with: the issue and its segments."""
    return F.concat(_fields("\n\n", ("Issue Description", issue)), F.lit("Segment Groups:\n"), formatted_segments(segments))


def judge_prompt(issue: Column, cause: Column, removed: Column, added: Column) -> Column:
    """What a judge of a root cause is given: the issue, the cause, and both sides of the diff."""
    return F.concat(_fields("\n\n", ("Issue Description", issue), ("Root Cause", cause), ("diff_remove", removed)), _fields("\n", ("diff_add", added)))


def refine_prompt(issue: Column, removed: Column, added: Column, cause: Column, reasoning: Column, repair: Column) -> Column:
    """What a rejected answer is refined with: the issue, both sides of the diff, the answer, and the judge's reasoning."""
    return _fields("\n", ("Issue Description", issue), ("diff_remove", removed), ("diff_add", added), ("root_cause", cause), ("gemini_reasoning", reasoning), ("repair_suggestion", repair))


def guidance_prompt(issue: Column, code: Column, instruction: str) -> Column:
    """What guidance is asked with; parts end in the two characters backslash and n. An error text if issue or code is blank."""
    end = F.lit("\\n")
    parts = (F.lit(instruction), F.lit(ISSUE_HEADING.strip()), issue, F.lit(CODE_HEADING.strip()), code)
    ok = present(issue).isNotNull() & present(code).isNotNull()
    return F.when(ok, F.concat(*[x for p in parts for x in (p, end)])).otherwise("user prompt build error")


def chat_request(key: Column, number: Column, model: str, system: str, user: Column, temperature: float = 0.2, top_p: float = 0.9, max_tokens: int = 1024) -> Column:
    """One line of a batch of chat requests, as a struct; `number` names requests without a key."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p"), F.lit(max_tokens).alias("max_tokens"), F.lit(False).alias("stream")
    )
    return F.struct(F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("req-"), number.cast("string"))).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


def task_rows(problem: Column, code: Column, win_rc: Column, win_rs: Column, lose_rc: Column, lose_rs: Column, role: str, given: str, tasks: dict[str, str]) -> Column:
    """The three training tasks of a row: A the root cause, B the repair given the winning cause, C both. array of structs.

    `role`, `given` and `tasks` (the instruction of each) are the caller's wording. Answers are trimmed and end the turn.
    """
    texts = {k: full_trim(F.coalesce(c, F.lit(""))) for k, c in (("win_rc", win_rc), ("win_rs", win_rs), ("lose_rc", lose_rc), ("lose_rs", lose_rs))}

    def ask(task: str) -> Column:
        head = f"{TURN_BEGINS}system\n{role}\n{TURN_ENDS}\n{TURN_BEGINS}user\n{given}\n\nPerform the following Task:\n{tasks[task]}\n\n"
        cause = [F.lit("\n\n" + CAUSE_HEADING), F.coalesce(win_rc, F.lit(""))] if task == "B" else []
        return F.concat(F.lit(head), task_context(problem, code), *cause, F.lit(f"\n\n{TURN_ENDS}\n{TURN_BEGINS}assistant\n"))

    def answer(task: str, side: str) -> Column:
        rc, rs = [F.lit(CAUSE_HEADING), texts[f"{side}_rc"]], [F.lit(REPAIR_HEADING), texts[f"{side}_rs"]]
        return F.concat(*{"A": rc, "B": rs, "C": [*rc, F.lit("\n\n"), *rs]}[task], F.lit(TURN_ENDS))

    return F.array(*[F.struct(F.lit(t).alias("task"), ask(t).alias("input"), answer(t, "win").alias("win"), answer(t, "lose").alias("lose")) for t in "ABC"])
