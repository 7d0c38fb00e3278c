"""Queries over issue texts, model outputs and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as t
from sievewright.operators.relational import keyword_combinations as combine


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def failed_requests(spark, sf):
    p = table(spark, sf, "eval_prompt").filter(t.is_failed_with_text("status", "prompt"))
    r = p.select(t.chat_request(F.col("instance_id"), F.lit(0), "any", "Answer briefly.", F.col("prompt")).alias("r"))
    return r.select("r.custom_id", "r.method", "r.url", F.size("r.body.messages").cast("long").alias("n_messages"), F.col("r.body.messages")[1]["content"].alias("content"))


def keyword_answers(spark, sf):
    """Answers in the form of headed sections, made of each issue's keywords, and read back."""
    m = table(spark, sf, "mined_issue").filter("keywords_used IS NOT NULL")
    answer = F.concat(F.lit("Here they are.\n# Error_Patterns\n\n"), F.array_join("keywords_used", " , "), F.lit("...\n# code_elements of it\n `a  b`, \"c\" ,,\n# code_elements\nlast.\n"))
    got = m.select("row_id", t.keyword_sections(answer).alias("k"))
    return got.select("row_id", F.array_join("k.error_patterns", "|").alias("errors"), F.array_join("k.code_elements", "|").alias("code"), F.col("k.domain_context").isNull().alias("no_domain"))


def response_content(spark, sf):
    """Responses in their three forms, made of predictions, and read back."""
    p = table(spark, sf, "prediction")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("raw_output").alias("content")).alias("message"))).alias("choices")))
    whole = F.concat(F.lit('{"response":{"body":'), F.when(F.col("row_id") % 2 == 0, body).otherwise(F.substring(F.to_json(F.struct(body.alias("b"))), 6, 10_000_000)), F.when(F.col("row_id") % 2 == 0, F.lit("}}")).otherwise("}"))
    line = F.when(F.col("row_id") % 5 == 0, F.to_json(F.struct(F.col("raw_output").alias("content")))).otherwise(whole)
    return p.select("row_id", F.coalesce(t.message_content(line), F.lit("")).alias("content"))


def event_props(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"))


def query_strings(spark, sf):
    m = table(spark, sf, "mined_issue")
    k = F.coalesce("keywords_used", F.array().cast("array<string>"))
    return m.select(
        "row_id", t.search_query("is:issue ", k, "AND").alias("q_and"), t.search_query("is:issue ", k, "OR").alias("q_or"), t.date_window("created_at").alias("window"), t.keyword_signature(k).alias("signature"), t.fallback_query(F.col("comments_count"), k).alias("used")
    )


def repo_of_url(spark, sf):
    m = table(spark, sf, "mined_issue")
    return m.select("row_id", t.repo_of_url("url", "tracker.example/").alias("repo_name"), t.clone_dir("repo", "issue_id").alias("dir"))


def iso_times(spark, sf):
    m = table(spark, sf, "mined_issue")
    return m.select("row_id", F.date_format(t.iso_timestamp("created_at"), "yyyy-MM-dd HH:mm:ss").alias("at"))


def issue_quality(spark, sf):
    p = table(spark, sf, "flat_pr")
    return p.select("row_id", t.has_code_example("problem_statement").alias("code"), t.has_error_message("problem_statement").alias("error"), t.good_body("problem_statement").alias("good"))


def issue_trim(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    e = t.middle_elided("text", 2000, 900)
    return d.select("doc_id", F.md5(t.tiered_trim("text").cast("binary")).alias("trimmed"), F.md5(e["head"].cast("binary")).alias("head"), F.md5(e["tail"].cast("binary")).alias("tail"), e["elided"].alias("elided"))


def segments_format(spark, sf):
    c = table(spark, sf, "cot")
    s = F.col("segments")
    forms = {"both": t.formatted_segments(s), "suspicious": t.formatted_segments(s, False), "present": t.formatted_segments(s, only_present=True), "asked": t.reasoning_prompt(F.col("problem_statement"), s)}
    return c.select("row_id", *[F.md5(f.cast("binary")).alias(k) for k, f in forms.items()])


def generation_parse(spark, sf):
    c = table(spark, sf, "cot").filter("gen_text IS NOT NULL")
    return c.select("row_id", t.tagged_section("gen_text", "root cause").alias("cause"), t.tagged_section("gen_text", "suggestion", True).alias("suggestion"), F.md5(t.tagged_section("gen_text", "patch").cast("binary")).alias("patch"))


def answer_sections(spark, sf):
    p = table(spark, sf, "prediction").filter("raw_output IS NOT NULL").select("row_id", t.headed_sections("raw_output").alias("s"))
    return p.select("row_id", "s.root_cause", "s.repair_suggestion", t.valid_answer("s.root_cause", "s.repair_suggestion").alias("valid"))


def verdicts(spark, sf):
    s = table(spark, sf, "scored")
    text = F.concat(F.when(F.col("gemini_judgement"), "< Yes >").when(~F.col("gemini_judgement"), "<NO>").otherwise(""), F.lit(" since it is so. "), F.when(F.col("row_id") % 7 == 0, "<no>").otherwise(""))
    v = s.select("row_id", t.verdict(text).alias("v"), t.tagged_verdict(F.concat(F.lit("<judgement> yes </judgement><reasoning>"), text, F.lit("</reasoning>"))).alias("w"))
    return v.select("row_id", "v.verdict", "v.reason", F.col("w.verdict").alias("tagged"))


def guidance_texts(spark, sf):
    return table(spark, sf, "prediction").select("row_id", F.md5(t.guidance("raw_output").cast("binary")).alias("guidance"))


def guidance_prompts(spark, sf):
    c = table(spark, sf, "final_row")
    return c.select("row_id", F.md5(t.guidance_prompt(F.col("problem_statement"), F.col("buggy_slice"), "Name cause and repair.").cast("binary")).alias("prompt"))


def review_prompts(spark, sf):
    """What judges and refiners are given, over predictions with their prompts as issues."""
    p = table(spark, sf, "prediction").select("row_id", *[F.col(c) for c in ("error_text", "root_cause", "repair_suggestion", "raw_output", "model", "status")])
    c = {x: F.col(x) for x in p.columns}
    judge = t.judge_prompt(c["error_text"], c["root_cause"], c["model"], c["status"])
    refine = t.refine_prompt(c["error_text"], c["model"], c["status"], c["root_cause"], c["raw_output"], c["repair_suggestion"])
    return p.select("row_id", F.md5(judge.cast("binary")).alias("judge"), F.md5(refine.cast("binary")).alias("refine"))


def agent_messages(spark, sf):
    """The last message of event streams made of predictions: plain lines, a started and a completed item, and errors."""
    p = table(spark, sf, "prediction")
    item = lambda **c: F.to_json(F.struct(F.lit(c.pop("event")).alias("type"), F.struct(*[v.alias(k) for k, v in c.items()]).alias("item")))
    events = F.array(
        F.lit("no event"),
        item(event="item.started", type=F.lit("agent_message"), text=F.col("root_cause")),
        item(event="item.completed", item_type=F.lit("assistant_message"), content=F.array(F.col("raw_output"), F.lit("!"))),
        item(event="item.completed", type=F.lit("reasoning"), text=F.lit("not this")),
        item(event="item.completed", item_type=F.lit("assistant_message"), content=F.array(F.struct(F.col("repair_suggestion").alias("text")))),
        F.to_json(F.struct(F.lit("error").alias("type"), F.col("error_text").alias("message"))),
        F.to_json(F.struct(F.lit("error").alias("type"), F.when(F.col("retry_count") > 1, "The Usage Limit is reached").alias("message"))),
    )
    return p.select("row_id", F.md5(F.coalesce(t.last_message(events), F.lit("")).cast("binary")).alias("message"), t.usage_limited(events).alias("limited"))


def large_and_starred(spark, sf):
    return table(spark, sf, "flat_pr").select("row_id", t.large_and_starred("body_length", "star").alias("ok"))


def retryable_errors(spark, sf):
    return table(spark, sf, "prediction").select("row_id", t.retryable("error_text").alias("again"), t.retryable(F.concat(F.lit("fatal: Early EOF "), F.coalesce("error_text", F.lit("")))).alias("always"))


def head_cuts(spark, sf):
    return table(spark, sf, "scored").select("row_id", F.char_length(t.head_cut("raw_diff")).alias("n"), F.md5(t.head_cut("raw_diff", 1000).cast("binary")).alias("head"))


def keyword_combinations(spark, sf):
    """Combinations of four lists made of all words of the title by position (mod 4), the keywords leading the errors."""
    m = table(spark, sf, "mined_issue").filter("keywords_used IS NOT NULL AND title IS NOT NULL")
    w = F.split("title", " ")
    every = lambda n: F.filter(w, lambda _, i: i % 4 == n)
    lists = [every(0), F.concat("keywords_used", every(1)), every(2), every(3)]
    return m.select("row_id", F.explode(combine(lists)).alias("k")).select("row_id", F.array_join("k", " ").alias("keywords"))


#: The wording that the test queries ask with.
ROLE, GIVEN, TASK, TEMPLATE = "You know how bugs are repaired.", "Given are an issue and code.", "Name cause and repair.", "Answer so:"


def prompts(spark, sf):
    f = table(spark, sf, "final_row")
    return f.select("row_id", F.md5(t.analysis_prompt(F.col("problem_statement"), F.col("buggy_slice"), ROLE, GIVEN, TASK, TEMPLATE).cast("binary")).alias("prompt"))


QUERIES = {f.__name__: f for f in (failed_requests, keyword_answers, response_content, event_props, query_strings, repo_of_url, iso_times, issue_quality, issue_trim, segments_format, generation_parse, answer_sections, verdicts, guidance_texts, guidance_prompts, review_prompts, agent_messages, large_and_starred, retryable_errors, head_cuts, keyword_combinations, prompts)}

_WS = r"[\s\x0b\x{85}\p{Z}]"


def trim_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def item_sql(x: str) -> str:
    return "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + trim_sql(x) + r""", '^["''` \t]+', ''), '["''` \t]+$', ''), '\s+', ' ', 'g'), '\.+$', '')"""


NL = "chr(10)"


def part(p: str, title: str) -> str:
    return f"""'[{title}] file: ' || coalesce(s.{p}.file, '') || {NL} || '```' || {NL} || regexp_replace(coalesce(s.{p}.content, ''), '{_WS}+$', '') || {NL} || '```'"""


def segments_sql(extra: str) -> str:
    there = "coalesce(s.supplementary.file, '') <> '' OR coalesce(s.supplementary.content, '') <> ''"
    more = {"always": f", {part('supplementary', 'Supplementary')}", "present": f", CASE WHEN {there} THEN {part('supplementary', 'Supplementary')} END", "": ""}[extra]
    return f"coalesce(array_to_string(list_transform(segments, lambda s, i: concat_ws({NL}, '--- Segment Group ' || i || ' ---', {part('suspicious', 'Suspicious')}{more}, '')), {NL}), '')"


def combos_sql(*lists: tuple[str, int]) -> str:
    """All combinations of the first so many of each list, the first list slowest."""
    names = "xyz"[: len(lists)]
    inner = f"[{', '.join(names)}]"
    for k in range(len(lists) - 1, -1, -1):
        inner = f"list_transform({lists[k][0]}[1:{lists[k][1]}], lambda {names[k]}: {inner})"
    for _ in lists[1:]:
        inner = f"flatten({inner})"
    return inner


def fields_sql(*named: tuple[str, str, int]) -> str:
    return " || ".join(f"'{title}:' || {NL} || coalesce({c}, '')" + f" || {NL}" * ends for title, c, ends in named)


def section_sql(tag: str, c: str = "gen_text") -> str:
    return "coalesce(" + trim_sql(f"regexp_extract({c}, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)") + ", '')"


SQL = {
    "failed_requests": "SELECT CASE WHEN coalesce(instance_id, '') = '' THEN 'req-0' ELSE instance_id END AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 2::BIGINT AS n_messages, prompt AS content FROM eval_prompt WHERE lower(coalesce(status, '')) = 'failed' AND " + trim_sql("prompt") + " <> ''",
    "keyword_answers": f"""SELECT row_id, array_to_string(list_filter(list_transform(string_split(array_to_string(keywords_used, ' , ') || '...', ','), lambda x: {item_sql('x')}), lambda x: x <> ''), '|') AS errors, 'last' AS code, true AS no_domain
        FROM mined_issue WHERE keywords_used IS NOT NULL""",
    "response_content": "SELECT row_id, coalesce(raw_output, '') AS content FROM prediction",
    "event_props": "SELECT event_type, count(json_extract(props, '$.k')) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum FROM events GROUP BY event_type",
    "query_strings": f"""WITH m AS (SELECT *, coalesce(keywords_used, []) AS k, try_strptime(substr(created_at, 1, 10), '%Y-%m-%d') AS d FROM mined_issue), n AS (SELECT *, list_filter(list_transform(k, lambda x: {trim_sql('x')}), lambda x: x <> '') AS kt FROM m)
        SELECT row_id, 'is:issue ' || array_to_string(kt, ' AND ') AS q_and, 'is:issue ' || array_to_string(kt, ' OR ') AS q_or,
        coalesce('created:' || strftime(d - INTERVAL 5 YEAR, '%Y-%m-%d') || '..' || strftime(d, '%Y-%m-%d'), 'created:>2020-01-01') AS "window", array_to_string(list_sort(list_filter(list_transform(k, lambda x: lower(x)), lambda x: x <> '')), '|') AS signature,
        CASE WHEN comments_count = 0 AND len(k) > 1 THEN 'OR' ELSE 'AND' END AS used FROM n""",
    "repo_of_url": "SELECT row_id, CASE WHEN url LIKE '%tracker.example/%' THEN nullif(regexp_extract(url, 'tracker\\.example/([^/]+/[^/]+)', 1), '') END AS repo_name, concat_ws('_', replace(repo, '/', '_'), issue_id::VARCHAR) AS dir FROM mined_issue",
    "iso_times": f"""WITH m AS (SELECT row_id, {trim_sql('created_at')} AS c FROM mined_issue)
        SELECT row_id, strftime(coalesce(CASE WHEN regexp_matches(c, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(Z|\\+00:00)$') THEN try_strptime(substr(c, 1, 19), '%Y-%m-%dT%H:%M:%S') END, try_strptime(c, '%Y-%m-%dT%H:%M:%S'), CASE WHEN regexp_matches(c, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN try_strptime(c, '%Y-%m-%d') END), '%Y-%m-%d %H:%M:%S') AS at FROM m""",
    "issue_quality": r"""SELECT row_id, coalesce(contains(problem_statement, '```') OR regexp_matches(problem_statement, '\n[\s\x0b]{4,}[^\s\x0b]'), false) AS code,
        coalesce(regexp_matches(lower(problem_statement), 'exception|error|traceback|bug|issue|problem'), false) AS error,
        coalesce(length(problem_statement) >= 100 AND (contains(problem_statement, '```') OR regexp_matches(problem_statement, '\n[\s\x0b]{4,}[^\s\x0b]')), false) AS good FROM flat_pr""",
    "issue_trim": """SELECT doc_id, md5(substr(text, 1, CASE WHEN length(text) < 3000 THEN length(text) WHEN length(text) <= 10000 THEN 3000 + floor((length(text) - 3000) * 0.5::DOUBLE)::INT ELSE 6000 + floor((length(text) - 6000) * 0.2::DOUBLE)::INT END)) AS trimmed,
        md5(CASE WHEN length(text) < 2000 THEN text ELSE substr(text, 1, 900) END) AS head, md5(CASE WHEN length(text) < 2000 THEN '' ELSE substr(text, length(text) - 899) END) AS tail, CASE WHEN length(text) < 2000 THEN 0 ELSE length(text) - 1800 END::BIGINT AS elided FROM documents WHERE text IS NOT NULL""",
    "segments_format": f"""SELECT row_id, md5({segments_sql('always')}) AS both, md5({segments_sql('')}) AS suspicious, md5({segments_sql('present')}) AS present,
        md5('Issue Description:' || {NL} || coalesce(problem_statement, '') || {NL} || {NL} || 'Segment Groups:' || {NL} || {segments_sql('always')}) AS asked FROM cot""",
    "generation_parse": f"""SELECT row_id, {section_sql('root cause')} AS cause, coalesce({trim_sql("CASE WHEN regexp_matches(gen_text, '(?is)<suggestion[^>]*>.*?</suggestion>') THEN regexp_extract(gen_text, '(?is)<suggestion[^>]*>(.*?)</suggestion>', 1) ELSE regexp_extract(gen_text, '(?is)<suggestion[^>]*>(.*)', 1) END")}, '') AS suggestion,
        md5({section_sql('patch')}) AS patch FROM cot WHERE gen_text IS NOT NULL""",
    "answer_sections": f"""WITH p AS (SELECT row_id, {trim_sql("regexp_replace(raw_output, '(?is)<think>.*?</think>', '', 'g')")} AS t FROM prediction WHERE raw_output IS NOT NULL),
        q AS (SELECT row_id, {trim_sql("regexp_replace(regexp_extract(t, '(?is)#[[:space:]]*root cause:[[:space:]]*(.*)', 1), '(?is)#[[:space:]]*repair suggestion:.*', '')")} AS root_cause, {trim_sql("regexp_extract(t, '(?is)#[[:space:]]*repair suggestion:[[:space:]]*(.*)', 1)")} AS repair_suggestion FROM p)
        SELECT row_id, root_cause, repair_suggestion, length(root_cause) >= 20 AND length(repair_suggestion) >= 20 AS valid FROM q""",
    "verdicts": """WITH s AS (SELECT row_id, coalesce(gemini_judgement, false) AS yes, gemini_judgement IS NOT NULL AND NOT gemini_judgement OR row_id % 7 = 0 AS no, (CASE WHEN gemini_judgement THEN '< Yes >' WHEN NOT gemini_judgement THEN '<NO>' ELSE '' END) || ' since it is so. ' || (CASE WHEN row_id % 7 = 0 THEN '<no>' ELSE '' END) AS t FROM scored)
        SELECT row_id, CASE WHEN yes AND no THEN false WHEN yes THEN true WHEN no THEN false END AS verdict, CASE WHEN yes AND no THEN '<BOTH_YES_NO>' || chr(10) || t WHEN yes OR no THEN 'since it is so.' ELSE t END AS reason, true AS tagged FROM s""",
    "guidance_texts": f"""SELECT row_id, md5({trim_sql("regexp_replace(regexp_replace(replace(regexp_replace(coalesce(raw_output, ''), chr(13) || chr(10) || '?', chr(10), 'g'), '```', ''), '(?im)^[[:space:]]*#[[:space:]]*root[[:space:]]*cause[[:space:]]*$', 'ROOT_CAUSE:', 'g'), '(?im)^[[:space:]]*#[[:space:]]*repair[[:space:]]*suggestion[[:space:]]*$', 'REPAIR_SUGGESTION:', 'g')")}) AS guidance FROM prediction""",
    "guidance_prompts": f"""SELECT row_id, md5(CASE WHEN {trim_sql("coalesce(problem_statement, '')")} <> '' AND {trim_sql("coalesce(buggy_slice, '')")} <> '' THEN 'Name cause and repair.\\n# GitHub Issue Description:\\n' || problem_statement || '\\n# Segments Groups:\\n' || buggy_slice || '\\n'
        ELSE 'user prompt build error' END) AS prompt FROM final_row""",
    "review_prompts": f"""SELECT row_id, md5({fields_sql(("Issue Description", "error_text", 2), ("Root Cause", "root_cause", 2), ("diff_remove", "model", 2), ("diff_add", "status", 1))}) AS judge,
        md5({fields_sql(("Issue Description", "error_text", 1), ("diff_remove", "model", 1), ("diff_add", "status", 1), ("root_cause", "root_cause", 1), ("gemini_reasoning", "raw_output", 1), ("repair_suggestion", "repair_suggestion", 1))}) AS refine FROM prediction""",
    "agent_messages": "SELECT row_id, md5(CASE WHEN coalesce(repair_suggestion, '') <> '' THEN repair_suggestion ELSE coalesce(raw_output, '') || '!' END) AS message, coalesce(retry_count > 1, false) OR contains(lower(coalesce(error_text, '')), 'usage limit') AS limited FROM prediction",
    "large_and_starred": "SELECT row_id, coalesce(body_length, 0) > 100 AND coalesce(star, 0) >= 30 AS ok FROM flat_pr",
    "retryable_errors": """SELECT row_id, regexp_matches(lower(coalesce(error_text, '')), 'gnutls recv error|early eof|connection timed out|invalid index-pack|unexpected disconnect while reading sideband packet|error in the pull function|exit status 128') AS again, true AS always FROM prediction""",
    "head_cuts": "SELECT row_id, least(length(raw_diff), 16000)::INT AS n, md5(substr(raw_diff, 1, 1000)) AS head FROM scored",
    "keyword_combinations": f"""WITH m AS (SELECT row_id, keywords_used AS k, string_split(title, ' ') AS w FROM mined_issue WHERE keywords_used IS NOT NULL AND title IS NOT NULL),
        n AS (SELECT row_id, k, list_filter(w, lambda v, i: i % 4 = 1) AS p, list_filter(w, lambda v, i: i % 4 = 2) AS e2, list_filter(w, lambda v, i: i % 4 = 3) AS c, list_filter(w, lambda v, i: i % 4 = 0) AS d FROM m),
        l AS (SELECT row_id, p, list_concat(k, e2) AS e, c, d, list_concat(list_concat(k, e2), list_concat(c, d)) AS o FROM n),
        a AS (SELECT row_id, list_concat(list_concat(list_concat({combos_sql(("p", 3), ("e", 4), ("c", 3))}, {combos_sql(("p", 3), ("d", 4), ("e", 3))}), list_concat({combos_sql(("p", 3), ("c", 4), ("d", 3))}, {combos_sql(("p", 4), ("o", 8))})), {combos_sql(("p", 5))}) AS every FROM l),
        u AS (SELECT row_id, unnest(every) AS s, unnest(range(len(every))) AS i FROM a), g AS (SELECT *, array_to_string(list_sort(list_filter(list_transform(s, lambda v: lower(v)), lambda v: v <> '')), '|') AS sig FROM u),
        f AS (SELECT *, row_number() OVER (PARTITION BY row_id, sig ORDER BY i) AS rep FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY i) AS place FROM f WHERE rep = 1)
        SELECT row_id, array_to_string(s, ' ') AS keywords FROM r WHERE place <= 15""",
    "prompts": f"""SELECT row_id, md5({NL} || '{ROLE}' || {NL} || {NL} || '{GIVEN}' || {NL} || {NL} || 'Perform the following Task:' || {NL} || '{TASK}' || {NL} || {NL} || '# GitHub Issue Description:' || {NL} || coalesce(problem_statement, '') || {NL} || {NL}
        || '# Segments Groups:' || {NL} || coalesce(buggy_slice, '') || {NL} || {NL} || '{TEMPLATE}' || {NL}) AS prompt FROM final_row""",
}
