"""Training rows within a token budget, preference losses, and deterministic splits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import present
from sievewright.functions.vectors import log_odds, odds_ratio_loss

FIELDS = ("problem", "slice", "win_rc", "win_rs", "lose_rc", "lose_rs")


class Blanks:
    """The simplest tokenizer: words between blanks. Any object with `encode` (text to tokens) and `decode` can stand in."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)


def fitted(texts: dict[str, str], preferred: bool, limit: int, tok) -> tuple[dict[str, str], dict]:
    """The fields of a row cut to a limit of tokens, and a log of what was cut.

    First problem and slice share the overflow by their sizes, each giving at most 30 %. If that isn't enough, a preference row
    gives up to 30 % of its losing answer; what is still over comes from problem and slice without a bound, one token more each.
    """
    t = dict(texts)
    size = lambda k: len(tok.encode(t[k]))
    answers = FIELDS[2:] if preferred else FIELDS[2:4]
    total = lambda: sum(size(k) for k in (*FIELDS[:2], *answers))
    log: dict = {"original_total": total(), "problem": size("problem"), "slice": size("slice"), "output": sum(size(k) for k in answers), "actions": []}

    def cut(k: str, n: int) -> None:
        if n > 0:
            tokens = tok.encode(t[k])
            t[k] = "" if n >= len(tokens) else tok.decode(tokens[: len(tokens) - n])

    def share(over: int, extra: int, most: float | None) -> int | None:
        p, s = size("problem"), size("slice")
        if p + s == 0:
            return None
        ratio = p / (p + s)
        cuts = [int(over * ratio) + extra, int(over * (1 - ratio)) + extra]
        if most is not None:
            cuts = [min(cuts[0], int(p * most)), min(cuts[1], int(s * most))]
        cut("problem", cuts[0])
        cut("slice", cuts[1])
        return sum(cuts)

    if total() > limit and (n := share(total() - limit, 0, 0.3)) is not None:
        log["actions"].append(f"soft_context({n})")
    if preferred and (over := total() - limit) > 0:
        rc, rs = size("lose_rc"), size("lose_rs")
        n = min(over, int((rc + rs) * 0.3))
        if n > 0:
            first = int(n * (rc / (rc + rs)))
            cut("lose_rc", first)
            cut("lose_rs", n - first)
            log["actions"].append(f"soft_losing({n})")
    if (over := total() - limit) > 0 and (n := share(over, 1, None)) is not None:
        log["actions"].append(f"force_context({n})")
    log["final_total"] = total()
    return t, log


def within_tokens(df: DataFrame, columns: dict[str, str], tag: str, max_tokens: int = 6144, reserve: int = 300, tokenizer: Callable[[], object] = Blanks) -> DataFrame:
    """A column `fitted`: struct of the six fields, original_total, final_total and actions of every row.

    `columns` names the column of each field (problem, slice, win_rc, win_rs, lose_rc, lose_rs). Supervised rows whose winning
    text is blank take the losing one. The tokenizer is made once in each worker. Null texts count as empty.
    """
    names = [columns[f] for f in FIELDS]
    kind = "struct<" + ", ".join(f"{f}:string" for f in FIELDS) + ", original_total:int, final_total:int, actions:array<string>>"

    @F.pandas_udf(kind)
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        tok = tokenizer()
        rows = []
        for *texts, kind_ in parts.itertuples(index=False):
            t = dict(zip(FIELDS, [x or "" for x in texts], strict=True))
            preferred = (kind_ or "").strip().upper() == "ORPO"
            if not preferred:
                for k in ("rc", "rs"):
                    t[f"win_{k}"] = t[f"win_{k}"] if t[f"win_{k}"].strip() else t[f"lose_{k}"]
            new, log = fitted(t, preferred, max_tokens - reserve, tok)
            rows.append({**new, "original_total": log["original_total"], "final_total": log["final_total"], "actions": log["actions"] or ["none"]})
        return pd.DataFrame(rows, columns=[*FIELDS, "original_total", "final_total", "actions"])

    return df.withColumn("fitted", run(F.struct(*[F.col(c).alias(f) for f, c in zip(FIELDS, names, strict=True)], F.col(tag).alias("tag"))))


def tag_of(c: str) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def usable_for_training(tag: str, win_rc: str, win_rs: str, lose_rc: str, lose_rs: str) -> Column:
    """Supervised rows need both winning texts, preference rows the losing ones too; other tags are never used."""
    won = present(win_rc).isNotNull() & present(win_rs).isNotNull()
    lost = present(lose_rc).isNotNull() & present(lose_rs).isNotNull()
    return F.when(tag_of(tag) == "SFT", won).when(tag_of(tag) == "ORPO", won & lost).otherwise(F.lit(False))


def hash_split(df: DataFrame, key: str, ratio: float = 0.85, modulus: int = 10_000) -> DataFrame:
    """`part` (train or held_out) by a hash of the key, the same for every run and every order; the share is met on average."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(key), F.lit(modulus)) < int(ratio * modulus), "train").otherwise("held_out"))


def exact_split(df: DataFrame, key: str, ratio: float = 0.85) -> DataFrame:
    """`part` as `hash_split`, but exactly int(n * ratio) rows are train: the first by the hash of the key, ties by the key."""
    from sievewright.operators.relational import row_numbers

    hashed = df.withColumn("__hash", F.xxhash64(key))
    most = df.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio))).scalar()
    numbered = row_numbers(hashed, ["__hash", key], "__place")
    return numbered.withColumn("part", F.when(F.col("__place") <= most, "train").otherwise("held_out")).drop("__hash", "__place")


def tokenized(input_: str, output: str, most: int, encode: Callable[[str], list[int]]) -> Column:
    """struct(ids, prompt_length) of an input and its output, cut at a length; `encode` runs in Arrow batches."""

    @F.pandas_udf("struct<ids:array<int>, prompt_length:int>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            head = encode(x or "")
            rows.append(((head + encode(y or ""))[:most], min(len(head), most)))
        return pd.DataFrame(rows, columns=["ids", "prompt_length"])

    return run(input_, output)


def preference_losses(df: DataFrame, tag: str, win: str, lose: str, beta: float = 1.0) -> DataFrame:
    """`sft_loss` (minus the mean log-probability of the winner), `ratio_loss` (0 for supervised rows), and for preference rows
    `margin`, `chosen`, `rejected` (the log-probabilities) and `log_odds` (the difference of the log-odds)."""
    orpo = (tag_of(tag) == "ORPO") & F.col(lose).isNotNull()
    ratio = F.when(orpo, odds_ratio_loss(F.col(win), F.col(lose), beta)).otherwise(0.0)
    only = lambda c: F.when(orpo, c)
    return df.withColumn("sft_loss", -F.col(win)).withColumns(
        {"ratio_loss": ratio, "margin": only(F.col(win) - F.col(lose)), "chosen": only(F.col(win)), "rejected": only(F.col(lose)), "log_odds": only(log_odds(F.col(win)) - log_odds(F.col(lose)))}
    )


def loss_report(df: DataFrame, group: str, tag: str, weight: float = 0.1) -> DataFrame:
    """Mean losses by group; both sums are over the number of all rows. accuracy and margin are over preference rows."""
    orpo = tag_of(tag) == "ORPO"
    n = F.count(F.lit(1))
    return df.groupBy(group).agg(
        n.alias("n"), F.count_if(orpo).alias("n_orpo"), (F.sum("sft_loss") / n).alias("sft_loss"), (F.sum("ratio_loss") / n).alias("ratio_loss"),
        ((F.sum("sft_loss") + weight * F.sum("ratio_loss")) / n).alias("total_loss"), (F.count_if(orpo & (F.col("margin") > 0)) / F.nullif(F.count_if(orpo), F.lit(0))).alias("accuracy"), F.avg("margin").alias("margin"),
    )


def task_loss_report(df: DataFrame, task: str, weight: float = 0.1) -> DataFrame:
    """The roll-up of `preference_losses` over training tasks: a row for each task, and one with task `all`.

    n, n_orpo (preference rows), sft_loss and ratio_loss (both over all rows of the task), total_loss (the first plus `weight` times
    the second). In the row `all` the losses are the means of the tasks' own, whatever their sizes, and accuracy, margin, chosen,
    rejected and log_odds are over the preference rows of all tasks (0.0 without any); they are null for single tasks. Null tasks
    are a task. An empty table gives the row `all` with zeros.
    """
    n = F.count(F.lit(1))
    per = df.groupBy(F.col(task).cast("string").alias("task")).agg(
        n.alias("n"), F.count("margin").alias("n_orpo"), (F.sum("sft_loss") / n).alias("sft_loss"), (F.sum("ratio_loss") / n).alias("ratio_loss"),
        F.count_if(F.col("margin") > 0).alias("__wins"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"__{c}") for c in ("margin", "chosen", "rejected", "log_odds")],
    )
    zero = F.lit(0.0)
    rate = lambda c: F.coalesce(F.sum(c) / F.nullif(F.sum("n_orpo"), F.lit(0)), zero)
    every = per.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.sum("n_orpo"), F.lit(0).cast("long")).alias("n_orpo"), F.coalesce(F.avg("sft_loss"), zero).alias("sft_loss"), F.coalesce(F.avg("ratio_loss"), zero).alias("ratio_loss"),
        rate("__wins").alias("accuracy"), *[rate(f"__{c}").alias(c) for c in ("margin", "chosen", "rejected", "log_odds")],
    ).withColumn("task", F.lit("all"))
    none = F.lit(None).cast("double")
    tasks = per.select("task", "n", "n_orpo", "sft_loss", "ratio_loss", *[none.alias(c) for c in ("accuracy", "margin", "chosen", "rejected", "log_odds")])
    return tasks.unionByName(every).withColumn("total_loss", F.col("sft_loss") + weight * F.col("ratio_loss"))
