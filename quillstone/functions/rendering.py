"""Rows to prompts and reports, replies to values: rendering, templates, parsing, part checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


def prompt_rows(df: DataFrame, by: str, order: list[str], line: Column, between: str = "\n\n---\n\n") -> DataFrame:
    """by, prompt: the rows of each group as numbered blocks, in order."""
    w = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    blocks = F.transform(w, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["_line"]))
    return df.groupBy(by).agg(F.array_join(blocks, between).alias("prompt"))


def money(x: Column) -> Column:
    """With thousands separators; null: an empty text."""
    return F.coalesce(F.format_number(x.cast("double"), 0), F.lit(""))


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by each value, null by nothing."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def answer_letter(reply: Column, default: str = "X") -> Column:
    """The first of A to D or X in a reply, full-width letters too; else the default."""
    found = F.regexp_extract(F.upper(F.translate(reply, "ＡＢＣＤＸａｂｃｄｘ", "ABCDXABCDX")), "([ABCDX])", 1)
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(default)


def listed_questions(reply: Column, most: int = 6) -> Column:
    """A JSON list of strings as questions: stripped, empty ones left out, "?" at the end; more than `most`, or no
    list: null."""
    items = F.filter(F.transform(F.from_json(reply, "array<string>"), strip), lambda x: x.isNotNull() & (x != ""))
    asked = F.transform(items, lambda x: F.when(F.regexp_like(x, F.lit("[?？]$")), x).otherwise(F.concat(x, F.lit("?"))))
    return F.when(F.size(items).between(1, most), asked)


def case_label(text: Column) -> Column:
    """The article and paragraph a case names, or "other"."""
    found = F.regexp_extract(text, r"第(\d+)條第(\d+)項", 0)
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise("other")


def learning_rows(cases: DataFrame) -> DataFrame:
    """cases(product, violation, penalty, law_cited, ...) -> text, penalty, log_penalty, label and the other columns: both
    texts with single spaces; rows without a text, or without a penalty above zero, are left out."""
    whole = F.concat_ws(" ", F.coalesce("product", F.lit("")), F.coalesce("violation", F.lit("")))
    rows = cases.withColumn("text", strip(F.regexp_replace(whole, r"(?U)\s+", " "))).filter((F.col("text") != "") & (F.col("penalty") > 0))
    return rows.withColumn("log_penalty", F.log("penalty")).withColumn("label", case_label(F.col("law_cited"))).drop("product", "violation", "law_cited")


def part_ok(answer: Column, must_any: Column, case: Column, none_ok: Column, money_pattern: str, actor_pattern: str, none_pattern: str) -> Column:
    """A part of a compound answer: one of the texts it must have; for a case, an amount and an actor; where no result
    is acceptable, a sentence that says so."""
    texts = F.coalesce(F.exists(must_any, lambda m: F.contains(answer, m)), F.lit(False))
    cases = F.coalesce(case, F.lit(False)) & F.regexp_like(answer, F.lit(money_pattern)) & F.regexp_like(answer, F.lit(actor_pattern))
    none = F.coalesce(none_ok, F.lit(False)) & F.regexp_like(answer, F.lit(none_pattern))
    return F.coalesce(texts | cases | none, F.lit(False))


def penalty_report(path: Column, word: str, month: str = "月", ending: str = ".pdf") -> Column:
    """Whether a file name belongs to a penalty report."""
    return F.contains(path, F.lit(word)) & F.contains(path, F.lit(month)) & F.endswith(F.lower(path), F.lit(ending))


def markdown_report(metrics: DataFrame, titles: list[str], section: str = "section", name: str = "name", value: str = "value") -> str:
    """A Markdown report of a metrics table (a row for each figure, so small): a section for each title, "not run" where
    it has no rows."""
    have: dict[str, list] = {}
    for r in metrics.select(section, name, F.col(value).cast("string").alias("v")).orderBy(section, name).toLocalIterator():
        have.setdefault(r[0], []).append((r[1], r[2]))
    parts = []
    for t in titles:
        rows = have.get(t)
        parts.append(f"## {t}\n\n" + ("\n".join(["| metric | value |", "|-|-|", *(f"| {n} | {v} |" for n, v in rows)]) if rows else "_not run_"))
    return "\n\n".join(parts) + "\n"
