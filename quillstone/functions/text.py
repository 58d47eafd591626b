"""Cleaning and shaping text. Column functions stay in the JVM; only NFKC and line folding need Arrow functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns whose matches are removed, in this order.
CID = r"\(cid:[0-9]+\)"
PLACEHOLDER = r"@#|(?<!\S)@(?!\S)"
PAGE_NUMBERS = [
    r"第\s*\d+\s*頁[,，]\s*共\s*\d+\s*頁",
    r"-\s*\d+\s*-",
    r"\b\d+\s*/\s*\d+\b",
    r"(?m)^\s*\d{1,3}\s*$",
    r"(?m)^\s*\d{1,3}-\d{1,3}\s*$",
    r"(?m)^\d{1,3}\)\s*$",
    r"~\s*\d+\s*~",
    r"(?m)^\s*\|\s*$",
]
# What begins a new paragraph, and what ends a sentence.
NEW_PARAGRAPH = re.compile(r"(?:[壹貳參肆伍陸柒捌玖拾零一二三四五六七八九十]+[、.,]|[(\(][一二三四五六七八九十0-9]+[)\)]|\d+[、.,]|[QA]\d+[:.：]|第\s*[一二三四五六七八九十0-9]+\s*[條章節項款]|\|)")
SENTENCE_END = "。!?;:,、:"
SPACED_CJK = r"(?<=[一-鿿㐀-䶿豈-﫿]) (?=[一-鿿㐀-䶿豈-﫿])"
_SPACED_RUN = re.compile("(?:[一-鿿㐀-䶿豈-﫿] ){2,}[一-鿿㐀-䶿豈-﫿]")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once for a row and not at each place, or for each element, that mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: Column) -> Column:
    """All white space at both ends, as Python's str.strip does."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def remove_invisible(x: Column) -> Column:
    """Byte-order marks and zero-width spaces go; a no-break space becomes a space."""
    return F.translate(x, " ﻿​", " ")


def remove_cid(x: Column) -> Column:
    return F.regexp_replace(x, CID, "")


def cid_ratio(x: Column) -> Column:
    """The share of characters that are font codes; 0 for empty text."""
    return F.when(F.length(x) > 0, (F.length(x) - F.length(remove_cid(x))) / F.length(x)).otherwise(0.0)


def remove_placeholders(x: Column) -> Column:
    return F.regexp_replace(x, "(?U)" + PLACEHOLDER, "")


def remove_page_numbers(x: Column) -> Column:
    for p in PAGE_NUMBERS:
        x = F.regexp_replace(x, "(?U)" + p, "")
    return x


def compact(x: Column) -> Column:
    """Runs of blanks to one, three or more line feeds to two, no white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def fold_lines(text: str) -> str:
    """Joins lines that a page layout broke: a line goes on unless it is empty, begins a paragraph, or the line
    before ends a sentence. Empty lines stay."""
    out: list[str] = []
    held = ""
    for line in map(str.rstrip, text.split("\n")):
        if held and line and not NEW_PARAGRAPH.match(line) and held[-1] not in SENTENCE_END:
            held += line
            continue
        if held:
            out.append(held)
        held = line
        if not line:
            out.append("")
    return "\n".join([*out, held] if held else out)


def close_spaced(text: str) -> str:
    """Three or more ideographs with single spaces between them lose the spaces."""
    return _SPACED_RUN.sub(lambda m: m[0].replace(" ", ""), text)


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Spark has no Unicode normal forms."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def merge_lines(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else fold_lines(t))


@F.pandas_udf(T.StringType())
def fix_spaced(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else close_spaced(t))


def clean(x: Column) -> Column:
    """The whole cleaning chain in its fixed order. Null stays null."""
    x = nfkc(remove_placeholders(remove_cid(remove_invisible(x))))
    return compact(fix_spaced(merge_lines(remove_page_numbers(x))))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> -> a Markdown table: pipes escaped, line feeds to spaces, short rows padded."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n"))


def valid_table(rows: Column) -> Column:
    """At least two rows and columns, three tenths of the cells filled, and not a two-column layout with a side that
    is empty in six tenths of the rows or more."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    filled = F.aggregate(rows, F.lit(0), lambda s, r: s + F.size(F.filter(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")))
    cells = F.aggregate(rows, F.lit(0), lambda s, r: s + F.size(r))
    blank = lambda i: F.size(F.filter(rows, lambda r: F.trim(F.coalesce(F.get(r, F.lit(i)), F.lit(""))) == ""))
    layout = (width == 2) & (F.greatest(blank(0), blank(1)) >= F.size(rows) * 0.6)
    return F.coalesce((F.size(rows) >= 2) & (width >= 2) & (filled >= cells * 0.3) & ~layout, F.lit(False))


def split_questions(x: Column, marks: str = "[?？]+", least: int = 2) -> Column:
    """A question cut at its marks: trimmed parts of at least `least` characters, a "?" after each; fewer than two
    such parts: the stripped text itself."""
    trimmed = F.filter(F.transform(F.split(x, marks), lambda p: F.btrim(p, F.lit(" \t\r\n,，;；、。"))), lambda p: F.length(p) >= least)
    return F.when(F.size(trimmed) >= 2, F.transform(trimmed, lambda p: F.concat(p, F.lit("?")))).otherwise(F.array(strip(x)))


#: A sub-question of fewer characters may lack its subject.
SHORT_PART = 8


def decomposed(x: Column, reply: Column, marks: str = "[?？]+", most: int = 6) -> Column:
    """struct(subs, used_llm): the rule's parts; where one of several is short and there is a model's reply (a JSON list
    of strings), the reply's questions, if they are 1 to `most`, else the rule's."""
    parts = split_questions(x, marks)
    asked = F.coalesce(reply.isNotNull() & (F.size(parts) >= 2) & F.exists(parts, lambda p: F.length(F.regexp_replace(p, "[?？]+$", "")) < SHORT_PART), F.lit(False))
    given = F.filter(F.transform(F.from_json(reply, "array<string>"), strip), lambda p: p.isNotNull() & (p != ""))
    given = F.transform(given, lambda p: F.when(F.regexp_like(p, F.lit("[?？]$")), p).otherwise(F.concat(p, F.lit("?"))))
    return F.struct(F.when(asked & F.size(given).between(1, most), given).otherwise(parts).alias("subs"), asked.alias("used_llm"))


# Words and marks that show a question.
QUESTION_MARKS = ("?", "嗎", "呢", "什麼", "甚麼", "哪", "如何", "怎麼", "怎樣", "是否", "多少", "為何", "為什麼", "會不會", "能不能", "可不可以", "要不要")


def is_keywords(x: Column, most: int = 12, marks: tuple[str, ...] = QUESTION_MARKS) -> Column:
    """Short, not empty, and without any mark of a question."""
    q = strip(x)
    return (q != "") & (F.length(q) <= most) & ~F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(q, m))


def keyword_question(x: Column, shell: str = "%s的相關規定是什麼?", most: int = 12, marks: tuple[str, ...] = QUESTION_MARKS) -> Column:
    """Keywords in the shell of a question; anything else as it is."""
    return F.when(is_keywords(x, most, marks), F.format_string(shell, F.btrim(x, F.lit(" \t\r\n,，;；、。")))).otherwise(x)


def enumerated(x: Column, cue: str = "(?:如|例如|包括)", mark: str = "、", stop: str = "。", least: int = 3) -> Column:
    """Nouns of enumerations: after a cue, up to 80 characters with `least` marks or more, cut at the marks."""
    spans = F.filter(F.regexp_extract_all(x, F.lit(f"{cue}([^{stop}]{{1,80}})"), F.lit(1)), lambda s: F.size(F.split(s, mark)) > least)
    nouns = F.flatten(F.transform(spans, lambda s: F.transform(F.split(s, mark), lambda p: strip(F.regexp_replace(p, "等.*$", "")))))
    return F.array_distinct(F.filter(nouns, lambda p: F.length(p).between(3, 12)))


def noun_map(rows: DataFrame, x: Column, key: str, shown: int) -> DataFrame:
    """noun, n (rows that enumerate it), rows (the first `shown` of their keys, in order). Keys are cut off in each task
    before they meet, so a noun of all rows makes no list of them."""
    one = rows.select(F.col(key).alias("_k"), F.explode(enumerated(x)).alias("noun")).distinct()
    top = one.withColumn("_p", F.row_number().over(Window.partitionBy("noun").orderBy("_k"))).filter(F.col("_p") <= shown)
    lists = top.groupBy("noun").agg(F.sort_array(F.collect_list("_k")).alias("rows"))
    return one.groupBy("noun").agg(F.count(F.lit(1)).alias("n")).join(lists, "noun")


def path_metadata(path: Column) -> Column:
    """category (first part), primary (second part if there are three or more), subtopic (what lies between, joined),
    document (file name without its ending)."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.struct(
        F.get(parts, F.lit(0)).alias("category"),
        F.when(n >= 3, F.get(parts, F.lit(1))).alias("primary"),
        F.when(n > 3, F.array_join(F.slice(parts, 3, F.greatest(n - 3, F.lit(0))), "/")).otherwise("").alias("subtopic"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9]+$", "").alias("document"),
    )


def kind_of(name: Column, rules: tuple[tuple[str, str], ...] = (("問答|Q&A|QA", "qa"), ("標準|準則", "standard"), ("指引|手冊|指南", "guide")), default: str = "law_text") -> Column:
    """The first rule whose pattern the file name has."""
    out = F.lit(default)
    for pattern, kind in reversed(rules):
        out = F.when(F.regexp_like(name, F.lit(pattern)), kind).otherwise(out)
    return out
