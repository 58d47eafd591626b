"""Rules over text: intent routing, filter inference, risk lexicons, verdicts, refusals, budgets. Lexicons are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound, split_questions, strip


def any_of(x: Column, words: tuple[str, ...]) -> Column:
    """Whether the text has one of the words; false for null or no words."""
    if not words:
        return F.lit(False)
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w)), F.lit(False))


@dataclass(frozen=True)
class Cues:
    """The word lists of the router. The defaults are fixed values, in Chinese; pass others for other languages."""

    case: tuple[str, ...] = ("案例", "被罰", "罰過", "紀錄", "實際罰", "開罰過", "處分過", "有沒有人", "有人因")
    amount_only: str = "被罰"
    amount: str = "罰多少|多少錢|罰鍰多少|罰金多少|罰款多少"
    penalty: tuple[str, ...] = ("罰款", "罰鍰", "裁罰", "裁處", "處分", "罰則", "罰多少", "開罰")
    rule: tuple[str, ...] = ("哪條", "哪一條", "哪些規定", "違反", "法源", "規定", "法規", "合法", "合不合法", "怎麼標", "如何標", "差在哪", "上限")
    weak: tuple[str, ...] = ("可以嗎", "需要", "要不要", "算不算", "算是", "是否", "嗎", "呢")
    related: tuple[str, ...] = ("一起被引用", "一起引用", "關聯條文", "關聯法條", "有關聯", "哪些條文", "有關的條文", "相關條文", "相關的條文", "其他條文", "連動", "常跟哪", "常常跟")
    review: tuple[str, ...] = ("幫我審", "審稿", "審查這", "這段文案", "這樣寫", "文案可以", "可以這樣寫", "這句話", "這句放", "這句可以", "幫我看這", "檢查這段", "這則廣告", "放在包裝上", "放在網頁", "放在網站")
    #: Where a question is cut into several, and the mark a question must have. The full-width mark counts as well.
    split: str = "[?？]+"
    asks: tuple[str, ...] = ("?", "？")


def route(q: Column, cues: Cues = Cues()) -> Column:  # noqa: B008
    """multi_hop, ad_review, regulation_qa, or null where the rules do not decide. First rule that holds."""
    x = strip(q)
    plain = tuple(w for w in cues.case if w != cues.amount_only)
    case = any_of(x, plain) | (any_of(x, (cues.amount_only,) if cues.amount_only else ()) & ~F.regexp_like(x, F.lit(cues.amount or "$^")))
    penalty, rule, weak = any_of(x, cues.penalty), any_of(x, cues.rule), any_of(x, cues.weak)
    parts = split_questions(x, cues.split)
    pure = lambda p: ~any_of(p, (*cues.case, *cues.penalty, *cues.related)) & any_of(p, (*cues.rule, *cues.weak))
    return (
        F.when(any_of(x, cues.related), "multi_hop")
        .when(case & rule, "multi_hop")
        .when(any_of(x, cues.review), "ad_review")
        .when(F.size(parts) >= 2, F.when(F.forall(parts, pure), "regulation_qa"))
        .when(case | penalty, F.lit(None).cast("string"))
        .when((rule | weak) & any_of(x, cues.asks), "regulation_qa")
    )


def routed(q: Column, model: Column, cues: Cues = Cues(), default: str = "regulation_qa", intents: tuple[str, ...] = ("regulation_qa", "case_lookup", "ad_review", "multi_hop")) -> Column:  # noqa: B008
    """struct(intent, source): the rules, else a model's answer if it is a known intent, else the default."""
    by_rule, ok = route(q, cues), F.coalesce(model.isin(*intents), F.lit(False))
    return F.struct(
        F.coalesce(by_rule, F.when(ok, model), F.lit(default)).alias("intent"),
        F.when(by_rule.isNotNull(), "rules").when(ok, "llm").otherwise("fallback").alias("source"),
    )


def inferred_filter(q: Column, ad: tuple[str, ...], claim: tuple[str, ...], label: tuple[str, ...], law: str) -> Column:
    """The law to search: `law` for advertising or claims unless labels are meant too; else null."""
    wanted = any_of(q, ad) | any_of(q, claim)
    return F.when(wanted & ~any_of(q, label), law)


@dataclass(frozen=True)
class Lexicon:
    """Risk terms by category; `level` orders the categories."""

    terms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    level: dict[str, int] = field(default_factory=dict)


def lexicon_scan(x: Column, lexicon: Lexicon) -> Column:
    """struct(category -> distinct terms in lexicon order)."""
    hits = lambda words: F.filter(F.array(*[F.lit(w) for w in dict.fromkeys(words)]), lambda w: F.contains(x, w))
    return F.struct(*[hits(words).alias(name) for name, words in lexicon.terms.items()])


LEVELS = ("low", "medium", "high")


def verdict(matched: Column, lexicon: Lexicon, report: Column, white: Column) -> Column:
    """The higher of keyword level and report level on low < medium < high. Text on the white list goes from medium to
    low, but only where no keyword is hit. An unknown report level counts as low."""
    by_words = F.greatest(F.lit(0), *[F.when(F.size(matched[c]) > 0, lvl).otherwise(0) for c, lvl in lexicon.level.items()], F.lit(0))
    by_report = F.when(report == "high", 2).when(report == "medium", 1).otherwise(0)
    both = F.greatest(by_words, by_report)
    none = F.forall(F.array(*[F.size(matched[c]) for c in lexicon.terms]), lambda n: n == 0)
    both = F.when((both == 1) & none & white, 0).otherwise(both)
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), both.cast("int") + 1)


# The sentence of a full refusal, and cues of a refusing sentence.
REFUSAL = "目前資料庫裡沒有找到足夠可信的法規依據可以回答這個問題,建議換個問法,或直接洽詢主管機關確認。"
REFUSAL_CUES = (
    "沒有找到足夠可信", "沒有找到", "未找到", "無法回答", "沒有相關", "無相關", "找不到相關", "不足以回答", "建議洽詢", "沒有足夠", "無法提供", "不在資料庫", "資料庫裡沒有", "查無",
)


def refused(answer: Column, sentence: str = REFUSAL, cues: tuple[str, ...] = REFUSAL_CUES, ends: str = "[。\n]", prefix: int = 14) -> Column:
    """The sentence itself, its first `prefix` characters at the beginning, or a cue in every sentence. A text without
    sentences is no refusal."""
    def of(a: Column) -> Column:
        parts = F.filter(F.transform(F.split(a, ends), strip), lambda s: s != "")
        every = bound(parts, lambda p: (F.size(p) > 0) & F.forall(p, lambda s: any_of(s, cues)))
        return (a == sentence) | F.startswith(a, F.lit(sentence[:prefix])) | every

    return F.coalesce(bound(strip(answer), of), F.lit(False))


def verdict_line(report: Column) -> Column:
    """low, medium or high from a line like "VERDICT: 高風險" (or high), however it is punctuated; else null."""
    found = F.lower(F.regexp_extract(report, r"(?i)VERDICT\s*[:：]?\s*\**\s*(高風險|有疑慮|合規|low|medium|high)", 1))
    return F.when(found.isin("高風險", "high"), "high").when(found.isin("有疑慮", "medium"), "medium").when(found.isin("合規", "low"), "low")


def without_verdict(report: Column) -> Column:
    """The report without the verdict line at its end."""
    return strip(F.regexp_replace(report, r"(?i)\n*\**VERDICT\**\s*[:：]?\s*\**\s*(高風險|有疑慮|合規|low|medium|high)\**\s*$", ""))


def report_level(report: Column, high: tuple[str, ...], medium: tuple[str, ...]) -> Column:
    """The verdict line's level, else what the report's words show, else low."""
    return F.coalesce(verdict_line(report), F.when(any_of(report, high), "high").when(any_of(report, medium), "medium").otherwise("low"))


def wants_cases(q: Column, words: tuple[str, ...]) -> Column:
    """Whether a question also asks for cases."""
    return any_of(q, words)


def over_budget(calls: Column, tokens: Column, seconds: Column, most_calls: int = 4, most_tokens: int = 12_000, most_seconds: float = 90.0) -> Column:
    """The first budget that is used up: tool_calls, tokens, seconds; else null."""
    return F.when(calls >= most_calls, "tool_calls").when(tokens >= most_tokens, "tokens").when(seconds >= most_seconds, "seconds")


def evidence_text(prompt: Column, markers: tuple[str, ...], most: int = 300) -> Column:
    """What follows the first marker of the list that the text has (list order, not place), cut to `most` characters."""
    after = lambda m: F.when(F.contains(prompt, F.lit(m)), strip(F.substr(prompt, F.instr(prompt, m) + len(m))))
    found = F.coalesce(*[after(m) for m in markers], strip(prompt))
    return F.when(F.length(found) > most, F.concat(F.substring(found, 1, most), F.lit("..."))).otherwise(found)
