"""Cards of comment summaries as Markdown: lead, visible and folded insights, quote, and the card for too few comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import stems, survivors
from .text import clamp_clause, clamp_display, escape_markdown, single_line, trimmed

# Words on cards, by language.
LABELS = {
    "en": {"dispute": "Debate", "advice": "Advice", "fallback": "From the discussion", "translation": "Translation"},
    "ru": {"dispute": "Спор", "advice": "Совет", "fallback": "Из обсуждения", "translation": "Перевод"},
}
#: Insights shown before the fold, comments on the fallback card and their least length, longest quote shown.
VISIBLE, FALLBACK_COMMENTS, FALLBACK_CHARS, QUOTE_CHARS = 3, 2, 80, 300


def safe_inline(text: Column) -> Column:
    """One line with Markdown's signs escaped. Text is taken as NFKC (see markup.nfkc)."""
    return escape_markdown(single_line(text))


def safe_author(name: Column) -> Column:
    return safe_inline(F.regexp_replace(name, "^@+", ""))


def lead(bottom_line: Column) -> Column:
    text = safe_inline(clamp_clause(bottom_line))
    return F.when(text == "", F.lit("")).otherwise(F.concat(text, F.lit("\n")))


def bullet(kind: Column, text: Column, language: str = "en") -> Column:
    body = safe_inline(clamp_clause(text))
    label = lambda name: F.concat(F.lit(f"- **{LABELS[language][name]}:** "), body)
    return F.when(kind == "dispute", label("dispute")).when(kind == "advice", label("advice")).otherwise(F.concat(F.lit("- "), body))


def quote(source: Column, author: Column, translation: Column, language: str = "en") -> Column:
    shown = escape_markdown(clamp_display(trimmed(F.regexp_replace(source, r"\r\n?", "\n")), QUOTE_CHARS))
    lines = F.array_join(F.transform(F.split(shown, "\n"), lambda s: F.when(s == "", F.lit(">")).otherwise(F.concat(F.lit("> "), s))), "\n")
    signed = F.concat(lines, F.lit("\n> — @"), safe_author(author))
    told = F.coalesce(single_line(translation), F.lit("")) != ""
    added = F.concat(F.lit(f"\n\n_{LABELS[language]['translation']}:_ "), safe_inline(clamp_display(F.coalesce(translation, F.lit("")), QUOTE_CHARS)))
    return F.concat(signed, F.when(told, added).otherwise(F.lit("")))


def parts(bottom_line: Column, insights: Column, quoted: Column, language: str = "en") -> Column:
    """struct(lead, visible, folded, folded_insights, folded_quote). insights: array of (kind, text); quoted: a rendered quote or null.

    Insights that repeat the bottom line or an earlier one are left out.
    """
    kept = survivors(stems(bottom_line), F.transform(insights, lambda x: stems(x["text"])))
    bullets = F.transform(kept, lambda i: bullet(insights[i]["kind"], insights[i]["text"], language))
    block = lambda xs: F.when(F.size(xs) > 0, F.concat(F.array_join(xs, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    visible, folded = F.slice(bullets, 1, VISIBLE), F.slice(bullets, VISIBLE + 1, 100)
    chunks = F.filter(F.array(F.array_join(folded, "\n"), F.coalesce(quoted, F.lit(""))), lambda x: x != "")
    return F.struct(
        lead(bottom_line).alias("lead"),
        block(visible).alias("visible"),
        F.when(F.size(chunks) > 0, F.concat(F.array_join(chunks, "\n\n"), F.lit("\n"))).otherwise(F.lit("")).alias("folded"),
        F.size(folded).alias("folded_insights"),
        (F.coalesce(quoted, F.lit("")) != "").alias("folded_quote"),
    )


def fold_label(p: Column, language: str = "en") -> Column:
    n = p["folded_insights"].cast("string")
    if language == "ru":
        base = F.when(p["folded_insights"] == 1, F.lit("ещё 1 тезис")).otherwise(F.concat(F.lit("ещё "), n, F.lit(" тезиса")))
        with_quote = F.when(p["folded_insights"] == 0, F.lit("цитата из треда")).otherwise(F.concat(base, F.lit(" (+ цитата)")))
    else:
        base = F.concat(n, F.lit(" more takeaways"))
        with_quote = F.when(p["folded_insights"] == 0, F.lit("quote from the thread")).otherwise(F.concat(base, F.lit(" (+ quote)")))
    return F.when(p["folded_quote"], with_quote).otherwise(base)


def card(p: Column) -> Column:
    chunks = F.filter(F.transform(F.array(p["lead"], p["visible"], p["folded"]), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    return F.when(F.size(chunks) > 0, F.concat(F.array_join(chunks, "\n\n"), F.lit("\n"))).otherwise(F.lit(""))


def fallback_card(comments: Column, language: str = "en") -> Column:
    """The first two comments of substance; empty without any. comments: array of (author, text) in order."""
    kept = F.slice(F.filter(comments, lambda c: F.length(single_line(c["text"])) >= FALLBACK_CHARS), 1, FALLBACK_COMMENTS)
    lines = F.transform(kept, lambda c: F.concat(F.lit("- **@"), safe_author(c["author"]), F.lit(":** "), safe_inline(c["text"])))
    return F.when(F.size(kept) > 0, F.concat(F.lit(f"### {LABELS[language]['fallback']}\n\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def insights_text(bottom_line: Column, insights: Column) -> Column:
    """Plain text of insights, as a compression's input: the bottom line and each insight, disputes and advice named in Russian."""
    prefix = lambda k: F.when(k == "dispute", F.lit("Спор: ")).when(k == "advice", F.lit("Совет: ")).otherwise(F.lit(""))
    lines = F.concat(F.array(trimmed(bottom_line)), F.transform(insights, lambda x: F.concat(prefix(x["kind"]), trimmed(x["text"]))))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
