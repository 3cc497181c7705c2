"""Text quality: triggers of summaries, metrics of extracts, token containment. All JVM-side Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import single_line, trimmed, word_count, words

# Phrases that give a summary away, by reason; the first that occurs counts.
REFUSAL = (
    "as an ai", "i cannot", "i can't comply", "i must decline", "the request is not allowed",
    "как искусственный интеллект", "я не могу", "доступ к этой статье закрыт",
)
POLICY = ("usage policy", "safety policy", "guidelines", "openai policy", "anthropic policy")
GENERIC = ("this article discusses", "the content provides", "the text covers")
META = ("for more information", "see the original article", "read the original article")
CONTENT_FREE = ("no additional information", "information not provided")
APOLOGY = ("i'm sorry", "im sorry", "sorry", "apologize", "к сожалению", "извините")
INABILITY = ("i cannot", "i can't", "cannot", "can't", "unable to", "я не могу", "мы не можем", "не буду", "не сможем")
INSTRUCTION_STRONG = (
    "я твой переводчик", "я ваш переводчик", "я буду твоим переводчиком", "я буду вашим переводчиком",
    "я являюсь твоим переводчиком", "я являюсь вашим переводчиком", "i will be your translator", "i can be your translator",
    "i will be the translator", "as your translator", "as the translator", "as your assistant", "as the assistant",
    "ignore previous instructions",
)
INSTRUCTION_WEAK = (
    "твоя задача", "ваша задача", "your task is", "ты пишешь", "вы пишете", "ты должен", "ты должна", "вы должны",
    "тебе нужно пересказать", "вам нужно пересказать", "тебе нужно перевести", "вам нужно перевести", "переведи на русский",
    "перескажи на русском", "you must summarize", "you should summarize", "you need to summarize", "you must translate",
    "you should translate", "you need to translate", "i will help you translate", "i can help you translate",
    "i will help you summarize", "i can help you summarize", "я помогу тебе перевести", "я помогу вам перевести",
    "я помогу тебе пересказать", "я помогу вам пересказать", "я могу тебе перевести", "я могу вам перевести",
)
#: How bad a reason is when two attempts are compared; 100 for others.
WEIGHTS = {
    "empty": 1000, "refusal": 800, "policy": 800, "content_free": 700, "artifact": 600, "prompt_instructions": 600,
    "low_cyrillic_ratio": 500, "url_encoded_noise": 400, "bare_bullets": 300, "repetition_run": 300, "low_unique_ratio": 250,
    "contains_url": 200, "latin_prose": 150, "numeric_headings": 150, "generic": 100, "meta_instructions": 100,
    "too_short": 75, "too_few_words": 50, "bullets_only": 50,
}
#: Reasons that keep a summary from being published.
DROP = (
    "empty", "too_short", "too_few_words", "refusal", "apology", "policy", "artifact", "bullets_only", "meta_instructions",
    "redirects_to_article", "content_free", "repetition_run", "low_unique_ratio", "url_encoded_noise",
)
#: Reasons that insight texts are held to.
INSIGHT_REASONS = ("policy", "prompt_instructions", "refusal")


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | text.contains(phrase)
    return hit


def longest_run(items: Column) -> Column:
    """The longest run of equal neighbours in an array."""
    zero = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["prev"].eqNullSafe(x), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(items, zero, step, lambda acc: acc["best"])


def instruction_score(low: Column) -> Column:
    """2 for a strong phrase, 1 for each weak one up to 2 in all of those."""

    def score(padded: Column) -> Column:
        weak = sum((padded.contains(f" {p} ").cast("int") for p in INSTRUCTION_WEAK), F.lit(0))
        return F.when(any_of(padded, tuple(f" {p} " for p in INSTRUCTION_STRONG)), F.lit(2)).otherwise(F.lit(0)) + F.least(weak, F.lit(2))

    longest = tuple(sorted({max(p.split(), key=len) for p in INSTRUCTION_STRONG + INSTRUCTION_WEAK}))  # no phrase without its longest word
    scored = let(F.concat(F.lit(" "), single_line(F.regexp_replace(low, r"[^\s\x{00A0}\x{FEFF}\p{L}\p{N}]", " ")), F.lit(" ")), score)
    return F.when(any_of(low, longest), scored).otherwise(F.lit(0))


def cyrillic_ratio(text: Column) -> Column:
    """Cyrillic letters among Cyrillic and Latin ones outside code; 1 without any."""
    prose = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^\n\r`]*`", " ")
    cyrillic, latin = (F.regexp_count(prose, F.lit(rf"\p{{Is{s}}}")) for s in ("Cyrillic", "Latin"))
    return F.when(cyrillic + latin > 0, cyrillic / (cyrillic + latin)).otherwise(F.lit(1.0))


def apology_refusal(low: Column) -> Column:
    """An apology and an inability in one sentence; only texts with both are split."""
    in_one = F.exists(F.split(low, r"[\n!.;?]+"), lambda s: any_of(s, APOLOGY) & any_of(s, INABILITY))
    return F.when(any_of(low, APOLOGY), F.when(any_of(low, INABILITY), in_one).otherwise(F.lit(False))).otherwise(F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def triggers(text: Column, kind: str = "post", least_chars: int = 120, language_flags: tuple[Column, Column] | None = None) -> Column:
    """Reasons against a summary in their fixed order; a reason may come twice. language_flags: low ratio and Latin prose, for Russian texts."""
    reason = lambda cond, name: F.when(cond, F.lit(name))

    def of_parts(v: Column) -> Column:
        s, low, w, lines = v["s"], v["low"], v["w"], v["lines"]
        stripped = F.transform(lines, trimmed)
        return F.struct(
            F.size(w).alias("n"),
            F.length(s).alias("chars"),
            F.size(lines).alias("n_lines"),
            F.regexp_count(s, F.lit("(?i)%[0-9a-f]{2}")).alias("percent"),
            F.size(F.filter(stripped, lambda x: x.rlike(r"^\\?[-–—•]{1,4}$"))).alias("bare"),
            F.size(F.filter(stripped, lambda x: x.rlike(r"^#+\s*[0-9./\- \t]*[0-9][0-9./\- \t]*$"))).alias("heading"),
            F.size(F.filter(stripped, lambda x: x != "")).alias("content"),
            F.when(F.size(w) >= 20, F.array_join(w, " ").rlike(r"(?:^| )([^ ]++)(?: \1){7}(?: |$)")).alias("runs"),
            F.when(F.size(w) >= 80, F.size(F.array_distinct(w))).alias("distinct"),
        )

    def reasons(v: Column, m: Column) -> Column:
        s, low = v["s"], v["low"]
        found = [
            reason(m["chars"] < least_chars, "too_short"),
            reason(m["n"] < 25, "too_few_words"),
            reason(F.forall(v["lines"], lambda x: F.ltrim(x).startswith("- ")) if kind != "comments" else F.lit(False), "bullets_only"),
            reason(any_of(low, REFUSAL), "refusal"),
            reason(apology_refusal(low), "refusal"),
            reason(any_of(low, POLICY), "policy"),
            reason(any_of(low, GENERIC), "generic"),
            reason(any_of(low, META), "meta_instructions"),
            reason(any_of(low, CONTENT_FREE), "content_free"),
            reason(s.contains("<|"), "artifact"),
            reason(s.contains("```"), "artifact"),
            reason(s.startswith("{") | s.startswith("["), "artifact"),
            reason(low.contains("http://") | low.contains("https://"), "contains_url"),
            reason(m["runs"], "repetition_run"),
            reason(m["distinct"] / m["n"] < 0.2, "low_unique_ratio"),
            reason((m["percent"] >= 8) & (m["percent"] / m["chars"] >= 0.05), "url_encoded_noise"),
            reason((m["bare"] >= 10) & (m["bare"] / m["n_lines"] >= 0.9), "bare_bullets"),
            reason(instruction_score(low) >= 2, "prompt_instructions"),
            reason((m["heading"] >= 3) & (m["content"] > 0) & (m["heading"] / m["content"] >= 0.8), "numeric_headings"),
        ]
        if language_flags is not None:
            found += [reason(language_flags[0], "low_cyrillic_ratio"), reason(language_flags[1], "latin_prose")]
        return F.array_compact(F.array(*found))

    def of_text(s: Column) -> Column:
        parts = F.struct(s.alias("s"), F.lower(s).alias("low"), words(F.lower(s)).alias("w"), F.split(s, r"\r?\n").alias("lines"))
        checked = let(parts, lambda v: let(of_parts(v), lambda m: reasons(v, m)))
        return F.when(s == "", F.array(F.lit("empty"))).otherwise(checked)

    return let(trimmed(F.coalesce(text, F.lit(""))), of_text)


def drops(reasons: Column) -> Column:
    return F.arrays_overlap(reasons, F.array(*map(F.lit, DROP)))


def rejection_score(reasons: Column) -> Column:
    weight = lambda r: F.coalesce(*(F.when(r == k, F.lit(v)) for k, v in WEIGHTS.items()), F.lit(100))
    return F.aggregate(reasons, F.lit(0), lambda acc, r: acc + weight(r))


def insight_triggers(text: Column, least_ratio: float | None = None) -> Column:
    """Only the reasons that insight texts are held to, and with least_ratio the share of Cyrillic."""
    base = F.filter(triggers(text, kind="comments", least_chars=0), lambda r: r.isin(*INSIGHT_REASONS))
    if least_ratio is None:
        return base
    return F.concat(base, F.when(cyrillic_ratio(text) < least_ratio, F.array(F.lit("low_cyrillic_ratio"))).otherwise(F.array().cast("array<string>")))


#: Scripts written without blanks between words: Thai, kana, ideographs, Hangul.
NO_SPACE = r"[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"


def extract_metrics(markdown: Column) -> Column:
    """struct(prose_chars, link_density, dup_ratio, phrase_dup_ratio, word_count, lines) of an article extract."""
    dup = lambda xs: F.when(F.size(xs) > 0, 1 - F.size(F.array_distinct(xs)) / F.size(xs)).otherwise(F.lit(0.0))

    def measured(x: Column) -> Column:
        return let(F.regexp_count(x, F.lit(NO_SPACE)), lambda k: F.struct(x.alias("x"), k.alias("k"), (word_count(x) + F.ceil(k / 2).cast("int")).alias("n")))

    def of_parts(v: Column) -> Column:
        total = F.aggregate(v["lines"], F.lit(0), lambda acc, r: acc + r["n"])
        prose = F.aggregate(v["lines"], F.lit(0), lambda acc, r: acc + F.when((r["n"] >= 12) & ~r["x"].rlike("^[#>|]"), F.length(r["x"]) + r["k"] * 2).otherwise(0))
        links = F.size(F.split(v["md"], r"\]\(", -1)) - 1
        return let(
            total,
            lambda n: F.struct(
                prose.alias("prose_chars"),
                F.when(n > 0, links / n).when(links > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("link_density"),
                dup(F.transform(v["lines"], lambda r: r["x"])).alias("dup_ratio"),
                dup(v["phrases"]).alias("phrase_dup_ratio"),
                n.alias("word_count"),
                F.size(v["lines"]).alias("lines"),
            ),
        )

    lines = F.transform(F.filter(F.transform(F.split(markdown, "\n"), trimmed), lambda x: x != ""), measured)
    # a phrase can only start where a run of other signs starts; saying so keeps runs without an end from being tried at every place
    phrase = r"(?<![^.!?…\n])[^.!?…\n]++[.!?…]+"
    found = F.transform(F.regexp_extract_all(F.regexp_replace(markdown, "(?m)^#.*$", " "), F.lit(phrase), F.lit(0)), trimmed)
    phrases = F.filter(found, lambda p: word_count(p) >= 5)
    return let(F.struct(markdown.alias("md"), lines.alias("lines"), phrases.alias("phrases")), of_parts)


def is_article(metrics: Column, least_prose: int = 500, most_links: float = 0.5, most_dup: float = 0.5) -> Column:
    return (metrics["prose_chars"] >= least_prose) & (metrics["link_density"] <= most_links) & (metrics["dup_ratio"] <= most_dup) & (metrics["phrase_dup_ratio"] <= most_dup)


# Words without weight in comparisons.
STOP_WORDS = (
    "это", "как", "для", "что", "или", "при", "они", "она", "он", "мы", "вы", "их", "его", "её", "ее", "так", "там", "тут",
    "уже", "ещё", "еще", "все", "всё", "без", "над", "под", "про", "чем", "кто", "где", "когда", "если", "тоже", "только",
    "можно", "нужно", "есть", "был", "была", "были", "быть", "этот", "эта", "эти", "такой", "такая", "такие", "таких", "того",
    "тому", "том", "тем", "те", "той", "то",
    "the", "and", "for", "with", "that", "this", "they", "them", "their", "from", "into", "about", "have", "has", "had", "are",
    "was", "were", "been", "being", "will", "would", "could", "should", "can", "not", "but", "you", "your", "our", "out", "any",
    "all", "more", "most", "than", "then", "there", "here", "when", "where", "which", "who", "what", "how", "why",
)


def stems(text: Column) -> Column:
    """The set of a text's stems: words of 3 letters or more that have weight, cut to 6. Text is taken as NFKC."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s\x{00A0}\x{FEFF}]+", " ")
    kept = F.filter(words(plain), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda t: F.substring(t, 1, 6)))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set of stems that is in the other; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def survivors(headline: Column, texts: Column, threshold: float = 0.7) -> Column:
    """Positions of texts that repeat neither the headline nor an earlier text that stays; texts and headline are sets of stems."""
    zero = F.struct(F.array().cast("array<array<string>>").alias("sets"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, s: Column) -> Column:
        repeats = (containment(s, headline) >= threshold) | F.exists(acc["sets"], lambda k: containment(s, k) >= threshold)
        sets = F.when(repeats, acc["sets"]).otherwise(F.concat(acc["sets"], F.array(s)))
        at = F.when(repeats, acc["at"]).otherwise(F.concat(acc["at"], F.array(acc["i"])))
        return F.struct(sets.alias("sets"), at.alias("at"), (acc["i"] + 1).alias("i"))

    return F.aggregate(texts, zero, step, lambda acc: acc["at"])


def compressed_verdict(text: Column, source: Column, least_chars: int = 200, least_ratio: float | None = None) -> Column:
    """Why a compressed paragraph doesn't do: a name, or all triggers joined by commas; or ok."""
    text = trimmed(F.coalesce(text, F.lit("")))
    reasons = triggers(text, kind="comments", least_chars=least_chars)
    ratio = F.lit(False) if least_ratio is None else cyrillic_ratio(text) < least_ratio
    return (
        F.when(text == "", F.lit("empty"))
        .when(F.length(text) < least_chars, F.lit("too_short"))
        .when(F.length(text) > F.length(source), F.lit("expanded"))
        .when(ratio, F.lit("low_cyrillic_ratio"))
        .when(F.size(reasons) > 0, F.array_join(reasons, ","))
        .otherwise(F.lit("ok"))
    )
