"""Text as Columns, with the string semantics of the web runtime the data comes from.

Blanks are the ECMAScript set, word boundaries and word characters are ASCII, lengths count code
points. Everything here stays in generated JVM code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript white space, as the inside of a character class.
WS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
W = "[A-Za-z0-9_]"
BLANKS = f"[{WS}]+"


#: The same set as characters, for trimming without a regex.
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def single_line(text: Column) -> Column:
    """Blanks collapse to one space; none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS}]+"))


def clamp(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def bounded(alternatives: list[str]) -> str:
    """A regex for any alternative between ASCII word boundaries. An end that isn't a word character has its boundary before one."""
    parts = [a + (f"(?!{W})" if a[-1].isalnum() or a[-1] in "?d)" else f"(?={W})") for a in alternatives]
    return f"(?i)(?<!{W})(?:{'|'.join(parts)})"


def slugify(name: Column) -> Column:
    s = F.regexp_replace(F.lower(trimmed(name)), "['’]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^0-9#+\-.a-z]+", "-"), "-+", "-")
    return F.regexp_replace(s, "^-|-$", "")


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


#: The signs that Markdown text escapes, the backslash first.
MARKDOWN_SIGNS = "\\`*_[]{}<>#+-|!"


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]{}<>#+\-|!])", r"\\$1")


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL without a leading www.; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", F.regexp_replace(found, r"^www\.", ""))


def http_url(url: Column) -> Column:
    return F.when(url.rlike(r"^(?i:https?)://[^/?#\s]+"), url)


def safe_http_url(url: Column, longest: int = 2000) -> Column:
    """An http(s) URL without credentials whose escaped form isn't too long; else null."""
    fine = http_url(url).isNotNull() & ~url.rlike(r"^[A-Za-z]+://[^/?#]*@") & (F.length(escape_html(url)) <= longest)
    return F.when(fine, url)


def head_tail(text: Column, whole: int, head: int, tail: int) -> Column:
    """The text if it has at most `whole` characters, else its head and tail around a mark."""
    cut = F.concat(F.substring(text, 1, head), F.lit("\n\n[…]\n\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= whole, text).otherwise(cut)


def video_id(url: Column) -> Column:
    """The video of a watch, embed, shorts or short-link URL; null for others."""
    site = F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^(?i:https?)://[^/?#]+(/[^?#]*)", 1)
    query = F.regexp_extract(url, r"\?(?:[^#]*&)?v=([^&#]*)", 1)
    long = F.when(path.startswith("/watch"), query).when(path.rlike("^/(?:embed|shorts)/"), F.regexp_extract(path, "^/(?:embed|shorts)/([^/]*)", 1))
    return F.nullif(F.when(site == "youtu.be", F.substring(path, F.lit(2), F.length(path))).when(site.endswith("youtube.com"), long), F.lit(""))


def strip_json_fence(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(text), r"^```(?i:json)?\s*", ""), r"\s*```$", ""))


def peel_quotes(text: Column) -> Column:
    """Without one outer pair of quotes, where no such quote is inside."""
    return trimmed(F.regexp_replace(trimmed(text), r"""(?s)^(?:"([^"]*)"|«([^«»]*)»|'([^']*)')$""", "$1$2$3"))


def clean_model_output(text: Column) -> Column:
    """A one-paragraph answer without fence, outer quotes (inside and outside a label) and label; ends repaired."""
    text = trimmed(F.regexp_replace(trimmed(text), r"(?s)^```(?:[A-Za-z0-9_]+)?\s*\n?(.*?)\n?```$", "$1"))
    text = peel_quotes(text)
    for label in (r"итоговый\s+текст", "итог"):  # fixed values: labels of results
        text = F.regexp_replace(text, rf"(?iu)^\*{{0,2}}_{{0,2}}{label}\*{{0,2}}_{{0,2}}\s*[:—-]\s*", "")
    return clamp_clause(single_line(peel_quotes(text)))


def right_trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def clamp_clause(text: Column) -> Column:
    """As it is if it ends a sentence; else up to the last sentence's end (from 20 characters on), else without its last word, marked."""
    text = right_trimmed(text)
    clean = text.rlike(r"""[.!?…]["'»”)\]]*$""") | (text == "")
    sentence = F.regexp_extract(text, r"""(?s)^(.*[.!?…]["'»”)\]]*)""", 1)
    without = right_trimmed(F.regexp_replace(text, r"\s+\S*$", ""))
    marked = F.concat(F.when(F.length(without) >= 20, without).otherwise(text), F.lit("…"))
    return F.when(clean, text).when(F.length(sentence) >= 20, sentence).otherwise(marked)


def clamp_display(text: Column, most: int) -> Column:
    """Cut at `most` characters, at the last space if 20 are left then, and marked."""
    text = right_trimmed(text)
    cut = F.substring(text, 1, most)
    at_space = right_trimmed(F.regexp_extract(cut, r"(?s)^(.*) ", 1))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(F.length(at_space) >= 20, at_space).otherwise(right_trimmed(cut)), F.lit("…")))


def strip_inline_markdown(text: Column) -> Column:
    text = F.regexp_replace(text, r"!\[([^\n\]]{0,500})\]\([^\n)]{0,2000}\)", "$1")
    text = F.regexp_replace(text, r"\[([^\n\]]{1,500})\]\([^\n)]{0,2000}\)", "$1")
    text = F.regexp_replace(text, r"(?<!\\)(?:\*\*|__|~~|`+)", "")
    text = F.regexp_replace(text, r"(?<!\\)[*_]", "")
    return single_line(F.regexp_replace(text, r"\\([^\s\p{L}\p{N}])", "$1"))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(right_trimmed(F.substring(text, 1, most - 1)), F.lit("…")))


def teaser(markdown: Column, most: int = 200) -> Column:
    """The first bullet's plain text, cut to length; empty if there is none."""
    lines = F.transform(F.split(trimmed(F.regexp_replace(markdown, r"\r\n?", "\n")), "\n"), trimmed)
    bullets = F.filter(lines, lambda s: s.rlike(r"^(?:[-+*] |[0-9]{1,6}[).] )"))
    plain = F.filter(F.transform(bullets, lambda s: strip_inline_markdown(F.regexp_replace(s, r"^(?:[-+*] |[0-9]{1,6}[).] )", ""))), lambda s: s != "")
    return F.coalesce(truncate(F.get(plain, F.lit(0)), most), F.lit(""))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, as a non-negative long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def token_estimate(text: Column) -> Column:
    return (F.ceil(F.length(text) / 4) + 600).cast("long")


# What a page or file is, by its type, name and first bytes


def looks_like_pdf(content_type: Column, url: Column, body: Column) -> Column:
    hits = (content_type.contains("application/pdf"), F.lower(url).endswith(".pdf"), body.startswith("%PDF"))
    return F.greatest(*(F.coalesce(h, F.lit(False)) for h in hits))


def looks_like_html(content_type: Column) -> Column:
    return F.coalesce(content_type.contains("text/html") | content_type.contains("+html"), F.lit(False))


#: What challenge pages of protected sites contain, in lower case.
CHALLENGE_MARKERS = (
    "challenges.cloudflare.com", "cdn-cgi/challenge-platform", "cf-browser-verification", "cf-challenge",
    "attention required! | cloudflare", "<title>just a moment", "<title>just a moment...",
    "enable javascript and cookies to continue", "checking your browser before accessing",
)


def is_challenge(page: Column) -> Column:
    low = F.lower(page)
    return F.coalesce(low.rlike("|".join(map(re.escape, CHALLENGE_MARKERS))), F.lit(False))


def challenge_error(status: Column, page: Column) -> Column:
    """A refusal by a challenge: 403 always; 503 or no status if the page shows a marker."""
    return F.coalesce(status == 403, F.lit(False)) | (F.coalesce(status == 503, F.lit(True)) & is_challenge(page))


# Captions


def vtt_text(vtt: Column) -> Column:
    kept = F.filter(F.split(vtt, "\n"), lambda s: ~s.startswith("WEBVTT") & ~s.contains("-->") & (trimmed(s) != "") & ~s.rlike("^[0-9]+$"))
    return single_line(F.array_join(kept, " "))


def caption_xml_text(xml: Column) -> Column:
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<text[^>]*>(.*?)</text>"), F.lit(1))
    return single_line(F.array_join(found, " "))


def caption_json_text(body: Column) -> Column:
    parsed = F.from_json(body, "events array<struct<segs array<struct<utf8 string>>>>")
    segs = F.flatten(F.transform(parsed["events"], lambda e: F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>"))))
    return single_line(F.array_join(F.transform(segs, lambda s: s["utf8"]), ""))
