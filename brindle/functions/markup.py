"""Markup to text and back: parsers that no Column expression can stand for, over Arrow batches.

html_plain keeps paragraphs and bullets of comment markup; page_markdown extracts the article of a page;
markdown_html renders safe HTML; chunks and messages cut texts for chat messages.
"""

from __future__ import annotations

import html as entities
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(f: Callable, kind: str, *columns: Column) -> Column:
    """f over rows, a batch at a time; a null first argument gives null."""

    if len(columns) == 1:

        @F.pandas_udf(kind)
        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda x: None if x is None else f(x))

        return one(*columns)

    @F.pandas_udf(kind)
    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x[0] is None else f(*x) for x in zip(*batch)], dtype=object)

    return many(*columns)


#: What an opening tag without attributes puts into plain text; other tags put nothing. A paragraph's break is marked until lines are done.
PARAGRAPH = "\u0002"
OPENS = {"br": "\n", "li": "\n• ", "ul": PARAGRAPH}
TAG = re.compile(r"<([^>]*)>")
FIRST_WORDS = re.compile(r"(?<=[A-Za-z0-9_])\s+(?=[A-Za-z0-9_])")


def _pieces(markup: str) -> Iterator[str]:
    """Texts between tags and what the tags put there. A list or paragraph that follows one that just ended begins a paragraph."""
    at, ended, blanks = 0, None, ""  # ended: the list or paragraph that was closed; blanks: what came since, if it is blank
    for tag in TAG.finditer(markup):
        text, name = markup[at : tag.start()], tag[1].lower()
        name = "br" if re.fullmatch(r"br\s*/?", name) else name
        at = tag.end()
        if ended and not text.strip() and name == ended:
            yield PARAGRAPH
            ended, blanks = None, ""
        elif ended and not text.strip() and name == "br":
            blanks += text + OPENS[name]
        else:
            yield blanks + text + OPENS.get(name, "")
            ended, blanks = name[1:] if name in ("/p", "/ul") else None, ""
    yield blanks + markup[at:]


def html_plain(markup: str, most: int = 20_000) -> str:
    """Plain text of comment markup: paragraphs a blank line apart, list items as bullets, the first two words of a line kept together."""

    def together(line: str) -> str:
        return line if line.lstrip().startswith("• ") else FIRST_WORDS.sub("\u00a0", line, count=1)

    text = entities.unescape("".join(_pieces(markup[:most])))
    text = "\n".join(map(together, text.split("\n"))).replace(PARAGRAPH, "\n\n")
    return re.sub(r"\n{3,}", "\n\n", text).strip()


class _Page(HTMLParser):
    """Blocks of a page, with the depth of its article; navigation and scripts are left out."""

    SKIP = frozenset({"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "template", "svg", "button"})
    BLOCKS = frozenset({"p", "div", "section", "article", "main", "li", "ul", "ol", "blockquote", "pre", "table", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.whole, self.article = "", [], []
        self.skip = self.inside = 0
        self.in_title, self.link = False, None

    def put(self, s: str) -> None:
        if self.skip:
            return
        self.whole.append(s)
        if self.inside:
            self.article.append(s)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in ("article", "main"):
            self.inside += 1
        if tag in self.BLOCKS:
            self.put("\n\n" if tag not in ("br", "li", "tr") else "\n")
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.put("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.put("- ")
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("_")
        elif tag == "code":
            self.put("`")
        elif tag == "a":
            self.link = dict(attrs).get("href")
            self.put("[" if self.link else "")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("_")
        elif tag == "code":
            self.put("`")
        elif tag == "a" and self.link:
            self.put(f"]({self.link})")
            self.link = None
        if tag in self.BLOCKS:
            self.put("\n\n" if tag not in ("br", "li", "tr") else "\n")
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("article", "main"):
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        else:
            self.put(re.sub(r"\s+", " ", data))


def _tidy(parts: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parts))).strip()


def page_markdown(page: str, least: int = 200) -> str:
    """The page's article under its title, if it has `least` characters; else the whole page."""
    parser = _Page()
    parser.feed(page)
    parser.close()
    article, title = _tidy(parser.article), " ".join(parser.title.split())
    if len(article) >= least:
        return f"# {title}\n\n{article}" if title else article
    return _tidy(parser.whole)


def markdown_html(markdown: str) -> str:
    """HTML of headings, bullets, quotes, emphasis, code and http(s) links; everything else is escaped."""

    def inline(s: str) -> str:
        s = entities.escape(s, quote=True)
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        s = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", s)
        s = re.sub(r"(?<![\w*])[*_]([^*_]+)[*_](?![\w*])", r"<em>\1</em>", s)
        return re.sub(r"\[([^\]]+)\]\((https?://[^\s)]+)\)", r'<a href="\2" rel="noopener nofollow">\1</a>', s)

    out, items = [], []
    for block in re.split(r"\n\s*\n", markdown.strip()):
        lines, fence = block.split("\n"), block.startswith("```")
        if fence:
            out.append("<pre><code>" + entities.escape("\n".join(lines[1:]).removesuffix("```").rstrip("\n")) + "</code></pre>")
        elif all(re.match(r"[-*+] ", x) for x in lines):
            items = "".join(f"<li>{inline(x[2:])}</li>" for x in lines)
            out.append(f"<ul>{items}</ul>")
        elif m := re.match(r"(#{1,6}) (.*)", block):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif block.startswith("> "):
            out.append("<blockquote>" + inline(" ".join(x.removeprefix("> ") for x in lines)) + "</blockquote>")
        elif block:
            out.append(f"<p>{inline(block)}</p>".replace("\n", "<br>"))
    return "\n".join(out)


#: Fixed value: a token that a model may leave in its text.
ARTIFACT = "<｜begin▁of▁sentence｜>"


def tidy_model_text(text: str) -> str:
    """Without artifacts; outside code fences more than two trailing blanks become two."""
    text = re.sub(r"\r\n?", "\n", text).replace(ARTIFACT, "")
    out, fenced = [], False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        out.append(line if fenced else re.sub(r"[ \t]{3,}$", "  ", line))
    return "\n".join(out).strip()


def chunks(text: str, limit: int = 4096) -> list[str]:
    """Pieces of at most `limit` characters: cut after a blank line past 70 % of it, a line past 80 %, a word past 90 %, else anywhere."""
    out = []
    while len(text) > limit:
        cut = limit
        for mark, share in (("\n\n", 0.7), ("\n", 0.8), (" ", 0.9)):
            at = text.rfind(mark, 0, limit - 1 + len(mark))
            if at > limit * share:
                cut = at + len(mark)
                break
        out.append(text[:cut])
        text = text[cut:]
    return out + [text] if text or not out else out


def fit_escaped(text: str, budget: int) -> str:
    """The longest start of a text whose escaped form, with an ellipsis if it was cut, takes at most `budget` characters."""
    if len(entities.escape(text)) <= budget:
        return text
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        if len(entities.escape(text[:mid].rstrip())) + 1 <= budget:
            low = mid
        else:
            high = mid - 1
    return text[:low].rstrip() + "…" if low and budget > 0 else ""


def message(title: str, url: str, summary: str, teaser: str, limit: int = 4096) -> str:
    """A chat message: linked title, summary, the comments' teaser; the summary gives way to the limit."""
    head = f'<b><a href="{entities.escape(url)}">{entities.escape(title)}</a></b>'
    tail = f"\n\n💬 {entities.escape(teaser)}" if teaser else ""
    body = fit_escaped(summary, limit - len(head) - len(tail) - 2)
    return head + (f"\n\n{entities.escape(body)}" if body else "") + tail


def first_object(text: str) -> str | None:
    """The first balanced JSON object in a text, strings and escapes respected."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, k = 0, False, start
        while k < len(text):
            c = text[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"' or text[k] != '"' if c != "\\" else True
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return text[start : k + 1]
            k += 1
        start = text.find("{", start + 1)
    return None


def valid_object(text: str) -> str | None:
    """first_object, if it parses."""
    found = first_object(text)
    try:
        return json.dumps(json.loads(found), sort_keys=True) if found else None
    except ValueError:
        return None


def nfkc(text: Column) -> Column:
    """NFKC form; plain ASCII texts, which it doesn't change, stay out of Python."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(batched(lambda s: unicodedata.normalize("NFKC", s), "string", F.when(~plain, text)))


def charset(content_type: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(content_type, "(?i)charset=([^;]+)", 1)), F.lit("")), F.lit("utf-8"))


def decode(body: Column, content_type: Column) -> Column:
    """Bytes as text in the named charset, or UTF-8 where it is unknown; bad bytes are replaced."""

    def one(data: bytes, name: str) -> str:
        try:
            return bytes(data).decode(name, "replace")
        except LookupError:
            return bytes(data).decode("utf-8", "replace")

    return batched(one, "string", body, charset(content_type))


def pdf_text(text: Column) -> Column:
    """What is done to text taken from PDF pages: nulls go, four or more line ends become three."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\u0000"), F.lit("")), "\n{4,}", "\n\n\n"))
