"""Purity of Russian summaries: shares of Cyrillic, English runs and stray English words.

Neighbouring tokens decide together and quoted parts are stripped by their length, so this is a Python
function over Arrow batches (`purity`), not a Column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names written in lower case that aren't prose.
ALLOWED = frozenset({
    "systemd", "npm", "pnpm", "yarn", "curl", "wget", "ffmpeg", "nginx", "webpack", "podman", "git", "github", "sudo",
    "bash", "zsh", "ssh", "node", "deno", "bun", "pip", "apt", "brew", "docker", "kubectl", "kubernetes", "grep", "vim",
    "neovim", "emacs", "tmux", "rsync", "jq", "sqlite", "postgres", "postgresql", "mysql", "redis", "linux", "unix",
    "macos", "ios", "android", "javascript", "typescript", "python", "rust", "golang", "kotlin", "swift", "wasm", "json",
    "yaml", "toml", "html", "css", "os", "de", "facto", "jure", "novo", "vitro", "vivo", "situ", "hoc", "ad", "priori",
    "posteriori", "versus", "vs",
})
# English function words.
FUNCTION_WORDS = frozenset({
    "the", "a", "an", "and", "or", "but", "nor", "of", "to", "in", "on", "at", "by", "for", "with", "from", "into",
    "onto", "over", "under", "about", "after", "before", "between", "through", "during", "without", "within", "against",
    "among", "around", "per", "is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "does", "do",
    "did", "will", "would", "can", "could", "should", "must", "may", "might", "shall", "not", "it", "its", "this",
    "that", "these", "those", "they", "them", "their", "his", "her", "our", "your", "you", "who", "whom", "whose",
    "which", "what", "when", "where", "why", "how", "than", "then", "thus", "hence", "however", "moreover", "therefore",
    "although", "though", "while", "whereas", "because", "since", "until", "unless", "if", "else", "whether", "both",
    "either", "neither", "each", "every", "all", "some", "any", "few", "many", "much", "more", "most", "other",
    "another", "such", "same", "only", "also", "too", "very", "just", "even", "still", "already", "yet", "again",
    "alike",
})
# Common verbs, and words seen astray.
VERBS = frozenset({
    "admits", "imposes", "allows", "enables", "provides", "requires", "offers", "gives", "takes", "makes", "gets",
    "uses", "needs", "wants", "helps", "seems", "looks", "feels", "creates", "claims", "argues", "notes", "says",
    "shows", "means", "lets", "supports", "includes", "contains", "describes", "explains", "suggests", "proposes",
    "reveals", "remains", "becomes", "keeps", "holds", "brings", "leads", "causes", "prevents", "reduces", "increases",
    "improves",
})
EXTRA = frozenset({
    "precedents", "dissent", "impasse", "sovereign", "fight", "sharp",
})
# Loanwords with the endings of English abstract nouns and adverbs.
LOANS = frozenset({
    "production", "performance", "inference", "assembly", "family", "supply", "apply", "reply", "early", "daily",
    "weekly", "monthly", "hourly", "anomaly", "monopoly",
})

CYRILLIC, LETTER = regex.compile(r"\p{Script=Cyrillic}"), regex.compile(r"\p{L}")
LATIN_WORD = re.compile(r"(?!.*['\-’]{2})[A-Za-z](?:['\-A-Za-z’]*[A-Za-z])?")
ENDINGS = re.compile(r"[a-z]+(?:ance|ence|ment|ness|sion|tion)s?|[a-z]{3,}ly")
BREAKS = re.compile(r"[\"&(),/:;\[\]{|}«»–—“”…]|[!.?]\s*$")
EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
QUOTES = [re.compile(p) for p in (r"«([^«»]{1,300})»", r"“([^“”]{1,300})”", r'"([^\n"]{1,300})"')]


def strip_non_prose(text: str) -> str:
    """Without code, link targets, headings and brackets that hold no Cyrillic, URLs, and quotes of three words or fewer."""
    text = re.sub(r"```[\s\S]*?(?:```|$)", " ", text)
    text = re.sub(r"`[^\n`]*`", " ", text)
    text = re.sub(r"\[([^\[\]]*)\]\([^()]*\)", r"\1", text)
    text = re.sub(r"(?m)^#{1,6}\s+([^\n]{1,80})$", lambda m: m[0] if CYRILLIC.search(m[1]) else " ", text)
    text = re.sub(r"(?i)(?:https?://|www\.)\S+", " ", text)
    for quote in QUOTES:
        text = quote.sub(lambda m: " " if len(m[1].split()) <= 3 else f" {m[1]} ", text)
    return re.sub(r"\(([^()]{1,60})\)", lambda m: m[0] if CYRILLIC.search(m[1]) else " ", text)


def _letters(word: str) -> int:
    return len(LETTER.findall(word))


def _is_latin(word: str) -> bool:
    return LATIN_WORD.fullmatch(word) is not None


def _has_upper(word: str) -> bool:
    return re.search("[A-Z]", word) is not None


def _is_low(word: str) -> bool:
    return _is_latin(word) and not _has_upper(word)


def _stray(word: str) -> bool:
    if word in FUNCTION_WORDS or word in VERBS or word in EXTRA:
        return True
    return word not in LOANS and ENDINGS.fullmatch(word) is not None


def analyze(text: str, least_ratio: float = 0.8, least_run: int = 2, soft: bool = False, singles: bool = True) -> dict:
    """cyrillic_ratio, letters, low_ratio, runs, soft_runs and singles (words joined by blanks) of a text."""
    raws = strip_non_prose(text).split()
    words = [EDGES.sub("", r) for r in raws]
    ends = [not w or bool(BREAKS.search(r[r.index(w) + len(w) :])) for r, w in zip(raws, words)]
    cyrillic = sum(len(CYRILLIC.findall(w)) for w in words)
    latin = [w for w in words if _is_latin(w) and w.lower() not in ALLOWED]
    low_latin = sum(_letters(w) for w in words if _is_low(w) and w not in ALLOWED)
    letters = cyrillic + low_latin
    out = {"cyrillic_ratio": cyrillic / letters if letters else 1.0, "letters": letters, "runs": [], "soft_runs": [], "singles": []}
    english = cyrillic == 0 and len(latin) >= 4 and sum(map(_letters, latin)) >= 16
    out["low_ratio"] = bool(letters and out["cyrillic_ratio"] < least_ratio) or english

    def near(k: int) -> str:
        return words[k] if 0 <= k < len(words) else ""

    def judge(start: int, end: int) -> None:
        run = [w.lower() for w in words[start:end]]
        before, after = near(start - 1), near(end)
        if len(run) >= least_run:
            if all(w in ALLOWED for w in run) or (len(run) == 2 and run[0] in ALLOWED):
                return
            if all(w in FUNCTION_WORDS for w in run) and (_has_upper(before) or _has_upper(after)):
                return
            if any(w in FUNCTION_WORDS for w in run) or len(run) >= 4:
                out["runs"].append(" ".join(run))
            elif soft:
                out["soft_runs"].append(" ".join(run))
        elif singles and len(run) == 1:
            word = run[0]
            named = re.search(r"[0-9]", before + " " + after) or (_has_upper(before) and _has_upper(after))
            if _letters(word) >= 3 and word not in ALLOWED and _stray(word) and not named:
                out["singles"].append(word)

    start = -1
    for k, word in enumerate(words):
        if _is_low(word) and _letters(word) >= 2:
            start = k if start < 0 else start
            if ends[k]:
                judge(start, k + 1)
                start = -1
        elif start >= 0:
            judge(start, k)
            start = -1
    if start >= 0:
        judge(start, len(words))
    return out


SCHEMA = "cyrillic_ratio double, letters long, low_ratio boolean, runs array<string>, soft_runs array<string>, singles array<string>"


def purity(text: Column, least_ratio: float = 0.8, soft: bool = False) -> Column:
    """struct of analyze(), a batch at a time; null and blank texts have ratio 1 and no findings."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["cyrillic_ratio", "letters", "low_ratio", "runs", "soft_runs", "singles"]
        for batch in batches:
            yield pd.DataFrame([analyze(t or "", least_ratio, soft=soft) for t in batch], columns=names)

    return run(text)
