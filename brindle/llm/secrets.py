"""Secret scans in DataFrame expressions only: known shapes, and sliding-window entropy.

Positions come without a regex function that returns them: splitting at a pattern gives what lies
between its matches, so a match starts where all pieces and matches before it end. Each pattern first
runs as a plain test; rows that it doesn't hit (nearly all) build no arrays.

The entropy scan takes candidate strings, maximal runs of a character class long enough to be a key.
A window slides over each candidate; the counts of the characters in it, and with them the sum of
c log2 c, change by the one character that enters and the one that leaves. A candidate is a secret
if its windows' largest Shannon entropy reaches the class's threshold and the allow-list of known
harmless shapes doesn't name it. Rows are independent: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
#: Runs of the class as a whole: shorter runs fail and hide nothing, since runs are maximal.
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class EntropyClass:
    """A character class whose runs of `least` or more are candidates, a window, the entropy in bits that makes a secret, and allowed shapes."""

    pattern: str
    least: int
    window: int
    bits: float
    allowed: tuple[str, ...] = ()


#: What no secret looks like, by class: whole shapes, and placeholders, which only suppress runs that are hardly longer than themselves.
WORDS = r"(?i)^(?=.{0,47}$).*(example|sample|dummy|xxxx|0000|1234567)"
UUID = r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
PATH = r"^/?([a-z0-9_-]+/)+[a-z0-9_-]*$"
#: Base-64 text mixes cases and digits; hexadecimal text in upper case has sixteen signs at most; keys of small letters and
#: digits change between both more often than words with numbers do.
CLASSES = (
    EntropyClass("[A-Za-z0-9+/_-]", 24, 20, 3.9, (r"^[^0-9]*$", r"^[^A-Z]*$", r"^[0-9_/+-]+$", UUID, WORDS, PATH)),
    EntropyClass("[0-9A-F]", 32, 24, 3.2, (r"^[0-9]+$", r"^[A-F]+$", WORDS)),
    EntropyClass("[a-z0-9]", 32, 24, 3.9, (r"^[0-9a-f]+$", r"^(?:[a-z]+[0-9]*){0,4}$", r"^[0-9]*(?:[a-z]+[0-9]*){0,4}$", WORDS)),
)
#: Elements of an array that a running sum takes at once.
RUN = 256


SPAN = "array<struct<start:int,end:int,length:int>>"


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array<int>, each element with those before it, put together by op, which has the neutral element 0.

    Within runs of RUN elements results are appended one by one, and so are the runs' totals: n elements take RUN n / 2 +
    (n / RUN)^2 / 2 copies instead of n^2 / 2.
    """
    none = F.array().cast("array<int>")

    def scanned(items: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return let(op(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

        return F.aggregate(items, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of_runs(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, x: op(acc, x)))
        starts = F.concat(F.array(F.lit(0)), scanned(totals, F.lit(0)))
        return F.flatten(F.transform(runs, lambda run, k: scanned(run, F.get(starts, k))))

    runs = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(RUN)), lambda i: F.slice(values, i, RUN))
    return F.when(F.size(values) > 0, let(runs, of_runs)).otherwise(none)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start,end,length,word>> of a pattern's matches, in code points; length is the group's, word what matched."""

    def of_parts(v: Column) -> Column:
        ends = running(F.transform(v["items"], lambda x: x["gap"] + x["size"]), lambda acc, n: acc + n)
        span = lambda end, x: F.struct((end - x["size"]).alias("start"), end.alias("end"), x["length"].alias("length"), x["word"].alias("word"))
        return F.zip_with(ends, v["items"], span)

    def of_words(words: Column) -> Column:
        sizes = F.transform(words, F.length)
        lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else sizes
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(words)), F.length)
        return let(F.struct(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), lengths.alias("length"), words.alias("word")).alias("items")), of_parts)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_words))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(matches: Column) -> Column:
    return F.coalesce(F.transform(matches, lambda x: F.struct(x["start"], x["end"], x["length"])), F.array().cast(SPAN))


def _window_entropy(word: Column, width: int) -> Column:
    """The largest entropy, in bits, of a window of `width` characters over the word, by incremental counts.

    State is the sum of c log2 c over the window's characters. The one that enters and the one that leaves change it by
    their own counts, which are taken over the window's signs; nothing else is kept.
    """

    def c_log_c(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def count(chars: Column, start: Column, n: Column, sign: Column) -> Column:
        return F.size(F.filter(F.slice(chars, start, n), lambda x: x == sign)).cast("double")

    def of_chars(chars: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.element_at(chars, i), F.element_at(chars, F.greatest(i - width, F.lit(1)))
            before = count(chars, F.greatest(i - width, F.lit(1)), F.least(i - 1, F.lit(width)), enters)  # in the window without the entering sign
            entered = state["sum"] + c_log_c(before + 1) - c_log_c(before)
            there = count(chars, F.greatest(i - width, F.lit(1)), F.lit(width + 1), leaves)  # with both
            total = F.when(i > width, entered - c_log_c(there) + c_log_c(there - 1)).otherwise(entered)
            bits = F.log2(F.lit(float(width))) - total / width
            return F.struct(total.alias("sum"), F.when(i >= width, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"))

        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), zero, step, lambda state: state["best"])

    return let(F.transform(F.filter(F.split(word, ""), lambda ch: ch != ""), F.ascii), of_chars)


def _entropy_spans(text: Column, kind: EntropyClass) -> Column:
    allowed = lambda word: reduce(Column.__or__, (word.rlike(p) for p in kind.allowed), F.lit(False))
    hits = F.filter(_matches(text, f"{kind.pattern}{{{kind.least},}}", 0), lambda x: F.when(allowed(x["word"]), F.lit(False)).otherwise(_window_entropy(x["word"], kind.window) >= kind.bits))
    return spans_of(hits)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans, found.

    found lists every span as a struct of start, order (the kind's place in KINDS) and end, end exclusive, in code
    points; spans joins kind:start:end by commas, by start, then kind as listed. base_sha256 is the digest of
    that list without entropy spans. An entropy span that lies within a base span is left out; base
    spans all stay. Null is empty; a text without spans has an empty list and the digest of "".
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        F.filter(spans_of(_matches(text, ASSIGN, 1)), lambda s: s["length"] >= 8).alias("assign"),
        spans_of(_matches(text, ACCESS, 0)).alias("access"),
        spans_of(_matches(text, HEX, 0)).alias("hex"),
        F.array_distinct(F.concat(*(_entropy_spans(text, k) for k in classes))).alias("entropy"),
    )

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end")))

    def within(spans: Column) -> Column:
        """Entropy spans of sorted ones that don't lie in a base span: no base span that starts before them, or where they do, reaches their end."""
        entropy = KINDS.index("entropy")
        reach = running(F.transform(spans, lambda s: F.when(s["order"] < entropy, s["end"]).otherwise(F.lit(0))), F.greatest)
        pairs = F.arrays_zip(spans.alias("span"), reach.alias("reach"))
        return F.transform(F.filter(pairs, lambda x: (x["span"]["order"] < entropy) | (x["reach"] < x["span"]["end"])), lambda x: x["span"])

    def ordered(kinds: tuple[str, ...]) -> Column:
        return F.array_sort(F.concat(*map(tagged, kinds)))

    def joined(spans: Column) -> Column:
        kind = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["order"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    known = base.withColumn("known", ordered(KINDS[:3]))
    found = known.withColumn("found", F.when(F.size("entropy") == 0, F.col("known")).otherwise(let(ordered(KINDS), within)))
    return found.select(
        F.col("id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        (F.size("found") - F.size("known")).cast("long").alias("n_entropy"),
        F.sha2(joined(F.col("known")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        "found",
    )
