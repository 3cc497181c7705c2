"""Predicates and small decisions on stories, summaries and runs, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import single_line, trimmed

AGGREGATE_FLOOR, CLEANUP_FLOOR, LONG_DISCUSSION, HOT_SCORE, POPULAR_TAG = 75, 50, 150, 250, 3


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def passes_gate(score: Column, comments: Column, least_score: int = 300, least_comments: int = 100) -> Column:
    """Enough votes or enough comments, inclusive; a threshold of 0 is off, and with both off all pass."""
    if least_score <= 0 and least_comments <= 0:
        return F.lit(True)
    hits = F.lit(False)
    if least_score > 0:
        hits = hits | (zero(score) >= least_score)
    if least_comments > 0:
        hits = hits | (zero(comments) >= least_comments)
    return hits


def has_summary(summary: Column) -> Column:
    return trimmed(F.coalesce(summary, F.lit(""))) != ""


def publishable(summary: Column, score: Column, comments: Column, least_score: int = 300, least_comments: int = 100) -> Column:
    return passes_gate(score, comments, least_score, least_comments) & has_summary(summary)


def in_cooldown(updated: Column, now: str, seconds: int) -> Column:
    """Whether an ISO time is less than so many seconds before now; unreadable times and no cooldown give false."""
    at = F.try_to_timestamp(updated, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))
    if seconds <= 0:
        return F.lit(False)
    return F.coalesce(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at) < seconds, F.lit(False))


def share_hit(row_id: Column, percent: int) -> Column:
    """A stable share of ids."""
    return F.lit(percent >= 100) if percent <= 0 or percent >= 100 else F.abs(row_id) % 100 < percent


def route(row_id: Column, tokens: Column, max_out: int, percent: int, short_cap: int = 5500, medium_cap: int = 8000, enabled: bool = True, fallback: str = "small", medium: str = "medium", exhausted: Column | None = None) -> Column:
    """struct(kind, model, reason): which second route a call takes, by a stable share of ids and by the tokens that it reserves.

    Outside the share (or with the routes off) the fallback model as ever; else the fallback for short calls, the medium model for
    medium ones, and none where the call is too large, or the model is unset or among the exhausted ones.
    """
    reserved = tokens + max_out
    pick = lambda kind, model, reason: F.struct(F.lit(kind).alias("kind"), F.lit(model).alias("model"), F.lit(reason).alias("reason"))
    spent = lambda model: F.array_contains(exhausted, model) if exhausted is not None else F.lit(False)

    def tier(kind: str, model: str, fits: str) -> Column:
        if not model.strip():
            return pick("skip", "", f"{kind}-empty")
        return F.when(spent(model), pick("skip", "", f"{kind}-exhausted")).otherwise(pick(kind, model, fits))

    off = "legacy-fallback-empty" if not fallback.strip() else "routes-off" if not enabled else "share-zero" if percent <= 0 else "share-miss"
    chosen = F.when(reserved < short_cap, tier("short", fallback, "under-short-cap")).when(reserved <= medium_cap, tier("medium", medium, "under-medium-cap")).otherwise(pick("skip", "", "over-medium-cap"))
    return F.when(F.lit(not enabled) | ~share_hit(row_id, percent), pick("legacy", fallback.strip(), off)).otherwise(chosen)


def is_substantive(text: Column, least: int = 80) -> Column:
    return F.length(single_line(text)) >= least


def insight_ceiling(substantive: Column) -> Column:
    return F.when(substantive >= 30, 15).when(substantive >= 20, 12).when(substantive >= 10, 8).otherwise(5)


def size_bucket(chars: Column, cap: int, truncated: Column) -> Column:
    return F.when(truncated | (chars >= 0.6 * cap), F.lit("long")).when(chars >= 0.25 * cap, F.lit("medium")).otherwise(F.lit("short"))


def count_bucket(comments: Column) -> Column:
    """By number of comments; under three is no fixture."""
    return F.when(comments >= 38, F.lit("long")).when(comments >= 25, F.lit("medium")).when(comments >= 3, F.lit("short"))


def compressed_state(text: Column, source_hash: Column, expected: Column) -> Column:
    stale = text.isNull() | ~source_hash.eqNullSafe(expected)
    return F.when(stale, F.lit("retryable")).when(text == "", F.lit("rejected")).otherwise(F.lit("usable"))


def guard_verdict(ok: Column, is_article: Column, refusal: Column, confidence: Column, verdict: Column, reasons: Column, least: float = 0.6, reject_from: float = 0.7) -> Column:
    """struct(ok, verdict, reasons): a guard's answer held to its own confidence; a confident verdict against a text counts.

    Reasons begin with what the flags say; at most two distinct ones stay.
    """
    fine = ok & is_article & ~refusal & (confidence >= least) & ~((verdict != "ok") & (confidence >= reject_from))
    final = F.when(fine, verdict).when(~is_article, F.lit("not_article")).when(refusal, F.lit("refusal")).otherwise(verdict)
    flags = F.array_compact(F.array(F.when(~is_article, F.lit("not_article")), F.when(refusal, F.lit("refusal"))))
    kept = F.slice(F.array_distinct(F.filter(F.concat(flags, F.transform(reasons, trimmed)), lambda r: r != "")), 1, 2)
    return F.struct(fine.alias("ok"), final.alias("verdict"), kept.alias("reasons"))


def post_changed(has_summary: Column, only_missing: bool, cooling: Column, cached: Column, stored_hash: Column, new_hash: Column) -> Column:
    """Whether a post's summary has to be made again; the first rule that applies decides."""
    return (
        F.when(~has_summary, True)
        .when(F.lit(only_missing), False)
        .when(cooling, False)
        .when(~cached, False)
        .otherwise(~stored_hash.eqNullSafe(new_hash))
    )


def comments_changed(c: dict[str, Column], policy: str, least_new: int) -> Column:
    """Whether a comments summary has to be made again. c: has_summary, failed, compress_state, cooling, policy, version, processed, descendants, stored_hash, new_hash."""
    current = c["policy"].isNull() | (c["policy"] == policy)
    counted = F.lit(least_new > 0) & (c["version"] == 2) & ~c["failed"] & c["policy"].eqNullSafe(F.lit(policy)) & c["processed"].isNotNull() & c["descendants"].isNotNull()
    return (
        F.when(~c["has_summary"], True)
        .when(c["failed"], True)
        .when((c["version"] == 2) & (c["compress_state"] == "retryable"), True)
        .when(c["cooling"], False)
        .when(~current, True)
        .when(F.coalesce(counted, F.lit(False)), c["descendants"] - c["processed"] > least_new)
        .otherwise(~c["version"].eqNullSafe(F.lit(2)) | ~c["stored_hash"].eqNullSafe(c["new_hash"]))
    )


def valid_item(item_id: Column, title: Column, by: Column, time_iso: Column, url: Column) -> Column:
    """Whether a row may be published: what the published collection's schema demands."""
    checks = (
        item_id > 0,
        F.length(title).between(1, 500),
        F.length(by).between(1, 80),
        time_iso.rlike(r"^\d{4}-\d{2}-\d{2}T.*Z$"),
        url.isNull() | url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"),
    )
    out = F.lit(True)
    for check in checks:
        out = out & F.coalesce(check, F.lit(False))
    return out
