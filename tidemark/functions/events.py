"""Column expressions for interaction events: vocabulary, sentiment, weight and decay."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from .scalars import to_number

# The event types that are scored, and words for a comment's sentiment.
SUPPORTED = ("click", "watch", "complete", "like", "dislike", "rating", "share", "comment")
SENTIMENTS = {"pos": 1.0, "positive": 1.0, "neutral": 0.0, "mixed": 0.0, "neg": -1.0, "negative": -1.0}


@dataclass(frozen=True)
class EventSettings:
    """How events are scored."""

    weights: dict[str, float] = field(default_factory=lambda: {"click": 2.0, "watch": 10.0, "complete": 12.0, "like": 15.0, "dislike": -15.0, "share": 15.0})
    rating_neutral: float = 3.0
    rating_scale: float = 5.0
    watch_threshold: float = 0.5
    comment_base: float = 3.0
    comment_scale: float = 12.0
    caps: dict[str, int] = field(default_factory=lambda: {"share": 3, "comment": 5})
    half_life_days: float = 30.0
    dislike_at: float = -5.0
    most_events: int = 200
    valid_types: tuple[str, ...] = ("watch", "complete", "like", "rating", "share", "comment")
    valid_days: int = 90
    enough_for_cf: int = 5


def coerce_id(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("bigint")


def timestamp_or_key(ts: Column, key: Column) -> Column:
    """``ts``, or what stands before the first ``#`` of a composite key."""
    return F.coalesce(ts, F.when(F.contains(key, F.lit("#")), F.split_part(key, F.lit("#"), F.lit(1))))


def translate(kind: Column, action: Column, value: Column, event_type: Column, complete_at: float = 0.95) -> Column:
    """Struct (event_type, value) of a backend record, null for a cleared one.

    A record that already names an event type passes through in lower case.
    """
    k, number = F.lower(F.trim(kind)), to_number(value)
    out = lambda t, v: F.struct(F.lit(t).alias("event_type") if isinstance(t, str) else t.alias("event_type"), v.cast("double").alias("value"))
    named = F.lower(F.trim(event_type))
    return (
        F.when((F.coalesce(named, F.lit("")) != ""), out(named, number))
        .when(F.lower(F.trim(action)) == "clear", F.lit(None))
        .when(k.isin("click", "share"), out(k, F.lit(1.0)))
        .when((k == "watch") & number.isNotNull() & (number >= complete_at), out("complete", F.lit(1.0)))
        .when(k == "watch", out("watch", number))
        .when(k == "rating", out("rating", number))
        .when((k == "reaction") & (number == 1), out("like", F.lit(1.0)))
        .when(k == "reaction", out("dislike", F.lit(-1.0)))
        .otherwise(out(k, number))
    )


def sentiment(value: Column) -> Column:
    """-1 to 1 from a label or a number; null if it is neither."""
    label = F.lower(F.trim(value.cast("string")))
    named = F.create_map(*[F.lit(x) for pair in SENTIMENTS.items() for x in pair])
    number = F.coalesce(F.try_element_at(named, label), to_number(label))
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(-1.0)), F.lit(1.0)))


def weight(event_type: Column, value: Column, movie_id: Column, s: EventSettings) -> Column:
    """Struct (weight, reason): one of the two is null."""
    t = F.lower(F.trim(F.coalesce(event_type, F.lit(""))))
    number, mood = to_number(value), sentiment(value)
    ok = lambda w: F.struct(w.cast("double").alias("weight"), F.lit(None).cast("string").alias("reason"))
    no = lambda r: F.struct(F.lit(None).cast("double").alias("weight"), F.lit(r).alias("reason"))
    fixed = F.try_element_at(F.create_map(*[x for k, v in s.weights.items() for x in (F.lit(k), F.lit(float(v)))]), t)
    return (
        F.when(movie_id.isNull(), no("unusable_movie_id"))
        .when(~t.isin(*SUPPORTED), no("unsupported_event_type"))
        .when((t == "rating") & number.isNull(), no("malformed_value"))
        .when(t == "rating", ok((number - s.rating_neutral) * s.rating_scale))
        .when((t == "comment") & mood.isNull(), no("missing_sentiment"))
        .when(t == "comment", ok(s.comment_base + s.comment_scale * mood))
        .when((t == "watch") & number.isNull(), no("malformed_value"))
        .when((t == "watch") & (number < s.watch_threshold), no("below_threshold"))
        .when(fixed.isNull(), no("no_weight_configured"))
        .otherwise(ok(fixed))
    )


def decay(ts: Column, as_of: Column, half_life_days: float) -> Column:
    """0.5 ** (age / half life); 1 for unknown and future times and without a half life."""
    if half_life_days <= 0:
        return F.lit(1.0)
    days = F.greatest((F.unix_micros(as_of) - F.unix_micros(ts)) / 86400e6, F.lit(0.0))
    return F.when(ts.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), days / half_life_days))
