"""Column expressions: text, numbers, dates and rating formulas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What stands for a missing text, after trimming and lower-casing.
MISSING = ("", "nan", "none", "null", "n/a", "na")


def normalize_text(c: Column, lower: bool = False) -> Column:
    """White space collapsed and trimmed; missing marks become null."""
    text = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    text = F.when(~F.lower(text).isin(*MISSING), text)
    return F.lower(text) if lower else text


def to_number(c: Column) -> Column:
    """A double, or null if it can't be read or is not a number."""
    return F.nullif(c.try_cast("double"), F.lit(float("nan")))


def to_id(c: Column) -> Column:
    """A whole positive number as a long, else null."""
    n = to_number(c)
    return F.when((n > 0) & (n % 1 == 0), n.cast("long"))


def in_range(c: Column, low: float | None = None, high: float | None = None, above: float | None = None) -> Column:
    """``c`` where low <= c <= high and c > above, else null."""
    ok = F.lit(True)
    for bound, test in ((low, lambda b: c >= b), (high, lambda b: c <= b), (above, lambda b: c > b)):
        if bound is not None:
            ok = ok & test(bound)
    return F.when(ok, c)


def to_year(c: Column, first: int = 1870, last: int = 2030) -> Column:
    """The year of a date text in range, else null."""
    return in_range(F.year(F.try_to_timestamp(c)), first, last).cast("smallint")


def imdb_id(c: Column) -> Column:
    """``tt`` and at least seven digits."""
    return F.when(c.isNotNull(), F.format_string("tt%07d", c))


def clean_free_text(c: Column) -> Column:
    """Lower case; everything but word characters to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(clean_free_text(c), " ", "_")


def prefixed_tokens(prefix: str, values: Column) -> Column:
    """``prefix_slug`` of each value whose slug is not empty."""
    made = F.transform(F.coalesce(values, F.array().cast("array<string>")), slug)
    return F.transform(F.filter(made, lambda x: x != ""), lambda x: F.concat(F.lit(f"{prefix}_"), x))


def half_up(c: Column, places: int) -> Column:
    """``c`` >= 0 rounded by its scaled double, as SQL engines do; ``F.round`` takes the shortest decimal, which may lie on the other side of a half."""
    return F.floor(c * 10.0**places + 0.5) / 10.0**places


def weighted_rating(mean: Column, count: Column, prior: Column, weight: Column) -> Column:
    """``mean`` shrunk towards ``prior``: the prior counts like ``weight`` ratings."""
    return count / (count + weight) * mean + weight / (count + weight) * prior


def preference(rating: Column) -> Column:
    """0 at 3.5 and below, 1 at 5."""
    return F.least(F.greatest((rating - 3.5) / 1.5, F.lit(0.0)), F.lit(1.0))


def confidence(rating: Column, alpha: float = 40.0) -> Column:
    return 1 + alpha * preference(rating)


def source_weights(count: Column, full: float = 20.0, floor: float = 0.25, popularity: float = 0.0) -> Column:
    """Struct (cf, cb, pop): trust moves from content to collaborative as valid interactions come in."""
    c = F.least(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)) / full, F.lit(1.0))
    return F.struct(c.alias("cf"), (1 - (1 - floor) * c).alias("cb"), F.lit(popularity).alias("pop"))


def score_to_rating(score: Column, span: float = 15.0, low: float = 0.5, middle: float = 3.0, high: float = 5.0) -> Column:
    """Piecewise linear: -span to low, 0 to middle, span to high, flat beyond."""
    s = F.least(F.greatest(score / span, F.lit(-1.0)), F.lit(1.0))
    return F.when(s >= 0, middle + s * (high - middle)).otherwise(middle + s * (middle - low))


def sentiment_from_stars(stars: Column, neutral: float = 3.0, span: float = 2.0) -> Column:
    return F.least(F.greatest((stars - neutral) / span, F.lit(-1.0)), F.lit(1.0))


def sentiment_from_classes(positive: Column, negative: Column) -> Column:
    return F.least(F.greatest(positive - negative, F.lit(-1.0)), F.lit(1.0))


def title_search(movies, text: str, limit: int = 10):  # noqa: ANN001, ANN201
    """Titles that hold ``text`` in any case, most votes first."""
    return movies.filter(F.contains(F.lower("title"), F.lit(text.lower()))).orderBy(F.desc_nulls_last("vote_count"), "movie_id").limit(limit)
