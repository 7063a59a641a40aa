"""Offline evaluation over all users at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from . import hybrid


def evaluation_set(parts: DataFrame, split: str = "test", positive: float = 4.0, picks: int = 3, users: str = "held out") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, seen, onboarding picks): held-out positives, all earlier items of their users, first positives of train (n: place).

    ``users`` "all": seen items and picks of all users, not only of those with a target.
    """
    targets = parts.filter((F.col("split") == split) & (F.col("rating") >= positive)).select("user_id", F.col("movie_id").alias("target"))
    earlier = parts.filter(F.col("split").isin("train") if split == "validation" else F.col("split").isin("train", "validation"))
    if users != "all":
        earlier = earlier.join(targets.select("user_id").distinct(), "user_id", "left_semi")
    seen = earlier.select("user_id", "movie_id", "rating", "timestamp", "split")
    first = W.partitionBy("user_id").orderBy("timestamp", "movie_id")
    onboarding = seen.filter((F.col("split") == "train") & (F.col("rating") >= positive)).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= picks).select("user_id", "movie_id", "n")
    return targets, seen.select("user_id", "movie_id"), onboarding


def popular_for_all(popular: DataFrame, targets: DataFrame, seen: DataFrame, top: int = 20) -> DataFrame:
    """(user_id, rank, movie_id): the popular list without what each user has seen.

    Only the first top + n rows can be left in a user's list who saw n, so no more of the list is paired with them.
    """
    n = seen.groupBy("user_id").agg(F.count("*").alias("n"))
    users = targets.select("user_id").distinct().join(n.hint("merge"), "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + top).alias("need"))
    order = popular.select("rank", "movie_id")
    slots = users.select("user_id", F.explode(F.sequence(F.lit(1), F.col("need"))).alias("rank"))
    rows = slots.join(F.broadcast(order) if order.limit(100_001).count() <= 100_000 else order.hint("merge"), "rank").join(seen.hint("merge"), ["user_id", "movie_id"], "left_anti")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy("rank"))).filter(F.col("rank") <= top).select("user_id", "rank", "movie_id")


def without_seen(rankings: DataFrame, seen: DataFrame, top: int = 20) -> DataFrame:
    rows = rankings.join(seen, ["user_id", "movie_id"], "left_anti")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy("rank"))).filter(F.col("rank") <= top).select("user_id", "rank", "movie_id")


def metrics(rankings: DataFrame, targets: DataFrame, cutoffs: Sequence[int] = (10, 20), keys: Sequence[str] = ()) -> DataFrame:
    """One row (a trial): users_scored, hit_rate_k, precision_k, ndcg_k for each cutoff, distinct items up to the last.

    Users without a list are not scored; ``keys``: further columns that tell lists apart.
    """
    by = [*keys, "user_id"]
    users = rankings.select(*by).distinct().join(targets.hint("merge"), "user_id")
    hits = users.join(rankings.withColumnRenamed("movie_id", "target").hint("merge"), [*by, "target"], "left")
    last = max(cutoffs)
    sums = []
    for k in cutoffs:
        hit = F.coalesce(F.col("rank") <= k, F.lit(False))
        sums += [
            F.round(F.avg(hit.cast("double")), 6).alias(f"hit_rate_{k}"),
            F.round(F.sum(hit.cast("double")) / (F.count("*") * k), 6).alias(f"precision_{k}"),
            F.round(F.avg(F.when(hit, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)), 6).alias(f"ndcg_{k}"),
        ]
    scored = hits.groupBy(*keys).agg(F.count("*").alias("users_scored"), *sums)
    items = rankings.join(targets.select("user_id").distinct().hint("merge"), "user_id", "left_semi").filter(F.col("rank") <= last).groupBy(*keys).agg(F.countDistinct("movie_id").alias("distinct_items"))
    return scored.join(items, list(keys)) if keys else scored.crossJoin(items)


def comparison(results: DataFrame, baseline: str, catalogue_size: int, metric: str = "hit_rate_10") -> DataFrame:
    """``results`` (model, ...) with coverage of the catalogue and the relative gain over the baseline model."""
    base = results.filter(F.col("model") == baseline).select(F.col(metric).alias("base"))
    rows = results.crossJoin(F.broadcast(base))
    gain = F.when(F.col("base") > 0, F.round(F.col(metric) / F.col("base") - 1, 6))
    return rows.select("model", "users_scored", metric, F.round(F.col("distinct_items") / catalogue_size, 6).alias("coverage"), gain.alias("gain"))


def fallback_levels(rows: DataFrame) -> DataFrame:
    """(level, users): lists by the deepest tier they needed."""
    return rows.select("request_id", "level").distinct().groupBy("level").agg(F.count("*").alias("users"))


def weight_sweep(candidates: DataFrame, requests: DataFrame, excluded: DataFrame, genres: DataFrame, targets: DataFrame, caps: Sequence[int] = (0, 4, 8), floors: Sequence[float] = (0.0, 0.1, 0.25, 0.5, 0.75), populars: Sequence[float] = (0.0, 0.2), top: int = 20, k: int = 60) -> DataFrame:
    """Metrics of each (cap, floor, pop): candidates are made, cleared of ``excluded`` and placed once.

    A row of a request and item holds its place in each source, and from these an array of the scores of all weights; only the
    scores are laid out by trial.  The cap changes the order alone, so the places under all caps come from running counts
    over one order: late items follow the others, both in their order.
    """
    placed = hybrid.without(candidates, excluded).withColumn("place", F.row_number().over(W.partitionBy("request_id", "source").orderBy("rank", "movie_id")))
    item = placed.groupBy("request_id", "movie_id").agg(*[F.min(F.when(F.col("source") == s, F.col("place"))).alias(f"p_{s}") for s in hybrid.SOURCES])
    share = F.least(F.col("n") / 20, F.lit(1.0))
    part = lambda w, s: F.when((w > 0) & F.col(f"p_{s}").isNotNull(), w / (k + F.col(f"p_{s}")))
    known = lambda *xs: F.when(F.coalesce(*xs).isNotNull(), F.round(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)), 12))
    trial = lambda f, p: F.struct(F.lit(float(f)).alias("floor"), F.lit(float(p)).alias("pop"), known(part(share, "cf"), part(1 - (1 - f) * share, "cb"), part(F.lit(float(p)), "pop")).alias("score"))
    scores = F.array(*[trial(f, p) for f in floors for p in populars])
    # The catalogue first: what follows goes by the request, where the rows then lie.
    each = item.join(genres.select("movie_id", "genre").hint("merge"), "movie_id", "left").join(requests.select("request_id", "n").hint("merge"), "request_id")
    rows = each.select("request_id", "movie_id", "genre", F.explode(scores).alias("t")).select("request_id", "movie_id", "genre", "t.*").filter("score is not null")

    lists = W.partitionBy("request_id", "floor", "pop")
    low, high = F.min("score").over(lists), F.max("score").over(lists)
    scaled = rows.withColumn("s", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)).drop("score")
    ranked = scaled.withColumn("rank", F.row_number().over(lists.orderBy(F.desc("s"), "movie_id")))
    nth = F.when(F.col("genre").isNotNull(), F.row_number().over(W.partitionBy("request_id", "floor", "pop", "genre").orderBy("rank"))).otherwise(0)
    counted = ranked.withColumn("nth", nth)
    upto = lists.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    late = lambda c: F.col("nth") > c if c > 0 else F.lit(False)
    early = lambda c: F.when(late(c), 0).otherwise(1)
    for c in caps:
        counted = counted.withColumns({f"e{c}": F.sum(early(c)).over(upto), f"n{c}": F.sum(early(c)).over(lists)})
    place = lambda c: F.when(late(c), F.col(f"n{c}") + F.col("rank") - F.col(f"e{c}")).otherwise(F.col(f"e{c}"))
    places = F.filter(F.array(*[F.struct(F.lit(c).alias("cap"), place(c).alias("place")) for c in caps]), lambda x: x["place"] <= top)
    out = counted.select("request_id", "floor", "pop", "movie_id", F.explode(places).alias("x"))
    made = out.select(F.col("request_id").alias("user_id"), F.col("x.cap").alias("cap"), "floor", "pop", F.col("x.place").alias("rank"), "movie_id")
    return metrics(made, targets, (10, 20), ("cap", "floor", "pop"))
