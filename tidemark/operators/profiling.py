"""Column and table profiles, audits across tables, integrity rules, summaries and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.scalars import to_number


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text), one row a cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.*")


def column_profile(df: DataFrame, columns: list[str], numeric: tuple[str, ...] = (), top: int = 5) -> DataFrame:
    """(column, n, nulls, null_share, distinct_values, malformed, low, high, top_values): one row a column.

    ``numeric`` columns count the cells that are not numbers and give numeric bounds; others'
    bounds are by text.  ``top_values``: the most frequent, ``value=count``, ties by value.
    """
    counts = _long(df, columns).groupBy("column", "value").agg(F.count("*").alias("k"))
    is_number = F.col("column").isin(*numeric) if numeric else F.lit(False)
    number = to_number(F.col("value"))
    stats = counts.groupBy("column").agg(
        F.sum("k").alias("n"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(is_number & F.col("value").isNotNull() & number.isNull(), F.col("k"))), F.lit(0)).alias("malformed"),
        F.min(F.when(is_number, number)).alias("low_number"),
        F.max(F.when(is_number, number)).alias("high_number"),
        F.min("value").alias("low_text"),
        F.max("value").alias("high_text"),
    )
    order = W.partitionBy("column").orderBy(F.desc("k"), "value")
    best = counts.filter("value is not null").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    lists = best.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("r", "value", "k"))).alias("t"))
    tops = lists.select("column", F.array_join(F.transform("t", lambda x: F.concat(x["value"], F.lit("="), x["k"].cast("string"))), "|").alias("top_values"))
    chosen = lambda a, b: F.when(is_number, F.round(F.col(a), 6).cast("string")).otherwise(F.col(b))
    return stats.join(tops, "column", "left").select("column", "n", "nulls", F.round(F.col("nulls") / F.col("n"), 6).alias("null_share"), "distinct_values", "malformed", F.when(is_number, F.col("low_number")).alias("low"), F.when(is_number, F.col("high_number")).alias("high"), F.when(~is_number, F.col("low_text")).alias("low_text"), F.when(~is_number, F.col("high_text")).alias("high_text"), "top_values")


def list_stats(parsed: DataFrame, status: str = "status") -> DataFrame:
    """(filled, malformed, wrong_type) over the parse statuses of a literal column."""
    return parsed.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("filled", "malformed", "wrong_type")])


def timestamp_stats(df: DataFrame, c: Column) -> DataFrame:
    """(first, last, unusable) of a text column of times."""
    t = F.try_to_timestamp(c)
    return df.agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count_if(t.isNull()).alias("unusable"))


def table_profile(ratings: DataFrame, keys: list[str], low: float = 0.5, high: float = 5.0) -> DataFrame:
    """(metric, value): rows, repeated rows, repeated keys, unusable ids and ratings; exact at any order of the input."""
    everything = ratings.groupBy(*ratings.columns).agg(F.count("*").alias("k")).agg(F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("r"))
    by_key = ratings.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.sum(F.col("k") - 1).alias("d"))
    bad = ratings.agg(
        F.count_if(~F.coalesce(F.least(*[F.col(k) for k in keys]) > 0, F.lit(False))).alias("i"),
        F.count_if(~F.coalesce(F.col("rating").between(low, high), F.lit(False))).alias("o"),
    )
    wide = everything.crossJoin(by_key).crossJoin(bad)
    named = [("rows", "n"), ("duplicate_rows", "r"), ("duplicate_keys", "d"), ("non_positive_ids", "i"), ("ratings_out_of_range", "o")]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(c), F.lit(0)).alias("value")) for m, c in named])).alias("x")).select("x.*")


def relationship_audit(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(name, missing): for each name the distinct ids of the first table that the second lacks; both have one column."""
    out = None
    for name, (a, b) in pairs.items():
        left, right = a.toDF("id").filter("id is not null").distinct(), b.toDF("id").distinct()
        row = left.join(right, "id", "left_anti").agg(F.count("*").alias("missing")).select(F.lit(name).alias("name"), "missing")
        out = row if out is None else out.unionByName(row)
    return out


def rules(metrics: DataFrame, limits: dict[str, tuple[float, bool]]) -> DataFrame:
    """(rule_id, status, critical, evidence) of metrics (name, missing).

    ``limits``: the highest value that passes, and whether the rule is critical.  Above it a
    critical rule FAILs and another gives a WARNING; a rule without a metric FAILs.
    """
    wanted = metrics.sparkSession.createDataFrame([(k, float(v), c) for k, (v, c) in limits.items()], "rule_id string, most double, critical boolean")
    rows = F.broadcast(wanted).join(metrics.withColumnRenamed("name", "rule_id"), "rule_id", "left")
    fine = F.coalesce(F.col("missing") <= F.col("most"), F.lit(False))
    status = F.when(fine, "PASS").when(F.col("critical") | F.col("missing").isNull(), "FAIL").otherwise("WARNING")
    return rows.select("rule_id", status.alias("status"), "critical", F.create_map(F.lit("count"), F.col("missing").cast("string"), F.lit("allowed"), F.col("most").cast("string")).alias("evidence"))


def overall(checked: DataFrame) -> DataFrame:
    """One row: the worst status and the number of critical rules that failed."""
    level = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARNING", 1).otherwise(0)
    return checked.agg(F.max(level).alias("l"), F.count_if((F.col("status") == "FAIL") & F.col("critical")).alias("critical_failures")).select(F.element_at(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")), F.col("l") + 1).alias("status"), "critical_failures")


def stop_on_critical(checked: DataFrame) -> None:
    bad = [r["rule_id"] for r in checked.filter("status = 'FAIL' and critical").select("rule_id").collect()]
    if bad:
        raise RuntimeError(f"critical rules failed: {', '.join(sorted(bad))}")


def interaction_summary(interactions: DataFrame, catalogue: DataFrame, least: int = 3) -> DataFrame:
    """(metric, value): size, sparsity, spread of rows a user and a movie, users below ``least``, movies without a row."""
    def spread(key: str) -> DataFrame:
        n = interactions.groupBy(key).agg(F.count("*").alias("k"))
        q = F.percentile("k", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]))
        return n.agg(F.count("*").alias("n"), F.min("k").alias("min"), q.alias("q"), F.max("k").alias("max"), F.count_if(F.col("k") < least).alias("few"))

    u, m = spread("user_id"), spread("movie_id")
    cold = catalogue.select("movie_id").distinct().join(interactions.select("movie_id").distinct(), "movie_id", "left_anti").agg(F.count("*").alias("cold"))
    total = interactions.agg(F.count("*").alias("rows"))
    wide = total.crossJoin(u.select(*[F.col(c).alias(f"u_{c}") for c in u.columns])).crossJoin(m.select(*[F.col(c).alias(f"m_{c}") for c in m.columns])).crossJoin(cold)
    values = {"rows": F.col("rows"), "users": F.col("u_n"), "movies": F.col("m_n"), "sparsity": 1 - F.col("rows") / (F.col("u_n") * F.col("m_n"))}
    for side, label in (("u", "user"), ("m", "movie")):
        values |= {f"{label}_min": F.col(f"{side}_min"), f"{label}_max": F.col(f"{side}_max")}
        values |= {f"{label}_p{p}": F.get(f"{side}_q", F.lit(i)) for i, p in enumerate((25, 50, 75, 95))}
    values |= {"users_below_minimum": F.col("u_few"), "cold_start_movies": F.col("cold")}
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v.cast("double"), 6).alias("value")) for k, v in values.items()])).alias("x")).select("x.*")


def histogram(interactions: DataFrame, value: str = "rating") -> DataFrame:
    return interactions.groupBy(value).agg(F.count("*").alias("n"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, xor, total): equal for equal bags of rows at any order and partitioning."""
    h = F.xxhash64(*[F.to_json(c) if df.schema[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("total"))
