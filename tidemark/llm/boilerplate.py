"""Line dedup by site-relative frequency.

For each site: in what share of its pages does a line stand?  Lines above a ratio are
boilerplate of that site and are dropped from its pages.  A floor of a few pages keeps out what
two pages of a tiny site share by chance; it decides for sites of under ``least`` / ``ratio`` pages only.
Only built-in functions; lines are counted once a page before they are shuffled, as
128-bit digests, and counts are combined on the map side, so neither a large site nor
a line on all its pages lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .batches import free_name
from .lookup import left_lookup
from .scratch import cut


def _lines(text: F.Column) -> F.Column:
    return F.split(text, "\n")


def _digest(line: F.Column) -> F.Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate_lines(pages: DataFrame, ratio: float = 0.1, least: int = 3, host: str = "source", text: str = "text") -> DataFrame:
    """(host, digest, n, pages): lines on at least ``least`` pages and on more than ``ratio`` of the pages of their site.

    Lines are compared without spaces at their ends; blank lines are not counted.  Pages
    without a site are left out; a null text is a page without lines.
    """
    rows = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")).filter("host is not null")
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    marks = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _digest))
    counted = rows.select("host", F.explode(marks).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))


def drop_boilerplate(df: DataFrame, ratio: float = 0.1, least: int = 3, host: str = "source", text: str = "text") -> DataFrame:
    """``df`` with ``text`` cleaned, ``n_lines`` and ``n_dropped``.

    Blank lines stay.  Rows without a site, and null texts, stay as they are (``n_lines`` of a
    null text is 0).  A text of boilerplate only becomes empty.  Repeated rows are pages of
    their own and stay repeated.  Columns named ``n_lines`` or ``n_dropped`` are replaced.
    A site has at most (mean lines a page) / ``ratio`` boilerplate lines, so its list, which
    is joined to its pages, is bounded.
    """
    found = boilerplate_lines(df, ratio, least, host, text)
    bad, site = free_name(df, "__bad__"), free_name(df, "__host__")
    lists = cut(found.groupBy("host").agg(F.collect_set("digest").alias(bad)).withColumnRenamed("host", site))
    keep = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{host}`").alias(site))
    digests = lists.agg(F.sum(F.size(bad) + 4)).first()[0] or 0  # of 16 bytes
    joined = left_lookup(rows, lists, site, digests, limit=500_000)
    lines = _lines(F.col(f"`{text}`"))
    good = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(bad, _digest(x)))
    cleaned = F.when(F.col(bad).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(good, "\n"))
    n = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(lines))
    left = F.when(F.col(f"`{text}`").isNull(), 0).when(F.col(bad).isNull(), F.size(lines)).otherwise(F.size(good))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in keep], n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_dropped"))
