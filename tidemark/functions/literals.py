"""Lists of records in a text cell, as JSON or as Python literals.

JSON is read by ``from_json``; only cells it can't read (None, True, single quotes with
escapes) go through one Arrow UDF with ``ast.literal_eval``.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .scalars import normalize_text, to_id

RECORD = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("iso_3166_1", T.StringType()), T.StructField("job", T.StringType())]))
_PARSED = T.StructType([T.StructField("status", T.StringType()), T.StructField("records", RECORD)])


@F.pandas_udf(_PARSED)
def _literal(cells: pd.Series) -> pd.DataFrame:
    def one(cell: str | None) -> tuple[str, list[dict]]:
        try:
            value = ast.literal_eval(cell)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return "malformed", []
        if not isinstance(value, list):
            return "wrong_type", []
        text = lambda x: None if x is None else str(x)
        rows = [{k: text(r.get(k)) for k in ("id", "name", "iso_3166_1", "job")} for r in value if isinstance(r, dict)]
        return ("filled" if rows else "empty"), rows

    return pd.DataFrame([one(c) for c in cells], columns=["status", "records"])


def parse_records(df: DataFrame, cell: str) -> DataFrame:
    """``df`` with ``records`` (array of id, name, iso_3166_1, job) and ``status``: filled, empty, missing, malformed or wrong_type.

    Whatever fails gives an empty list; elements that are not records are left out.
    """
    c = F.col(cell)
    none = F.array().cast(RECORD)
    easy = F.when(F.trim(c).startswith("[") & ~c.contains("'") & ~F.contains(c, F.lit("None")) & ~F.contains(c, F.lit("True")) & ~F.contains(c, F.lit("False")), F.from_json(c, RECORD))
    rows = df.withColumn("_json", easy)
    hard = F.when(F.col("_json").isNull() & c.isNotNull(), _literal(F.when(F.col("_json").isNull() & c.isNotNull(), c)))
    rows = rows.withColumn("_hard", hard)
    known = F.filter(F.coalesce("_json", none), lambda x: x.isNotNull())
    status = F.when(c.isNull(), "missing").when(F.col("_json").isNotNull(), F.when(F.size(known) > 0, "filled").otherwise("empty")).otherwise(F.col("_hard.status"))
    records = F.when(F.col("_json").isNotNull(), known).otherwise(F.coalesce("_hard.records", none))
    return rows.withColumn("status", status).withColumn("records", records).drop("_json", "_hard")


def _first_of_each(df: DataFrame, key: str, fold: Column, keep: list[Column]) -> DataFrame:
    items = df.select(key, F.posexplode("records").alias("pos", "r"))
    order = W.partitionBy(key, fold).orderBy("pos")
    return items.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(key, "pos", *keep)


def names(parsed: DataFrame, key: str) -> DataFrame:
    """(key, pos, name): normalised names, each once in any case, first spelling."""
    name = normalize_text(F.col("r.name"))
    return _first_of_each(parsed, key, F.lower(name), [name.alias("name")]).filter("name is not null")


def companies(parsed: DataFrame, key: str) -> DataFrame:
    """(key, pos, company_id, company), each id and name once."""
    name, ident = normalize_text(F.col("r.name")), to_id(F.col("r.id"))
    return _first_of_each(parsed, key, F.struct(ident, F.lower(name)), [ident.alias("company_id"), name.alias("company")]).filter("company is not null")


def countries(parsed: DataFrame, key: str) -> DataFrame:
    """(key, pos, country_code, country): the code in upper case; the name falls back to it; rows without both are left out."""
    code, name = F.upper(normalize_text(F.col("r.iso_3166_1"))), normalize_text(F.col("r.name"))
    shown = F.coalesce(name, code)
    return _first_of_each(parsed, key, F.struct(code, F.lower(shown)), [code.alias("country_code"), shown.alias("country")]).filter("country is not null")


def _each_once(items: Column, fold) -> Column:  # noqa: ANN001
    """The elements of an array whose folded form isn't met before."""
    folded = F.transform(items, fold)
    return F.filter(items, lambda x, i: F.array_position(folded, fold(x)) == i + 1)


def name_list(records: Column) -> Column:
    """As ``names``, in the row: an array in the order of the cell."""
    found = F.filter(F.transform(records, lambda r: normalize_text(r["name"])), lambda x: x.isNotNull())
    return _each_once(found, F.lower)


def company_list(records: Column) -> Column:
    """As ``companies``: the names, each id and name once."""
    found = F.filter(F.transform(records, lambda r: F.struct(to_id(r["id"]).alias("id"), normalize_text(r["name"]).alias("name"))), lambda x: x["name"].isNotNull())
    return F.transform(_each_once(found, lambda x: F.struct(x["id"].alias("id"), F.lower(x["name"]).alias("name"))), lambda x: x["name"])


def country_list(records: Column) -> Column:
    """As ``countries``: the shown names, each code and name once."""
    shown = lambda r: F.struct(F.upper(normalize_text(r["iso_3166_1"])).alias("code"), F.coalesce(normalize_text(r["name"]), F.upper(normalize_text(r["iso_3166_1"]))).alias("name"))
    found = F.filter(F.transform(records, shown), lambda x: x["name"].isNotNull())
    return F.transform(_each_once(found, lambda x: F.struct(x["code"].alias("code"), F.lower(x["name"]).alias("name"))), lambda x: x["name"])
