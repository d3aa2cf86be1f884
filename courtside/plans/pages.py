"""Rows written as landed pages and documents, which stay short however many rows a key has."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a page, about.
PAGE_ROWS = 200


def dealt(rows: DataFrame, keys: list[str], by: str, most: int = PAGE_ROWS) -> DataFrame:
    """``rows`` with ``page``: the rows of a key lie on as many pages as it has rows for, dealt by the hash of ``by``.

    Rows are counted by key first, in sums that are combined before the shuffle. A null in a key is a key.
    """
    pages = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.ceil(F.count("*") / most).alias("__pages"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    page = F.pmod(F.xxhash64(by, F.lit("page")), F.col("__pages")).cast("int")
    return rows.join(pages, same).withColumn("page", page).drop("__pages", *[f"__{k}" for k in keys])


def listed(rows: DataFrame, keys: list[str], order: str, tr: Column, most: int = PAGE_ROWS) -> DataFrame:
    """``(*keys, page, trs)``: the rows of each page one after another."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__tr").alias("tr"))))
    paged = dealt(rows.withColumn("__tr", tr), keys, order, most)
    return paged.groupBy(*keys, "page").agg(F.array_join(F.transform(pairs, lambda r: r["tr"]), "").alias("trs"))


def document(rows: DataFrame, keys: list[str], by: str, item: Column, most: int = PAGE_ROWS) -> DataFrame:
    """``(*keys, page, body)``: the items of each page as the ``data`` of a JSON document."""
    paged = dealt(rows.withColumn("__item", item), keys, by, most)
    return paged.groupBy(*keys, "page").agg(F.to_json(F.struct(F.collect_list("__item").alias("data"))).alias("body"))
