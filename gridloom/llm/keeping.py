"""Which rows of a table stay, and joins in which one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch, fresh_name

#: A key with more than one in so many of the rows is frequent; so there are fewer frequent keys than this.
SHARE = 1000


def join_by_key(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows with what groups (a written table, a row for each key) says of their key; count: how many rows have the key.

    Fewer than SHARE keys can have more than one in SHARE of the rows. Those few are broadcast, so that a frequent key's rows
    stay where they are; the others meet in a join whose largest key is a small share.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    (flag,) = fresh_name(rows, "frequent")
    few = groups.filter(F.col(count) * SHARE > total).drop(count).withColumn(flag, F.lit(True))
    told = rows.join(F.broadcast(few), key, "left")
    rest = told.filter(F.col(flag).isNull()).select(*rows.columns).join(groups.drop(count), key)
    return told.filter(flag).drop(flag).unionByName(rest)


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs as a written table whose rows are numbered, and the name of the number."""
    (rid,) = fresh_name(docs, "row_id")
    return scratch.keep(docs.withColumn(rid, F.monotonically_increasing_id()), "rows"), rid


def least_of_each(rows: DataFrame, rid: str, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Of a written table's rows those with the least (doc_id, rid) of their component, without rid.

    found: rid and component of every row. Rows without a doc_id can't be named and all stay.
    """
    named = rows.select(rid, "doc_id").filter(F.col("doc_id").isNotNull()).join(found, rid)
    kept = named.groupBy("component").agg(F.min(F.struct("doc_id", rid)).alias("least")).select(F.col("least")[rid].alias(rid))
    kept = rows.join(scratch.keep(kept, "kept"), rid, "left_semi").select(*rows.columns)
    return kept.unionByName(rows.filter(F.col("doc_id").isNull())).drop(rid)
