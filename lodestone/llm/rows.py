"""Joins of rows with what is known of their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import Scratch

#: Groups of more rows are dealt out in SALTS parts.
HOT, SALTS = 200, 64


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    prefix = "_k"
    while any(f"{prefix}_{n}".lower() in taken for n in names):
        prefix += "k"
    return [f"{prefix}_{n}" for n in names]


def with_group(rows: DataFrame, groups: DataFrame, on: list[str], salt: str, size: str = "size") -> DataFrame:
    """rows with the column g, a struct of the other columns of their group, or null where there is none.

    groups has a row for each group, with how many rows it has in the column size; on are not null. Rows of a group
    of more than HOT rows meet their group in SALTS parts, by the hash of the column salt, so that no task gets a whole one.
    """
    told = groups.select(*on, size, F.struct(*(c for c in groups.columns if c not in on)).alias("_g"))
    hot = told.where(F.col(size) > HOT).select(*on, F.col("_g").alias("_hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    # A literal would leave the keys of the join, and then a whole group would be dealt to one task again.
    cold = told.where(F.col(size) <= HOT).select(*on, F.col("_g").alias("_cold"), F.when(F.col(size) <= HOT, -1).otherwise(0).alias("_part"))
    part = F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")
    out = rows.withColumn("_part", part).join(hot, [*on, "_part"], "left")
    # Rows that met their group are dealt out as before; no other group has their part.
    out = out.withColumn("_part", F.when(F.col("_hot").isNull(), -1).otherwise(F.col("_part"))).join(cold, [*on, "_part"], "left")
    return out.withColumn("g", F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_part")


def keep_rows(docs: DataFrame, verdicts: DataFrame, key: Column, scratch: Scratch) -> DataFrame:
    """docs without the rows that verdicts (doc_id, text_key, kept) drop; all columns of docs stay.

    key is text_key's expression over docs. Rows of docs that agree in doc_id and key have the same text. They go
    if no verdict on them is kept; otherwise the one whose columns come first as JSON stays for those dropped.
    """
    id_, text, one_row = unused(docs, "id", "text", "row")
    groups = verdicts.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.min("kept").alias("all_kept"))
    groups = scratch.save(groups.where("not all_kept"), "dropped")

    def matching(some: DataFrame, how: str) -> DataFrame:
        k = some.select(F.col("doc_id").alias(id_), F.col("text_key").alias(text))
        return docs.join(k.hint("merge"), docs["doc_id"].eqNullSafe(F.col(id_)) & key.eqNullSafe(F.col(text)), how)

    out = matching(groups, "left_anti")
    again = groups.where("kept")
    if again.isEmpty():
        return out
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = matching(again, "left_semi").groupBy("doc_id", key.alias(text)).agg(F.min_by(row, F.to_json(row)).alias(one_row))
    return out.unionByName(one.select(f"{one_row}.*"))
