"""One record per key out of many claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(claims: DataFrame, key: str, generation: str, kind: str, value: str, strength: dict[str, int], order: Sequence[str]) -> DataFrame:
    """Of each key's claims of its greatest generation: the strongest kind, the value, and conflicts.

    Returns key, generation, kind, value, conflict, n_claims. The kind is the one with the greatest ``strength``
    (unknown kinds weigh 0), ties broken by ``order`` (greatest wins, null is least). The value is null if the
    claims of that generation name several; conflict tells so. A null generation is the least, null keys don't count.
    Two aggregations on the key; the first also on the generation, so a key with very many claims is combined
    map-side and split by generation.
    """
    weight = F.coalesce(F.create_map(*[x for k, v in strength.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)], F.lit(0)) if strength else F.lit(0)
    by = F.struct(weight.alias("w"), *order)
    each = claims.where(F.col(key).isNotNull()).groupBy(key, F.col(generation).alias("generation")).agg(
        F.max_by(F.col(kind), by).alias("kind"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n_claims")
    )
    top = each.groupBy(key).agg(F.max(F.struct(F.coalesce(F.col("generation"), F.lit(-1)).alias("g"), "generation", "kind", "lo", "hi", "n_claims")).alias("r"))
    return top.select(
        key, "r.generation", "r.kind", F.when(F.col("r.lo") == F.col("r.hi"), F.col("r.lo")).alias("value"),
        F.coalesce(F.col("r.lo") != F.col("r.hi"), F.lit(False)).alias("conflict"), "r.n_claims",
    )


def keep_sticky(old: DataFrame, new: DataFrame, key: str, kind: str, sticky: Sequence[str], generation: str) -> DataFrame:
    """New rows over old ones, except that a sticky kind of the same or a later generation stays.

    Both tables have unique keys and the same columns. Keys on one side only come through.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key)
    held = F.max(F.when((F.col("_new") == 0) & F.col(kind).isin(*sticky), F.col(generation))).over(w)
    incoming = F.max(F.when(F.col("_new") == 1, F.coalesce(F.col(generation), F.lit(-1)))).over(w)
    stays = held.isNotNull() & (held >= F.coalesce(incoming, F.lit(-1)))
    newest = F.max("_new").over(w)
    marked = both.withColumn("_keep", F.when(stays, 0).otherwise(newest))
    return marked.where("_new = _keep").drop("_new", "_keep")
