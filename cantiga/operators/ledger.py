"""The finance ledger and its reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantiga.sources.relation import join_to_sums

CATEGORY_KEYS = ["tipo", "grupo", "categoria"]


def active_ledger(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries whose group is active.

    A group listed twice lets its entries through once; one that holds a third of
    the entries is split.
    """
    active = groups.where("ativo").select(F.col("grupo").alias("key_0")).distinct()
    return join_to_sums(entries, active, ["grupo"], "inner")


def category_drift(entries: DataFrame, reference: DataFrame) -> DataFrame:
    """Combinations in use that the reference list does not have, with their entries."""
    used = entries.groupBy(*CATEGORY_KEYS).agg(F.count("*").alias("lancamentos"))
    known = reference.select(*CATEGORY_KEYS)
    same = [used[k].eqNullSafe(known[k]) for k in CATEGORY_KEYS]
    return used.join(known, same, "left_anti")
