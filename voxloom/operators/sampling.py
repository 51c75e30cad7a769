"""Samples whose size is the feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strata by distance of a score from the threshold, and their shares of a sample.
QUOTAS = {"boundary": 0.45, "near": 0.30, "keep": 0.15, "drop": 0.10}


def stratified(rows: DataFrame, size: int, threshold: float = 0.35) -> DataFrame:
    """(id, stratum, place): ``size`` rows of (id, score) by quota, in the order of a hash of the id.

    Each stratum is cut by its own top-k, so no stratum is sorted as a whole; what a
    small stratum lacks is filled up from the others in order of the hash.
    """
    off = F.abs(F.coalesce("score", F.lit(0.0)) - threshold)
    stratum = F.when(off <= 0.05, "boundary").when(off <= 0.20, "near").when(F.col("score") >= threshold, "keep").otherwise("drop")
    mixed = rows.select("id", stratum.alias("stratum"), F.md5(F.col("id").cast("string")).alias("h"))
    parts = [mixed.filter(F.col("stratum") == s).orderBy("h", "id").limit(round(size * q)) for s, q in QUOTAS.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    rest = mixed.join(chosen.select("id"), "id", "left_anti").orderBy("h", "id").limit(size)
    filled = chosen.withColumn("turn", F.lit(0)).unionByName(rest.withColumn("turn", F.lit(1)))
    return filled.orderBy("turn", "h", "id").limit(size).select("id", "stratum")
