"""Mixing sources to target weights by Poisson replication.

A source of n of N rows and target weight w gets the mean repetition rate w * N / n.  Each row draws a uniform number from a hash of seed and id and
inverts the Poisson distribution of its source's rate; it is repeated that many times, and all copies are shuffled
globally by a second hash.  A rate above ``PART`` is divided into equal parts, each with a draw of its own: the sum of independent Poisson numbers is one of the summed rate, so counts are
as exact, no table grows with the rate, and the work for a row stays in proportion to its copies.  Draws depend on nothing but seed and id, so tasks can be run again and rows keep their counts when other
rows come or go (but for the change of rate).  Only a count for each source is gathered, combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, free_name, join_sized, with_row_ids

#: The largest rate that is inverted at once, and the bytes of its table of chances (under 200 numbers).
PART, TABLE_BYTES = 64, 1600


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, power: float) -> tuple[DataFrame, int, int]:
    """(mix_source, n, rate, mix_parts, mix_cdf) of each source, their number and that of all rows; a row's rate is divided into mix_parts parts, and mix_cdf[k] is the chance that a part gives k copies or fewer."""
    n = cut(docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    if weights is None:
        weight = F.pow("n", F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    n = n.withColumn("w", weight)
    sums = n.agg(F.sum("n"), F.sum("w"), F.count(F.lit(1))).first()
    if sums[2] and not sums[1]:
        raise ValueError("no source has a weight")
    n = n.select("mix_source", "n", (F.col("w") / F.lit(sums[1]) * F.lit(sums[0]) / F.col("n")).alias("rate"))
    n = n.withColumn("mix_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("part", F.col("rate") / F.col("mix_parts"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("part") + 12 * F.sqrt("part") + 30).cast("int"))
    start = F.struct((-F.col("part")).alias("log_p"), F.array(F.exp(-F.col("part"))).alias("cdf"))

    def step(acc, k):
        log_p = acc["log_p"] + F.log("part") - F.log(k.cast("double"))
        return F.struct(log_p.alias("log_p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(log_p))).alias("cdf"))

    cdf = F.when(F.col("part") > 0, F.aggregate(steps, start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))
    return cut(n.select("mix_source", "n", "rate", "mix_parts", cdf.alias("mix_cdf"))), sums[2], int(sums[0] or 0)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", add: tuple[str, str, str] = ("copy", "n_copies", "shuffle_key")) -> DataFrame:
    """Rows of ``docs``, each as often as drawn, in a global random order, with copy (0, 1, ...), n_copies and shuffle_key (the order).

    Target weights come from ``weights``, or are in proportion to n**power of a source's n rows (0: equal, 1: as they are).  Sources without a
    weight go.  Null is a source of its own; null ids draw as an empty id, and repeated rows draw alike, but go to different places of the order's partitions.  ``add`` names the
    added columns; columns of ``docs`` with these names are replaced.
    """
    docs, uid = with_row_ids(docs.drop(*add), id_col)
    copy, n_copies, shuffle_key = add
    rate, few, total = rates(docs, source_col, weights, power)
    cdf, parts, key = free_name(docs, "mix_cdf"), free_name(docs, "mix_parts"), free_name(docs, "mix_source")
    # null becomes a text of its own, so that sources join as plain keys
    name = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    rate = rate.select(name("mix_source").alias(key), F.col("n").alias("mix_n"), F.col("mix_cdf").alias(cdf), F.col("mix_parts").alias(parts))
    given = docs.withColumn(key, name(source_col))
    if few * TABLE_BYTES <= BROADCAST_BYTES:
        drawn = given.join(F.broadcast(rate.drop("mix_n")), key)
    else:
        drawn = join_sized(given, rate, [key], total, TABLE_BYTES, "mix_n")
    one = lambda u: F.size(F.filter(cdf, lambda c: c < u)).cast("long")
    rest = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col(parts))), F.lit(0).cast("long"), lambda s, k: s + F.when(k <= F.col(parts), one(uniform(F.lit(seed), F.col(id_col), k))).otherwise(0))
    count = one(uniform(F.lit(seed), F.col(id_col))) + F.when(F.col(parts) > 1, rest).otherwise(0)
    drawn = drawn.withColumn(n_copies, count).where(F.col(n_copies) > 0)
    out = drawn.select(*docs.columns, n_copies, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_copies) - 1)).alias(copy))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(copy).cast("string")))
    out = out.withColumn(shuffle_key, order)
    if uid == id_col:
        return out.repartition(shuffle_key).sortWithinPartitions(shuffle_key)
    return out.repartition(shuffle_key, uid).sortWithinPartitions(shuffle_key, uid).drop(uid)
