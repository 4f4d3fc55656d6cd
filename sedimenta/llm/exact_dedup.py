"""Exact duplicates by distributed MSD radix partitioning.

Texts are compared as UTF-8 byte strings.  Round ``r`` looks at the next ``width_r`` bytes of every text that still
shares all earlier bytes with another one, and splits its group by them.  A group with one member is finished; so is
a group whose digit is shorter than the width: its texts have ended and are equal.  Everything else goes to the next
round, with a digit ``GROWTH`` times as wide (up to ``WIDEST``), so the number of rounds grows with the logarithm of
the longest shared prefix until digits are widest.  Equality is decided by the bytes alone, no digest takes part.

The source is scanned twice.  The first scan stores each row's first digit; the second fetches what is left of the texts
whose first digit another one shares, and stores it; later rounds cut their digits from there.  Only row ids, group ids and digits are shuffled (texts only where
over ``BROADCAST_ROWS`` rows are fetched).
Rows of a hot group and digit are dealt to several tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_sized, narrow, with_row_ids

FIRST_WIDTH, GROWTH, WIDEST = 32, 16, 1 << 16
#: The most hashes that can be hot, and the rows of one that never are.
HOT_KEYS, HOT_ROWS = 10_000, 64


def _data(text_col: str) -> Column:
    return F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")


def first_digits(docs: DataFrame, uid: str, text_col: str, width: int, *more: Column) -> DataFrame:
    """(uid, digit, ...) of every row, stored: all that the first round and the result need of finished rows."""
    return cut(docs.select(F.col(uid).cast("long").alias("uid"), F.substring(_data(text_col), 1, width).alias("digit"), *more))


def split_groups(rows: DataFrame, known: int) -> DataFrame:
    """(uid, gid, ended) of those of ``rows`` (uid, gid, digit, ended) that share group and digit with another one; the new gid is the smallest uid among them.

    One shuffle of the digits: a window over group and digit finds the smallest uid.  Where more than ``most`` rows have one hash of group and digit (a hash only deals rows to tasks), they are
    dealt to several salts, and then the salts' smallest uids are compared by group and digit.  There are at most HOT_KEYS such hashes and two salts for each ``most`` rows, so what is broadcast is bounded.
    """
    most = max(HOT_ROWS, math.ceil(known / HOT_KEYS))
    rows = rows.withColumn("h", F.xxhash64("gid", "digit"))
    hot = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("h", F.ceil(F.col("n") / most).cast("long").alias("salts"))
    rows = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", F.pmod(F.xxhash64("uid"), F.coalesce("salts", F.lit(1).cast("long"))))
    same = Window.partitionBy("gid", "digit", "salt")
    rows = rows.withColumn("rep", F.min("uid").over(same)).withColumn("n", F.count(F.lit(1)).over(same)).where("n > 1 or salts is not null")
    chief = F.col("salts").isNotNull() & (F.col("uid") == F.col("rep"))
    rows = cut(rows.select("uid", "rep", "n", "ended", chief.alias("chief"), F.when(chief, F.col("gid")).alias("gid"), F.when(chief, F.col("digit")).alias("digit")))
    same = Window.partitionBy("gid", "digit")
    chiefs = rows.where("chief").select("rep", F.min("uid").over(same).alias("first"), F.sum("n").over(same).alias("total"))
    out = rows.join(F.broadcast(chiefs), "rep", "left").where(F.coalesce("total", "n") > 1)
    return cut(out.select("uid", F.coalesce("first", "rep").alias("gid"), "ended"))


def equal_groups(docs: DataFrame, uid: str, text_col: str, heads: DataFrame, first_width: int = FIRST_WIDTH, growth: int = GROWTH, widest: int = WIDEST) -> DataFrame:
    """(uid, gid) of every row whose text equals another row's; gid is the smallest uid among the equal texts.  ``heads``: first_digits() of the same width."""
    rows, known = heads.select("uid", F.lit(0).cast("long").alias("gid"), "digit"), heads.count()
    at, width, left, done = 0, first_width, None, None
    while True:
        step = split_groups(rows.withColumn("ended", F.length("digit") < width), known)
        ended = step.where("ended").select("uid", "gid")
        done = ended if done is None else done.unionByName(ended)
        active = step.where("not ended").select("uid", "gid")
        known = active.count()
        if not known:
            return done
        at += width
        if left is None:
            left = docs.select(F.col(uid).cast("long").alias("uid"), _data(text_col).alias("data")).join(narrow(active.select("uid"), known), "uid")
            left, skipped = cut(left.select("uid", F.expr(f"substring(data, {at + 1})").alias("rest"))), at
        width = min(width * growth, widest)
        rows = left.select("uid", F.substring("rest", at - skipped + 1, width).alias("digit")).join(narrow(active, known), "uid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_width: int = FIRST_WIDTH, **widths) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty.  Of equal texts the row with the largest id stays; rows with
    that same id and the same text (repeated rows) all count as kept, as nothing tells them apart.  Null ids sort below others, and
    keep_id is null if all ids of a group are.  Extra columns are ignored; an empty table gives an empty result.
    """
    docs, uid = with_row_ids(docs, id_col)
    heads = first_digits(docs, uid, text_col, first_width, F.col(id_col).alias("doc_id"), F.unhex(F.sha2(_data(text_col), 256)).alias("sha"))
    groups = cut(equal_groups(docs, uid, text_col, heads, first_width, **widths))
    n = groups.count()
    if uid == id_col:
        members = groups.withColumn("doc_id", F.col("uid"))
    else:
        members = heads.select("uid", "doc_id").join(narrow(groups, n), "uid")
    sums = cut(members.groupBy("gid").agg(F.max("doc_id").alias("largest"), F.count(F.lit(1)).alias("n")))
    members = join_sized(groups, sums, ["gid"], n).select("uid", "largest", "n")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    out = heads.join(narrow(members, n), "uid", "left")
    return out.select(F.col("doc_id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an equal text with a larger id replaces (one row of each repeated row stays); columns unchanged."""
    own, uid = with_row_ids(docs, id_col)
    heads = first_digits(own, uid, text_col, FIRST_WIDTH, F.col(id_col).alias("o"))
    groups = cut(equal_groups(own, uid, text_col, heads))
    n = groups.count()
    members = cut(heads.select("uid", "o").join(narrow(groups, n), "uid"))
    order = F.struct(F.col("o").isNotNull(), F.col("o"), F.col("uid"))
    stay = cut(members.groupBy("gid").agg(F.max(order)["uid"].alias("stay"), F.count(F.lit(1)).alias("n")))
    lost = cut(join_sized(members, stay, ["gid"], n).where("uid <> stay").select(F.col("uid").alias(uid)))
    return own.join(narrow(lost, lost.count()), uid, "left_anti").select(docs.columns)
