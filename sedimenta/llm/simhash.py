"""SimHash near-duplicates with vantage-point trees.

Fingerprints link where at most ``RADIUS`` = 3 of 64 bits differ.  Then in one of the two 32-bit halves at most one bit differs, so each
half gets a vantage-point tree over its own Hamming distance, searched with radius 1, and every pair found is checked on all 64 bits.

A tree is built by the driver from a bounded sample of fingerprints and only routes: a fingerprint goes home to one leaf, left of a node if its
distance to the vantage point is at most the node's median, else right; by the triangle inequality a point within the radius can be
on the other side only if the distance is within the radius of the median, and then the fingerprint visits that side too.  A leaf (a shard of the
shuffle) compares home points with each other and with visitors, not visitors with each other.  Inside a large leaf the same pruning is repeated, and what no
vantage point splits is compared in blocks of bounded memory.  Only distinct fingerprints take part, and a leaf returns a spanning forest of its
links, not all pairs.  So the size of groups of copies does not matter, and no link between different fingerprints changes the components.
Depth and sample grow with the number of fingerprints up to a bound; a shard that is still too large for one task is dealt to several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_sized, narrow, pieces, with_row_ids

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Points of a shard while there are up to FEW shards a tree, and beyond that; the most levels; the sample's least size and its points for each leaf (so at most EACH << DEEPEST, about
#: a million); points that a shard compares without dividing them; rows above which a shard is dealt to several tasks.
LEAF, FEW, WIDE, DEEPEST, SAMPLE, EACH, INNER, FULL = 2048, 128, 1 << 16, 16, 20_000, 16, 2048, 2_000_000
SPACES = b" \t\n\x0b\x0c\r"


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Words of the text with A-Z lower-cased, shingles with repeats, XXH64 of each; a bit is 1 if it is set in over half of them."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    h64, n, seen = xxhash.xxh64_intdigest, 0, np.zeros((8, 256), "int64")
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        flat = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[: len(ends) - shingle]]]
        grams = (flat[s:e] for s, e in zip(starts, ends[shingle - 1 :], strict=True))
    while True:
        block = np.fromiter((h64(g, SEED) for g, _ in zip(grams, range(1 << 16), strict=False)), "uint64")
        if not len(block):
            break
        n += len(block)
        octets = block.view("uint8").reshape(-1, 8)
        for k in range(8):
            seen[k] += np.bincount(octets[:, k], minlength=256)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    ones = (seen @ bits).ravel()  # bit b of octet k at 8k + b
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed 64-bit integer; null texts count as empty, whose fingerprint is zero."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t or "") for rows in pieces([(t,) for t in batch.column(1).to_pylist()], lambda r: r[0]) for (t,) in rows], "uint64").view("int64")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _distance(a, b):
    import numpy as np

    return np.bitwise_count(a ^ b)


class VantageTree:
    """Nodes (point, median, left, right) over one half of the bits; a child that is not negative is a node, else leaf -1 - child."""

    def __init__(self, half, depth: int, seed: int = 0):
        import numpy as np

        self.nodes, self.leaves, rng = [], 0, np.random.default_rng(seed)

        def build(points, depth):
            if depth > 0 and len(points) >= 8:
                for vantage in rng.choice(points, 4):
                    d = _distance(points, vantage)
                    median = int(np.median(d))
                    near = d <= median
                    if 0.2 <= near.mean() <= 0.8:
                        at = len(self.nodes)
                        self.nodes.append(None)
                        self.nodes[at] = (int(vantage), median, build(points[near], depth - 1), build(points[~near], depth - 1))
                        return at
            self.leaves += 1
            return -self.leaves

        self.root = build(half, depth)

    def route(self, half, radius: int):
        """(index of the point, leaf, whether it is the point's home), for all points."""
        import numpy as np

        out = []
        stack = [(self.root, np.arange(len(half)), np.ones(len(half), bool))]
        while stack:
            at, idx, home = stack.pop()
            if not len(idx):
                continue
            if at < 0:
                out.append((idx, np.full(len(idx), -1 - at), home))
                continue
            point, median, left, right = self.nodes[at]
            d = _distance(half[idx], np.uint64(point)).astype("int64")
            near = d <= median
            go = d <= median + radius
            stack.append((left, idx[go], (home & near)[go]))
            go = d > median - radius
            stack.append((right, idx[go], (home & ~near)[go]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def _links(points, home, radius: int, block: int = 1024):
    """Index pairs of points within the radius, one of them at home at least, as found; a spanning forest is left of them.  Recursive vantage points above ``INNER`` points."""
    import numpy as np

    n = len(points)
    parent = np.arange(n)
    rng = np.random.default_rng(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    kept = []

    def join(i, j):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                kept.append((a, b))

    def compare(left, right):
        for s in range(0, len(left), block):
            x = left[s : s + block]
            for t in range(0, len(right), block):
                y = right[t : t + block]
                i, j = np.nonzero(_distance(points[x][:, None], points[y][None, :]) <= radius)
                join(x[i], y[j])

    def within(idx):
        at, guests = idx[home[idx]], idx[~home[idx]]
        for s in range(0, len(at), block):
            x = at[s : s + block]
            i, j = np.nonzero(np.triu(_distance(points[x][:, None], points[x][None, :]) <= radius, 1))
            join(x[i], x[j])
            compare(x, at[s + block :])
        compare(at, guests)

    def split(idx):
        for vantage in rng.choice(idx, 4):
            d = _distance(points[idx], points[vantage]).astype("int64")
            median = int(np.median(d))
            if 0.2 <= (d <= median).mean() <= 0.8:
                return d, median
        return None, 0

    stack = [np.arange(n)]
    while stack:
        idx = stack.pop()
        if not home[idx].any():
            continue
        d, median = split(idx) if len(idx) > INNER else (None, 0)
        if d is None:
            within(idx)
        else:
            stack += [idx[d <= median], idx[d > median]]
            left, right = idx[(d <= median) & (d > median - radius)], idx[(d > median) & (d <= median + radius)]
            compare(left[home[left]], right)
            compare(left[~home[left]], right[home[right]])
    return kept


def tree_depth(known: int) -> int:
    """Levels of the trees: ``LEAF`` points a shard at ``FEW`` shards or fewer, above that ``WIDE`` points a shard, up to ``DEEPEST`` levels."""
    depth = 0
    while depth < DEEPEST and known > (LEAF if 1 << depth < FEW else WIDE) << depth:
        depth += 1
    return depth


def fingerprint_links(distinct: DataFrame, known: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between different fingerprints that connect all that are linked.  ``distinct`` has each fp once, ``known`` is their number."""
    import numpy as np

    spark = distinct.sparkSession
    depth = tree_depth(known)
    share = min(0.5, max(SAMPLE, EACH << depth) / max(known, 1))
    drawn = distinct.where(F.pmod(F.xxhash64(F.col("fp").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toPandas()["fp"].to_numpy("int64").view("uint64")
    drawn.sort()
    near = radius // 2
    halves = [lambda x: x & np.uint64(0xFFFFFFFF), lambda x: x >> np.uint64(32)]
    trees = spark.sparkContext.broadcast([VantageTree(h(drawn), depth, k) for k, h in enumerate(halves)])

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy().view("uint64")
            if not len(fp):
                continue
            for k, tree in enumerate(trees.value):
                idx, leaf, home = tree.route(halves[k](fp), near)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * 2 + k, pa.int64()), pa.array(fp[idx].view("int64")), pa.array(home)], names=["shard", "fp", "home"])

    def search(pdf):
        import pandas as pd

        home = pdf["home"].to_numpy("bool")
        fp = pdf["fp"].to_numpy("int64").view("uint64")
        kept = _links(fp, home, radius) if home.any() else []
        a = np.array([x[0] for x in kept], "int64")
        b = np.array([x[1] for x in kept], "int64")
        fp = fp.view("int64")
        return pd.DataFrame({"a": np.minimum(fp[a], fp[b]), "b": np.maximum(fp[a], fp[b])})

    routed = distinct.select("fp").mapInArrow(route, "shard long, fp long, home boolean")
    if known > FULL:  # no shard can have more rows otherwise
        routed = cut(routed)
        large = routed.groupBy("shard").count().where(F.col("count") > FULL).select("shard", F.ceil(F.col("count") / FULL).cast("int").alias("blocks"))
        routed = split_large(routed, large)
    else:
        routed = routed.withColumn("pair", F.lit(0))
    return routed.groupBy("shard", "pair").applyInPandas(search, "a long, b long").distinct()


def split_large(routed: DataFrame, large: DataFrame) -> DataFrame:
    """``routed`` with a column pair: rows of ``large`` shards (there are fewer than the trees have leaves) are dealt to as many blocks as the shard needs, and each block goes to the pairs
    it forms with itself and the others, so that every two rows still meet, and no task gets more than about twice ``FULL`` rows."""
    both = routed.join(F.broadcast(large), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = F.transform(others, lambda k: F.least(k, F.col("own")) * F.col("blocks") + F.greatest(k, F.col("own")))
    return both.withColumn("own", own).select("shard", "fp", "home", F.explode(pair).alias("pair"))


def components(links: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, label) of every node of the undirected links (a, b), label being the smallest node reachable.

    Rounds of large-star and small-star until nothing changes; each is written to the shared checkpoint folder.  Their number grows with the logarithm of the longest path;
    ``most_rounds`` only guards against endless runs.  A hub of many links is one key of the grouping, whose minimum is combined before the shuffle, and rows of hubs get it from a broadcast.
    """
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"))
    before, known = None, edges.count()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        edges = join_sized(both.where("v > u"), low, ["u"], 2 * known).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        low = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        edges = join_sized(down, low, ["u"], 2 * known).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(edges)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, known = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(id, fp) of every row; (fp, n, component_id, label) of every fingerprint, both stored; the number of rows."""
    marked = cut(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id"))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    known = distinct.count()
    labels = cut(components(fingerprint_links(distinct, known)))
    member = cut(distinct.join(narrow(labels.withColumnRenamed("node", "fp"), known), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    least = cut(member.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    by_fp = cut(join_sized(member.select("fp", "label", F.col("n").alias("rows")), least, ["label"], known).select("fp", F.col("rows").alias("n"), "component_id", "label"))
    return marked, by_fp, marked.count()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 lowercase hex digits, and the smallest id reachable over links.

    Empty and null texts have fingerprint zero and link like any other.  Repeated ids give repeated rows; null ids are ignored by the
    minimum, so component_id is null only where all ids of a component are.  Extra columns are ignored.
    """
    marked, by_fp, n = _grouped(docs, id_col, text_col)
    out = join_sized(marked, by_fp, ["fp"], n)
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id (null ids come last; of repeated ids, one row).  Columns unchanged."""
    own, uid = with_row_ids(docs, id_col)
    if uid == id_col:
        marked, by_fp, n = _grouped(docs, id_col, text_col)
        lost = join_sized(marked, by_fp, ["fp"], n).where("doc_id <> component_id").select(F.col("doc_id").alias(uid))
    else:
        marked, by_fp, n = _grouped(own, uid, text_col)
        marked = join_sized(marked, by_fp, ["fp"], n).select(F.col("doc_id").alias("uid"), "label")
        marked = cut(marked.join(narrow(own.select(F.col(uid).alias("uid"), F.col(id_col).alias("o")), n), "uid"))
        order = F.struct(F.col("o").isNull(), F.col("o"), F.col("uid"))
        stay = cut(marked.groupBy("label").agg(F.min(order)["uid"].alias("stay"), F.count(F.lit(1)).alias("n")))
        lost = join_sized(marked, stay, ["label"], n).where("uid <> stay").select(F.col("uid").alias(uid))
    lost = cut(lost)
    return own.join(narrow(lost, lost.count()), uid, "left_anti").select(docs.columns)
