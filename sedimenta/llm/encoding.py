"""Piece encoding, decoding and token counts over DataFrames, with the transducer of :mod:`piece_fst`."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, pieces
from .piece_fst import PieceTransducer, fitting


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    """One compiled machine per Python worker and model."""
    return PieceTransducer(path)


def _arrow(df: DataFrame, per_block, schema: T.StructType, model_path: str) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def blocks(batches):
        for batch in batches:
            for rows in pieces(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: r[-1]):
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(per_block(rows), out, strict=True)], schema=out)

    def run(batches):
        try:
            yield from blocks(batches)
        finally:  # the worker stays for other stages
            if transducer.cache_info().currsize:
                transducer(model_path).forget()
            give_back()

    return df.mapInArrow(run, schema)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, round_trip) of every row.

    ids is the whole text's encoding; round_trip says whether decoding it gives the text again (a visible space U+2581 in a text comes back as a
    space, which does not count as a difference).  Null counts as empty, and an empty text has no ids.  Ids may be null or repeated;
    other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def block(rows):
        import numpy as np
        import pyarrow as pa

        m = transducer(model_path)
        packed = [m.encode_packed(t or "") for _, t in rows]
        ends = np.cumsum([0] + [len(p) // 4 for p in packed])
        same = [m.decode(memoryview(p).cast("i")) == (t or "").replace("▁", " ") for p, (_, t) in zip(packed, rows, strict=True)]
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "i4")))
        return [pa.array([r[0] for r in rows]), pa.array(np.diff(ends), pa.int64()), ids, pa.array(same)]

    return _arrow(docs.select(F.col(id_col), F.col(text_col)), block, schema, model_path)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give null."""
    kind = encoded.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        m = transducer(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else m.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)


def token_counts(docs: DataFrame, model_path: str, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, cut_chars) of every row; with ``prefixes``, prefix_counts as well: the token count of each prefix, from the empty one
    to the whole text, which cut_at() answers other budgets from.

    n_tokens is the count of the last prefix; over_limit says whether it exceeds ``budget``, and cut_chars is the number of characters
    of the longest prefix none of whose prefixes does (the whole length where it fits).  Null counts as empty.  Ids may be null or
    repeated; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("cut_chars", T.LongType()), *[T.StructField("prefix_counts", T.ArrayType(T.IntegerType()))] * prefixes])

    def block(rows):
        import numpy as np
        import pyarrow as pa

        m = transducer(model_path)
        texts = [r[1] or "" for r in rows]
        tokens, cuts, kept = [], [], []
        for t in texts:
            counts = m.prefix_counts(t)
            tokens.append(int(counts[-1]))
            cuts.append(fitting(counts, budget))
            if prefixes:
                kept.append(counts.astype("i4"))
        out = [pa.array([r[0] for r in rows]), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > budget for n in tokens], pa.bool_()), pa.array(cuts, pa.int64())]
        if prefixes:
            ends = np.cumsum([0, *map(len, kept)])
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(kept))))
        return out

    return _arrow(docs.select(F.col(id_col), F.col(text_col)), block, schema, model_path)


def cut_at(counted: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """(id, over_limit, cut_chars) for another budget, from the stored ``prefix_counts`` of token_counts(); nothing is encoded."""
    first = F.array_position(F.transform("prefix_counts", lambda n: n > budget), True)
    return counted.select(F.col(id_col), (F.element_at("prefix_counts", -1) > budget).alias("over_limit"), F.when(first > 0, first - 2).otherwise(F.size("prefix_counts") - 1).cast("long").alias("cut_chars"))
