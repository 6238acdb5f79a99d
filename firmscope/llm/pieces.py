"""SentencePiece encoding and decoding with a distinct-chunk table.

When no piece of a BPE model holds a whitespace marker behind another
character, merges never cross the start of a marked word. A text then splits
into chunks (a run of markers and what follows it), each distinct chunk is
segmented once by the sentencepiece library, and the ids are joined back by
position. The table lives in the task; it is emptied when it holds
``table_entries`` chunks, which changes speed only.

Rows: a null text is the empty text (no ids, empty decoding). Empty table:
empty result. Very long texts: their ids are held by the task that has the row.
There are no ties. Repeated rows: one output row each. Extra columns are not read;
the result has the id column, ``ids`` and ``decoded``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_CHUNKS = re.compile(f"[ {MARK}]+[^ {MARK}]*")
#: Rows of an Arrow batch handled at a time, so that memory follows a slice of texts, not a batch.
SLICE_ROWS = 500


def model_bytes(model_path: str) -> bytes:
    """The model file, read once by the caller and sent along with the task
    (executors need not share a folder with the driver). A vocabulary's size
    does not depend on the corpus."""
    with open(model_path, "rb") as f:
        return f.read()


def check_markers(proto: bytes) -> None:
    """Raise unless chunks can be segmented apart: no normalisation, a dummy
    prefix, and markers only at the start of pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(proto)
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("the chunk table needs a model with the identity normaliser and a dummy prefix")
    if any(MARK in p.piece.lstrip(MARK) for p in model.pieces):
        raise ValueError("a piece crosses a whitespace marker; chunks cannot be segmented apart")


class ChunkTable:
    """ids of each distinct chunk; a chunk starts with at least one marker."""

    def __init__(self, proto: bytes, entries: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.entries = entries
        self.ids: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [_CHUNKS.findall(" " + t) if t else [] for t in texts]
        if len(self.ids) > self.entries:
            self.ids = {}
        new = list({c for chunks in split for c in chunks if c not in self.ids})
        # encode() puts the first marker back; a lone marker would be an empty text
        for chunk, ids in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1)):
            self.ids[chunk] = ids if len(chunk) > 1 else [self.sp.piece_to_id(MARK)]
        get = self.ids.__getitem__
        return [list(chain.from_iterable(map(get, chunks))) for chunks in split]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", table_entries: int = 500_000) -> DataFrame:
    """(id, ids, decoded): the ids of every text and what they decode to."""
    proto = model_bytes(model_path)
    check_markers(proto)
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(proto, table_entries)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = table.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(table.sp.decode(ids), pa.string())],
                    names=["key", "ids", "decoded"],
                )

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def id_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of an encoded table."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
