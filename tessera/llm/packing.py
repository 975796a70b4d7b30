"""Packing tokenized documents by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import documents, numbered, written

_LOADED: dict[str, tuple] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, ranks: str | None = None):
    """A function from a text to its ids, loaded once in a worker.

    ``ranks`` names the same vocabulary as a file of ranks, which a faster library reads; the ids are the same. A text
    that holds the vocabulary's special token goes to the tokenizer itself.
    """
    if (path, ranks) not in _LOADED:
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(path)
        special = [str(t.content) for t in full.get_added_tokens_decoder().values()]
        slow = lambda text: full.encode(text, add_special_tokens=False).ids
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            plain = fast.encode_ordinary
            _LOADED[path, ranks] = lambda text: slow(text) if any(s in text for s in special) else plain(text)
        else:
            _LOADED[path, ranks] = slow
    return _LOADED[path, ranks]


def binary_pieces(length: int, longest: int) -> list[int]:
    """Piece lengths of a document: as many of ``longest`` as fit, then the powers of two that make up the rest."""
    rest = length % longest
    return [longest] * (length // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Cut every document into pieces of 2^k tokens (2^k <= ``longest``) and bucket pieces of equal length.

    A sequence is one piece, so no sequence crosses documents and none has padding: its length is a power of two, and
    a batch is drawn from one bucket. ``sequence_id`` numbers the sequences bucket by bucket, longest first, without
    gaps, and ``offset`` is 0 in each. ``longest`` must be a power of two. ``end_id`` ends each document.

    A null text counts as empty: one piece with ``end_id`` alone. Rows that repeat, and null ids, are packed as often as
    they stand; an empty table gives an empty one. Columns but id and text aren't read.
    Texts are tokenized one at a time and whole. ``with_ids`` adds the ids of each piece. Returns doc_id, start,
    length, ids_crc32, doc_tokens, bucket, sequence_id, offset.
    """
    schema = PIECE.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                start = 0
                for n in binary_pieces(len(ids), longest):
                    piece = ids[start : start + n]
                    rows.append((key, start, n, zlib.crc32(piece.tobytes()), len(ids), *([piece.astype(np.int32)] if with_ids else [])))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, kind)
    pieces = written(pieces, "pieces").withColumn("bucket", F.round(F.log2("length")).cast("int"))
    pieces = pieces.withColumn("group", F.lit(longest.bit_length() - 1) - F.col("bucket"))
    within = numbered(pieces, "group", [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "in_bucket")
    before = pieces.groupBy("group").agg(F.count(F.lit(1)).alias("n"))  # one row for each power of two
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(F.col("group").alias("own"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    out = within.join(F.broadcast(before), F.col("group") == F.col("own"))
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", (F.col("base") + F.col("in_bucket")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else [])
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary(), vocabulary("byte_bpe_50k.tiktoken"))
