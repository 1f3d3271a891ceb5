"""Token ids on disk: one shared zstandard dictionary, one frame for each document, and an offset index.

The store is a folder of two Parquet tables, so that any Hadoop file system can hold it and Spark's commit
protocol decides which attempt of a task counts:

``dictionary``  dict_hash string (sha256 hex), width int (bytes of an id), content binary
``blocks``      shard int, block int, first_start long, first_id/last_id long, dict_hash string,
                doc_ids array<long>, offsets array<int> (one more than documents), n_tokens array<int>,
                payload binary (the frames, one after another)

Documents ascend by id through shards, blocks and frames. A short document is read by its block alone
(first_id and last_id prune row groups) and one frame in it.

Null texts are empty documents (just the end id); null ids come first; rows with equal ids are all kept, in
order of their text, and need not fit into one task; an empty table gives an empty store. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship
from .tokens import PieceEncoder, default_vocabulary

BLOCKS = "shard int, block int, first_start long, first_id long, last_id long, dict_hash string, doc_ids array<long>, offsets array<int>, n_tokens array<int>, payload binary"
#: Bytes of frames in a block, and documents in it, at most (a single larger document has a block of its own).
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
#: The dictionary: bytes, documents it is trained on, and bytes of each that count.
DICT_BYTES, DICT_DOCS, DICT_DOC_BYTES = 64 << 10, 1200, 32 << 10


def serialized(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, width: int) -> bytes:
    """A dictionary from a bounded sample of documents, taken by a hash of id and text.

    Compression is all it bears on: every document is stored whole with any dictionary.
    """
    import zstandard

    total = docs.count()
    share = min(1.0, DICT_DOCS / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(vocabulary)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            own = [serialized(encoder.encode(t) + end, width)[:DICT_DOC_BYTES] for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(own, pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in sample.select("text").mapInArrow(encode, "ids binary").limit(2 * DICT_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on
        return b"".join(samples)[:DICT_BYTES]


def _dictionary(content: bytes):
    import zstandard

    if not content:
        return None
    trained = content[:4] == b"\x37\xa4\x30\xec"  # the format's magic number
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0) -> str:
    """Encodes docs (doc_id, text), appends end_id to each and writes a store at path."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = 2 if PieceEncoder.of(vocabulary).size <= 1 << 16 and end_id < 1 << 16 else 4
    content = train_dictionary(docs, vocabulary, end_id, width)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, width, bytearray(content))], "dict_hash string, width int, content binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = PieceEncoder.of(vocabulary)
        made = _dictionary(content)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=made) if made else zstandard.ZstdCompressor(level=3)
        end = end_id.to_bytes(4, "little")
        block, start, before = 0, 0, 0
        ids: list = []
        offsets, tokens, frames = [0], [], []

        def flush() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = {
                "shard": shard, "block": block, "first_start": start, "first_id": min(known, default=None), "last_id": max(known, default=None),
                "dict_hash": digest, "doc_ids": ids, "offsets": offsets, "n_tokens": tokens, "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=ARROW_BLOCKS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encoder.encode(text) + end
                frame = compressor.compress(serialized(raw, width))
                ids.append(doc)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                tokens.append(len(raw) // 4)
                before += len(raw) // 4
                if offsets[-1] >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    block, start = block + 1, before
                    ids, offsets, tokens, frames = [], [0], [], []
        if ids:
            yield flush()

    # The start of the text splits rows of one id; the order is that of id and text.
    ordered = docs.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


ARROW_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_start", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dict_hash", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int32())), ("payload", pa.binary()),
])


def _opened(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.content)).hexdigest() != row.dict_hash:
        raise ValueError(f"the dictionary in {path} does not have the hash it is stored under")
    return bytes(row.content), row.dict_hash, row.width


def _frames(content: bytes, digest: str, width: int):
    """A function from a block to (doc_id, ids as little-endian unsigned 32-bit bytes)."""
    import zstandard

    made = _dictionary(content)
    reader = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()

    def read(block: dict, only: int | None = None) -> Iterator[tuple[int | None, bytes]]:
        if block["dict_hash"] != digest:
            raise ValueError("a block was compressed with another dictionary")
        payload, offsets = memoryview(block["payload"]), block["offsets"]
        for k, doc in enumerate(block["doc_ids"]):
            if only is None or doc == only:
                raw = reader.decompress(payload[offsets[k] : offsets[k + 1]])
                yield doc, raw if width == 4 else np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()

    return read


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """For each stored document: doc_id, start (ids of all before it), n_tokens, ids_crc32."""
    ship(spark)
    content, digest, width = _opened(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One number for each shard, of which there are as many as writing tasks.
    totals = blocks.groupBy("shard").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n")).orderBy("shard").collect()
    bases, base = {}, 0
    for row in totals:
        bases[row.shard], base = base, base + row.n

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _frames(content, digest, width)
        for batch in batches:
            for block in batch.to_pylist():
                start, ids, starts, counts, sums = bases[block["shard"]] + block["first_start"], [], [], [], []
                for doc, raw in read(block):
                    ids.append(doc)
                    starts.append(start)
                    counts.append(len(raw) // 4)
                    sums.append(zlib.crc32(raw))
                    start += len(raw) // 4
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (ids, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("shard", "first_start", "dict_hash", "doc_ids", "offsets", "payload").mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id, by the offset index: one block is read, one frame decompressed."""
    content, digest, width = _opened(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    rows = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard", "block").collect()
    read = _frames(content, digest, width)
    return [np.frombuffer(raw, dtype="<u4").tolist() for r in rows for _, raw in read(r.asDict(), doc_id)]
