"""Token files: documents as coded id blocks in binary shards, in ascending order of document id.

Documents are range-partitioned by id and sorted, each partition writes one or more shards (a document never spans two),
and a small table says which shards there are. A shard is

    magic, u32 version, u32 header bytes, u32 crc32 of the header,
    header: u32 block size, u32 blocks, u64 documents, u64 bytes of the document table, u64 bytes of the order-0 model,
            per block u32 ids, u32 bytes, u32 crc32 of the ids, u32 crc32 of the bytes,
            the document table (zlib): i64 ids, then u64 sizes,
            the order-0 model that every block starts from (zlib),
    the blocks' bytes: of each stripe u16 words, then the stripes' words (u32).

With the header, each block decodes alone, and is checked twice. Files are written under a name of the attempt and then
moved, so a task that runs again leaves the same file. They go to shared storage through pyarrow's file systems.

Defined cases: a null or empty text is the end id alone; a null document id comes first (kept as the smallest integer in the
file); rows that repeat are documents of their own, ordered by their text; other columns are left; no rows, no shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import settle, shared_path
from spindrift.llm.mixing_coder import BLOCK, Prior, checksum, decode_blocks, encode_blocks
from spindrift.llm.word_bpe import default_tokenizer, slices, word_bpe

MAGIC, VERSION = b"SPMIXER\n", 3
#: Ids of a shard, about, and ids decoded side by side.
SHARD_IDS = 10_000_000
NULL_ID = -(2**63)
MANIFEST = "part int, shard int, path string, n_docs long, n_ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def shard_bytes(doc_ids: list[int], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    prior = Prior.of(ids)
    coded, model = encode_blocks(ids, prior), prior.to_bytes()
    rows = [(len(part := ids[k * BLOCK : (k + 1) * BLOCK]), len(c), checksum(part), zlib.crc32(c)) for k, c in enumerate(coded)]
    docs = zlib.compress(np.array(doc_ids, "<i8").tobytes() + np.asarray(sizes).astype("<u8").tobytes())
    header = struct.pack("<IIQQQ", BLOCK, len(coded), len(doc_ids), len(docs), len(model)) + np.array(rows, "<u4").tobytes() + docs + model
    return b"".join([MAGIC, struct.pack("<III", VERSION, len(header), zlib.crc32(header)), header, *coded])


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, their sizes, all ids); ValueError where a checksum does not hold."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    version, size, crc = struct.unpack_from("<III", data, 8)
    header = data[20 : 20 + size]
    if version != VERSION or zlib.crc32(header) != crc:
        raise ValueError("the shard's header is damaged")
    block, n_blocks, n_docs, table, model = struct.unpack_from("<IIQQQ", header)
    rows = np.frombuffer(header, "<u4", n_blocks * 4, 32).reshape(-1, 4)
    after = 32 + 16 * n_blocks
    docs, prior = zlib.decompress(header[after : after + table]), Prior.from_bytes(header[after + table : after + table + model])
    doc_ids, sizes = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    at, parts = 20 + size, []
    lanes = max(1, SHARD_IDS // block)
    for first in range(0, n_blocks, lanes):
        own, coded = rows[first : first + lanes], []
        for k, (_, length, _, crc) in enumerate(own.tolist()):
            coded.append(data[at : at + length])
            at += length
            if zlib.crc32(coded[-1]) != crc:
                raise ValueError(f"block {first + k} of the shard is damaged")
        ids = decode_blocks(coded, own[:, 0].tolist(), prior)
        ends = np.cumsum(own[:, 0])
        for k, (n, _, crc, _) in enumerate(own.tolist()):
            if checksum(ids[ends[k] - n : ends[k]]) != crc:
                raise ValueError(f"block {first + k} of the shard decodes to other ids")
        parts.append(ids)
    return doc_ids, sizes, np.concatenate(parts) if parts else np.empty(0, np.uint16)


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards, and return their table (part, shard, path, n_docs, n_ids), in order of part and shard."""
    target, model = path or shared_path(docs.sparkSession, "tokens"), tokenizer or default_tokenizer()

    def write(batches):
        part, encoder = TaskContext.get().partitionId(), word_bpe(model)
        fs, root = _filesystem(target)
        fs.create_dir(root)
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        shard = n = 0

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                held.append(([NULL_ID if i is None else i for i in ids_of[a:b]], sizes, ids))
                n += len(ids)
                if n >= SHARD_IDS:
                    yield write_shard(fs, root, part, shard, held)
                    held, n, shard = [], 0, shard + 1
        if held:
            yield write_shard(fs, root, part, shard, held)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return settle(ordered.mapInArrow(write, MANIFEST), "shards")


def write_shard(fs, root: str, part: int, shard: int, held: list) -> pa.RecordBatch:
    """Write one file, under an own name first, and say what it holds."""
    doc_ids = [i for h in held for i in h[0]]
    ids = np.concatenate([h[2] for h in held])
    name = f"part-{part:06d}-{shard:06d}.mix"
    own = f"{root}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(shard_bytes(doc_ids, np.concatenate([h[1] for h in held]), ids))
    fs.move(own, f"{root}/{name}")
    return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": f"{root}/{name}", "n_docs": len(doc_ids), "n_ids": len(ids)}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))


def read_tokens(spark, shards: DataFrame, root: str) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32, all long."""

    def read(batches):
        fs, _ = _filesystem(root)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f:
                    doc_ids, sizes, ids = read_shard(f.read())
                data, ends = ids.astype("<u4"), np.cumsum(sizes)
                crcs = [zlib.crc32(data[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(row["first"] + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition that wrote: that many meet in the unpartitioned window.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    firsts = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    starts = shards.select("part", "path", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before")).join(firsts, "part").select("path", (F.col("first") + F.col("before")).alias("first"))
    # What is joined and dealt out is the table of shards; documents come out of the files with their place.
    return starts.repartition(n).mapInArrow(read, DOCUMENTS)


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write documents to token files and return what reading the files gives."""
    spark = docs.sparkSession
    root = shared_path(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, root, tokenizer, id_col, text_col), root)
