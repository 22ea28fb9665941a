"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their frequency rank in the corpus, so frequent ids have small
numbers.  A rank takes one to four bytes; the lengths (less one) of four ranks
share a control byte, and control bytes are stored apart from the data bytes.  A
decoder looks the four lengths of a control byte up in a 256-row table, and numpy
gathers all ranks of a block at once.

A file set is a Parquet folder whose rows are blocks of about a million ids in
ascending doc_id order: the doc_ids and token counts of a block's documents, its
control bytes and its data bytes, with the number of its part, its place there and
the ids before it in the part.  The rank table lies beside it.  The container keeps
the files readable and writable by any store that Spark reaches, and a lost task
rewrites its part alone.

Defined results: doc_ids of any type that Spark orders (numbers, strings, dates), in the
order of that type; null text is empty and has the end id alone; rows that repeat a
doc_id follow each other, ordered by their ids; null doc_ids come first; an empty
table gives an empty file set; further columns are ignored by name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import Scratch
from .text_arrays import buffers, releasing, slices
from .tokens import tokenizer

VOCABULARY = "byte_bpe_50k.json"
PART_IDS = 8_000_000
MAX_PARTS = 20_000
BLOCK_IDS = 1_000_000
#: Lengths of the four numbers of each control byte.
LENGTHS = np.stack([((np.arange(256) >> shift) & 3) + 1 for shift in (0, 2, 4, 6)], axis=1).astype(np.int64)
_BLOCK_SCHEMA = "part int, block int, before long, n_ids long, n_docs long, doc_ids array<{}>, counts binary, control binary, data binary"


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of uint32 numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    code = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    padded = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    padded[: len(numbers)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4) <= code[:, None]
    return control.tobytes(), numbers.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n uint32 numbers of a block."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    at = np.cumsum(sizes) - sizes
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenise(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokenizer(vocabulary)
        end = np.array([end_id], kind.dtype).tobytes()
        for batch in batches:
            for i, j in slices(buffers(batch.column(1))[1], 1_500_000):
                part = batch.slice(i, j - i)
                coded = [ids + end for ids in kind.encode(part.column(1).to_pylist())]
                h = pa.array([zlib.crc32(x) for x in coded], pa.int64())
                yield pa.record_batch([part.column(0), h, pa.array(coded, pa.binary())], names=["doc_id", "h", "ids"])

    return run


def _count(width: int):
    """Id counts of a whole partition, so each task sends a vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                own = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return run


def _write_blocks(rank: np.ndarray, width: int, id_kind: pa.DataType):
    def block(part: int, number: int, before: int, docs: list[tuple[object, np.ndarray]]) -> pa.RecordBatch:
        counts = np.array([len(x) for _, x in docs], "<u4")
        ids = np.concatenate([x for _, x in docs])
        control, data = encode_numbers(rank[ids])
        values = [part, number, before, len(ids), len(docs), [d for d, _ in docs], counts.tobytes(), control, data]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(id_kind), *[pa.binary()] * 3]
        names = [x.split()[0] for x in _BLOCK_SCHEMA.split(", ")]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, before, held, size = 0, 0, [], 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and size >= BLOCK_IDS:
                    yield block(part, number, before, held)
                    number, before, held, size = number + 1, before + size, [], 0
                held.append((doc, np.frombuffer(ids.as_py(), f"<u{width}")))
                size += len(held[-1][1])
        if held:
            yield block(part, number, before, held)

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, vocabulary: str = VOCABULARY) -> None:
    """Write the file set of docs(doc_id, text) below `path`: blocks/ and ranks/."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    kind = tokenizer(vocabulary)
    width = kind.dtype.itemsize
    id_type = docs.schema["doc_id"].dataType
    id_name = id_type.simpleString()
    tokens = scratch.save(docs.select("doc_id", "text").mapInArrow(releasing(_tokenise(vocabulary, end_id)), f"doc_id {id_name}, h long, ids binary"), "ids")
    counted = tokens.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "id").collect()  # at most the vocabulary
    rank, total = np.zeros(kind.size, np.uint32), sum(r["n"] for r in rows)
    rank[[r["id"] for r in rows]] = np.arange(len(rows))
    ranks = [(i, int(r["id"]), int(r["n"])) for i, r in enumerate(rows)]
    spark.createDataFrame(ranks, "rank int, id int, n long").coalesce(1).write.parquet(f"{path}/ranks")
    parts = min(MAX_PARTS, max(1, -(-total // PART_IDS)))
    # Ranges of (doc_id, h): a doc_id that many rows share is split by the hash of their ids.
    ordered = tokens.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").select("doc_id", "ids")
    ordered.mapInArrow(_write_blocks(rank, width, to_arrow_type(id_type)), _BLOCK_SCHEMA.format(id_name)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    scratch.drop("ids")


def _read_blocks(id_of: np.ndarray, starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("part", "before", "n_ids", "counts", "control", "data")}
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                ids = id_of[decode_numbers(row["control"], row["data"], row["n_ids"])]
                cuts = np.concatenate([[0], np.cumsum(counts)])
                coded = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                first = starts[row["part"]] + row["before"]
                names = ["doc_id", "start", "ids"]
                yield pa.record_batch([batch.column("doc_ids")[k].values, pa.array(first + cuts[:-1], pa.int64()), pa.array(coded, pa.binary())], names=names)

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document in the files; ids are little-endian uint32, start counts all ids before."""
    blocks = spark.read.parquet(f"{path}/blocks")
    id_name = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    table = spark.read.schema("rank int, id int, n long").parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in table], "<u4")
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # at most MAX_PARTS
    starts, at = {}, 0
    for r in sizes:
        starts[r["part"]], at = at, at + r["n"]
    return blocks.mapInArrow(_read_blocks(id_of, starts), f"doc_id {id_name}, start long, ids binary")
