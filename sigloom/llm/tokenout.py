"""Token-ID / binary output: a corpus of token ids in files of directly addressable codes (``dac``).

Documents are dealt out by ranges of doc_id, and of a hash of the text where ids repeat, and sorted within each, tokenised, and written as blocks by Spark's own
writer, whose commit protocol survives lost executors and repeated tasks.  Blocks follow one another in the order of
(part, seq), which is ascending doc_id order; rows that share a doc_id stand side by side and null ids come first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm import dac
from sigloom.llm.store import new_folder
from sigloom.llm.textbatch import chunks
from sigloom.llm.tokens import default_path, tokenizer, with_end

#: Ids in a block, but for the last document's.
BLOCK_IDS = 1 << 18
#: A place is looked up in spans of this many ids; a block lies in few of them.
SPAN = 1 << 20

BLOCKS = "part int, seq int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, codes binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every whole text of ``docs`` (doc_id, text), each document ended by ``end_id``.

    Null and empty texts give the end id alone.  An empty table gives no blocks.  Repeated rows are written each.
    """
    tokenizer_path = tokenizer_path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def block() -> pa.RecordBatch:
            values = np.concatenate(ids)
            row = [[part], [seq], [list(doc_ids)], [list(lengths)], [len(values)], [dac.encode(values)]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in chunks(batches):
            found, offsets = with_end(*tokenizer(tokenizer_path).encode(batch.column(1)), end_id)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                ids.append(found[offsets[k] : offsets[k + 1]])
                doc_ids.append(doc_id)
                lengths.append(len(ids[-1]))
                held += len(ids[-1])
                if held >= block_ids:
                    yield block()
                    seq, held = seq + 1, 0
                    ids, doc_ids, lengths = [], [], []
        if ids:
            yield block()

    tie = F.xxhash64("text")  # so that null or repeated ids don't all go to one task
    ordered = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(encode, BLOCKS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base``, the number of ids before each.  The sums over parts are as few as there were tasks."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("part", "seq", "n_tokens").join(parts, "part")
    bases = bases.select("part", "seq", (F.col("part_base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("base"))
    return blocks.join(bases, ["part", "seq"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids (little-endian unsigned 32 bits), read from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = dac.Block(row["codes"]).decode().astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - row["lengths"]
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"]), pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = read_blocks(spark, path).select("doc_ids", "lengths", "codes", "base")
    return blocks.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, token_id) for each place of ``places``, read from the codes without decoding blocks.

    Places outside the corpus and null places are left out; a place asked for twice is answered twice.  Each block meets
    all its places at once, so no block is sent twice; these are distinct, hence no more than the block's ids.
    """
    blocks = read_blocks(spark, path).select("part", "seq", "base", "n_tokens", "codes")
    spans = F.sequence(F.expr(f"base div {SPAN}"), F.expr(f"(base + n_tokens - 1) div {SPAN}"))
    directory = blocks.select("part", "seq", "base", "n_tokens", F.explode(spans).alias("span"))
    asked = places.groupBy("place").agg(F.count("*").alias("times")).withColumn("span", F.expr(f"place div {SPAN}"))
    found = asked.join(directory, "span").where("place >= base and place < base + n_tokens")
    found = found.groupBy("part", "seq").agg(F.collect_list(F.struct("place", "times")).alias("asked"))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, codes = batch.column(0)[row].as_py(), dac.Block(batch.column(1)[row].as_py())
                wanted = batch.column(2)[row].values
                place, times = (wanted.field(k).to_numpy() for k in (0, 1))
                ids = [codes.get(int(p) - base) for p in place]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(place, times)), pa.array(np.repeat(np.array(ids, np.int64), times))], names=["place", "token_id"])

    return found.join(blocks, ["part", "seq"]).select("base", "codes", "asked").mapInArrow(get, "place bigint, token_id bigint")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all ``documents`` and reads the files back."""
    path = new_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)
