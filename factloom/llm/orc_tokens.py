"""Token ids in ORC: integer run-length encoded lists in stripes, with row indexes and Bloom filters on doc_id.

Rows are ranged by doc_id before they are encoded, so only text moves, and each
task writes one file of ascending ids, numbering its rows. Bounds are Spark's, from
a sample of (doc_id, hash of the text), so neither outlying ids nor one id with very
many rows fill a file. Reading back needs no order: a file's stripes are read in
parallel, min/max indexes and Bloom filters prune a search for single ids
(``find``), and starts come from totals per file plus a running sum by row number in
each.

Defined cases: null and empty texts give the end id alone; very long texts are one
row; rows with equal doc_id are ordered by a hash of the text, then by the text; a
null doc_id comes first; an empty table gives an empty dataset; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from factloom.llm.common import Scratch, slices, table, workers_import
from factloom.llm.tokens import ENCODE_BYTES, encoder, tokenizer_path

NAME = "op6_orc_tokens"
END_ID = 2
#: Characters of text for each file.
FILE_CHARS = 32 << 20
SCHEMA = "part int, row long, doc_id long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_chars: int = FILE_CHARS) -> None:
    """Writes part, row, doc_id and ids of every row to ORC files under path, in ascending order of doc_id."""
    spark = docs.sparkSession
    workers_import(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(total // file_chars + 1, *order).sortWithinPartitions(*order, "text")

    def run(batches):
        code, part, written = encoder(tokenizer, False), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, ENCODE_BYTES):
                found, rows = code.encode(batch.column(1))
                ends = rows + np.arange(len(rows))
                flat = np.full(ends[-1], end_id, np.int32)
                inside = np.ones(ends[-1], bool)
                inside[ends[1:] - 1] = False
                flat[inside] = found
                n = batch.num_rows
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.record_batch([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(written, written + n)), batch.column(0), lists], ["part", "row", "doc_id", "ids"])
                written += n

    encoded = ranged.mapInArrow(run, SCHEMA)
    encoded.write.mode("overwrite").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.compress", "ZSTD").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def find(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Documents by id; stripes without them are skipped by their indexes and Bloom filters."""
    return read(spark, path).filter(F.col("doc_id").isin(ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """part, row, doc_id, n_tokens and ids_crc32 of every row read back."""
    workers_import(spark)

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.value_lengths().to_numpy()
            raw, at = memoryview(flat.tobytes()), np.cumsum([0, *sizes.tolist()]).tolist()
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(run, "part int, row long, doc_id long, n_tokens long, ids_crc32 long")


def placed(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of digests; totals have one row per file."""
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    summed = found.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return summed.join(F.broadcast(totals), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = f"{scratch.path}/ids"
    write(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return placed(scratch.save(digests(spark, path), "digests"))
