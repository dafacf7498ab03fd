"""Language-model scoring by deleted interpolation of n-gram estimates.

P(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), with one set of
weights for each bucket of context counts (powers of two). The weights come from
expectation-maximisation on held-out counts in the deleted sense: every training
token is scored by counts from which it has been taken out.

Counting and scoring share one exchange. Texts are read once, in batches of
some megabytes; a batch stores its tokens as indexes into its own distinct words
and asks once for the count of each word and pair, sending along what
it adds to the training counts. Requests are ranged by hash; what moves are sorted
hash lists, coded by differences and compressed. A hot word moves once per
batch. Answers return to their batch, which scores its texts. Word counts are by
64-bit hashes, pair counts by 56 bits of theirs.

Defined cases: a null or empty text is the end token alone; without training
tokens every count is 0 and only the uniform part remains; repeated rows are
all counted and scored alike; a null doc_id is hashed as an empty text; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from factloom.llm.common import BLANK, LOWER, Scratch, mix, pair_up, partitions, slices, table, text_buffer, word_hashes, words, workers_import

#: Text bytes for each part in which counts meet.
PART_BYTES = 16 << 20
NAME = "op4_lm_score"
#: Text bytes of a batch.
BATCH_BYTES = 16 << 20
#: Rounds of expectation-maximisation; quarters of a factor of two in which estimates are pooled for it.
ROUNDS, FINE = 60, 4
ADD = 0.1
END = mix(np.array([0x0E4D], np.uint64))[0]
START = mix(np.array([0x57A7], np.uint64))[0]
PAIR_BITS = np.uint64(8)
WORD, PAIR, COUNTS, TEXTS = 0, 1, 2, 3


def squeeze(values: np.ndarray) -> bytes:
    """Integers as planes of their bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def expand(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw, "<u8"), dtype=np.uint64)


def token_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by END, and the rows' offsets."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, BLANK)
    at = first + np.arange(len(first))
    out = np.full(at[-1], END, np.uint64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = word_hashes(data, starts, ends)
    return out, at


def batches_of(docs: DataFrame, parts: int) -> DataFrame:
    """kind, batch, part, x, y: requests by part (keys, training counts) and each batch's TEXTS."""
    workers_import(docs.sparkSession)

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, BATCH_BYTES):
                name = task << 32 | number
                number += 1
                h, at = token_rows(batch.column(1))
                learn = batch.column(2).to_numpy(zero_copy_only=False)
                token_learns = np.repeat(learn, np.diff(at))
                before = np.roll(h, 1)
                before[at[:-1]] = START
                out = []
                for kind, keys in ((WORD, h), (PAIR, pair_up(before, h) >> PAIR_BITS)):
                    ids, index = np.unique(keys, return_inverse=True)
                    add = np.bincount(index[token_learns], minlength=len(ids)).astype("<u4")
                    top = np.uint64(64 - (int(PAIR_BITS) if kind == PAIR else 0) - 24)
                    part = ((ids >> top).astype(np.int64) * parts) >> 24
                    cut = np.searchsorted(part, np.arange(parts + 1))
                    out += [(kind, name, p, steps(ids[cut[p] : cut[p + 1]]), squeeze(add[cut[p] : cut[p + 1]])) for p in range(parts) if cut[p] < cut[p + 1]]
                    if kind == WORD:
                        told = [steps(ids), squeeze(index.astype("<u4"))]
                    del index
                keys = batch.column(0)
                meta = pa.BufferOutputStream()
                with pa.ipc.new_stream(meta, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("learn", pa.bool_())])) as sink:
                    sink.write_batch(pa.record_batch([keys, pa.array(np.diff(at)), pa.array(learn)], ["doc_id", "n", "learn"]))
                lengths = np.array([len(x) for x in told], "<i8").tobytes()
                out.append((TEXTS, name, -1, meta.getvalue().to_pybytes(), lengths + b"".join(told)))
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["kind", "batch", "part", "x", "y"])

    return docs.mapInArrow(run, "kind int, batch long, part int, x binary, y binary")


def answers(requests: DataFrame) -> DataFrame:
    """kind, batch, part, x: counts of each request's keys; and COUNTS rows with tokens and distinct words of a part."""

    def run(group: pa.Table) -> pa.Table:
        kinds, names = group.column("kind").to_numpy(), group.column("batch").to_numpy()
        part = group.column("part")[0].as_py()
        x, y = group.column("x").to_pylist(), group.column("y").to_pylist()
        rows = []
        for kind in (WORD, PAIR):
            mine = np.flatnonzero(kinds == kind)
            if not len(mine):
                continue
            keys = [from_steps(x[k]) for k in mine]
            ids, index = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(index, np.concatenate([expand(y[k], "<u4") for k in mine]), len(ids)).astype(np.int64)
            at = 0
            for k, own in zip(mine, keys, strict=True):
                rows.append((kind, int(names[k]), part, squeeze(total[index[at : at + len(own)]].astype("<u8"))))
                at += len(own)
            if kind == WORD:
                rows.append((COUNTS, -1, part, np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names=["kind", "batch", "part", "x"])

    return requests.groupBy("part").applyInArrow(run, "kind int, batch long, part int, x binary")


class Batch:
    """Counts along the tokens of one batch."""

    def __init__(self, texts: pa.Table, replies: pa.Table, rows_learned: int):
        meta = pa.ipc.open_stream(texts.column("x")[0].as_py()).read_all()
        self.doc_id, self.n, self.learn = meta.column(0), meta.column(1).to_numpy(), meta.column(2).to_numpy()
        raw = texts.column("y")[0].as_py()
        cut = 16 + int(np.frombuffer(raw, "<i8", 1)[0])
        ids, word = from_steps(raw[16:cut]), expand(raw[cut:], "<u4")
        kinds, parts, counts = replies.column("kind").to_numpy(), replies.column("part").to_numpy(), replies.column("x")

        def told(kind: int) -> np.ndarray:
            mine = np.flatnonzero(kinds == kind)
            return np.concatenate([expand(counts[int(k)].as_py(), "<u8") for k in mine[np.argsort(parts[mine])]]).astype(np.int64)

        ends = np.cumsum(self.n)
        self.first = ends - self.n
        h = ids[word]
        before = np.roll(h, 1)
        before[self.first] = START
        _, pair = np.unique(pair_up(before, h) >> PAIR_BITS, return_inverse=True)
        self.word, self.pair = told(WORD)[word], told(PAIR)[pair]
        self.context = np.roll(self.word, 1)
        self.context[self.first] = rows_learned
        self.row = np.repeat(np.arange(len(self.n)), self.n)


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the logarithm to base 2."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def parts_of(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    return pair / np.maximum(context, 1), word / max(total, 1)


def with_replies(stored: DataFrame, replies: DataFrame) -> DataFrame:
    """Groups of a batch's TEXTS and answers."""
    texts = stored.filter(F.col("kind") == TEXTS).select("kind", "batch", "part", "x", "y")
    return texts.unionByName(replies.filter(F.col("kind") < COUNTS).withColumn("y", F.lit(None).cast("binary")))


def split(group: pa.Table, rows_learned: int) -> Batch:
    kinds = group.column("kind").to_numpy()
    return Batch(group.take(pa.array(np.flatnonzero(kinds == TEXTS))), group.take(pa.array(np.flatnonzero(kinds != TEXTS))), rows_learned)


def deleted_estimates(batches: DataFrame, total: int, rows_learned: int) -> DataFrame:
    """bucket, pair and word estimates in steps (null for 0), their sums and number, over all training tokens."""

    def run(group: pa.Table) -> pa.Table:
        b = split(group, rows_learned)
        on = b.learn[b.row]
        context = b.context[on] - 1
        f2, f1 = parts_of(b.pair[on] - 1, context, b.word[on] - 1, total - 1)
        code = np.stack([buckets(context), *(np.where(f > 0, np.round(FINE * np.log2(np.maximum(f, 1e-300))), 9999).astype(np.int64) for f in (f2, f1))])
        flat = (code[0] * 20000 + code[1] + 10000) * 20000 + code[2] + 10000
        ids, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        return pa.table({"cell": ids, "n": n.astype(np.int64), "f2": np.bincount(at, f2, len(ids)).astype(float), "f1": np.bincount(at, f1, len(ids)).astype(float)})

    cells = batches.groupBy("batch").applyInArrow(run, "cell long, n long, f2 double, f1 double")
    return cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "f2", "f1")))


def learn_weights(cells: list, distinct: int) -> np.ndarray:
    """Rows of l2, l1, l0 for each bucket; buckets without training tokens use l1 and l0 of all."""
    weights = np.tile([0.0, 0.9, 0.1], (65, 1))
    if not cells:
        return weights
    cell, n, f2, f1 = (np.array([r[k] for r in cells], float) for k in range(4))
    estimate = np.stack([f2 / n, f1 / n, np.full(len(n), 1 / (distinct + 1))])
    bucket = (cell // (20000 * 20000)).astype(int)
    for b in range(65):
        on = bucket == b
        if not on.any():
            continue
        w = np.array([0.4, 0.5, 0.1])
        for _ in range(ROUNDS):
            joint = w[:, None] * estimate[:, on]
            w = (joint / joint.sum(0) * n[on]).sum(1) / n[on].sum()
        weights[b] = 0.999 * w + 0.001 * np.array([0.0, 0.5, 0.5])
    return weights


def scores(spark: SparkSession, docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learn says which rows train."""
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    path = f"{scratch.path}/stored"
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches_of(rows, max(partitions(spark), text_bytes // PART_BYTES)).write.partitionBy("kind").option("compression", "none").parquet(path)
    stored = spark.read.schema("kind int, batch long, part int, x binary, y binary").parquet(path)
    replies = scratch.save(answers(stored.filter(F.col("kind") < COUNTS)), "replies")
    for kind in (WORD, PAIR):
        scratch.drop(f"stored/kind={kind}")
    scratch.settle()
    stored = spark.read.schema("batch long, part int, x binary, y binary").parquet(f"{path}/kind={TEXTS}").withColumn("kind", F.lit(TEXTS))
    sums = [np.frombuffer(r.x, "<i8") for r in replies.filter(F.col("kind") == COUNTS).select("x").collect()]
    total, distinct = (int(sum(x[k] for x in sums)) for k in (0, 1))
    rows_learned = rows.filter("learn").count()
    batches = with_replies(stored, replies)
    weights = learn_weights(deleted_estimates(batches, total, rows_learned).collect(), distinct)
    scratch.settle()

    def run(group: pa.Table) -> pa.Table:
        b = split(group, rows_learned)
        f2, f1 = parts_of(b.pair, b.context, b.word, total)
        w = weights[buckets(b.context)]
        p = w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (distinct + 1)
        each = lambda v: np.bincount(b.row, v, len(b.n))
        base = each(np.log10((b.word + ADD) / (total + ADD * (distinct + 1))))
        return pa.table(
            {
                "doc_id": b.doc_id,
                "held_out": ~b.learn,
                "n_tokens": b.n,
                "n_known": each(b.word > 0).astype(np.int64),
                "train_tokens": np.full(len(b.n), total),
                "base_score": base,
                "score": each(np.log10(p)),
            }
        )

    return batches.groupBy("batch").applyInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, table(spark, sf_dir, "documents"), ~held_out())
