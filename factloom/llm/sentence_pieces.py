"""SentencePiece encoding and decoding as relations.

Encoding. A text is cut where no piece reaches across: between two characters
that stand together in no piece. Distinct words so cut are exploded into
substrings no longer than the longest piece, those are joined to the piece table
by equality, the edges of a word are grouped, and a fold with a higher-order
aggregate turns edges into a path.

For unigram tables the fold is Viterbi: edges come by their ends, and the state
holds the best sum of scores to each position. A BPE table's scores are merge
ranks, and the path with the best sum of them is not what the encoder gives. Its
path is the one whose merges come first, so for BPE tables edges come by their
last merge (rank, then place), and the state is the set of cuts that are left, as
bits: an edge both ends of which are cuts and that has one cut inside takes that
one away. That equals merging step by step, since a piece is made the same way
wherever it is made; pieces that merging does not make of their own characters are
left out, and a merge that only a later-ranked one made possible counts as of that
one's rank. Characters without a piece become their UTF-8 bytes' pieces.

Words over WINDOW characters enter the lattice as windows that overlap by half.
A sequence of pieces is the encoding of a text exactly if each two neighbours
are that of theirs, so windows are joined where they share a piece. Windows that
share none (periodic texts can do that), and all long words of unigram tables,
are folded from their characters one by one.

Texts are in batches; a batch asks once for each of its distinct words, and
answers meet the batch's texts again. Both travel as compressed blocks, so a hot
word moves once per batch and task. Decoding puts the bytes of a row's pieces
together, where the row is.

Defined cases: null counts as empty; an empty text has no ids and decodes to an
empty text; a very long text makes a batch larger; of equal merges the leftmost
comes first, of equal sums the path whose last piece is longer; repeated rows are
encoded alike; an empty table gives an empty result; unknown ids decode to
nothing; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from factloom.llm.common import Scratch, arrow_map, partitions, slices, table, text_buffer, word_hashes, workers_import
from factloom.llm.tokens import tokenizer_path

NAME = "op2_sentence_pieces"
MARK = "▁"
#: Characters of a word that enter the lattice at once; their places and one more are bits of a long.
WINDOW = 60
#: Bits of a packed edge's places; what a unigram table's character without a piece scores below the worst piece.
PLACE_BITS, UNKNOWN = 6, -10.0
#: Text bytes of a batch, and for each part of the words; words of a lattice partition.
BATCH_BYTES, PART_BYTES, LATTICE_WORDS = 12 << 20, 12 << 20, 1 << 16
#: Words that a task holds before it sends them, and those looked up together.
HELD_WORDS, TOGETHER = 1 << 18, 1 << 16
#: Characters that are cut together, and text bytes whose words are looked up together.
BLOCK, LOOKUP_BYTES = 1 << 18, 1 << 20
#: What is done to a result where it is made, and the schema that it then has.
Then = tuple[Callable[[pa.Table], pa.Table], str]


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """id, piece, score, byte (value of a byte piece, else null) of a model file; a vocabulary in size."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = []
    for k in range(m.vocab_size()):
        if m.is_byte(k):
            rows.append((k, None, 0.0, int(m.id_to_piece(k)[3:5], 16)))
        elif not (m.is_control(k) or m.is_unknown(k) or m.is_unused(k)):
            piece = m.id_to_piece(k)
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} spans words")
            rows.append((k, piece, float(m.get_score(k)), None))
    return spark.createDataFrame(rows, "id int, piece string, score double, byte int")


def merge_all(text: str, rank: dict[str, int]) -> tuple[list[str], list[tuple[int, int]]]:
    """Symbols of a text after all merges, the smallest rank first, of equals the leftmost; and (rank, place) of each merge."""
    n = len(text)
    symbol, after, before, done = list(text), list(range(1, n + 1)), list(range(-1, n - 1)), []
    heap = [(r, k, text[k : k + 2]) for k in range(n - 1) if (r := rank.get(text[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, k, whole = heapq.heappop(heap)
        right = after[k]
        if not symbol[k] or right >= n or symbol[k] + symbol[right] != whole:
            continue
        done.append((r, k))
        symbol[k], symbol[right] = whole, ""
        after[k] = after[right]
        if after[k] < n:
            before[after[k]] = k
            if (r := rank.get(x := whole + symbol[after[k]])) is not None:
                heapq.heappush(heap, (r, k, x))
        if before[k] >= 0 and (r := rank.get(x := symbol[before[k]] + whole)) is not None:
            heapq.heappush(heap, (r, before[k], x))
    return [x for x in symbol if x], done


def ranks(scores: dict[str, float]) -> dict[str, int]:
    order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
    return {x: order[s] for x, s in scores.items()}


def merge_table(spark: SparkSession, pieces: DataFrame) -> tuple[DataFrame, int]:
    """piece and last (its last merge) of the pieces that merging makes, and by how many bits a place is shifted.

    A merge is a number of rank, place in the piece and, for one that only a later-ranked merge made possible, its turn
    after that one. Single characters have none.
    """
    rows = pieces.filter("piece is not null").collect()  # a vocabulary
    rank = ranks({r.piece: r.score for r in rows})
    longest = max(len(x) for x in rank)
    turn_bits = (longest - 1).bit_length()
    if 2 * longest > WINDOW or len(rank).bit_length() + turn_bits + 3 * PLACE_BITS > 62:
        raise ValueError("pieces are too long or too many for packed edges")
    out = []
    for r in rows:
        symbols, done = merge_all(r.piece, rank)
        if len(symbols) > 1 or not done:
            continue
        last = None
        for merge in done:
            last = (*last[:2], last[2] + 1) if last and merge < last[:2] else (*merge, 0)
        a, b, c = last
        out.append((r.piece, (a << (PLACE_BITS + turn_bits)) + (b << turn_bits) + c))
    return spark.createDataFrame(out, "piece string, last long"), turn_bits


class Cutter:
    """Cuts texts between characters that stand together in no piece."""

    def __init__(self, pieces: list[str]):
        pairs = sorted({(ord(a), ord(b)) for x in pieces for a, b in zip(x, x[1:], strict=False)})
        self.codes = np.array([a << 21 | b for a, b in pairs] or [-1], np.int64)
        #: A small number of each character, 1023 for rare ones; and whether two such stand together.
        self.small = np.full(0x110000, 1023, np.uint16)
        self.small[:1022] = np.arange(1022)
        self.small[ord(MARK)] = 1022
        self.together = np.zeros(1 << 20, bool)
        for a, b in pairs:
            self.together[int(self.small[a]) << 10 | int(self.small[b])] = True

    def cut(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
        """All marked texts together; where words begin, with the end; and where each text's words begin among them."""
        marked = [MARK + x.replace(" ", MARK) if x else "" for x in texts]
        whole = "".join(marked)
        rows = np.cumsum([0, *map(len, marked)])
        begins = np.ones(len(whole) + 1, bool)
        for k in range(0, len(whole), BLOCK):
            chars = np.frombuffer(whole[k : k + BLOCK + 1].encode("utf-32-le"), np.uint32)
            small = self.small[chars]
            pair = small[:-1].astype(np.uint32) << np.uint32(10) | small[1:]
            stay = self.together[pair]
            rare = np.flatnonzero((small[:-1] == 1023) | (small[1:] == 1023))
            if len(rare):
                code = chars[rare].astype(np.int64) << 21 | chars[rare + 1]
                stay[rare] = self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code
            begins[k + 1 : k + 1 + len(stay)] = ~stay
        begins[rows] = True
        starts = np.flatnonzero(begins)
        return whole, starts, np.searchsorted(starts, rows)


def words_between(whole: str, starts: np.ndarray) -> Iterator[list[str]]:
    """The words of a cut text, some at a time."""
    for k in range(0, len(starts) - 1, TOGETHER):
        some = starts[k : k + TOGETHER + 1].tolist()
        yield [whole[a:b] for a, b in zip(some[:-1], some[1:], strict=True)]


def windows(word: str) -> list[str]:
    """A word itself, or windows over it that overlap by half."""
    if len(word) <= WINDOW:
        return [word]
    return [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def asked_words(texts: list[str | None], cutter: Cutter) -> set[str]:
    whole, starts, _ = cutter.cut(texts)
    found = set().union(*words_between(whole, starts))
    for word in [x for x in found if len(x) > WINDOW]:
        found.remove(word)
        found.update(windows(word))
    return found


def put(*columns: np.ndarray | bytes) -> bytes:
    """Columns as one compressed block."""
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in columns]
    whole = np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw)
    return np.array([len(whole)], "<u4").tobytes() + pa.Codec("zstd", compression_level=5).compress(whole, asbytes=True)


def got(block: bytes) -> list[bytes]:
    size = int(np.frombuffer(block, "<u4", 1)[0])
    whole = pa.decompress(block[4:], size, "zstd", asbytes=True)
    n = int(np.frombuffer(whole, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(whole, "<u4", n, 4)) + 4 * n + 4).tolist()
    return [whole[a:b] for a, b in zip([4 * n + 4, *ends[:-1]], ends, strict=True)]


def strings(sizes: bytes, data: bytes) -> list[str]:
    """Words of a block; a size takes one byte, as a window has less than 256."""
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).to_pylist()


def batch_words(rows: DataFrame, cutter: Cutter, parts: int) -> DataFrame:
    """part, batch and words (a block of distinct ones) of rows with columns batch and text; a word's part is by its hash."""
    workers_import(rows.sparkSession)

    def sent(held: dict[int, set[str]]) -> Iterator[pa.RecordBatch]:
        for number, found in held.items():
            words = pa.array(sorted(found), pa.string())
            data, at = text_buffer(words)
            part = (word_hashes(data, at[:-1], at[1:]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            kinds, first = np.unique(part[order], return_index=True)
            blocks = []
            for mine in np.split(order, first[1:]):
                some = words.take(pa.array(mine))
                raw, ends = text_buffer(some)
                blocks.append(put(np.diff(ends).astype(np.uint8), raw[:-8]))
            yield pa.record_batch([pa.array(kinds, pa.int64()), pa.array(np.full(len(kinds), number)), pa.array(blocks, pa.binary())], ["part", "batch", "words"])

    def run(batches):
        held: dict[int, set[str]] = {}
        for whole in batches:
            for batch in slices(whole):
                numbers = batch.column(0).to_numpy()
                for number in np.unique(numbers).tolist():
                    texts = batch.column(1).filter(pa.array(numbers == number)).to_pylist()
                    held.setdefault(number, set()).update(asked_words(texts, cutter))
                if sum(map(len, held.values())) > HELD_WORDS:
                    last = int(numbers[-1])
                    yield from sent({k: x for k, x in held.items() if x and (k != last or len(x) > HELD_WORDS)})
                    held = {last: held[last]} if len(held[last]) <= HELD_WORDS else {}
        yield from sent({k: x for k, x in held.items() if x})

    return rows.select("batch", "text").mapInArrow(run, "part long, batch long, words binary")


def distinct_words(asked: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        found = set().union(*(strings(*got(x)) for x in group.column("words").to_pylist()))
        words = pa.array(sorted(found), pa.string())
        return pa.table({"part": pa.array(np.full(len(words), group.column("part")[0].as_py(), np.int64)), "word": words})

    return asked.groupBy("part").applyInArrow(run, "part long, word string")


def lattice(words: DataFrame, pieces: DataFrame, spread: int, edge: Column, least: int = 2) -> DataFrame:
    """words with edges, an array of edge in ascending order; edge is of start, end and columns of pieces.

    Edges are substrings of at least so many characters; single characters always are ways on. Words are dealt by
    themselves once; substrings fall to the broadcast piece table, by a hash and then in full, before they are grouped, so
    none moves. The first substring stays for the sake of words without edges.
    """
    known = pieces.filter(F.length("piece") >= least).withColumn("hash", F.xxhash64("piece"))
    longest = max(least, known.agg(F.max(F.length("piece"))).first()[0] or 0)
    keys, at, n = words.columns, F.lit(least), F.length("word")
    spans = words.repartition(spread, "word").select(*keys, F.explode(F.sequence(F.lit(0), F.greatest(n - at, F.lit(0)))).alias("start"))
    spans = spans.select(*keys, "start", F.explode(F.sequence(at, F.greatest(F.least(F.lit(longest), n - F.col("start")), at))).alias("n"))
    parts = spans.select(*keys, "start", (F.col("start") + F.col("n")).alias("end"), F.substring(F.col("word"), F.col("start") + 1, F.col("n")).alias("text"))
    same = (F.xxhash64("text") == F.col("hash")) & F.col("text").startswith(F.col("piece")) & F.col("piece").startswith(F.col("text"))
    edges = parts.join(F.broadcast(known), same, "left").filter(F.col("piece").isNotNull() | ((F.col("start") == 0) & (F.col("end") == least)))
    return edges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), edge))).alias("edges"))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bits(value: Column, at: int) -> Column:
    """A place in a packed edge."""
    return F.shiftright(value, at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def packed(shift: int) -> Column:
    """An edge as a long: its last merge, start, end."""
    start = F.col("start").cast("long")
    last = F.col("last") + F.shiftleft(start, shift)
    return F.shiftleft(last, 2 * PLACE_BITS).bitwiseOR(F.shiftleft(start, PLACE_BITS)).bitwiseOR(F.col("end"))


def merged(edges: Column) -> Column:
    """Cuts, as bits, that are left when packed edges in order of their last merges take away the one cut inside them."""

    def step(cuts: Column, edge: Column) -> Column:
        first, last = bit(bits(edge, PLACE_BITS)), bit(bits(edge, 0))
        inner = last - F.shiftleft(first, 1)
        fits = (F.bitwise_not(cuts).bitwiseAND(first.bitwiseOR(last)) == 0) & (F.bit_count(cuts.bitwiseAND(inner)) == 1)
        return F.when(fits, cuts.bitwiseAND(F.bitwise_not(inner))).otherwise(cuts)

    return F.aggregate(edges, F.lit(-1).cast("long"), step)


def best_path(word: Column, edges: Column, unknown: float) -> Column:
    """Viterbi: cuts, as bits, of the path with the highest sum of scores; a character without a piece scores unknown.

    The state holds the best score and cuts to each position so far; unknown is below the score of any piece.
    """
    state = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("cuts")))

    def step(best: Column, end: Column) -> Column:
        def way(score: Column, start: Column) -> Column:
            before = F.element_at(best, start + 1)
            return F.struct((before["score"] + score).alias("score"), F.negative(start).alias("longer"), before["cuts"].bitwiseOR(bit(end)).alias("cuts"))

        ways = F.transform(F.filter(edges, lambda x: x["end"] == end), lambda x: way(x["score"], x["start"]))
        top = F.array_max(F.concat(ways, F.array(way(F.lit(unknown), end - 1))))
        return F.concat(best, F.array(let(top, lambda x: F.struct(x["score"].alias("score"), x["cuts"].alias("cuts")))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), state, step), -1)["cuts"]


def encode_words(spark: SparkSession, words: DataFrame, pieces: DataFrame, spread: int, merges: bool = True) -> DataFrame:
    """words (distinct, not empty, at most WINDOW long, in column word) with cuts, bits that are set where pieces begin.

    merges: of a BPE table, else of a unigram table.
    """
    if merges:
        known, shift = merge_table(spark, pieces)
        cuts = merged(F.col("edges")).bitwiseAND(bit(F.length("word")) - 1)
        return lattice(words, known, spread, packed(shift)).select(*words.columns, cuts.alias("cuts"))
    known = pieces.filter("piece is not null").select("piece", "score")
    unknown = known.agg(F.min("score")).first()[0] + UNKNOWN
    found = lattice(words, known, spread, F.struct("end", "start", "score"), 1)
    return found.select(*words.columns, best_path(F.col("word"), F.col("edges"), unknown).alias("cuts"))


def sum_all(text: str, score: dict[str, float], unknown: float) -> list[str]:
    """Symbols on the path of the highest sum, of a whole text."""
    longest = max(map(len, score))
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        ways = [(best[k] + score.get(text[k:end], unknown if end - k == 1 else -np.inf), -k) for k in range(max(0, end - longest), end)]
        value, start = max(ways)
        best.append(value)
        back.append(-start)
    cuts = [len(text)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [text[a:b] for a, b in zip(cuts[:0:-1], cuts[-2::-1], strict=True)]


class Vocabulary:
    """Pieces in a worker: ids, scores, and how many characters an id stands for."""

    def __init__(self, rows: list, merges: bool):
        self.merges = merges
        self.score = {r.piece: r.score for r in rows if r.byte is None}
        self.number = {r.piece: r.id for r in rows if r.byte is None}
        self.first_byte = next(r.id for r in rows if r.byte == 0)
        self.rank = ranks(self.score)
        self.width = np.zeros(max(r.id for r in rows) + 1, np.int64)
        for r in rows:
            self.width[r.id] = len(r.piece) if r.byte is None else not 0x80 <= r.byte < 0xC0

    def ids(self, symbols: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, bytes' ids for those without a piece, and how many each has."""
        found = np.fromiter((self.number.get(x, -1) for x in symbols), np.int64, len(symbols))
        n = np.ones(len(symbols), np.int64)
        without = np.flatnonzero(found < 0).tolist()
        if not without:
            return found, n
        raw = [[b + self.first_byte for b in symbols[k].encode()] for k in without]
        n[without] = [len(x) for x in raw]
        out = np.repeat(found, n)
        out[out < 0] = [x for some in raw for x in some]
        return out, n

    def pieces_between(self, words: list[str], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's begin, with the end."""
        whole, size = "".join(words), np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        at = np.arange(len(whole)) - np.repeat(first, size)
        begins = np.flatnonzero(np.repeat(cuts, size) >> at.astype(np.uint64) & np.uint64(1))
        ends = [*begins[1:].tolist(), len(whole)]
        out, n = self.ids([whole[a:b] for a, b in zip(begins.tolist(), ends, strict=True)])
        place = np.concatenate([[0], np.cumsum(n)])
        return out.astype(np.int32), place[np.searchsorted(begins, np.append(first, len(whole)))]

    def whole(self, word: str) -> np.ndarray:
        symbols = merge_all(word, self.rank)[0] if self.merges else sum_all(word, self.score, min(self.score.values()) + UNKNOWN)
        return self.ids(symbols)[0].astype(np.int32)

    def joined(self, word: str, found: list[np.ndarray]) -> np.ndarray:
        """Ids of a long word, from those of its windows where these share pieces."""
        if not self.merges:
            return self.whole(word)
        out = [found[0]]
        ends = np.cumsum(self.width[found[0]])
        for k in range(1, len(found)):
            last, now, base = out[-1], found[k], k * (WINDOW // 2)
            stops = np.cumsum(self.width[now]) + base
            mine = {(e, i): at for at, (e, i) in enumerate(zip(ends.tolist(), last.tolist(), strict=True)) if e > base and self.width[i]}
            shared = next(((mine[x], at) for at, x in enumerate(zip(stops.tolist(), now.tolist(), strict=True)) if x in mine), None)
            if shared is None:
                return self.whole(word)
            out[-1] = last[: shared[0]]
            out.append(now[shared[1] :])
            ends = stops[shared[1] :]
        return np.concatenate(out).astype(np.int32)


def answered(asked: DataFrame, coded: DataFrame) -> DataFrame:
    """batch and answers: blocks of words and their cuts, for the words that the batch asked for."""

    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        place, cuts = {w: k for k, w in enumerate(told.column("word").to_pylist())}, told.column("cuts").to_numpy()
        blocks = []
        for block in group.column("words").to_pylist():
            sizes, data = got(block)
            mine = cuts[[place[w] for w in strings(sizes, data)]]
            # The lowest bytes of all come first: the others hardly differ.
            blocks.append(put(sizes, data, mine.astype("<i8").view(np.uint8).reshape(-1, 8).T))
        return pa.table({"batch": group.column("batch"), "answers": pa.array(blocks, pa.binary())})

    return asked.groupBy("part").cogroup(coded.groupBy("part")).applyInArrow(run, "batch long, answers binary")


def encode(spark: SparkSession, rows: DataFrame, model: str, text_col: str = "text", near: str | None = None, merges: bool = True, then: Then | None = None) -> DataFrame:
    """rows with ids, an array of piece ids of text_col, a string; merges: the model is BPE, else unigram.

    near names an integer column whose close values lie in the same files; rows go to batches by it, so that a task's
    rows fall into few. Without it they go by a hash of the row. then is a function of Arrow tables of the result, some
    rows at a time, and its schema: it runs where the result is made, so that only what it returns travels.
    """
    scratch = Scratch(spark)
    pieces = piece_table(spark, model)
    known = pieces.collect()  # a vocabulary
    cutter, vocabulary = Cutter([r.piece for r in known if r.byte is None]), Vocabulary(known, merges)
    total, count = rows.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.count("*")).first()
    total = total or 0
    batches = max(1, -(-total // BATCH_BYTES), min(partitions(spark), total >> 20))
    key = F.floor(F.coalesce(F.col(f"`{near}`").cast("double"), F.lit(0.0)) / max(1, count // batches)) if near else F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    number = F.pmod(key, F.lit(batches)).cast("long")
    parts = max(partitions(spark), total // PART_BYTES)
    asked = scratch.save(batch_words(rows.select(number.alias("batch"), F.col(f"`{text_col}`").alias("text")), cutter, parts), "asked")
    words = scratch.save(distinct_words(asked), "words")
    scratch.settle()
    spread = max(partitions(spark), words.count() // LATTICE_WORDS)
    coded = scratch.save(encode_words(spark, words, pieces, spread, merges), "coded")
    scratch.settle()
    answers = scratch.save(answered(asked, coded), "answers")
    for name in ("asked", "words", "coded"):
        scratch.drop(name)
    scratch.settle()
    names = rows.columns
    at_text = names.index(text_col)

    def pack(whole_batches):
        for whole in whole_batches:
            for batch in slices(whole):
                numbers = batch.column(batch.num_columns - 1).to_numpy()
                plain = pa.record_batch(batch.columns[:-1], [f"c{k}" for k in range(len(names))])
                for n in np.unique(numbers).tolist():
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, plain.schema) as writer:
                        writer.write_batch(plain.filter(pa.array(numbers == n)))
                    yield pa.record_batch([pa.array([n], pa.int64()), pa.array([put(sink.getvalue().to_pybytes())], pa.binary())], ["batch", "rows"])

    def assemble(group: pa.Table, told: pa.Table) -> pa.Table:
        words, cuts = [], [np.zeros(0, np.uint64)]
        for block in told.column("answers").to_pylist():
            lengths, data, bits_ = got(block)
            words += strings(lengths, data)
            cuts.append(np.frombuffer(bits_, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel())
        flat, offsets = vocabulary.pieces_between(words, np.concatenate(cuts))
        first, size = offsets[:-1], np.diff(offsets)
        place = {w: k for k, w in enumerate(words)}
        del words, cuts, offsets
        done = []
        for block in group.column("rows").to_pylist():
            for batch in pa.ipc.open_stream(got(block)[0]):
                for some in slices(batch, LOOKUP_BYTES):
                    whole, starts, rows_ = cutter.cut(some.column(at_text).to_pylist())
                    for word in {whole[starts[k] : starts[k + 1]] for k in np.flatnonzero(np.diff(starts) > WINDOW).tolist()} - place.keys():
                        found = vocabulary.joined(word, [flat[first[k] : first[k] + size[k]] for k in map(place.__getitem__, windows(word))])
                        place[word] = len(size)
                        first, size, flat = np.append(first, len(flat)), np.append(size, len(found)), np.concatenate([flat, found])
                    word = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(place.__getitem__, x), np.int64, len(x)) for x in words_between(whole, starts))])
                    n = size[word]
                    ends = np.concatenate([[0], np.cumsum(n)])
                    out = np.arange(ends[-1])
                    out += np.repeat(first[word] - ends[:-1], n)
                    lists = pa.ListArray.from_arrays(pa.array(ends[rows_], pa.int32()), pa.array(flat[out], pa.int32()))
                    made = pa.table([*some.columns, lists], names=[*names, "ids"])
                    done.append(then[0](made) if then else made)
        return pa.concat_tables(done)

    workers_import(spark)
    name = next(f"batch{k}" for k in range(len(names) + 1) if f"batch{k}" not in names)
    packed = rows.withColumn(name, number).mapInArrow(pack, "batch long, rows binary")
    schema = then[1] if then else StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(assemble, schema)


class Decoder:
    """Texts of lists of ids; unknown ids are nothing."""

    def __init__(self, rows: list):
        known = {r.id: bytes([r.byte]) if r.byte is not None else r.piece.replace(MARK, " ").encode() for r in rows}
        raw = [known.get(k, b"") for k in range(max(known) + 2)]
        self.pool, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([*map(len, raw)], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def texts(self, column: pa.ListArray) -> list[str]:
        lists = column.value_lengths().fill_null(0).to_numpy()
        ids = column.flatten().fill_null(-1).to_numpy().astype(np.int64)
        ids[(ids < 0) | (ids >= len(self.size))] = len(self.size) - 1
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(ends[-1])
        at += np.repeat(self.first[ids] - ends[:-1], n)
        flat, cuts = self.pool[at].tobytes(), ends[np.cumsum([0, *lists.tolist()])].tolist()
        return [flat[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode(spark: SparkSession, rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col, the text of ids_col; no row moves."""
    decoder = Decoder(piece_table(spark, model).collect())
    at = rows.columns.index(ids_col)

    def run(batch):
        yield pa.record_batch([*batch.columns, pa.array(decoder.texts(batch.column(at)), pa.string())], [*batch.schema.names, out_col])

    return arrow_map(rows, run, StructType([*rows.schema.fields, StructField(out_col, StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    model = tokenizer_path("piece_bpe_32k.model")
    decoder = Decoder(piece_table(spark, model).collect())
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def digest(made: pa.Table) -> pa.Table:
        ids, texts = made.column("ids").combine_chunks(), made.column("text").to_pylist()
        raw, at = ids.flatten().to_numpy().astype("<u4").tobytes(), np.cumsum([0, *ids.value_lengths().to_pylist()]).tolist()
        shas = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        same = [x == y for x, y in zip(decoder.texts(ids), texts, strict=True)]
        return pa.table({"doc_id": made.column("doc_id"), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_sha256": shas, "round_trip": same})

    schema = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean"
    return encode(spark, docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, near="doc_id", then=(digest, schema))
