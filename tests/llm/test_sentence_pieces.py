"""SentencePiece operators against the library, and against all paths for unigram tables."""

from __future__ import annotations

import hashlib
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import sentence_pieces as sp
from factloom.llm import tokens
from factloom.llm.common import Scratch


@pytest.fixture(scope="module")
def model():
    return tokens.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def odd_texts(library):
    """Pieces glued together, mixtures of few characters, long runs and periods, and what has no piece."""
    r = random.Random(1)
    pieces = [library.id_to_piece(k) for k in range(300, 32000)]
    out = ["".join(r.choice(pieces).replace(sp.MARK, " ") for _ in range(r.randrange(1, 12))).replace("  ", " x") for _ in range(300)]
    out += ["".join(r.choice(pieces).replace(sp.MARK, "") for _ in range(r.randrange(1, 60))) for _ in range(200)]
    out += ["".join(r.choice("aabet=-é日\x00😀\n ") for _ in range(r.randrange(1, 200))) for _ in range(200)]
    out += ["a" * k for k in (58, 59, 60, 61, 89, 90, 91, 300, 50_000)] + [" " * 300 + "y", "ab" * 500, "abc" * 3000, "aaab" * 700, "=" * 999, "日本語" * 100]
    return [*out, None, "", " ", "\n", " \n x\n ", "x  y", "a\n" + "b" * 70 + " c\n\n d", "same", "same"]


def test_encoding_equals_the_library(spark, model, library):
    texts = odd_texts(library)
    rows = spark.createDataFrame([(k, t, k, "w", k % 3) for k, t in enumerate(texts)], "batch long, text string, part long, word string, start int").repartition(3)
    coded = Scratch(spark).save(sp.encode(spark, rows, model), "coded")
    assert coded.columns == [*rows.columns, "ids"]
    got = {r.batch: (r.text, list(r.ids), r.part, r.word, r.start) for r in coded.collect()}
    assert got == {k: (t, library.encode(t or ""), k, "w", k % 3) for k, t in enumerate(texts)}
    back = sp.decode(spark, coded, model)
    assert back.filter("decoded <> coalesce(text, '')").isEmpty()


def test_empty_table_and_unknown_ids(spark, model):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert sp.encode(spark, nothing, model).isEmpty()
    assert sp.decode(spark, sp.encode(spark, nothing, model), model).isEmpty()
    rows = spark.createDataFrame([([1, 99_999, -3, 35],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in sp.decode(spark, rows, model).collect()][1:] == ["", ""]


def test_query_reads_all_documents(spark, small, library):
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids) == (r.text or "")))
    assert sorted(map(tuple, sp.query(spark, small).collect())) == sorted(want)


def test_windows_are_joined_as_if_whole(library):
    from collections import namedtuple

    row = namedtuple("row", "id piece score byte")
    rows = [row(k, None, 0.0, int(library.id_to_piece(k)[3:5], 16)) if library.is_byte(k) else row(k, library.id_to_piece(k), library.get_score(k), None) for k in range(3, library.vocab_size())]
    known = sp.Vocabulary(rows, True)
    r = random.Random(3)
    cases = [" " * k + "y" for k in range(60, 400, 17)] + ["".join(r.choice(["in", "g", "the", "er", "t", "日", "😀", "aa"]) for _ in range(r.randrange(40, 200))) for _ in range(60)]
    for text in cases:
        word = sp.MARK + text.replace(" ", sp.MARK)
        assert known.joined(word, [known.whole(x) for x in sp.windows(word)]).tolist() == library.encode(text)


def symbols(word, cuts):
    at = [k for k in range(len(word)) if cuts >> k & 1] + [len(word)]
    return [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def test_viterbi_of_a_unigram_table(spark):
    r = random.Random(7)
    table = {x: -1.0 - r.randrange(40) / 8 for x in {"".join(r.choice("abc") for _ in range(n)) for n in (1, 2, 2, 3, 3, 4, 5) for _ in range(6)}}
    table.pop("c", None)
    unknown = min(table.values()) + sp.UNKNOWN
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 11))) for _ in range(60)})
    pieces = spark.createDataFrame([(k, x, s, None) for k, (x, s) in enumerate(sorted(table.items()))], "id int, piece string, score double, byte int")
    got = {x.word: x.cuts for x in sp.encode_words(spark, spark.createDataFrame([(w,) for w in words], "word string"), pieces, 2, merges=False).collect()}
    assert got.keys() == set(words)
    value = lambda parts: sum(table.get(p, unknown if len(p) == 1 else float("-inf")) for p in parts)
    for word in words:
        ways = [symbols(word, 1 | sum(b << k + 1 for k, b in enumerate(bits))) for bits in product((0, 1), repeat=len(word) - 1)]
        best = max(map(value, ways))
        assert abs(value(symbols(word, got[word])) - best) < 1e-9
        assert abs(value(sp.sum_all(word, table, unknown)) - best) < 1e-9


def test_edges_are_the_pieces_of_a_word(spark):
    pieces = spark.createDataFrame([("ab", 1), ("bc", 2), ("abc", 3), ("x", 4)], "piece string, rank int")
    found = sp.lattice(spark.createDataFrame([("abcab",), ("x",), ("zz",)], "word string"), pieces, 2, F.struct("start", "end", "rank"))
    assert {r.word: [tuple(e) for e in r.edges] for r in found.collect()} == {"abcab": [(0, 2, 1), (0, 3, 3), (1, 3, 2), (3, 5, 1)], "x": [], "zz": []}
