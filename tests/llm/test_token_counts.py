"""Token counts: every count is compared with the library's on the whole text."""

import random

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from strandloom.llm import tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _texts():
    rng = random.Random(5)
    words = ["token", "counts", "of", "a", "huge", "text", "naïve", "日本語", "\U0001f9ff", "ﷺ", "é", "▁", "<s>",
             "<0x41>", "\n\n", "\t", "    ", "x" * 9, "1234567"]
    prose = " ".join(rng.choices(words, k=900))
    glued = "".join(rng.choices(words, k=900))
    return [
        prose, glued, "a" * 5000, " " * 5000, "ab" * 2500, "\n" * 3000, "\U0001f9ff" * 700, "日本" * 1500,
        prose + "a" * 3000 + prose, "x " + " " * 3000 + glued, "a" * 129, "", None, " ", "a", prose,
        "".join(rng.choices("ab ", k=4000)), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(4000)),
    ]


def _found(spark, rows, **kind):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, doc int, first string")
    return sorted(map(tuple, tokencount.counted(docs, MODEL, **kind).collect()), key=str)


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (64, 64), (300, 40), (1500, 5)])
def test_counts_equal_the_library(spark, library, chunk, overlap):
    rows = [(i // 2 or None, t, "x", 1, None) for i, t in enumerate(_texts())]
    expected = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows), key=str)
    assert _found(spark, rows, chunk=chunk, overlap=overlap) == expected


def test_defaults_and_texts_of_one_character(spark, library):
    rows = [(1, "a" * 200_000, "", 0, ""), (2, " " * 150_000 + "b", "", 0, ""), (2, "\n" * 300_000, "", 0, "")]
    assert _found(spark, rows) == sorted(
        ((i, len(t), len(library.encode(t))) for i, t, *_ in rows), key=str)


def test_empty_table(spark):
    assert _found(spark, []) == []


def test_a_model_that_normalises_is_widened_to_the_whole_text(library, monkeypatch):
    pieces = tokencount._Pieces(MODEL)
    pieces.chars = pieces.chars + 1
    total, start, end, index = pieces.symbols("some text")
    assert total == len(library.encode("some text")) and not len(start)


def test_shared_tokens_prove_a_border(library):
    """The theorem of the module on random strings: chunks are spliced at any shared token."""
    rng = random.Random(11)
    pieces = tokencount._Pieces(MODEL)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", "ab", "the", " ", "ing", "é", "日", "0"], k=60))
        a, b = sorted(rng.sample(range(len(text)), 2))
        whole, first, second = (pieces.symbols(t) for t in (text, text[:b], text[a:]))
        left = {(s, e): i for s, e, i in zip(*map(list, first[1:])) if s >= 0}
        right = {(s + a, e + a): i for s, e, i in zip(*map(list, second[1:])) if s >= 0}
        for place in left.keys() & right.keys():
            assert left[place] + second[0] - right[place] == whole[0]
