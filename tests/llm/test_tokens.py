"""Byte-level coding and packing against the libraries and by round trip."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import bpe, packing
from strandloom.llm.queries import QUERIES

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n \t", "it's 1234  fine…", "naïve ça ñandú 漢字かな", "a" * 5000, "ab" * 700, "<|endoftext|>",
       "\x1c\x85　x \U0001f600", "it's 1234  fine…"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(library):
    own = bpe.Codec(RANKS, P.PATTERN)
    random.seed(3)
    tokens = list(own.ranks)
    made = [b"".join(random.choices(tokens, k=random.randint(1, 6))).decode("utf-8", "ignore") for _ in range(3000)]
    for text in [*filter(None, ODD), *made]:
        ids = own.encode(text)
        assert list(ids) == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_backtracking_equals_the_definition():
    own = bpe.Codec(RANKS, P.PATTERN)
    random.seed(5)
    for _ in range(300):
        piece = bytes(random.choices(b"aeinrst the", k=random.randint(1, 40)))
        assert list(own.encode_piece(piece)) == ([own.ranks[piece]] if piece in own.ranks else own.merge(piece))


def test_encode_and_decode_documents(spark, library):
    rows = [(i if i else None, t, "x") for i, t in enumerate(ODD)] + [(1, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_documents(docs, RANKS, P.PATTERN, emit=("ids", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(out) == len(rows)
    want = sorted(
        (len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
         hashlib.sha256((t or "").encode()).hexdigest()) for _, t, _ in rows)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    back = bpe.decode_documents(bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode_documents(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_coding_query_covers_every_document(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_byte_pair_coding"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def check_packing(rows, texts, window=packing.WINDOW):
    """Every id once, sequences gapless, and padding in one sequence at most."""
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= window
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    short = 0
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    assert short <= 1
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.crc == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op9_packing"](spark, SF).withColumnRenamed("ids_crc32", "crc").collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()})


def test_packing_of_odd_and_equal_documents(spark):
    texts = dict(enumerate([*ODD, *["one two three"] * 500, *["word " * 1500] * 7]))
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, length int")
    out = packing.packed(docs.repartition(5), JSON, P.PATTERN).withColumn("crc", F.crc32("ids"))
    check_packing(out.collect(), texts)
    assert packing.packed(docs.limit(0), JSON, P.PATTERN).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "c"), (4, "c")], "doc_id long, text string")
    rows = packing.packed(same, JSON, P.PATTERN).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_combinations_fill_the_window_and_repeats_come_close():
    lengths = np.array([2, 3, 5, 7, 8])
    combos = packing.combinations(lengths, 10)
    assert {tuple(c) for c in combos.tolist()} == {(0, 2, 8), (0, 3, 7), (0, 5, 5), (2, 3, 5)}
    counts = np.zeros(11)
    counts[[2, 3, 5, 7, 8]] = [30, 50, 40, 20, 10]
    x = packing.repeats(combos, counts, 3000)
    used = np.bincount(combos[combos > 0], np.repeat(x, (combos > 0).sum(1)), 11)
    assert (x >= 0).all()
    # No feasible change of one amount improves the fit.
    slope = np.array([sum(used[c] - counts[c] for c in combo if c) for combo in combos])
    assert (slope[x > 1e-6] ** 2 < 1e-3).all() and (slope > -1e-2).all()


def test_tokeniser_engines_agree_on_all_documents(spark):
    own, slow = packing._Ids(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    slow.encode_special_tokens = True
    assert own.slow is None
    for text in [*filter(None, ODD), *(r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect())]:
        assert list(own(text)) == slow.encode(text, add_special_tokens=False).ids


def test_added_tokens_of_the_file_keep_their_ids(spark, tmp_path):
    own, library = packing._Ids(JSON, P.PATTERN, added=True), Tokenizer.from_file(JSON)
    assert own.slow is None
    rows = [*ODD, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>x\n<|endoftext|", "<|endoftext|> " * 900]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert want[-4] == [64, 220, 50256, 275]
    assert [list(own(t or "")) for t in rows] == want
    docs = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = defaultdict(list)
    for r in QUERIES["op9_packing"](spark, str(tmp_path)).collect():
        found[r.doc_id].append(r)
    for i, ids in enumerate(want):
        ids, at = np.array([*ids, 0], "<u4"), 0
        for r in sorted(found[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_long_runs_of_white_space_are_packed(spark):
    rows = ["\n" * 1_200_000, " " * 1_000_000, "word " * 60 + "\t" * 1_000_000 + "<|endoftext|> end", "a" + "\u3000" * 800_000]
    library = Tokenizer.from_file(JSON)
    docs = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string").repartition(2)
    found = defaultdict(list)
    for r in packing.packed(docs, JSON, P.PATTERN, added=True).collect():
        found[r.doc_id].append((r.start, bytes(r.ids)))
    for i, text in enumerate(rows):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(part for _, part in sorted(found[i])) == ids
