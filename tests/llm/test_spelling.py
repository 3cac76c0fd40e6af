"""Spelling groups: the index against plain search, the whole operator against brute force."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from strandloom.llm import spelling


def _near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute(counts: dict[str, int], ratio: int = 10):
    form, near = {}, {}
    for w in counts:
        near[w] = [v for v in counts if _near(w, v)]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return rows


def _run(spark, counts: dict[str, int], **kind):
    table = spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n long, near int")
    rows = [tuple(r) for r in spelling.grouped(table, **kind).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _variants(seed: int, size: int, letters: str):
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        w = "".join(rng.choices(letters, k=rng.randint(5, 12)))
        words[w] = rng.choice([20, 300, 4000])
        for _ in range(rng.randint(0, 6)):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c])
            words.setdefault(v, rng.randint(2, 30))
            w = rng.choice([w, v])
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abñ", max_size=6), min_size=1, max_size=25, unique=True),
       st.lists(st.text("abcñ", max_size=6), min_size=1, max_size=10))
def test_index_equals_plain_search(listed, asked):
    index = spelling.BidirectionalIndex(listed)
    for right in (True, False):
        found = set(zip(*(c.tolist() for c in index.one_error(asked, right))))
        for i, a in enumerate(asked):
            h = len(a) // 2
            for j, b in enumerate(listed):
                half = b.startswith(a[:h]) if right else b.endswith(a[h:])
                if (i, j) in found:
                    assert _near(a, b) and half
                elif _near(a, b) and half:
                    # An unchanged half may still need an error in front of it: "ab" and "aab" both begin with "a".
                    assert any((i, j) in set(zip(*(c.tolist() for c in index.one_error(asked, s)))) for s in (True, False))


@pytest.mark.parametrize("seed, letters, shard_words", [(1, "ab", 16384), (2, "abcé", 40), (3, "abcdefgh", 10)])
def test_groups_equal_brute_force(spark, seed, letters, shard_words):
    counts = _variants(seed, 220, letters)
    assert _run(spark, counts, shard_words=shard_words) == _brute(counts)


def test_chain_of_forms(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20_000, "zzzzzzz": 5}
    rows = _run(spark, counts)
    assert rows == _brute(counts)
    assert {r[2] for r in rows} == {"abcdefghijk", "zzzzzzz"}


def test_ties_repeated_rows_nulls_and_odd_words(spark):
    counts = {"baaaaaa": 3, "aaaaaaa": 30, "bbaaaaa": 30, "": 2, "x": 40, "\n": 2, "a b": 9, "a\nb": 90,
              "\U0001f600aaaaaa": 2, "e" * 3000: 50, "e" * 3001: 2}
    assert _run(spark, counts) == _brute(counts)
    table = spark.createDataFrame([("aaaaaaa", 15), ("aaaaaaa", 15), (None, 7), ("aaaaaab", 3)], "word string, n long")
    assert {tuple(r) for r in spelling.grouped(table).collect()} == _brute({"aaaaaaa": 30, "aaaaaab": 3})
    assert _run(spark, {}) == set()


def _vocabulary(rows, noise=31):
    words = Counter()
    for name, text in rows:
        run = ""
        for c in (text or "") + "\n":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                low = "".join(x.lower() if x.isascii() else x for x in run)
                crc = zlib.crc32(f"{'' if name is None else name}:{low}".encode())
                if crc % noise == 0:
                    low = low[: crc % len(low)] + low[crc % len(low) + 1 :]
                words[low] += 1
            run = ""
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def test_vocabulary(spark):
    rng = random.Random(4)
    stems = ["Überraschung", "ÉTUDIANTE", "señorita", "question", "Straßen", "a×b÷cdefg", "œuvrettes", "x1longword",
             "combinéd", "seven77letters", "SEVENLE", "sixsix"]
    rows = [(i % 40 or None, " ".join(rng.choices(stems, k=60)), "q") for i in range(120)]
    rows += [(7, None, ""), (8, "", ""), (9, "longlong" * 4000 + " " + "longlong" * 4000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    for noise in (31, 3):
        found = {r.word: r.n for r in spelling.vocabulary(docs, noise=noise).collect()}
        assert found == _vocabulary([r[:2] for r in rows], noise)
    assert {r.word for r in spelling.vocabulary(docs).collect()} >= {"question", "sevenle", "Überraschung"[:1] + "berraschung"}
