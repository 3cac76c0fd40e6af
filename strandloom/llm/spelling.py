"""Spelling variants: words at one edit from a far more frequent one, found by bidirectional FM-indexes.

If two words differ by one inserted, deleted or replaced character, one half of the first is, unchanged, the
beginning or the end of the second. So a search takes a half as it is and lets the error be in the other: the
first half is matched with the delimiter in front, then the match grows to the right with one error up to the
delimiter behind; the second half likewise to the left. An index over a delimited list of words keeps the
suffix ranks of the list and of its reverse, and both intervals of a match while it grows at either end.

The vocabulary is dealt to shards by halves: a word stands where words of its own length, or one more or less, look for
it, and is looked for in the two shards of its own halves. So a word never meets the rest of the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.common import store

#: Runs of these are words; only the capital letters without accents are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a shard; one with twice as many is split, and its searches go to each part.
SHARD_WORDS = 16_384
#: Searches that run together.
TOGETHER = 4096


def vocabulary(
    docs: DataFrame, noise: int | None = None, doc_id: str = "doc_id", text: str = "text",
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n): runs of letters in the texts, with their number; A to Z are lower-cased.

    With ``noise``, a run whose crc32 of "<doc_id>:<run>" is a multiple of it loses one character, at the crc
    modulo its length; a null id is written as nothing. Null and empty texts have no words. Rows with the same id or
    text all count. Other columns play no part. Counts are combined before the shuffle, however frequent a word.
    """
    # Shorter runs are no words, with or without a character less.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{max(least_length, 1)},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    run = F.translate("_run", UPPER, LOWER)
    words = words.select("_id", run.alias("word"))
    if noise:
        crc = F.crc32(F.concat("_id", F.lit(":"), "word"))
        at = (F.col("_crc") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.withColumn("_crc", crc).select(
            F.when(F.col("_crc") % noise == 0, cut).otherwise(F.col("word")).alias("word"))
        words = words.where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _ranked(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order, by doubling; its last symbol is the smallest and stands nowhere else."""
    bits = int(text.max()).bit_length()
    width = max(1, 62 // bits)
    size = len(text)
    padded = np.concatenate([text, np.zeros(width, np.int64)])
    key = np.zeros(size, np.int64)
    for i in range(width):
        key = key << bits | padded[i : i + size]
    while True:
        order = np.argsort(key, kind="stable")
        fresh = np.diff(key[order], prepend=-1) != 0
        if fresh.all():
            return order
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(fresh)
        after = np.zeros(size, np.int64)
        after[: max(0, size - width)] = rank[width:]
        key = rank * (size + 1) + after
        width *= 2


class BidirectionalIndex:
    """FM-indexes of a delimited list of words and of its reverse.

    A match is three numbers: its first suffix rank in either index, and the number of its suffixes. Symbol 0
    ends the list, 1 is the delimiter, letters follow in order.
    """

    def __init__(self, words: list[str]):
        lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(letters)
        starts = np.cumsum(lengths + 1) - lengths  # of the words, behind a delimiter each
        body = np.ones(len(letters) + len(words) + 1, np.int64)
        inside = np.ones(len(body), bool)
        inside[starts - 1] = inside[-1] = False
        body[inside] = np.searchsorted(self.alphabet, letters) + 2
        self.starts = starts
        self.symbols = len(self.alphabet) + 2
        self.suffixes = None
        self.below = [self._table(body), self._table(body[::-1])]
        self.first = self.below[0][-1]

    def _table(self, body: np.ndarray) -> np.ndarray:
        """Row i, column c: how many of the first i last-column symbols are below c."""
        text = np.append(body, 0)
        order = _ranked(text)
        if self.suffixes is None:
            self.suffixes = order
        last = text[order - 1]
        below = np.zeros((len(text) + 1, self.symbols + 1), np.int32)
        for c in range(1, self.symbols + 1):
            np.cumsum(last < c, out=below[1:, c])
        return below

    def everything(self, size: int) -> list[np.ndarray]:
        return [np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, len(self.below[0]) - 1, np.int64)]

    def extend(self, match: list[np.ndarray], symbols: np.ndarray, right: bool) -> list[np.ndarray]:
        """Matches with one more symbol, in front or behind."""
        own, other, size = match[right], match[not right], match[2]
        below = self.below[right]
        low, low1 = below[own, symbols], below[own, symbols + 1]
        high, high1 = below[own + size, symbols], below[own + size, symbols + 1]
        grown = [None, None, (high1 - high - low1 + low).astype(np.int64)]
        grown[right] = self.first[symbols].astype(np.int64) + low1 - low
        grown[not right] = other + high - low
        return grown

    def followers(self, match: list[np.ndarray], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """All letters that stand in front of or behind the matches: number of the match, symbol."""
        below, own = self.below[right], match[right]
        there = np.diff(below[own + match[2]] - below[own], axis=1) > 0
        there[:, :2] = False
        return np.nonzero(there)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, 0 for a letter that no listed word has; and lengths. A row per word."""
        lengths = np.array([len(w) for w in words], np.int64)
        table = np.zeros((len(words), int(lengths.max(initial=0)) + 1), np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, letters)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == letters[known]
        table[np.arange(table.shape[1]) < lengths[:, None]] = np.where(known, at + 2, 0)
        return table, lengths

    def one_error(self, words: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``words``, number of a listed word) pairs at one edit, with the half before the error (``right``)
        or behind it unchanged. Pairs whose error may be in either half are found by both."""
        table, lengths = self.encoded(words)
        half = lengths // 2
        who = np.arange(len(words))
        # The exact half grows towards the delimiter at its own end, the other half away from it.
        exact = half if right else lengths - half
        match = self.everything(len(words))
        for i in range(int(exact.max(initial=0)) + 1):
            on = i <= exact[who]
            where = half[who] - 1 - i if right else half[who] + i
            symbol = np.where(i < exact[who], table[who, np.clip(where, 0, None)], 1)
            match = [np.where(on, g, m) for g, m in zip(self.extend(match, symbol, not right), match)]
            match[2][on & (symbol == 0)] = 0
            keep = match[2] > 0
            who, match = who[keep], [m[keep] for m in match]

        rest = lengths - half if right else half

        def symbol_at(who, used):
            """The symbol due after ``used`` of the other half, at its end the delimiter."""
            where = half[who] + used if right else half[who] - 1 - used
            return np.where(used < rest[who], table[who, np.clip(where, 0, table.shape[1] - 1)], 1)

        found: list[tuple[np.ndarray, np.ndarray]] = []
        wrong_who = wrong_used = np.zeros(0, np.int64)
        wrong = self.everything(0)
        step = 0
        while len(who) or len(wrong_who):
            # Matches with their error behind them only grow as due.
            symbol = symbol_at(wrong_who, wrong_used)
            grown = self.extend(wrong, symbol, right)
            grown[2][symbol == 0] = 0
            done = (grown[2] > 0) & (wrong_used == rest[wrong_who])
            found.append((wrong_who[done], self.suffixes[grown[0][done]]))
            more = (grown[2] > 0) & ~done
            parts = [(wrong_who[more], wrong_used[more] + 1, [m[more] for m in grown])]
            if len(who):
                used = np.full(len(who), step)
                due = symbol_at(who, used)
                inner = used < rest[who]
                parts.append((who[inner], used[inner] + 1, [m[inner] for m in match]))  # left out
                at, letter = self.followers(match, right)
                differs = letter != due[at]
                at, letter = at[differs], letter[differs]
                grown = self.extend([m[at] for m in match], letter, right)
                parts.append((who[at], used[at], grown))  # put in
                swap = inner[at]
                parts.append((who[at[swap]], used[at[swap]] + 1, [m[swap] for m in grown]))  # replaced
                match = self.extend(match, due, right)
                match[2][(due == 0) | ~inner] = 0
                keep = match[2] > 0
                who, match = who[keep], [m[keep] for m in match]
            wrong_who, wrong_used = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            wrong = [np.concatenate([p[2][i] for p in parts]) for i in range(3)]
            step += 1
        asked, place = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(np.column_stack([asked, np.searchsorted(self.starts, place + 1)]), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _search(items: pa.Table, asked: pa.Table) -> pa.Table:
    """Words with near ones in a shard: their number and the most frequent, ties to the smaller."""
    out: list[tuple] = []
    if items.num_rows and asked.num_rows:
        right = items["side"][0].as_py() == 0
        listed, counts = items["word"].to_pylist(), np.array(items["n"])
        index = BidirectionalIndex(listed)
        names = asked["wanted"].to_pylist()
        for at in range(0, len(names), TOGETHER):
            words = names[at : at + TOGETHER]
            who, near = index.one_error(words, right)
            if not right:  # those with the first half unchanged as well are found by its own search
                own = np.array([not listed[j].startswith(words[i][: len(words[i]) // 2])
                                for i, j in zip(who.tolist(), near.tolist())], bool)
                who, near = who[own], near[own]
            cuts = np.flatnonzero(np.diff(who, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(who)]):
                best = min((-int(counts[j]), listed[j]) for j in near[a:b].tolist())
                out.append((words[who[a]], b - a, -best[0], best[1]))
    columns = list(zip(*out)) or [()] * 4
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("word", "near", "form_n", "form"), columns, types)})


def _halves(side: int, length: Column) -> Column:
    """Beginning (side 0) or end of a word as looked for by words of ``length``."""
    if side == 0:
        return F.substring("word", F.lit(1), F.floor(length / 2).cast("int"))
    take = F.floor((length + 1) / 2).cast("int")
    return F.substring("word", F.length("word") - take + 1, take)


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of the words (stored, distinct: word, n) that have near ones: their number,
    and the most frequent."""
    rows = words.count()
    shards = max(1, -(-3 * rows // shard_words))

    def dealt(lengths: list[Column]) -> DataFrame:
        shard = lambda side, length: F.struct(
            F.lit(side).alias("side"),
            F.pmod(F.xxhash64(F.lit(side), _halves(side, F.greatest(length, F.lit(0)))), F.lit(shards)).alias("shard"))
        places = F.array_distinct(F.array(*(shard(side, length) for side in (0, 1) for length in lengths)))
        return words.select("word", "n", F.inline(places))

    size = F.length("word")
    listed, asked = dealt([size - 1, size, size + 1]), dealt([size])
    crowded = listed.groupBy("side", "shard").agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * shard_words).select(
        "side", "shard", F.ceil(F.col("_n") / shard_words).cast("long").alias("parts"))
    crowded = store(crowded, "crowded-shards")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    keys = ["side", "shard", "part"]
    listed = listed.join(crowded, keys[:2], "left").withColumn("part", F.pmod(F.xxhash64("word"), parts)).drop("parts")
    asked = asked.join(crowded, keys[:2], "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select(*keys, F.col("word").alias("wanted"))
    found = listed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        _search, "word string, near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def grouped(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Words (word, n) with their form and root: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. A form is the near word of
    largest n (ties: the smallest in code-point order) if that is at least ``ratio`` times the word's own n,
    else null; the root is where the forms lead to. Null words take no part, n of repeated rows is added up. An
    empty table gives no rows. Any characters and lengths may be in words; other columns play no part.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants: a ratio of 2 at least")
    own = store(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    near = near_words(own, shard_words)
    far = F.col("form_n") >= ratio * F.col("n")
    table = store(own.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")), "forms")
    least, most = own.agg(F.min("n"), F.max("n")).first()
    hops = 0  # every hop multiplies n
    while least is not None and max(least, 1) * ratio ** (hops + 1) <= most:
        hops += 1
    roots = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, hops - 1).bit_length()):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = store(roots.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root")), "roots")
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
