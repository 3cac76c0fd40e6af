"""Passages that an earlier document has: suffix automata of reference shards, and matching statistics.

A word goes if a window of 13 words around it also stands in a document with a smaller id.

Broadcasting automata of all earlier documents to all later ones would take work that grows with the
square of the table, so documents only go to the shards that can match them. Each window picks an anchor,
its five-word run with the smallest hash; equal windows pick equal anchors. Successive windows with
one anchor form a chunk. Chunks meet by their anchor's hash:

1. Only hashes travel. Equal chunks are settled at once: all but those of the smallest id match it.
2. Where an anchor has several differing chunks, the first document of each sends its words to the anchor's shard.
3. A shard takes its chunks by document id. Each is streamed through the suffix automaton of the chunks
   before it; positions where the matching statistic reaches 13 end a repeated window. Then the
   chunk joins the automaton.
4. The found windows return to their block of documents, where maximal spans of words are removed.

Work follows the text. A frequent passage is one chunk per block in step 1 and one in step 3. An anchor
with very many differing chunks sends its windows one by one, by their own hash, so no shard grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.blocks import Segments, U, Words, blocked, each_block, with_blocks
from strandloom.llm.common import NO_ID, free_name, shuffle_width, store

WINDOW = 13
GRAM = 5
#: Characters of text whose chunks' hashes go to one bucket.
BUCKET_CHARS = 32_000_000
#: Words of one automaton; a new one starts at the next anchor.
SHARD_WORDS = 20_000
#: Differing chunks of an anchor above which its windows are matched one by one.
MANY_CHUNKS = 2_000

KEEP, REPEATED, COMPARE, SINGLY = range(4)


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.follow: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[int]) -> None:
        follow, link, length = self.follow, self.link, self.length
        last = 0
        for w in words:
            there = follow[last].get(w)
            if there is not None and length[there] == length[last] + 1:
                last = there
                continue
            if there is None:
                now = self._state({}, length[last] + 1, 0)
                at = last
                while at >= 0 and w not in follow[at]:
                    follow[at][w] = now
                    at = link[at]
                if at >= 0:
                    link[now] = self._direct(at, w)
                last = now
            else:
                last = self._direct(last, w)

    def _state(self, follow: dict[int, int], length: int, link: int) -> int:
        self.follow.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _direct(self, at: int, w: int) -> int:
        """The state after ``w`` that is one longer than ``at``, split off if need be."""
        follow, link, length = self.follow, self.link, self.length
        there = follow[at][w]
        if length[there] == length[at] + 1:
            return there
        split = self._state(dict(follow[there]), length[at] + 1, link[there])
        link[there] = split
        while at >= 0 and follow[at].get(w) == there:
            follow[at][w] = split
            at = link[at]
        return split

    def statistics(self, words: list[int]) -> Iterator[int]:
        """Length of the longest known run that ends at each word."""
        follow, link, length = self.follow, self.link, self.length
        at = size = 0
        for w in words:
            while at and w not in follow[at]:
                at = link[at]
                size = length[at]
            there = follow[at].get(w)
            if there is not None:
                at, size = there, size + 1
            yield size


class Chunks:
    """Chunks of a block's documents, and its entries: distinct (anchor, chunk), each with its smallest id."""

    def __init__(self, words: Words, ids: np.ndarray, buckets: int):
        size = max(0, len(words) - WINDOW + 1)
        self.windows = size
        owner = words.owner
        runs = Segments(words.hashes, 1)
        self.runs = runs
        at = np.arange(max(0, len(words) - GRAM + 1))
        grams = runs(at, at + GRAM)
        least, where = grams[:size].copy(), np.zeros(size, np.int64)
        for j in range(1, WINDOW - GRAM + 1):
            smaller = grams[j : j + size] < least
            least[smaller] = grams[j : j + size][smaller]
            where[smaller] = j
        where += np.arange(size)
        valid = owner[:size] == owner[WINDOW - 1 : WINDOW - 1 + size]
        border = np.ones(size + 1, bool)
        if size:
            border[1:size] = (where[1:] != where[:-1]) | (valid[1:] != valid[:-1])
        borders = np.flatnonzero(border)
        first, last = borders[:-1], borders[1:]
        fine = valid[first] if size else np.zeros(0, bool)
        self.first, self.count = first[fine], (last - first)[fine]
        self.anchor = least[self.first]
        self.content = runs(self.first, self.first + self.count + WINDOW - 1)
        self.doc = ids[owner[self.first]] if size else np.zeros(0, np.int64)
        bucket = ((self.anchor >> U(32)) % U(buckets)).astype(np.int64)
        order = np.lexsort((self.doc, self.content, self.anchor, bucket))
        a, c = self.anchor[order], self.content[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        #: One chunk of each entry, of its smallest id; and the entry of each chunk.
        self.sample = order[fresh]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        self.bounds = np.searchsorted(bucket[self.sample], np.arange(buckets + 1))


def _ids(rows: pa.RecordBatch, place: int) -> np.ndarray:
    return np.array(rows.column(place).cast(pa.int64()).fill_null(NO_ID))


def _bytes(column) -> list[bytes]:
    return column.to_pylist()


def _settled(table: pa.Table) -> pa.Table:
    """What becomes of the entries of one bucket: see the codes."""
    anchors, contents, docs = (
        np.frombuffer(b"".join(_bytes(table[c])), kind)
        for c, kind in (("anchors", U), ("contents", U), ("docs", np.int64)))
    order = np.lexsort((docs, contents, anchors))
    a, c, d = anchors[order], contents[order], docs[order]
    new_anchor, new_pair = np.ones(len(a), bool), np.ones(len(a), bool)
    new_anchor[1:] = a[1:] != a[:-1]
    new_pair[1:] = new_anchor[1:] | (c[1:] != c[:-1])
    pair, group = np.cumsum(new_pair) - 1, np.cumsum(new_anchor) - 1
    pairs = np.bincount(group, new_pair).astype(np.int64)[group]
    code = np.where(pairs > MANY_CHUNKS, SINGLY, np.where(pairs > 1, COMPARE, KEEP)).astype(np.uint8)
    code[d > d[new_pair][pair]] = REPEATED
    back = np.empty_like(code)
    back[order] = code
    ends = np.cumsum([len(x) // 8 for x in _bytes(table["docs"])])
    parts = np.split(back, ends[:-1])
    some = [i for i, p in enumerate(parts) if p.any()]
    blocks, buckets = table["block"].to_pylist(), table["bucket"].to_pylist()
    return pa.table({
        "block": pa.array([blocks[i] for i in some], pa.int64()),
        "bucket": pa.array([buckets[i] for i in some], pa.int32()),
        "codes": pa.array([parts[i].tobytes() for i in some], pa.binary()),
    })


_SENT = {"entry": np.int32, "at": np.int32, "size": np.int32, "key": U, "doc": np.int64, "words": U}


def _matched(table: pa.Table) -> pa.Table:
    """Repeated windows of the chunks sent to one bucket, by shards of whole anchors."""
    data = {c: np.frombuffer(b"".join(_bytes(table[c])), kind) for c, kind in _SENT.items()}
    owner = np.repeat(np.arange(table.num_rows), [len(x) // 4 for x in _bytes(table["size"])])
    size, key, doc = data["size"], data["key"], data["doc"]
    start = np.cumsum(size) - size
    order = np.lexsort((doc, key))
    sorted_key = key[order]
    borders = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    groups = np.split(order, borders[1:]) if len(order) else []
    hits: list[tuple[int, int]] = []
    shard: list[np.ndarray] = []
    held = 0

    def run_shard() -> None:
        automaton = Automaton()
        items = np.concatenate(shard)
        items = items[np.argsort(doc[items], kind="stable")]
        waiting: list[list[int]] = []
        now = None
        for i in items.tolist():
            if doc[i] != now:  # chunks of one document are no reference for each other
                for words in waiting:
                    automaton.add(words)
                waiting, now = [], doc[i]
            words = data["words"][start[i] : start[i] + size[i]].tolist()
            found = [n - WINDOW + 1 for n, s in enumerate(automaton.statistics(words)) if s >= WINDOW]
            hits.extend((i, n) for n in found)
            if len(found) < len(words) - WINDOW + 1:
                waiting.append(words)

    for group in groups:
        if len(group) < 2:
            continue
        shard.append(group)
        held += int(size[group].sum())
        if held >= SHARD_WORDS:
            run_shard()
            shard, held = [], 0
    if shard:
        run_shard()

    if not hits:
        return pa.table({"block": pa.array([], pa.int64()), "entry": pa.array([], pa.binary()), "at": pa.array([], pa.binary())})
    item, window = np.array(hits, np.int64).T
    rows = owner[item]
    sort = np.argsort(rows, kind="stable")
    item, window, rows = item[sort], window[sort], rows[sort]
    cuts = np.flatnonzero(rows[1:] != rows[:-1]) + 1
    blocks = table["block"].to_pylist()
    return pa.table({
        "block": pa.array([blocks[r[0]] for r in np.split(rows, cuts)], pa.int64()),
        "entry": pa.array([data["entry"][x].tobytes() for x in np.split(item, cuts)], pa.binary()),
        "at": pa.array([(data["at"][x] + w).astype(np.int32).tobytes()
                        for x, w in zip(np.split(item, cuts), np.split(window, cuts))], pa.binary()),
    })


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", respace: bool = False
) -> tuple[DataFrame, str, str]:
    """``docs`` with repeated passages removed from the text, and the names of two new columns: the
    number of words and of removed words.

    Where something was removed, the kept words are joined by one space; ``respace`` does so for all
    texts. Windows are judged on the texts as given. A null text has no words and stays null (empty with
    ``respace``). A null id counts as larger than all others; documents with equal ids, null or not, do not
    count as earlier than each other, so repeated rows are treated alike. Texts under 13 words stay. An empty table stays empty.
    """
    total_name, removed_name = free_name(docs, "n_words"), free_name(docs, "n_removed")
    id_at, text_at = docs.columns.index(doc_id), docs.columns.index(text)
    blocks = blocked(docs, "texts", text)
    chars = blocks.agg(F.sum("chars")).first()[0] or 0
    buckets = max(shuffle_width(docs.sparkSession), -(-chars // BUCKET_CHARS))

    def chunks_of(rows: pa.RecordBatch) -> tuple[Words, Chunks]:
        words = Words(rows.column(text_at).to_pylist())
        return words, Chunks(words, _ids(rows, id_at), buckets)

    def hashes(block: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, own = chunks_of(rows)
        used = np.flatnonzero(np.diff(own.bounds))
        parts = [own.sample[own.bounds[b] : own.bounds[b + 1]] for b in used]
        yield pa.RecordBatch.from_arrays([
            pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block)),
            *(pa.array([values[p].tobytes() for p in parts], pa.binary())
              for values in (own.anchor, own.content, own.doc)),
        ], names=["bucket", "block", "anchors", "contents", "docs"])

    entries = each_block(
        blocks, hashes, "bucket int, block long, anchors binary, contents binary, docs binary")
    codes = store(
        entries.groupBy("bucket").applyInArrow(_settled, "block long, bucket int, codes binary"), "repeats")

    def with_codes(own: Chunks, bucket: list, found: list) -> np.ndarray:
        code = np.zeros(len(own.sample), np.uint8)
        for b, values in zip(bucket, found):
            code[own.bounds[b] : own.bounds[b + 1]] = np.frombuffer(values, np.uint8)
        return code

    def sent(rows: pa.RecordBatch, info: pa.Table) -> pa.Table:
        out = {c: [] for c in ("bucket", "block", *_SENT)}
        if info.num_rows:
            words, own = chunks_of(rows)
            code = with_codes(own, info["bucket"].to_pylist(), info["codes"].to_pylist())
            whole, single = np.flatnonzero(code == COMPARE), np.flatnonzero(code == SINGLY)
            each = own.count[own.sample[single]]
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            entry = np.concatenate([whole, np.repeat(single, each)])
            at = np.concatenate([0 * whole, inside])
            first = own.first[own.sample[entry]] + at
            size = np.concatenate([own.count[own.sample[whole]] + WINDOW - 1, np.full(len(inside), WINDOW)])
            key = np.where(np.arange(len(entry)) < len(whole), own.anchor[own.sample[entry]], own.runs(first, first + WINDOW))
            bucket = ((key >> U(16)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            block = info["block"][0].as_py()
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                p = order[cuts[b] : cuts[b + 1]]
                spread = np.repeat(first[p], size[p]) + np.arange(size[p].sum()) - np.repeat(np.cumsum(size[p]) - size[p], size[p])
                values = {"entry": entry[p], "at": at[p], "size": size[p], "key": key[p],
                          "doc": own.doc[own.sample[entry[p]]], "words": words.hashes[spread]}
                out["bucket"].append(b)
                out["block"].append(block)
                for c, kind in _SENT.items():
                    out[c].append(values[c].astype(kind).tobytes())
        kinds = {"bucket": pa.int32(), "block": pa.int64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})

    passages = with_blocks(
        blocks, codes, sent, "bucket int, block long, " + ", ".join(f"{c} binary" for c in _SENT))
    windows = passages.groupBy("bucket").applyInArrow(_matched, "block long, entry binary, at binary")
    info = codes.select("block", "bucket", "codes", F.lit(None).cast("binary").alias("at")).unionByName(
        windows.select("block", F.lit(-1).alias("bucket"), F.col("entry").alias("codes"), "at"))

    schema = T.StructType([
        *docs.schema.fields, T.StructField(total_name, T.LongType()), T.StructField(removed_name, T.LongType())])

    def cut(rows: pa.RecordBatch, info: pa.Table) -> pa.Table:
        texts = rows.column(text_at).to_pylist()
        words, own = chunks_of(rows)
        bucket, found, ats = (info[c].to_pylist() for c in ("bucket", "codes", "at"))
        code = with_codes(own, [b for b in bucket if b >= 0], [f for b, f in zip(bucket, found) if b >= 0])
        # A chunk whose entry has a smaller id in this block or elsewhere is repeated as a whole.
        gone = np.zeros(own.windows + 1, np.int64)
        smallest = own.doc[own.sample][own.entry]
        whole = (own.doc > smallest) | (code[own.entry] == REPEATED)
        np.add.at(gone, own.first[whole], 1)
        np.add.at(gone, own.first[whole] + own.count[whole], -1)
        gone = np.cumsum(gone)[:-1] > 0
        # The others have the windows found by matching; equal chunks of one id share them.
        rest = np.flatnonzero(~whole)
        rest = rest[np.argsort(own.entry[rest], kind="stable")]
        of_entry = own.entry[rest]
        for b, e, a in zip(bucket, found, ats):
            if b < 0:
                entry, at = np.frombuffer(e, np.int32), np.frombuffer(a, np.int32)
                low, high = np.searchsorted(of_entry, entry), np.searchsorted(of_entry, entry, "right")
                many = high - low
                chunk = rest[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                gone[own.first[chunk] + np.repeat(at, many)] = True
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(gone), 1)
        np.add.at(cover, np.flatnonzero(gone) + WINDOW, -1)
        drop = np.cumsum(cover)[:-1] > 0
        removed = np.bincount(words.owner[drop], minlength=len(texts))
        for i in range(len(texts)):
            if removed[i] or respace:
                own_words = (texts[i] or "").encode().split()
                if removed[i]:
                    lost = drop[words.bounds[i] : words.bounds[i + 1]].tolist()
                    own_words = [w for w, x in zip(own_words, lost) if not x]
                texts[i] = b" ".join(own_words).decode()
        columns = [*rows.columns]
        columns[text_at] = pa.array(texts, rows.column(text_at).type)
        return pa.table([*columns, pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64))], names=schema.names)

    return with_blocks(blocks, info, cut, schema), total_name, removed_name
