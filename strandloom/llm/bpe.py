"""Byte-level BPE, encoded by backtracking and decoded by table.

A piece of text is encoded without replaying its merges. All tokens that occur in it are found in
one pass of an Aho-Corasick automaton over its bytes (as Latin-1 characters), which gives the
longest token at each position. From the left, the longest token is taken that is compatible with
the one before it: two tokens are compatible if merging their joined bytes gives just these two
again. A sequence in which all neighbours are compatible is the encoding. If no token fits, the
position is marked as a dead end and the last token is shortened. Each position becomes a dead end
at most once, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from strandloom.llm.common import bounded_batches, per_batch, worker_state

#: Entries a worker keeps of encoded pieces and of compatible pairs; either starts anew when full.
MEMO = 400_000
#: Above so many characters the pieces of a text are streamed instead of listed.
LONG_TEXT = 1 << 20

# The classes of the pattern language of the encoding, where this library's differ: white space
# is the Unicode property.
_SPACE = r"\p{White_Space}"


def compiled(pattern: str) -> regex.Pattern:
    """``pattern`` with white space as the Unicode property, inside and outside of classes."""
    return regex.compile(pattern.replace(r"\s", _SPACE).replace(r"\S", rf"[^{_SPACE}]"))


class _Memo(dict):
    def __init__(self, make, limit=MEMO):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Codec:
    """Encoder and decoder for the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            rows = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"vocabulary without the bytes {missing[:5]}")
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.pattern = compiled(pattern)
        self.automaton = ahocorasick.Automaton()
        for token in self.ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.pairs = _Memo(self._compatible)
        self.shorter = _Memo(self._shorter)
        self.pieces = _Memo(lambda piece: self.encode_piece(piece.encode("utf-8")))

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank, the leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [
                (rank, i) for i in range(len(parts) - 1)
                if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None
            ]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.token[pair[0]] + self.token[pair[1]]) == [*pair]

    def _shorter(self, token: bytes) -> int:
        """Length of the longest token that is a proper prefix of ``token``; 0 for a byte."""
        return next((n for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), 0)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        ranks, pairs, shorter = self.ranks, self.pairs, self.shorter
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        end = len(piece)
        longest = array("i", bytes(4 * (end + 1)))
        for last, size in self.automaton.iter(piece.decode("latin-1")):
            longest[last - size + 1] = size
        dead = bytearray(end + 1)
        ids: list[int] = []
        at, size = 0, longest[0]
        while at < end:
            while size:
                token = piece[at : at + size]
                rank = ranks[token]
                if not dead[at + size] and (not ids or pairs[ids[-1], rank]):
                    break
                size = shorter[token]
            if size:
                ids.append(rank)
                at += size
                size = longest[at]
            elif ids:
                dead[at] = 1
                token = self.token[ids.pop()]
                at -= len(token)
                size = shorter[token]
            else:
                raise ValueError("the vocabulary has no consistent encoding")
        return tuple(ids)

    def encode(self, text: str) -> array:
        if len(text) > LONG_TEXT:
            pieces: Iterable[str] = (m.group() for m in self.pattern.finditer(text))
        else:
            pieces = self.pattern.findall(text)
        ids = array("I")
        ids.extend(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker for one vocabulary."""
    state = worker_state("bpe")
    key = (path, pattern)
    if key not in state:
        state[key] = Codec(path, pattern)
    return state[key]


_COLUMNS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "n_tokens": (pa.int64(), "bigint"),
    "ids_sha256": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text",
    keep: tuple[str, ...] = ("doc_id",), emit: tuple[str, ...] = ("ids", "n_tokens"),
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with those of ``emit``: ids, n_tokens, ids_sha256 (of the
    ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes decoded from them).

    One pass without a shuffle. A null text counts as empty and gives no ids; repeated rows and null
    keys stay as they are; columns outside ``keep`` do not matter, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, docs[text].cast("string").alias("__text"))
    schema = T.StructType(
        [*kept.schema.fields[:-1], *T._parse_datatype_string(
            ", ".join(f"{c} {_COLUMNS[c][1]}" for c in emit)).fields]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path, pattern)
        out: dict[str, list] = {c: [] for c in emit}
        for value in batch.column(len(keep)):
            ids = own.encode(value.as_py() or "")
            if "n_tokens" in out:
                out["n_tokens"].append(len(ids))
            if "ids" in out:
                out["ids"].append(list(ids))
            if "ids_sha256" in out:
                out["ids_sha256"].append(hashlib.sha256(little(ids)).hexdigest())
            if "decoded_sha256" in out:
                out["decoded_sha256"].append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(keep)], *(pa.array(out[c], _COLUMNS[c][0]) for c in emit)],
            names=[*keep, *emit],
        )

    return kept.mapInArrow(per_batch(run), schema)


def decode_documents(
    encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep`` with ``decoded`` (binary) from a column of id arrays; null stays null."""
    kept = encoded.select(*keep, encoded[ids].alias("__ids"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("decoded", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path, pattern)
        values = [None if v is None else own.decode(v) for v in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(keep)], pa.array(values, pa.binary())], names=[*keep, "decoded"]
        )

    return kept.mapInArrow(per_batch(run), schema)


def little(ids: array) -> bytes:
    import sys

    if sys.byteorder != "little":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()
