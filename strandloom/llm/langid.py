"""Language of pages and documents by Bayesian fusion of four kinds of evidence.

- Text: log-likelihood of its byte trigrams under one model per language, fitted on a bounded sample
  of the documents with its label.
- Declared language: the ``lang`` attribute of the markup.
- Address tag: a language named by the address, as country suffix of the host or first part of the path.
- Prior of the host, smoothed by its domain, that by its suffix, and that by all rows.

Reliability of declarations and tags, and all priors, are counted by grouped aggregation over all
rows, with the language that the text alone suggests as the vote of a row. A row's own vote is left
out of its host's prior.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.common import bounded_batches, per_batch, store
from strandloom.llm.links import host_of, path_of

#: Distinct labelled texts of each language that its text model is fitted on.
SAMPLE_ROWS = 2000
SLOTS = 1 << 16
#: Trigrams of one text depend on each other: a text counts as at most so many independent ones.
INDEPENDENT = 200
#: Rows of prior belief with which a level of the hierarchy is smoothed by the one above.
STRENGTH = 20.0
#: Country suffixes that are not the code of their main language.
_SUFFIXES = {"at": "de", "mx": "es", "ar": "es", "uk": "en", "us": "en"}

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>|&[a-z#0-9]{1,10};")


def visible(html: str) -> str:
    """Text of a page outside of tags, scripts, styles, comments and character references."""
    return _HIDDEN.sub(" ", html)


def trigram_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all trigrams of lower-cased texts, and where each text's begin (one more at the end)."""
    data = np.frombuffer(b" ".join(texts) + b"   ", np.uint8).astype(np.uint32)
    slots = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return slots, ends


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS):
    """(languages, table of log-probabilities by slot and language), fitted on about ``rows`` texts a language.

    All labels of rows with a text are languages, however rare. Distinct texts are counted per label by
    their hashes, and each label's sample takes the share ``rows`` / distinct of the hashes, so its size grows
    neither with the table nor shrinks with copies; a label with at most ``rows`` texts gives all. Rows
    without text or label are left out. The driver holds one count per label and one row of the table each.
    """
    known = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    hashed = known.withColumn("hash", F.xxhash64("text"))
    distinct = hashed.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    sizes = dict(map(tuple, distinct.collect()))
    share = F.get(F.lit([max(n, 1) for _, n in sorted(sizes.items())] or [1]),
                  F.array_position(F.lit(sorted(sizes) or [""]), F.col("lang")).cast("int") - 1)
    sample = hashed.where(F.pmod(F.col("hash"), share) < rows).select("lang", "text").distinct().coalesce(4)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slots, _ = trigram_slots([value.lower().encode()])
                own = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                own += np.bincount(slots, minlength=SLOTS)
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([own.tobytes()], pa.binary())], names=["lang", "counts"])

    sums: dict[str, np.ndarray] = {}
    for lang, counts in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        sums[lang] = sums.get(lang, 0) + np.frombuffer(counts, np.int64)
    languages = sorted(sizes)
    table = np.array([sums.get(c, np.zeros(SLOTS)) for c in languages], float).reshape(-1, SLOTS) + 0.5
    return languages, np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)


def address_tag(url: Column, languages: list[str]) -> Column:
    """Language that the address names, or null."""
    suffix = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    for code, lang in _SUFFIXES.items():
        suffix = F.when(suffix == code, lang).otherwise(suffix)
    part = F.lower(F.regexp_extract(path_of(url), r"^/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1))
    return F.coalesce(*[F.when(x.isin(languages), x) for x in (part, suffix)])


def declared_language(html: Column, languages: list[str]) -> Column:
    """Language code of the root element's ``lang`` attribute; null if absent or unknown."""
    code = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2})\b""", 1))
    return F.when(code.isin(languages), code)


def from_pages(pages: DataFrame, languages: list[str]) -> DataFrame:
    """Evidence columns of pages: host, domain, suffix, declared, tag, markup."""
    host = host_of(F.col("url"))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"),
        host.alias("host"), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"),
        F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        declared_language(F.col("html"), languages).alias("declared"),
        address_tag(F.col("url"), languages).alias("tag"),
        F.coalesce(F.col("html"), F.lit("")).alias("text"), F.lit(True).alias("markup"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Evidence columns of plain documents: their source is their host, and nothing is declared."""
    source = F.coalesce(F.col("source"), F.lit(""))
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"),
        source.alias("host"), F.lit("documents").alias("domain"), F.lit("documents").alias("suffix"),
        none.alias("declared"), none.alias("tag"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"), F.lit(False).alias("markup"))


def scored(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``rows`` with ``likelihood``, the log-likelihood per language, in place of the text."""
    bounded_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c not in ("text", "markup")]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        markup = batch.column("markup").to_pylist()
        data = [(visible(t) if m else t).lower().encode() for t, m in zip(texts, markup)]
        out = np.zeros((len(data), table.shape[1]))
        at = 0
        while at < len(data):  # a few megabytes at a time
            to, size = at, 0
            while to < len(data) and (to == at or size < 1 << 22):
                size, to = size + len(data[to]), to + 1
            slots, ends = trigram_slots(data[at:to])
            for c in range(table.shape[1]):
                out[at:to, c] = np.add.reduceat(table[slots, c], ends[:-1], dtype=float)
            at = to
        sizes = np.array([len(d) for d in data])
        out[sizes == 0] = 0.0
        out *= np.minimum(1.0, INDEPENDENT / np.maximum(sizes, 1))[:, None]
        out -= out.max(1, keepdims=True) if table.shape[1] else 0
        lists = pa.ListArray.from_arrays(
            np.arange(len(data) + 1, dtype=np.int32) * table.shape[1], pa.array(out.ravel(), pa.float64()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "likelihood"])

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in kept)
    return rows.mapInArrow(per_batch(score), f"{kinds}, likelihood array<double>")


def identified(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, page_id, lang, confidence, text_lang, declared, tag for rows of evidence.

    A row without text is judged by the other evidence, without any by the prior of all rows. Repeated
    rows each count and stay. Without a single labelled document no language is known: lang is null.
    Empty tables give no rows. The result has one row per input row.
    """
    if not languages:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"),
                           none.alias("text_lang"), "declared", "tag")
    k = len(languages)
    names = F.lit(languages)
    best = F.get(names, (F.array_position("likelihood", F.array_max("likelihood")) - 1).cast("int"))
    likely = store(scored(rows, table).withColumn("text_lang", best), "likelihoods")

    # Votes of each level, as arrays in the order of the languages.
    tally = [F.count_if(F.col("text_lang") == c).alias(f"n{i}") for i, c in enumerate(languages)]
    votes = [f"n{i}" for i in range(k)]
    per_host = store(likely.groupBy("suffix", "domain", "host").agg(*tally), "host-votes")

    def level(*by: str) -> DataFrame:
        return per_host.groupBy(*by).agg(F.array(*[F.sum(n) for n in votes]).alias(f"{by[-1]}_n"))

    total = per_host.agg(*[F.sum(n) for n in votes]).first()
    every = [(n or 0) + 1.0 for n in total]
    prior = F.lit([n / sum(every) for n in every])

    def smoothed(counts: Column, above: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda n, p: (n + STRENGTH * p) / (size + STRENGTH))

    hosts = (
        per_host.select("suffix", "domain", "host", F.array(*votes).alias("host_n"))
        .join(level("suffix", "domain"), ["suffix", "domain"]).join(level("suffix"), ["suffix"])
        .select("suffix", "domain", "host", "host_n", smoothed(F.col("domain_n"), smoothed(F.col("suffix_n"), prior)).alias("above"))
    )

    def reliability(column: str) -> Column:
        """log P(column = said | language), for each language; zero where nothing is said."""
        counts = np.ones((k, k)) / k  # language, said
        pairs = likely.where(F.col(column).isNotNull()).groupBy("text_lang", column).count().collect()
        for lang, said, n in pairs:
            counts[languages.index(lang), languages.index(said)] += n
        logs = np.log(counts / counts.sum(1, keepdims=True))
        out = F.lit([0.0] * k)
        for j, said in enumerate(languages):
            out = F.when(F.col(column) == said, F.lit(logs[:, j].tolist())).otherwise(out)
        return out

    others = F.zip_with("host_n", names, lambda n, c: n - (c == F.col("text_lang")).cast("int"))
    logs = F.transform(smoothed(others, F.col("above")), lambda p: F.log(p))
    for part in (F.col("likelihood"), reliability("declared"), reliability("tag")):
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    weight = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    # Rows and hosts never have null keys: an absent host is empty.
    return likely.join(hosts, ["suffix", "domain", "host"], "left").withColumn("logs", logs).select(
        "doc_id", "page_id",
        F.get(names, (F.array_position("logs", F.array_max("logs")) - 1).cast("int")).alias("lang"),
        (1 / F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)).alias("confidence"),
        "text_lang", "declared", "tag")
