"""Personal data: fixed formats first, then identifiers found by their context.

The base finds spans of four kinds by format and checksum. Each is a seed. The words around seeds
form lexical patterns; identifier-like strings that the base did not take are candidates, with the
same patterns. Over the graph of patterns and instances (distinct strings) two scores are passed to and
fro: a pattern is as good as the average of its instances, an instance as likely as one of its patterns
being right. Candidates that high-confidence patterns reach become spans of the pattern's kind and seeds
in their turn, until nothing changes. What else stands in a context, strings of another kind or such as
fail the check of this one, speaks against its pattern.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import bounded_batches, free_name, per_batch, store

KINDS = ("email", "ip", "card", "phone")
#: Scores are final when no candidate is added and no confidence grows by more.
TOLERANCE = 1e-6
DIGITS = 9
#: Distinct seeds that a pattern needs, and the confidence that a pattern needs to add spans.
SUPPORT = 3
CONFIDENCE = 0.75

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Quantifiers give nothing back, so that no text makes a search more than linear. None of the
# formats could match after giving back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Identifier-like strings by kind; what the base accepts is taken out of them.
_CANDIDATES = {
    "email": re.compile(
        r"(?<![\w.%+-])\w[\w.%+-]{0,63}\x20?(?:@|\(at\)|\[at\])\x20?[\w-]{1,63}"
        r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\w-]{1,63}){1,5}"),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<![\w.+-])[0-9](?:[\x20.-]?[0-9]){11,18}(?![\w-]|\.[0-9])"),
    "phone": re.compile(r"(?<![\w.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![\w-]|\.[0-9])"),
}
_LEFT = re.compile(r"[^\x20\x09-\x0D]+")
_REACH = 80


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with the local characters before it, if a domain follows."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            end = tail.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of each kind, leftmost first; matches that fail their check are dropped."""
    found = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            found["phone"].append(m.span())
    return found


def _failed(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of strings that have a kind's format but fail its check, without those that
    touch a span or candidate of that kind in ``taken``."""
    if not _DIGIT.search(text):
        return []
    found = [("ip", *m.span()) for m in _IP.finditer(text)]
    found += [("card", *m.span()) for m in _CARD.finditer(text)
              if len(m.group()) >= 13 and 13 <= len(_DIGIT.findall(m.group())) <= 19]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text)]
    return [f for f in found if not any(k == f[0] and a < f[2] and f[1] < b for k, a, b in taken)]


def _candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of identifier-like strings that touch nothing in ``taken`` nor each other."""
    if "@" not in text and "at)" not in text and "at]" not in text and not _DIGIT.search(text):
        return []
    busy, found = sorted(taken), []
    for kind, pattern in _CANDIDATES.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            if not any(x < b and a < y for x, y in busy):
                found.append((kind, a, b))
                busy.append((a, b))
    return sorted(found, key=lambda x: x[1])


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: two words before it; one before and one after it."""
    left = [w.lower() for w in _LEFT.findall(text[max(0, start - _REACH) : start])]
    right = _LEFT.match(text, end + 1) if end < len(text) and text[end] in " \n\t" else None
    found = []
    if len(left) > 1:
        found.append(f"{left[-2]} {left[-1]} _")
    if left and right:
        found.append(f"{left[-1]} _ {right.group()[:_REACH].lower()}")
    return found


_SPAN = "struct<kind: string, start: int, end: int>"
_FOUND = (
    f"struct<spans: array<{_SPAN}>, candidates: array<struct<kind: string, start: int, end: int, "
    "patterns: array<string>, instance: string>>, seeds: array<struct<kind: string, "
    "patterns: array<string>, instance: string>>, failed: array<struct<kind: string, "
    "patterns: array<string>, instance: string>>>"
)


def scanned(docs: DataFrame, text: str = "text", name: str = "_private") -> DataFrame:
    """``docs`` with a struct of base spans, candidates, seeds and failed strings of each whole text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(_FOUND))])
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in batch.column(place):
            t = value.as_py() or ""
            spans = [(k, a, b) for k, s in base_spans(t).items() for a, b in s]

            def entry(kind, a, b):
                instance = hashlib.blake2b(t[a:b].lower().encode(), digest_size=12).hexdigest()
                return {"kind": kind, "start": a, "end": b, "patterns": _contexts(t, a, b), "instance": instance}

            candidates = _candidates(t, [s[1:] for s in spans])
            rows.append({
                "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans],
                "candidates": [entry(*c) for c in candidates],
                "seeds": [entry(*s) for s in spans],
                "failed": [entry(*f) for f in _failed(t, spans + candidates)],
            })
        kind = pa.struct([
            ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
            ("candidates", pa.list_(pa.struct([
                ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                ("patterns", pa.list_(pa.string())), ("instance", pa.string())]))),
            *((part, pa.list_(pa.struct([
                ("kind", pa.string()), ("patterns", pa.list_(pa.string())), ("instance", pa.string())])))
              for part in ("seeds", "failed")),
        ])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=schema.names)

    return docs.mapInArrow(per_batch(run), schema)


def confident_patterns(found: DataFrame, name: str = "_private") -> DataFrame:
    """(kind, pattern): the patterns that may add spans.

    Edges join a pattern with its distinct instances. Seeds have score one; a pattern scores the sum of its
    instances' scores over their number, one more, and the number of strings against it, and counts only with
    SUPPORT distinct seeds; a candidate scores one minus the chance that all its patterns are wrong. A pattern
    that reaches CONFIDENCE makes its candidates seeds, and support is counted again. Both only grow, so this
    ends at the one fixed point. A candidate's score holds a share of the pattern's own confidence; for
    that share the equation is solved (``k + o`` over ``k + o + 1 + against``, with k seeds and what other
    patterns say of the candidates, o), so the number of rounds does not depend on the number of candidates.
    """
    def edges(part: str, seed: bool) -> DataFrame:
        return (
            found.select(F.explode(F.col(f"{name}.{part}")).alias("e"))
            .select("e.kind", "e.instance", F.explode("e.patterns").alias("pattern"), F.lit(seed).alias("seed"))
        )

    key, one = ["kind", "pattern"], ["kind", "instance"]
    graph = store(
        edges("seeds", True).unionByName(edges("candidates", False))
        .groupBy("kind", "pattern", "instance").agg(F.bool_or("seed").alias("seed")), "pattern-edges")
    # Only patterns with candidates have something to decide.
    wanted = graph.groupBy(*key).agg(F.count_if("seed").alias("own"), F.count_if(~F.col("seed")).alias("open")).where(
        F.col("open") > 0).drop("open")
    claims = graph.where("seed").groupBy("pattern").agg(F.count("*").alias("claims"))
    failed = edges("failed", False).groupBy(*key).agg(F.countDistinct("instance").alias("failed"))
    against = store(
        wanted.join(claims, "pattern", "left").join(failed, key, "left").select(
            *key, (F.coalesce("claims", F.lit(0)) - F.col("own") + F.coalesce("failed", F.lit(0))).alias("against")),
        "pattern-against")
    # A string that is a seed in one place is one in all.
    sure = graph.where("seed").select(*one).distinct().withColumn("sure", F.lit(True))
    graph = store(
        graph.join(against, key, "left_semi").join(sure, one, "left").select(
            *key, "instance", F.coalesce("sure", F.lit(False)).alias("seed")), "pattern-edges")
    scores = None
    while True:
        patterns = graph.groupBy(*key).agg(F.count_if("seed").alias("k")).where(F.col("k") >= SUPPORT)
        if scores is None:
            patterns = patterns.withColumns({"before": F.lit(0.0), "others": F.lit(0.0)})
        else:
            doubts = graph.where(~F.col("seed")).join(
                scores.select(*key, F.log1p(-F.col("confidence")).alias("doubt")), key)
            joint = doubts.groupBy(*one).agg(F.sum("doubt").alias("joint"))
            others = doubts.join(joint, one).groupBy(*key).agg(
                F.sum(1 - F.exp(F.col("joint") - F.col("doubt"))).alias("others"))
            before = scores.select(*key, F.col("confidence").alias("before"))
            patterns = patterns.join(others, key, "left").join(before, key, "left").fillna(0.0, ["before", "others"])
        right = F.col("k") + F.col("others")
        patterns = store(
            patterns.join(against, key).withColumn("confidence", F.round(right / (right + 1 + F.col("against")), DIGITS)),
            "pattern-scores")
        good = patterns.where(F.col("confidence") >= CONFIDENCE).select(*key)
        fresh = store(graph.where(~F.col("seed")).join(good, key, "left_semi").select(*one).distinct(), "fresh-seeds")
        if not fresh.isEmpty():
            graph = store(
                graph.join(fresh.withColumn("fresh", F.lit(True)), one, "left").withColumn(
                    "seed", F.col("seed") | F.coalesce("fresh", F.lit(False))).drop("fresh"), "pattern-edges")
        elif patterns.where(F.col("confidence") - F.col("before") > TOLERANCE).isEmpty():
            return good
        scores = patterns


def annotated(docs: DataFrame, text: str = "text", compression: str = "zstd") -> tuple[DataFrame, str]:
    """``docs`` with an array of spans (kind, start, end in code points), sorted by kind as in KINDS and
    start, and the name of that column.

    A null text counts as empty and has no spans. Rows are told apart by a number given when they are
    written, so repeated rows and null keys are no matter. Empty tables stay empty. The rows
    are written once; only those with candidates are shuffled, and only by that number.
    """
    name, row = free_name(docs, "_private"), free_name(docs, "_private_row")
    found = store(
        scanned(docs, text, name).withColumn(row, F.monotonically_increasing_id()), "private", compression=compression)
    good = store(confident_patterns(found, name), "patterns")
    some = F.size(F.col(f"{name}.candidates")) > 0
    occurrences = found.where(some).select(row, F.explode(F.col(f"{name}.candidates")).alias("c")).select(
        row, "c.kind", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
    added = occurrences.join(good, ["kind", "pattern"], "left_semi").groupBy(F.col(row).alias("_r")).agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("_added"))
    base = F.col(f"{name}.spans")
    plain = found.where(~some).withColumn("_added", F.array().cast(f"array<{_SPAN}>"))
    mixed = found.where(some).join(added, F.col(row) == F.col("_r"), "left").drop("_r")
    spans = F.array_sort(
        F.concat(base, F.coalesce("_added", F.array().cast(f"array<{_SPAN}>"))),
        lambda x, y: F.when(_order(x) != _order(y), _order(x) - _order(y)).otherwise(x["start"] - y["start"]))
    both = plain.unionByName(mixed)
    return both.select(*docs.columns, base.alias(f"{name}_base"), spans.alias(name)), name


def _order(span):
    return F.array_position(F.lit(list(KINDS)), span["kind"]).cast("int")


def span_text(spans):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans become one.

    A text without spans, null included, stays as it is; see ``annotated`` for the other cases.
    """
    found, name = annotated(docs, text)
    ordered = F.sort_array(F.transform(F.col(name), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    value = F.col(text)

    def step(done, s):
        fresh = s["start"] >= done["at"]
        gap = F.substring(value, done["at"] + 1, s["start"] - done["at"])
        return F.struct(
            F.when(fresh, F.concat(done["text"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            .otherwise(done["text"]).alias("text"),
            F.greatest(done["at"], s["end"]).alias("at"))

    whole = F.aggregate(ordered, start, step, lambda d: F.concat(
        d["text"], F.substring(value, d["at"] + 1, F.length(value))))
    new = F.when(F.size(name) > 0, whole).otherwise(value)
    return found.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])
