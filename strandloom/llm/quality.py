"""Quality rules as one projection: a table of thresholds over ratios of lengths, symbols, stop
words and lines, compiled into column expressions. No user function is involved."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.common import SPACES, free_name

#: Frequent function words of the four languages of the corpus, and capitalised.
STOP_WORDS = (
    "the of and to in is was for that on with by be this are from at as or it "
    "le la les de des du et en un une que pour dans est pas sur avec au par "
    "der die das und ist zu den von mit ein eine im dem nicht sich auf für "
    "el los las y una para con por se su del no lo"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low`` <= ``measure`` <= ``high``; an open end is None."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The base rules of the corpus: enough words, and not mostly repeated word triples.
BASE_RULES = (Rule("n_words", low=50), Rule("repeat_word_ratio", high=0.5))
#: What the method adds.
RULES = (
    Rule("mean_word_length", low=2.0, high=15.0),
    Rule("symbol_word_ratio", high=0.3),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("longest_word", high=1000),
)

# Measures by name, from a struct with the fields COUNTS. Each is a number for any document.
MEASURES = {
    "n_words": lambda c: c["n_words"],
    "repeat_word_ratio": lambda c: c["n_repeat_words"] / _least_one(c["n_words"]),
    "mean_word_length": lambda c: c["word_chars"] / _least_one(c["n_words"]),
    "longest_word": lambda c: c["longest_word"],
    "symbol_word_ratio": lambda c: c["n_symbols"] / _least_one(c["n_words"]),
    "stop_word_ratio": lambda c: c["n_stop_words"] / _least_one(c["n_words"]),
    "dup_line_ratio": lambda c: c["n_dup_lines"] / _least_one(c["n_lines"]),
    "bullet_line_ratio": lambda c: c["n_bullet_lines"] / _least_one(c["n_lines"]),
    "ellipsis_line_ratio": lambda c: c["n_ellipsis_lines"] / _least_one(c["n_lines"]),
}
COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words longest_word "
    "n_bullet_lines n_ellipsis_lines"
).split()


def _least_one(count: Column) -> Column:
    return F.greatest(count, F.lit(1))


def passes(rules: tuple[Rule, ...], counts: Column) -> Column:
    """One boolean column from a table of rules, over a struct with the fields COUNTS."""
    tests = [F.lit(True)]
    for rule in rules:
        measure = MEASURES[rule.measure](counts)
        if rule.low is not None:
            tests.append(measure >= rule.low)
        if rule.high is not None:
            tests.append(measure <= rule.high)
    return reduce(Column.__and__, tests)


def _covered(positions: Column) -> Column:
    """Words covered by the windows of three that start at the ascending ``positions``."""
    first = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-3).alias("last"))
    return F.aggregate(
        positions, first,
        lambda done, at: F.struct(
            (done["covered"] + F.least(F.lit(3), at - done["last"])).alias("covered"),
            at.alias("last"),
        ),
        lambda done: done["covered"],
    )


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of COUNTS, and the name of that struct column.

    The steps are separate projections, so that each array is made once per document. Triples of
    words are sorted within their document: equal ones become neighbours, and work stays
    n log n for a text of any length.
    """
    own = free_name(docs, "_quality")
    words, lines, grams, found = (f"{own}_{x}" for x in ("words", "lines", "grams", "found"))
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    letters = F.translate(value, SPACES, "")
    stops = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    one = docs.withColumns({
        words: F.array_remove(F.split(value, "[\x20\x09-\x0d]+"), ""),
        lines: F.filter(F.split(value, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
    })
    w = F.col(words)
    two = one.withColumn(grams, F.sort_array(F.transform(
        F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("gram"), i.alias("at")),
    )))
    g = F.col(grams)
    three = two.withColumn(found, F.sort_array(F.transform(
        F.filter(g, lambda x, i: (F.get(g, i - 1)["gram"] == x["gram"]).eqNullSafe(True)
                 | (F.get(g, i + 1)["gram"] == x["gram"]).eqNullSafe(True)),
        lambda x: x["at"],
    )))
    rows = F.col(lines)
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(letters),
        "n_symbols": F.length(letters) - F.length(F.translate(letters, SYMBOLS, "")),
        "n_dup_lines": F.size(rows) - F.size(F.array_distinct(rows)),
        "n_repeat_words": _covered(F.col(found)),
        "n_lines": F.size(rows),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stops))),
        "longest_word": F.aggregate(w, F.lit(0), lambda most, x: F.greatest(most, F.length(x))),
        "n_bullet_lines": F.size(F.filter(rows, lambda x: F.ltrim(x).rlike(r"^[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(rows, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))),
    }
    struct = F.struct(*[counts[c].cast("long").alias(c) for c in COUNTS])
    # As a generated row the counts are a border that no filter is pushed across: pushed down, it
    # would make the arrays anew wherever they are used, even for each of their items.
    return three.select(*docs.columns, F.explode(F.array(struct)).alias(own)), own


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the columns COUNTS, ``base_failed`` and ``kept``, under free names.

    A null text counts as empty: no words, so the base rules reject it. Every row is judged by
    itself, so repeated rows and null keys stay as they are, and an empty table stays empty.
    Columns of ``docs`` named like a result make the result column take a leading underscore.
    """
    rows, own = measured(docs, text)
    counts = F.col(own)
    base = passes(BASE_RULES, counts)
    return rows.select(
        *docs.columns,
        *[counts[c].alias(free_name(docs, c)) for c in COUNTS],
        (~base).alias(free_name(docs, "base_failed")),
        (base & passes(rules, counts)).alias(free_name(docs, "kept")),
    )
