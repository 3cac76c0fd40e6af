"""Quality rules, repeated passages, near duplicates and personal data against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import blocks, common, jaccard, private, quality, substrings
from strandloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# Quality rules

def measured(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(repeated))


def test_quality_counts_equal_brute_force(spark):
    odd = [None, "", " \n\t ", "a b\x0bc", "x x x x x", "a b c\na b c\n\na b c ", "# * <é>\n# * <é>", "one two " * 4000]
    rows = [*texts(spark), *((None if i == 2 else i, t) for i, t in enumerate(odd))]
    docs = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, n_words int")
    out = quality.judged(docs).collect()
    assert len(out) == len(rows)
    got = sorted((r["_n_words"], r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted(measured(t) for _, t in rows)
    for r in out:
        failed = r["_n_words"] < 50 or 100 * r.n_repeat_words > 50 * r["_n_words"]
        assert r.base_failed == failed and not (failed and r.kept) and r.n_words == -1
    assert quality.judged(docs.limit(0)).count() == 0


def test_quality_filter_does_not_remake_arrays(spark):
    kept = quality.judged(spark.read.parquet(f"{SF}/documents.parquet")).where("kept")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # words and lines, each once


def test_quality_keeps_good_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed")
    good, bad = (both.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good == 1.0 and (bad or 0) < 0.05


# Repeated passages

def cut(rows):
    rows = [(substrings.NO_ID if i is None else i, t) for i, t in rows]
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        lost = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out.append((i, len(w), len(lost), " ".join(x for k, x in enumerate(w) if k not in lost)))
    return sorted(out)


def cut_by_spark(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x")).repartition(parts)
    out, total, removed = substrings.without_repeats(docs, respace=True)
    assert out.columns[:3] == docs.columns
    return sorted((substrings.NO_ID if r.doc_id is None else r.doc_id, r[total], r[removed], r.text) for r in out.collect())


def hard_passages():
    rng = np.random.default_rng(1)
    pool = [" ".join(rng.choice([*"abcdefgh"], 40)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [pool[rng.integers(6)] if rng.random() < 0.5 else " ".join(rng.choice([*"abcdefgh"], rng.integers(1, 30)))
                 for _ in range(rng.integers(1, 6))]
        words = " ".join(parts).split()
        a, b = sorted(rng.integers(0, len(words) + 1, 2))
        rows.append((int(i), "\n".join([" ".join(words[:a]), " ".join(words[a:b]), "  ".join(words[b:])])))
    return rows + [(5, rows[7][1]), (None, rows[3][1]), (None, rows[3][1]), (200, None), (201, ""), (202, "a " * 5000), (203, "a " * 60)]


@pytest.mark.parametrize("many", [2000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY_CHUNKS", many)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    rows = hard_passages()
    assert cut_by_spark(spark, rows) == cut(rows)


def test_repeats_of_a_table(spark):
    rows = QUERIES["op5_repeated_passages"](spark, SF).collect()
    want = cut(texts(spark))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == [
        (i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in want]


def test_repeats_of_nothing(spark):
    assert cut_by_spark(spark, []) == []


def test_texts_without_repeats_stay(spark):
    docs = spark.createDataFrame([(1, " a\n b "), (2, None)], "doc_id long, text string")
    out, _, _ = substrings.without_repeats(docs)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, " a\n b "), (2, None)}


def test_automaton_statistics_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        known = [rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(4)]
        own = substrings.Automaton()
        for k in known:
            own.add(k)
        runs = {tuple(k[a:b]) for k in known for a in range(len(k)) for b in range(a + 1, len(k) + 1)}
        text = rng.integers(0, 3, 25).tolist()
        want = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(25)]
        assert list(own.statistics(text)) == want


# Near duplicates

def near(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    group, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= t * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        members[root(i)].append(doc)
    ids = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    order = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(((doc, ids[root(i)], links[i]) for i, (doc, _) in enumerate(rows)), key=order)


def near_rows(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice([*"abcdefghij"], 80)) for _ in range(4)]
    rows = texts(spark)
    for k in range(60):  # variants of a text, some of which are linked to each other only through others
        words = base[k % 4].split()
        for at in rng.integers(0, 80, k % 3):
            words[at] = "z"
        rows.append((1000 + k, " ".join(words)))
    return rows + [(2000, None), (2001, ""), (2002, "a b"), (2003, "a  b"), (2004, "a b c"), (None, base[0]), (1001, base[1])]


@pytest.mark.parametrize("members, heavy", [(400, 10_000), (7, 3)])
def test_near_join_equals_brute_force(spark, monkeypatch, members, heavy):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(common, "HEAVY_ROWS", heavy)
    rows = near_rows(spark)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string").repartition(3)
    order = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in jaccard.linked(docs).collect()), key=order)
    assert got == near(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {c for i, c, _ in near([r for r in rows if WORD.search(r[1] or "")])}
    assert kept.where("text rlike '[^ ]'").count() == len(classes) and kept.where("text is null or text = ''").count() == 2


def test_loose_clusters_are_verified_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 3)
    rng = np.random.default_rng(8)
    line = rng.choice([*"abcdefghijklmnop"], 3000)  # texts that overlap the next ones along a line
    starts = np.cumsum(rng.choice([3, 8, 11], 200))
    rows = [(i, " ".join(line[at : at + 60])) for i, at in enumerate(starts.tolist())]
    units = []
    plain = jaccard._with_units
    monkeypatch.setattr(jaccard, "_with_units", lambda *a: units.append(plain(*a)) or units[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.linked(docs).collect()) == near(rows)
    seen = units[0].select(F.inline("units")).groupBy("band").count().collect()
    assert len([r for r in seen if r.band >= 0]) > 1 and len({c for _, c, _ in near(rows)}) < 200


def test_near_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.linked(docs).count() == 0 and jaccard.one_of_each(docs).count() == 0


@pytest.mark.parametrize("heavy, most", [(2, 100), (2, 1), (100, 100)])
def test_spread_join_equals_the_plain_one(spark, monkeypatch, heavy, most):
    monkeypatch.setattr(common, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(common, "MOST_HEAVY", most)
    rows = spark.createDataFrame([(None if i % 5 == 0 else i % 3 * (i % 2), i, "x") for i in range(60)], "k long, i long, _part string")
    values = spark.createDataFrame([(0, "a", 30), (1, "b", 8), (7, "c", 1)], "k long, v string, n long")
    for how in ("inner", "left"):
        got = common.attach(rows, values, "k", "n", "i", how)
        want = rows.join(values.drop("n"), "k", how)
        assert got.columns == want.columns
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_many_pairs_are_counted_like_few():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, 120)).astype(np.uint64) for _ in range(80)]
    pairs = np.argwhere(np.triu(np.ones((80, 80)), 1))
    want = [len({*sets[i].tolist()} & {*sets[j].tolist()}) for i, j in pairs.tolist()]
    assert jaccard._shared(sets, pairs).tolist() == want
    assert jaccard._shared(sets, pairs[:50]).tolist() == want[:50]


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= jaccard.MOST_HASHES


def test_components(spark):
    edges = [(9, 7), (7, 5), (5, 3), (3, 1), (20, 21), (22, 21), (30, 30)]
    found = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "node long, other long")).collect()}
    assert found == {9: 1, 7: 1, 5: 1, 3: 1, 1: 1, 20: 20, 21: 20, 22: 20}


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(text):
    fits = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d),
        "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if fits[k](m.group()))


PII = [
    None, "", "a@b.c d.e@f..g x@y", "é a.b%c@d-e.f.g.h@i.j", "@a.b a@@b.c a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3",
    "4539 1488 0343 6467 4539148803436467x 12-34 4539-1488-0343-6468", "+1 (366) 555-9807 +12 34 +1--2((((9 +1(234)567890",
    "9" * 400 + ".1.1.1", "a" * 3000 + "@" + "b" * 3000, "+1" + "(" * 2000,
]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice([*"12 .-+()@ab4"], 60)) for _ in range(600)]
    rows = [*texts(spark), *enumerate(PII), *enumerate(made), (None, PII[5]), (3, PII[3])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _private int").repartition(3)
    out, name = private.annotated(docs)
    got = sorted(r.b for r in out.select(private.span_text(F.col(f"{name}_base")).alias("b")).collect())
    assert got == sorted(base_spans(t) for _, t in rows)
    assert private.annotated(docs.limit(0))[0].count() == 0


def test_query_spans_are_those_of_each_document(spark):
    want = {i: base_spans(t) for i, t in texts(spark)}
    for r in QUERIES["op2_private_spans"](spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.n_email == want[r.doc_id].count("email:") and r.n_card == want[r.doc_id].count("card:")
        assert set(filter(None, want[r.doc_id].split(","))) <= set(r.spans.split(","))


def test_contexts_of_seeds_discover_unseen_identifiers(spark):
    rows = [(i, f"w{i} please call me at +1 (366) 555-98{i:02} thanks v{i}") for i in range(12)]
    rows += [(50, "please call me at 366 555 9807 today"), (51, "lot number of parts 366 555 9807 in stock"), (52, "please call me at noon")]
    rows += [(60 + i, f"mail to user{i}@example.com now") for i in range(6)] + [(70, "mail to someone (at) example (dot) com now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out, name = private.annotated(docs)
    spans = {r.doc_id: r.s for r in out.select("doc_id", private.span_text(F.col(name)).alias("s")).collect()}
    assert spans[50] == "phone:18:30" and spans[51] == "" and spans[52] == ""
    assert spans[70].startswith("email:8:")
    hidden = {r.doc_id: r.text for r in private.redacted(docs).collect()}
    assert hidden[50] == "please call me at <PHONE> today" and hidden[51] == rows[13][1]
    assert hidden[3] == "w3 please call me at <PHONE> thanks v3"


def test_redaction_of_odd_texts(spark):
    docs = spark.createDataFrame([*enumerate(PII)], "doc_id long, text string")
    hidden = {r.doc_id: r.text for r in private.redacted(docs).collect()}
    assert hidden[0] is None and hidden[1] == ""
    for i, text in enumerate(PII[2:], 2):
        marks = sorted((int(a), int(b), k.upper()) for k, a, b in (s.split(":") for s in base_spans(text).split(",") if s))
        want, at = "", 0
        for a, b, k in marks:
            if a >= at:
                want += text[at:a] + f"<{k}>"
            at = max(at, b)
        assert hidden[i] == want + text[at:]


def added(spark, rows):
    out, name = private.annotated(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id for r in out.where(F.size(name) > F.size(f"{name}_base")).select("doc_id").collect()}


def test_patterns_are_iterated_to_the_fixed_point(spark):
    # Many unseen identifiers in a good context; three seeds are support enough.
    rows = [(i, f"w{i} call me at +1 (366) 555-{i:04} x{i}") for i in range(100)]
    unseen = [(1000 + i, f"w{i} call me at 366 777 {i:04} y{i}") for i in range(300)]
    rows += [(2000 + i, f"w{i} ring office under +1 (366) 444-{i:04} z{i}") for i in range(3)]
    unseen += [(2010, "so ring office under 366 444 9999 v")]
    # A chain: the ones found after 'me at' are the only support of 'fax to', and those found there of 'or via'.
    unseen += [(3000 + i, f"please fax to 366 777 {i:04} a{i}") for i in range(4)]
    unseen += [(3010 + i, f"please fax to 366 888 {i:04} b{i}") for i in range(4)]
    unseen += [(3020 + i, f"please or via 366 888 {i:04} c{i}") for i in range(4)] + [(3030, "please or via 366 999 1234 d")]
    assert added(spark, rows + unseen) == {i for i, _ in unseen}


def test_other_kinds_and_failed_formats_speak_against_a_pattern(spark):
    rows = [(i, f"w{i} value found is +1 (366) 555-{i:04} x{i}") for i in range(6)]
    rows += [(100 + i, f"w{i} value found is user{i}@example.com y{i}") for i in range(6)]
    rows += [(200 + i, f"w{i} the host was 10.0.0.{i} x{i}") for i in range(6)]
    rows += [(300 + i, f"w{i} the host was 900.0.0.{i} y{i}") for i in range(6)]
    rows += [(400, "value found is 366 777 1234 z"), (401, "the host was fe80:1:2:3:4:5:6:7 z")]
    assert added(spark, rows) == set()
    assert added(spark, [r for r in rows if not (100 <= r[0] < 200 or 300 <= r[0] < 400)]) == {400, 401}


def test_long_words_of_equal_sums_differ(spark):
    """The word of Thue and Morse and its complement: sums modulo 2**64 cannot tell them apart."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    for size in (1024, 2048):
        one, two = a[:size], a[:size].translate(str.maketrans("ab", "ba"))
        first, second, third = blocks.Words([f"x {one} y", two, f"{one}\n"]).hashes[[1, 3, 4]]
        assert first != second and first == third
        texts = [" ".join([*map(str, range(12)), one]), " ".join([*map(str, range(12)), two])]
        docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
        cut, total, removed = substrings.without_repeats(docs)
        assert [r[0] for r in cut.select(removed).collect()] == [0, 0]
        words = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
        assert {r.class_id for r in jaccard.linked(words).collect()} == {1, 2}


def test_scratch_tables_of_a_step_stay_until_a_later_one(spark):
    rows = spark.range(3)
    with common.scratch_of("test", 1):
        one = common.store(rows, "one")
    with common.scratch_of("test", 1):
        two = common.store(rows, "two")
    assert one.count() == two.count() == 3
    with common.scratch_of("test", 2):
        assert ("test", 1) not in common._MADE
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(one.inputFiles()[0].rsplit("/", 1)[0]).count()
