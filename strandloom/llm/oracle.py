"""Comparison SQL of this subpackage's queries, where SQL can express them.

The others are tested on fixtures: coding and packing by library and round trip, private spans by
brute force, language by held-out accuracy, whitening by exact fractions, token counts by the library.
"""

from __future__ import annotations

from strandloom.llm import fixity, links, quality, spelling

_SPACES = r"[\x20\x09-\x0D]"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DOCS = rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}+'), lambda x: x <> '') AS w FROM documents)
"""


def _url_filter() -> str:
    said = "CASE " + " ".join(f"WHEN rule = {_text(r.name)} THEN '{r.verdict}'" for r in links.RULES) + " END"
    rules = " ".join(
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(links.RULES, key=lambda r: -len(r.name)))
    host = r"translate(regexp_extract({0}, '^[^/?#]*'), '%s', '%s')" % (links.UPPER, links.LOWER)
    after = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    parts = []

    def spread(name: str, seed: str, source: str, target: str) -> None:
        parts.append(f"""{name}_e AS MATERIALIZED (SELECT {source} AS source, {target} AS target,
          n::DOUBLE / sum(n) OVER (PARTITION BY {source}) AS share FROM edges)""")
        parts.append(f"""{name}_w AS (SELECT 0 AS steps, host, {seed}::DOUBLE AS marked, pages::DOUBLE AS pages FROM votes
          UNION ALL SELECT any_value(steps) + 1, target, sum({links.FLOW} * marked * share), sum({links.FLOW} * w.pages * share)
          FROM {name}_w w JOIN {name}_e e ON e.source = w.host WHERE steps < {links.MOST_ROUNDS} GROUP BY target)""")
        parts.append(f"""{name} AS MATERIALIZED (SELECT host, round(sum(marked) / sum(pages), {links.DIGITS}) AS share
          FROM {name}_w GROUP BY host)""")

    spread("trust", "allowed", "source", "target")
    spread("dist", "blocked", "target", "source")
    return rf"""WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, html, coalesce({host.format('rest')}, '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM (SELECT *, {after.format('url')} AS rest FROM pages)),
    j AS MATERIALIZED (SELECT *, {said} AS said FROM (SELECT *, CASE {rules} END AS rule FROM p)),
    votes AS MATERIALIZED (SELECT host, count(*) FILTER (said = 'allow') AS allowed,
      count(*) FILTER (said = 'block') AS blocked, count(*) AS pages FROM j WHERE host <> '' GROUP BY host),
    raw AS (SELECT host AS source, unnest(regexp_extract_all(html, {_text(links._LINK)}, 1)) AS link FROM p),
    edges AS MATERIALIZED (SELECT source, target, count(*) AS n FROM (
      SELECT source, {host.format("substr(link, instr(link, '//') + 2)")} AS target FROM raw)
      WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL),
    {", ".join(parts)},
    bad AS (SELECT coalesce(t.host, d.host) AS host FROM trust t FULL JOIN dist d ON t.host = d.host
      WHERE coalesce(d.share, 0) >= {links.LEAST} AND coalesce(d.share, 0) > {links.RATIO} * coalesce(t.share, 0))
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
    FROM j"""


def _fixity() -> str:
    body = "coalesce(html, '')"
    record = rf"""'WARC/1.0' || e'\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
      || e'>\r\nWARC-Target-URI: ' || coalesce(url, '') || e'\r\nContent-Length: ' || strlen({body})
      || e'\r\n\r\n' || {body} || e'\r\n\r\n'"""
    return f"""WITH r AS (SELECT page_id, strlen({record}) AS length, sha256({record}) AS digest FROM pages),
    g AS (SELECT page_id, length, digest, count(*) AS copies FROM r GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY digest) AS nth,
      greatest(1, (SELECT count(*) FROM g) // {fixity.FILE_ROWS} + CASE WHEN (SELECT count(*) FROM g) % {fixity.FILE_ROWS} > 0 THEN 1 ELSE 0 END) AS files FROM g),
    f AS (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 8) AS BIGINT) % files AS INT) AS file FROM n),
    o AS (SELECT page_id, file, row_number() OVER w - 1 AS ordinal,
      CAST(coalesce(sum(length * copies) OVER (PARTITION BY file ORDER BY page_id, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length
      FROM f WINDOW w AS (PARTITION BY file ORDER BY page_id, nth))
    SELECT page_id, file, ordinal, "offset", length,
      CASE WHEN page_id % 307 = 5 THEN 'missing' ELSE 'changed' END AS status
    FROM o WHERE page_id % 307 = 5 OR page_id % 101 = 7 OR page_id % 211 = 3
    UNION ALL SELECT -page_id - 1, NULL, NULL, NULL, length, 'extra' FROM r WHERE page_id % 409 = 11"""


def _quality() -> str:
    stops = quality.STOP_WORDS + [w.capitalize() for w in quality.STOP_WORDS]
    words, lines = "greatest(n_words, 1)", "greatest(n_lines, 1)"
    measures = {
        "n_words": "n_words", "repeat_word_ratio": f"n_repeat_words / {words}", "mean_word_length": f"word_chars / {words}",
        "longest_word": "longest_word", "symbol_word_ratio": f"n_symbols / {words}", "stop_word_ratio": f"n_stop_words / {words}",
        "dup_line_ratio": f"n_dup_lines / {lines}", "bullet_line_ratio": f"n_bullet_lines / {lines}",
        "ellipsis_line_ratio": f"n_ellipsis_lines / {lines}",
    }

    def rules(table):
        return " AND ".join(
            f"{measures[r.measure]} {sign} {limit}" for r in table
            for sign, limit in ((">=", r.low), ("<=", r.high)) if limit is not None)

    spaces = "e' \\t\\n\\x0B\\f\\r'"
    letters = f"translate(text, {spaces}, '')"
    return rf"""WITH {_DOCS},
    g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
    r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g),
      unnest(range(0, 3)) AS t(k) WHERE c > 1 GROUP BY rid),
    l AS (SELECT rid, list_filter(string_split(text, e'\n'), lambda x: translate(x, {spaces}, '') <> '') AS rows FROM d),
    m AS (SELECT doc_id, len(w) AS n_words, length({letters}) AS word_chars,
      length({letters}) - length(translate({letters}, {_text(quality.SYMBOLS)}, '')) AS n_symbols,
      len(rows) - len(list_distinct(rows)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(rows) AS n_lines,
      len(list_filter(w, lambda x: x IN ({", ".join(map(_text, stops))}))) AS n_stop_words,
      coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word,
      len(list_filter(rows, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullet_lines,
      len(list_filter(rows, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS n_ellipsis_lines
      FROM d JOIN l USING (rid) LEFT JOIN r USING (rid))
    SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in quality.COUNTS)},
      NOT ({rules(quality.BASE_RULES)}) AS base_failed, ({rules(quality.BASE_RULES + quality.RULES)}) AS kept FROM m"""


_REPEATS = rf"""WITH {_DOCS},
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
early AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT rid, i + k AS p FROM win JOIN early USING (g), unnest(range(0, 13)) AS t(k) WHERE m < doc_id),
words AS (SELECT rid, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN lost USING (rid)"""

_NEAR = rf"""WITH RECURSIVE {_DOCS},
s AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
  list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS grams FROM d),
c AS MATERIALIZED (SELECT grams, min(rid) AS node, min(doc_id) AS doc, count(*) AS copies FROM s WHERE len(grams) > 0 GROUP BY grams),
g AS MATERIALIZED (SELECT node, unnest(grams) AS gram FROM c),
shared AS MATERIALIZED (SELECT a.node AS x, b.node AS y, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y, q.copies AS copies FROM shared JOIN c p ON p.node = x JOIN c q ON q.node = y
  WHERE 5 * n >= 4 * (len(p.grams) + len(q.grams) - n)),
reach AS (SELECT DISTINCT x, x AS y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
class AS (SELECT reach.x AS node, min(doc) AS class_id FROM reach JOIN c ON c.node = reach.y GROUP BY reach.x),
many AS (SELECT x AS node, sum(copies) AS n FROM link GROUP BY x)
SELECT s.doc_id, CASE WHEN c.node IS NULL THEN s.doc_id ELSE coalesce(class.class_id, c.doc) END AS class_id,
  CAST(CASE WHEN c.node IS NULL THEN 0 ELSE coalesce(many.n, 0) + c.copies - 1 END AS BIGINT) AS n_links
FROM s LEFT JOIN c ON c.grams = s.grams LEFT JOIN class ON class.node = c.node LEFT JOIN many ON many.node = c.node"""

_NEAREST = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _spelling(noise: int = 31) -> str:
    step = [i for i in range(16)]  # the crc of four bits at a time
    for _ in range(4):
        step = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in step]

    def four(c: str) -> str:
        return f"xor(({c}) >> 4, ({step}::BIGINT[])[(({c}) & 15) + 1])"

    return rf"""WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
      '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents),
    long AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM runs WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY ALL),
    crcs AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h) // 2 + 1),
      lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda c, b: {four(four("xor(c, b)"))})) AS crc FROM long),
    cut AS (SELECT CASE WHEN crc % {noise} = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2)
      ELSE run END AS word, n FROM crcs),
    v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word
      HAVING sum(n) >= {spelling.LEAST_COUNT}),
    less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
    pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM (
      SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
      UNION ALL SELECT l.word, v.word FROM less l JOIN v ON l.rest = v.word
      UNION ALL SELECT v.word, l.word FROM less l JOIN v ON l.rest = v.word)),
    best AS (SELECT a, count(*) AS n_near, arg_min(b, (-v.n, b)) AS b, max(v.n) AS most FROM pairs JOIN v ON v.word = b GROUP BY a),
    f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling.RATIO} * n THEN b END AS form,
      CASE WHEN most >= {spelling.RATIO} * n THEN most END AS form_n FROM v LEFT JOIN best ON best.a = word),
    walk AS (SELECT word, word AS here FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
    roots AS (SELECT walk.word, here AS root FROM walk JOIN f ON f.word = here WHERE f.form IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)"""


ORACLE = {
    "op3_url_filter": _url_filter(),
    "op5_repeated_passages": _REPEATS,
    "op6_fixity_audit": _fixity(),
    "op7_near_join": _NEAR,
    "op8_quality_rules": _quality(),
    "op10_nearest": _NEAREST,
    "op11_spelling_groups": _spelling(),
}
