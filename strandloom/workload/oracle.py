"""Comparison SQL for DuckDB, one statement per registered query.

Written from the definitions, on its own: it shares the input views with the Spark side and
nothing else. Redraws take the same numbered draws. The tail of the t distribution is an integral, taken
here by Simpson's rule.
"""

from __future__ import annotations

from strandloom.operators.classify import SPLIT_SEED
from strandloom.schema import CONTRAST_KEY
from strandloom.workload.views import duckdb_view

_KEY = "chrom, somatic_pos, variant_type, vcf_source_id, somatic_allele_type, haplotype_tag"
_SITE_KEY = (
    "chrom, methyl_pos, somatic_pos, variant_type, vcf_source_id, bam_source_id, "
    "somatic_allele_type, haplotype_tag, meth_call, strand, read_id"
)
_FEATURES = [
    "supporting_read_count", "methyl_sites_count", "mean_methylation", "normal", "tumor", "delta",
]


def _state(call: str) -> str:
    return (
        f"CASE WHEN {call} >= CAST(0.8 AS FLOAT) THEN 'high' "
        f"WHEN {call} > CAST(0.2 AS FLOAT) THEN 'mid' ELSE 'low' END"
    )


def _r(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


# Named steps and the steps they build on, in order.
_STEPS: dict[str, tuple[str, tuple[str, ...]]] = {
    name: (duckdb_view(name), ())
    for name in ("sites", "sparse_sites", "records", "aln", "regions", "positions")
}


def _summary(source: str) -> str:
    return f"""
SELECT chrom, somatic_pos, variant_type, vcf_source_id, bam_source_id, somatic_allele_type,
  haplotype_tag, CAST(count(DISTINCT read_id) AS INT) AS supporting_read_count,
  CAST(count(*) AS INT) AS methyl_sites_count,
  CAST(avg(CAST(meth_call AS DOUBLE)) AS FLOAT) AS mean_methylation,
  CASE WHEN count(*) FILTER (strand = '+') > count(*) FILTER (strand = '-') THEN '+'
    WHEN count(*) FILTER (strand = '+') < count(*) FILTER (strand = '-') THEN '-'
    ELSE '.' END AS strand
FROM {source} GROUP BY ALL"""


def _covered(source: str, key: str, k: int) -> str:
    return f"""
SELECT * EXCLUDE (plus, minus) FROM (
  SELECT *, count(*) FILTER (strand = '+') OVER w AS plus,
    count(*) FILTER (strand = '-') OVER w AS minus
  FROM {source} WINDOW w AS (PARTITION BY {key})
) WHERE plus >= {k} AND minus >= {k}"""


def _step(name: str, sql: str, *needs: str) -> None:
    _STEPS[name] = (sql.strip(), needs)


_step("covered2", _covered("sites", "chrom, methyl_pos, bam_source_id", 2), "sites")
_step("covered1", _covered("sites", "chrom, methyl_pos, bam_source_id", 1), "sites")
_step(
    "covered_vcf",
    _covered("sparse_sites", "chrom, methyl_pos, bam_source_id, vcf_source_id", 1), "sparse_sites",
)
_step("l2", _summary("sparse_sites"), "sparse_sites")
_step("l2_covered", _summary("covered1"), "covered1")
_step("l2_covered_vcf", _summary("covered_vcf"), "covered_vcf")
_step("contrast", f"""
SELECT upper(vcf_source_id) AS label, {_KEY},
  avg(CAST(mean_methylation AS DOUBLE)) FILTER (bam_source_id = 'normal') AS normal,
  avg(CAST(mean_methylation AS DOUBLE)) FILTER (bam_source_id = 'tumor') AS tumor,
  tumor - normal AS delta
FROM l2 GROUP BY ALL""", "l2")
_step("details", f"""
SELECT upper(vcf_source_id) AS label, {_KEY},
  count(DISTINCT read_id) AS supporting_read_count,
  count(DISTINCT methyl_pos) AS methyl_sites_count,
  avg(CAST(meth_call AS DOUBLE)) AS mean_methylation
FROM sparse_sites GROUP BY ALL""", "sparse_sites")
_step(
    "features", f"SELECT * FROM contrast JOIN details USING (label, {_KEY})", "contrast", "details"
)
_step("modes", """
SELECT *,
  CASE WHEN normal IS NULL THEN 'miss' WHEN normal < 0.2e0 THEN 'low'
    WHEN normal > 0.8e0 THEN 'high' ELSE 'mid' END || '→' ||
  CASE WHEN tumor IS NULL THEN 'miss' WHEN tumor < 0.2e0 THEN 'low'
    WHEN tumor > 0.8e0 THEN 'high' ELSE 'mid' END AS asm_mode
FROM contrast""", "contrast")
_step("l3", """
SELECT haplotype_tag AS haplotype_group, bam_source_id AS bam_source,
  CASE WHEN variant_type IN ('INS', 'DEL') THEN 'INDEL' ELSE variant_type END AS variant_type_group,
  avg(CAST(mean_methylation AS DOUBLE)) FILTER (vcf_source_id = 'fp') AS m1,
  avg(CAST(mean_methylation AS DOUBLE)) FILTER (vcf_source_id = 'tp') AS m2,
  var_samp(CAST(mean_methylation AS DOUBLE)) FILTER (vcf_source_id = 'fp') AS v1,
  var_samp(CAST(mean_methylation AS DOUBLE)) FILTER (vcf_source_id = 'tp') AS v2,
  count(*) FILTER (vcf_source_id = 'fp') AS n1, count(*) FILTER (vcf_source_id = 'tp') AS n2
FROM l2 GROUP BY ALL""", "l2")
_step("l3p", """
SELECT *, CASE WHEN m1 IS NULL OR m2 IS NULL THEN NULL WHEN n1 < 2 OR n2 < 2 THEN 1.0
  WHEN v1 / n1 + v2 / n2 > 0
    THEN 1 / (1 + abs(m1 - m2) / sqrt(v1 / n1 + v2 / n2) * sqrt((n1 + n2 - 2) / 2.0))
  WHEN m1 <> m2 THEN 0.0 END AS p
FROM l3""", "l3")
_step("long", f"""
SELECT label, haplotype_tag, variant_type, feature, value FROM (
  SELECT label, haplotype_tag, variant_type,
    {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in _FEATURES)} FROM features
) UNPIVOT (value FOR feature IN ({", ".join(_FEATURES)}))""", "features")
_step("long_contrast", """
SELECT label, feature, value FROM (SELECT label, normal, tumor, delta FROM contrast)
UNPIVOT (value FOR feature IN (normal, tumor, delta))""", "contrast")


def _moments(by: str) -> str:
    return f"""
SELECT {by} feature, avg(value) FILTER (label = 'TP') AS m1, avg(value) FILTER (label = 'FP') AS m2,
  var_samp(value) FILTER (label = 'TP') AS v1, var_samp(value) FILTER (label = 'FP') AS v2,
  count(*) FILTER (label = 'TP') AS n1, count(*) FILTER (label = 'FP') AS n2
FROM long GROUP BY ALL"""


_step("moments", _moments(""), "long")
_step("group_moments", _moments("haplotype_tag, variant_type,"), "long")

_T = """CASE WHEN v1 / n1 + v2 / n2 > 0 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2)
  WHEN m1 > m2 THEN CAST('inf' AS DOUBLE) WHEN m1 < m2 THEN CAST('-inf' AS DOUBLE) END"""
_DF = """CASE WHEN v1 / n1 + v2 / n2 > 0 THEN pow(v1 / n1 + v2 / n2, 2)
  / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) ELSE 1.0 END"""
_D2 = """(m1 - m2) / CASE WHEN v1 + v2 > 0
  THEN sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) END"""


def _cross(column: str, source: str) -> str:
    return (
        f"SELECT {column}, count(*) FILTER (label = 'FP') AS FP, "
        f"count(*) FILTER (label = 'TP') AS TP FROM {source} GROUP BY ALL"
    )


for _name, _column, _source in (
    ("hap_counts", "haplotype_tag", "contrast"), ("mode_counts", "asm_mode", "modes"),
    ("allele_counts", "somatic_allele_type", "contrast"),
):
    _step(_name, _cross(_column, _source), _source)


def _chi2(counts: str, column: str) -> str:
    return f"""
SELECT {_r("sum(pow(greatest(abs(o - e) - CASE WHEN k = 2 THEN 0.5 ELSE 0 END, 0), 2) / e)")}
  AS chi2, any_value(k) - 1 AS dof, CAST(any_value(n) AS BIGINT) AS n
FROM (
  SELECT o, k, n, r * c / n AS e FROM (
    SELECT o, CAST(sum(o) OVER (PARTITION BY v) AS DOUBLE) AS r,
      CAST(sum(o) OVER (PARTITION BY l) AS DOUBLE) AS c, CAST(sum(o) OVER () AS DOUBLE) AS n,
      count(*) OVER (PARTITION BY l) AS k
    FROM (SELECT {column} AS v, l, o FROM {counts} UNPIVOT (o FOR l IN (FP, TP)))
  )
)"""


# --- records and reads ------------------------------------------------------------------------

_step("alleles", """
SELECT * EXCLUDE (alt, alts), unnest(alts) AS alt, CAST(unnest(range(1, len(alts) + 1)) AS INT) AS allele_index
FROM (
  SELECT *, CASE WHEN alt = '.' THEN [] ELSE string_split(alt, ',') END AS alts,
    CASE WHEN contains(alt, ',') THEN 'MULTI'
      WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV'
      WHEN length(ref) > length(alt) THEN 'DEL' WHEN length(ref) < length(alt) THEN 'INS'
      ELSE 'COMPLEX' END AS variant_type,
    CASE WHEN contains(format, 'AD') THEN string_split(string_split(sample, ':')[2], ',') END AS ad
  FROM records
)""", "records")
_step("bed", """
SELECT chrom, start_pos, end_pos FROM regions WHERE start_pos >= 0 AND end_pos > start_pos
""", "regions")
_step("in_bed", """
SELECT * FROM alleles a WHERE EXISTS (
  SELECT 1 FROM bed b WHERE b.chrom = a.chrom AND a.pos - 1 >= b.start_pos AND a.pos - 1 < b.end_pos)
""", "alleles", "bed")
_PASSING = "(filter = '.' OR list_contains(string_split(filter, ';'), 'PASS'))"
_SUPPORTED = "(ad IS NULL OR coalesce(TRY_CAST(ad[allele_index + 1] AS INT) >= 5, false))"
_step("variants", f"SELECT * FROM alleles WHERE {_PASSING}", "alleles")
_step("cigars", r"""
SELECT ord_block, ord_row, qname, pos, i, CAST(t[:-2] AS INT) AS n, t[-1] AS op FROM (
  SELECT *, unnest(tokens) AS t, unnest(range(1, len(tokens) + 1)) AS i FROM (
    SELECT *, regexp_extract_all(cigar, '\d+[MIDNSHP=X]') AS tokens FROM aln))
""", "aln")
_step("walked", """
SELECT *, CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END AS dq,
  CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END AS dr,
  CAST(sum(dq) OVER w - dq AS INT) AS query_start,
  CAST(pos + sum(dr) OVER w - dr AS INT) AS ref_start
FROM cigars WINDOW w AS (PARTITION BY ord_block, ord_row ORDER BY i)
""", "cigars")
_step(
    "blocks",
    "SELECT ord_block, ord_row, qname, pos, query_start, ref_start, n AS length FROM walked "
    "WHERE op IN ('M', '=', 'X')", "walked",
)
_step("spans", """
SELECT a.*, a.pos - 1 AS start0, a.pos - 1 + s.span AS end0 FROM aln a JOIN (
  SELECT ord_block, ord_row, CAST(sum(dr) AS INT) AS span FROM walked GROUP BY ALL
) s USING (ord_block, ord_row)""", "aln", "walked")
_step(
    "fetchable",
    "SELECT * FROM spans WHERE (flag & 2308) = 0 AND mapq >= 10", "spans",
)
_PAIR = (
    "bam_source_id, qname, start0, end0, chrom, somatic_pos, ref, alt, variant_type, vcf_source_id"
)


def _pairs(window: int, source: str) -> str:
    return f"""
SELECT r.*, v.chrom, v.pos AS somatic_pos, v.ref, v.alt, v.variant_type, v.vcf_source_id
FROM {source} r JOIN (
  SELECT chrom, pos, ref, alt, variant_type, vcf_source_id,
    greatest(0, pos - 1 - {window}) AS lo, pos - 1 + {window} AS hi FROM variants
) v ON r.rname = v.chrom AND r.start0 < v.hi AND r.end0 > v.lo"""


_step("pairs", _pairs(2000, "fetchable"), "fetchable", "variants")
_step("touching", _pairs(2000, "spans"), "spans", "variants")


def _alleles_of(source: str) -> str:
    return f"""
SELECT * FROM (
  SELECT p.*, substr(p.seq, b.query_start + p.somatic_pos - b.ref_start + 1, 1) AS base,
    CASE WHEN base = substr(p.ref, 1, 1) THEN 'ref' WHEN base = substr(p.alt, 1, 1) THEN 'alt' END
      AS somatic_allele_type
  FROM {source} p JOIN blocks b ON p.ord_block = b.ord_block AND p.ord_row = b.ord_row
    AND p.somatic_pos >= b.ref_start AND p.somatic_pos < b.ref_start + b.length
) WHERE somatic_allele_type IS NOT NULL"""


_step("touching_alleles", _alleles_of("touching"), "touching", "blocks")
_step("supporting", _alleles_of("pairs"), "pairs", "blocks")
_step("mm_groups", r"""
SELECT *, string_split(regexp_extract(g, '^[A-Z][-+]([a-z]+)', 1), '') AS codes,
  string_split(regexp_extract(g, ',(.*)$', 1), ',') AS skips,
  CAST(coalesce(sum(len(codes) * len(skips)) OVER (
    PARTITION BY ord_block, ord_row ORDER BY gi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
  ), 0) AS BIGINT) AS used
FROM (
  SELECT ord_block, ord_row, flag, seq, ml, unnest(string_split(rtrim(mm, ';'), ';')) AS g,
    unnest(range(1, len(string_split(rtrim(mm, ';'), ';')) + 1)) AS gi
  FROM aln WHERE mm IS NOT NULL)
""", "aln")
_step("mm_steps", """
SELECT ord_block, ord_row, flag, seq, ml, codes, used, si,
  sum(CAST(skip AS INT) + 1) OVER (PARTITION BY ord_block, ord_row, gi ORDER BY si) AS nth
FROM (SELECT *, unnest(skips) AS skip, unnest(range(1, len(skips) + 1)) AS si FROM mm_groups)
WHERE g LIKE 'C%'
""", "mm_groups")
_step("mm_bases", """
SELECT ord_block, ord_row, i - 1 AS q, row_number() OVER (
  PARTITION BY ord_block, ord_row ORDER BY CASE WHEN (flag & 16) > 0 THEN -i ELSE i END) AS nth
FROM (SELECT ord_block, ord_row, flag, seq, unnest(range(1, length(seq) + 1)) AS i FROM aln)
WHERE substr(seq, i, 1) = CASE WHEN (flag & 16) > 0 THEN 'G' ELSE 'C' END
""", "aln")
_step("calls", """
SELECT s.ord_block, s.ord_row, k.ref_start + b.q - k.query_start AS ref_pos,
  CASE WHEN s.ml IS NULL THEN -1 ELSE s.ml[s.used + (s.si - 1) * len(s.codes) + s.ci] END AS qual
FROM (
  SELECT * FROM (
    SELECT *, unnest(codes) AS code, unnest(range(1, len(codes) + 1)) AS ci FROM mm_steps)
  WHERE code IN ('m', 'h')
) s
JOIN mm_bases b ON s.ord_block = b.ord_block AND s.ord_row = b.ord_row AND s.nth = b.nth
JOIN blocks k ON k.ord_block = b.ord_block AND k.ord_row = b.ord_row
  AND b.q >= k.query_start AND b.q < k.query_start + k.length
""", "mm_steps", "mm_bases", "blocks")
_TAG = """CASE WHEN hp_type IS NULL THEN '0'
  WHEN hp_type = 'Z' THEN CASE WHEN hp_value = 'UN' THEN 'un' ELSE hp_value END
  WHEN hp_value = '0' AND orig_hp IN ('1-1', '2-1') THEN orig_hp
  WHEN hp_value = '-1' THEN 'un' ELSE hp_value END"""
_step("found", f"""
SELECT s.chrom, CAST(c.ref_pos AS INT) AS methyl_pos, s.somatic_pos, s.variant_type,
  s.vcf_source_id, s.bam_source_id, s.somatic_allele_type, s.base AS somatic_base_at_variant,
  {_TAG} AS haplotype_tag, CAST(CAST(c.qual AS DOUBLE) / 255 AS FLOAT) AS meth_call,
  CASE WHEN (s.flag & 16) > 0 THEN '-' ELSE '+' END AS strand, s.qname AS read_id
FROM supporting s JOIN calls c USING (ord_block, ord_row)
WHERE (s.flag & 1796) = 0 AND abs(c.ref_pos - s.somatic_pos) <= 2000
""", "supporting", "calls")


def _with(*steps: str) -> str:
    """WITH clause for the named steps and everything below them."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _STEPS[name][1]:
            visit(need)
        if name not in order:
            order.append(name)

    for step in steps:
        visit(step)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{_STEPS[n][0]}\n)" for n in order)


ORACLE: dict[str, str] = {}


def _oracle(name: str, sql: str, *steps: str) -> None:
    ORACLE[name] = (f"{_with(*steps)}\n{sql.strip()}" if steps else sql.strip())


def _rounded_summary(source: str) -> str:
    return f"SELECT * REPLACE ({_r('mean_methylation')} AS mean_methylation) FROM {source}"


_oracle(
    "l1_state",
    f"SELECT read_id, chrom, methyl_pos, somatic_pos, {_r('meth_call')} AS meth_call, "
    f"{_state('meth_call')} AS meth_state FROM sites", "sites",
)
_oracle(
    "strand_filter", f"SELECT * REPLACE ({_r('meth_call')} AS meth_call) FROM covered2", "covered2"
)
_oracle("level2", _rounded_summary("l2_covered"), "l2_covered")
_oracle("level2_per_vcf", _rounded_summary("l2_covered_vcf"), "l2_covered_vcf")
_L3_KEY = "haplotype_group, bam_source, variant_type_group"
_oracle("level3_pivot", f"""
SELECT {_L3_KEY}, {_r('m1')} AS fp_mean_methylation, {_r('m2')} AS tp_mean_methylation,
  {_r('m1 - m2')} AS difference, m1 IS NOT NULL AND m2 IS NOT NULL AS is_comparable FROM l3
""", "l3")
_oracle("level3_pvalue", f"SELECT {_L3_KEY}, {_r('p')} AS p_value FROM l3p", "l3p")
_oracle("global_metrics", f"""
SELECT vcf_source_id || suffix AS name, CAST(CASE suffix WHEN '_processed_variants' THEN variants
  ELSE rows END AS VARCHAR) AS value
FROM (SELECT vcf_source_id, count(*) AS rows,
    count(DISTINCT (chrom, somatic_pos, variant_type)) AS variants FROM sites GROUP BY ALL)
CROSS JOIN (VALUES ('_total_variants'), ('_site_rows'), ('_processed_variants')) t(suffix)
UNION ALL
SELECT bam_source_id || suffix, CASE suffix WHEN '_methylated_site_count' THEN CAST(m AS VARCHAR)
  WHEN '_total_site_count' THEN CAST(n AS VARCHAR) ELSE printf('%.4f', coalesce(a, 0)) END
FROM (SELECT bam_source_id, count(*) AS n, count(*) FILTER (st <> 'low') AS m,
    avg(CAST(meth_call AS DOUBLE)) FILTER (st <> 'low') AS a
  FROM (SELECT *, {_state('meth_call')} AS st FROM sites) GROUP BY ALL)
CROSS JOIN (VALUES ('_methylated_site_count'), ('_total_site_count'), ('_mean_methylation')) t(suffix)
""", "sites")
_oracle(
    "level2_report",
    "SELECT * REPLACE (printf('%.4f', CAST(mean_methylation AS DOUBLE)) AS mean_methylation) "
    "FROM l2", "l2",
)
_oracle("level3_report", f"""
SELECT {_L3_KEY}, coalesce(printf('%.4f', m1), 'NA') AS fp_mean_methylation,
  coalesce(printf('%.4f', m2), 'NA') AS tp_mean_methylation,
  printf('%.4f', coalesce(m1 - m2, 0e0)) AS difference,
  printf('%.6f', coalesce(p, 1e0)) AS p_value FROM l3p
""", "l3p")
_oracle("vcf_ids", "SELECT DISTINCT vcf_source_id FROM sites", "sites")

_CONTRAST = ", ".join(f"{_r(c)} AS {c}" for c in ("normal", "tumor", "delta"))
_oracle("pivot_delta", f"SELECT * REPLACE ({_CONTRAST}) FROM contrast", "contrast")
_oracle(
    "detail_features",
    f"SELECT * REPLACE ({_r('mean_methylation')} AS mean_methylation) FROM details", "details",
)
_oracle(
    "merged_features",
    f"SELECT * REPLACE ({_CONTRAST}, {_r('mean_methylation')} AS mean_methylation) FROM features",
    "features",
)
_oracle("threshold_filter", f"""
SELECT label, {_KEY}, {_CONTRAST}, supporting_read_count AS read_count_detail,
  methyl_sites_count AS site_count_detail, {_r('mean_methylation')} AS mean_meth_detail
FROM features
WHERE normal >= 0.3e0 AND abs(delta) >= 0.1e0 AND supporting_read_count >= 2
""", "features")
_oracle("asm_mode_counts", "SELECT * FROM mode_counts", "mode_counts")
_oracle("haplotype_counts", "SELECT * FROM hap_counts", "hap_counts")
_oracle("haplotype_chi2_stat", _chi2("hap_counts", "haplotype_tag"), "hap_counts")
# With an even number of degrees of freedom the tail is a finite sum; here it has 6.
_oracle("haplotype_chi2_p", f"""
SELECT chi2, dof, n, CASE dof WHEN 6 THEN {_r("exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 * chi2 / 8)")} END AS p_value
FROM ({_chi2("hap_counts", "haplotype_tag")})
""", "hap_counts")
_oracle("allele_chi2_stat", _chi2("allele_counts", "somatic_allele_type"), "allele_counts")
_oracle("asm_mode_chi2_stat", _chi2("mode_counts", "asm_mode"), "mode_counts")
_oracle("expected_counts", f"""
SELECT haplotype_tag,
  {_r("(FP + TP) * sum(FP) OVER () / (sum(FP + TP) OVER ())")} AS "expected_FP",
  {_r("(FP + TP) * sum(TP) OVER () / (sum(FP + TP) OVER ())")} AS "expected_TP"
FROM hap_counts
""", "hap_counts")
_oracle("proportions", f"""
SELECT asm_mode, FP, TP, {_r("FP / (FP + TP)")} AS "FP_share", {_r("TP / (FP + TP)")} AS "TP_share",
  {_r("FP / sum(FP) OVER ()")} AS "FP_fraction", {_r("TP / sum(TP) OVER ()")} AS "TP_fraction"
FROM mode_counts
""", "mode_counts")
_oracle("retention_grid", f"""
SELECT c AS min_cpg, r AS min_reads,
  count(*) FILTER (vcf_source_id = 'tp' AND ok) AS tp_count,
  count(*) FILTER (vcf_source_id = 'fp' AND ok) AS fp_count,
  {_r("tp_count / count(*) FILTER (vcf_source_id = 'tp')")} AS tp_rate,
  {_r("fp_count / count(*) FILTER (vcf_source_id = 'fp')")} AS fp_rate
FROM (
  SELECT c, r, vcf_source_id, supporting_read_count >= r AND methyl_sites_count >= c AS ok
  FROM l2 CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (10)) x(c)
  CROSS JOIN (VALUES (0), (5), (10), (15), (20), (25), (30), (40), (50)) y(r)
) GROUP BY c, r
""", "l2")
_oracle("tpr_fpr_grid", f"""
SELECT read_th, normal_th, delta_th,
  {_r("count(*) FILTER (label = 'TP' AND ok) / count(*) FILTER (label = 'TP')")} AS "TPR",
  {_r("count(*) FILTER (label = 'FP' AND ok) / count(*) FILTER (label = 'FP')")} AS "FPR"
FROM (
  SELECT read_th, normal_th, delta_th, label, coalesce(
    normal >= normal_th AND abs(delta) >= delta_th AND supporting_read_count >= read_th, false
  ) AS ok
  FROM features
  CROSS JOIN (VALUES (0.0e0), (0.1e0), (0.2e0), (0.3e0), (0.4e0), (0.5e0)) a(normal_th)
  CROSS JOIN (VALUES (0.0e0), (0.05e0), (0.1e0), (0.15e0), (0.2e0)) b(delta_th)
  CROSS JOIN (VALUES (0), (2), (5), (10)) c(read_th)
) GROUP BY ALL
""", "features")

_oracle("descriptive_stats", f"""
SELECT feature, label AS "group", count(*) AS count, {_r('avg(value)')} AS mean,
  {_r('median(value)')} AS median, {_r('stddev_samp(value)')} AS std, {_r('min(value)')} AS min,
  {_r('max(value)')} AS max
FROM long GROUP BY ALL
""", "long")
_oracle("describe", f"""
SELECT label, feature, count(*) AS count,
  (SELECT count(*) FROM contrast c WHERE c.label = l.label) - count(*) AS missing,
  {_r('avg(value)')} AS mean, {_r('stddev_samp(value)')} AS std, {_r('min(value)')} AS min,
  {_r('quantile_cont(value, 0.25)')} AS q25, {_r('quantile_cont(value, 0.5)')} AS q50,
  {_r('quantile_cont(value, 0.75)')} AS q75, {_r('max(value)')} AS max
FROM long_contrast l GROUP BY label, feature
""", "contrast", "long_contrast")
_oracle("corr_matrix", "\nUNION ALL\n".join(
    f"SELECT label, '{a}' AS feature_a, '{b}' AS feature_b, {_r(f'corr({a}, {b})')} AS correlation "
    "FROM features GROUP BY label"
    for a in _FEATURES for b in _FEATURES
), "features")
_oracle("histogram", f"""
SELECT feature, label, bin, {_r('lo + (hi - lo) * bin / 30')} AS left_edge, count(*) AS count FROM (
  SELECT feature, label, lo, hi,
    CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 30), 29) ELSE 0 END AS INT)
      AS bin
  FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM long
    WINDOW w AS (PARTITION BY feature, label))
) GROUP BY feature, label, bin, lo, hi
""", "long")
_oracle("histogram_shared", f"""
SELECT feature, label, bin, {_r('lo + (hi - lo) * bin / 50')} AS left_edge, count(*) AS count FROM (
  SELECT feature, label, lo, hi,
    CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 50), 49) ELSE 0 END AS INT)
      AS bin
  FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM long_contrast
    WINDOW w AS (PARTITION BY feature))
) GROUP BY feature, label, bin, lo, hi
""", "long_contrast")
_oracle(
    "welch_t", f"SELECT feature, {_r(_T)} AS t_stat, {_r(_DF)} AS t_df FROM moments", "moments"
)
# Two-sided tail: with x = sqrt(df) * tan(a), the density becomes a power of the cosine.
_oracle("welch_p", f"""
SELECT feature, {_r('m1')} AS TP_mean, {_r('m2')} AS FP_mean, {_r('t')} AS t_stat,
  {_r('p')} AS p_val, {_r('d')} AS cohen_d, coalesce(p < 0.05, false) AS significant
FROM (
  SELECT feature, m1, m2, t, d, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2))
    / sqrt(pi()) * atan(abs(t) / sqrt(df)) / 6000 * sum(
      CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * pow(cos(i / 2000 * atan(abs(t) / sqrt(df))), df - 1))) AS p
  FROM (SELECT feature, m1, m2, {_T} AS t, {_DF} AS df, (m1 - m2) / sqrt((v1 + v2) / 2) AS d FROM moments)
  CROSS JOIN range(0, 2001) s(i)
  GROUP BY feature, m1, m2, t, df, d)
""", "moments")
_oracle("cohens_d", f"""
SELECT feature, {_r('(m1 - m2) / sqrt((v1 + v2) / 2)')} AS d_simple, {_r(_D2)} AS d_weighted
FROM moments
""", "moments")
_oracle("welch_by_group", f"""
SELECT haplotype_tag, variant_type, feature, {_r(_T)} AS t_stat, {_r(_DF)} AS t_df,
  {_r(_D2)} AS d_weighted
FROM group_moments WHERE n1 >= 2 AND n2 >= 2
""", "group_moments")
_oracle("bonferroni", f"""
SELECT {_L3_KEY}, {_r('p')} AS p_value, {_r('least(p * count(*) OVER (), 1)')} AS p_adj
FROM l3p WHERE m1 IS NOT NULL AND m2 IS NOT NULL
""", "l3p")
_oracle("group_values", "SELECT DISTINCT haplotype_tag FROM l2 ORDER BY ALL", "l2")
_oracle("dedup", """
SELECT DISTINCT chrom, somatic_pos, variant_type, vcf_source_id, strand,
  upper(vcf_source_id) AS label FROM sites
""", "sites")


def _drawn(source: str, level: int, one: str) -> str:
    """Places drawn from ``source`` (gid, start, stop, side, redraw, number), one row per draw or per ``one``."""
    return f"""
SELECT *, start + CAST(floor(xor(e, e >> 16) * ((stop - start) / 2147483648e0)) AS BIGINT) AS place,
  CASE WHEN one THEN number ELSE 1 END AS times FROM (
SELECT *, (xor(c, c >> 13) * 695872825) & 2147483647 AS e FROM (
SELECT *, ((xor(a, a >> 15) + k2) * 739982445) & 2147483647 AS c FROM (
SELECT *, (xor(j, k1) * 2146121005) & 2147483647 AS a FROM (
SELECT *, unnest(range(CASE WHEN one THEN 1 ELSE least(65536, number - chunk * 65536) END)) AS j FROM (
SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) & 2147483647 AS k1,
  CAST('0x' || substr(h, 9, 8) AS BIGINT) & 2147483647 AS k2 FROM (
SELECT *, md5('1|{level}|' || concat_ws('|', stream, start, side, redraw, chunk)) AS h FROM (
SELECT *, {one} AS one, unnest(range(CASE WHEN {one} THEN 1 ELSE (number + 65535) // 65536 END)) AS chunk
FROM {source} WHERE number > 0)))))))"""


def _redraws(column: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """Bootstrap steps by one grouping column: ranges of 131,072 places (up to 1024 of them), then places."""
    c = column
    return [
        (f"pool_{c}", f"""
SELECT {c} AS name, feature, label, value,
  row_number() OVER (PARTITION BY {c}, feature ORDER BY value) - 1 AS place
FROM long WHERE {c} IS NOT NULL""", ("long",)),
        (f"pools_{c}", f"""
SELECT *, row_number() OVER () AS gid, n1 + n2 AS n,
  CAST('0x' || substr(md5(name || '|' || feature), 1, 15) AS BIGINT) AS stream FROM (
  SELECT name, feature, count(*) FILTER (label = 'TP') AS n1, count(*) FILTER (label = 'FP') AS n2,
    abs(avg(value) FILTER (label = 'TP') - avg(value) FILTER (label = 'FP')) - 1e-12 * max(abs(value)) AS gap
  FROM pool_{c} GROUP BY ALL) WHERE n1 >= 2 AND n2 >= 2""", (f"pool_{c}",)),
        (f"roots_{c}", f"""
SELECT gid, stream, n, 0 AS start, n AS stop, side, redraw, CASE side WHEN 0 THEN n1 ELSE n2 END AS number
FROM pools_{c}, (VALUES (0), (1)) s(side), range(1000) b(redraw)""", (f"pools_{c}",)),
        (f"ranges_{c}", f"""
SELECT gid, stream, n, side, redraw, place // 131072 * 131072 AS start,
  least(n, place // 131072 * 131072 + 131072) AS stop, CAST(sum(times) AS BIGINT) AS number
FROM ({_drawn(f"roots_{c}", 131072, "stop <= 131072")}) GROUP BY ALL""", (f"roots_{c}",)),
        (f"boot_{c}", f"""
SELECT name, feature, count(*) FILTER (abs(tp / n1 - fp / n2) >= gap) / 1000e0 AS p_boot FROM (
  SELECT gid, redraw, sum(value) FILTER (side = 0) AS tp, sum(value) FILTER (side = 1) AS fp
  FROM ({_drawn(f"ranges_{c}", 1, "false")}) d
  JOIN (SELECT gid, p.place, p.value FROM pool_{c} p JOIN pools_{c} g USING (name, feature)) v USING (gid, place)
  GROUP BY gid, redraw) JOIN pools_{c} USING (gid)
GROUP BY name, feature""", (f"ranges_{c}", f"pool_{c}", f"pools_{c}")),
    ]


for _column in ("variant_type", "haplotype_tag"):
    for _name, _sql, _needs in _redraws(_column):
        _step(_name, _sql, *_needs)
_step("tag_moments", _moments("haplotype_tag,"), "long")
_oracle("bootstrap_p", 'SELECT name AS "group", feature, p_boot FROM boot_variant_type', "boot_variant_type")
_oracle("feature_stats", f"""
SELECT name AS "group", feature, {_r('t')} AS t_stat, {_r('p')} AS p_val, p_boot, {_r('d')} AS cohens_d,
  {_r('least(p * count(*) OVER (), 1)')} AS p_adj
FROM (
  SELECT name, feature, t, d, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2))
    / sqrt(pi()) * atan(abs(t) / sqrt(df)) / 6000 * sum(
      CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * pow(cos(i / 2000 * atan(abs(t) / sqrt(df))), df - 1))) AS p
  FROM (SELECT haplotype_tag AS name, feature, {_T} AS t, {_DF} AS df, {_D2} AS d
    FROM tag_moments WHERE n1 >= 2 AND n2 >= 2 AND haplotype_tag IS NOT NULL)
  CROSS JOIN range(0, 2001) s(i)
  GROUP BY name, feature, t, df, d)
JOIN boot_haplotype_tag USING (name, feature)
""", "tag_moments", "boot_haplotype_tag")

_step("standardized", "SELECT label, {key}, {cols} FROM features CROSS JOIN ({stats})".format(
    key=_KEY,
    cols=", ".join(f"(coalesce({f}, {f}_med) - {f}_avg) / {f}_sd AS {f}" for f in _FEATURES),
    stats="SELECT " + ", ".join(
        f"any_value({f}_med) AS {f}_med, avg(coalesce({f}, {f}_med)) AS {f}_avg, "
        f"stddev_pop(coalesce({f}, {f}_med)) AS {f}_sd" for f in _FEATURES
    ) + " FROM features CROSS JOIN (SELECT " + ", ".join(
        f"median({f}) AS {f}_med" for f in _FEATURES
    ) + " FROM features)",
), "features")
_oracle("median_impute_scale", f"SELECT label, {_KEY}, " + ", ".join(
    f"{_r(f)} AS {f}" for f in _FEATURES) + " FROM standardized", "standardized")
_step("test_sizes", """
SELECT label, n, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (
    ORDER BY floor(x) - x, label) <= total - sum(CAST(floor(x) AS BIGINT)) OVER ()
  THEN 1 ELSE 0 END AS t
FROM (
  SELECT label, count(*) AS n, CAST(ceil(sum(count(*)) OVER () * 0.3e0) AS BIGINT) AS total,
    n * total / (sum(count(*)) OVER ()) AS x
  FROM features GROUP BY label)
""", "features")
_oracle("stratified_split", """
SELECT label, is_test, CASE WHEN is_test THEN t ELSE n - t END AS rows
FROM test_sizes CROSS JOIN (VALUES (true), (false)) v(is_test)
""", "test_sizes")
_HASHED = " || '|' || ".join(
    [f"'{SPLIT_SEED}'", *(f"coalesce(CAST({c} AS VARCHAR), '')" for c in [*CONTRAST_KEY, "label"])])
_step("split", f"""
SELECT s.*, row_number() OVER (PARTITION BY s.label
  ORDER BY CAST('0x' || substr(md5({_HASHED.replace("CAST(label", "CAST(s.label")}), 1, 15) AS BIGINT)) <= t AS is_test
FROM standardized s JOIN test_sizes z ON s.label = z.label
""", "standardized", "test_sizes")


def _newton(rounds: int = 12) -> str:
    """Newton steps of the weighted logistic loss; each system is solved by elimination, a table per pivot."""
    x = [*_FEATURES, "1e0"]
    size = len(x)
    cells = [(i, j) for i in range(size) for j in range(size + 1)]
    parts = ["""t AS MATERIALIZED (SELECT *, CASE label WHEN 'TP' THEN 1e0 ELSE 0e0 END AS y,
      count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY label)) AS w FROM split WHERE NOT is_test)""",
             "b0 AS MATERIALIZED (SELECT " + ", ".join(f"0e0 AS b_{i}" for i in range(size)) + ")"]
    margin = " + ".join(f"b_{i} * {c}" for i, c in enumerate(x))
    for n in range(rounds):
        sums = [
            (f"sum(w * (p - y) * {x[i]})" if j == size else f"sum(w * p * (1 - p) * {x[i]} * {x[j]})")
            + (f" + any_value(b_{i})" if j == size and i < size - 1 else " + 1" if i == j < size - 1 else "")
            + f" AS a_{i}_{j}" for i, j in cells]
        parts.append(f"""a{n}_0 AS MATERIALIZED (SELECT {", ".join(sums)}
          FROM (SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM t CROSS JOIN b{n}))""")
        for k in range(size):
            swept = [f"a_{i}_{j}" + (f" - a_{i}_{k} / a_{k}_{k} * a_{k}_{j}" if i != k else "") + f" AS a_{i}_{j}"
                     for i, j in cells]
            parts.append(f"a{n}_{k + 1} AS MATERIALIZED (SELECT {', '.join(swept)} FROM a{n}_{k})")
        moved = ", ".join(f"b_{i} - a_{i}_{size} / a_{i}_{i} AS b_{i}" for i in range(size))
        parts.append(f"b{n + 1} AS MATERIALIZED (SELECT {moved} FROM b{n} CROSS JOIN a{n}_{size})")
    return f"WITH {', '.join(parts)} SELECT * FROM b{rounds}"


_step("fit", _newton(), "split")
_oracle("logreg_coefficients", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {_r(f'b_{i}')} AS coef FROM fit" for i, f in enumerate(_FEATURES)), "fit")
_step("fit_scored", "SELECT label, 1 / (1 + exp(-(b_{last} + {terms}))) AS score FROM split CROSS JOIN fit WHERE is_test".format(
    last=len(_FEATURES), terms=" + ".join(f"b_{i} * {f}" for i, f in enumerate(_FEATURES))), "split", "fit")
_step("scored", "SELECT label, round(mean_methylation, 4) AS score FROM features", "features")
_step("curve", """
SELECT threshold, tp, fp, sum(tp) OVER w AS cum_tp, sum(fp) OVER w AS cum_fp FROM (
  SELECT score AS threshold, count(*) FILTER (label = 'TP') AS tp,
    count(*) FILTER (label = 'FP') AS fp
  FROM scored GROUP BY ALL
) WINDOW w AS (ORDER BY threshold DESC)
""", "scored")
_oracle("roc_points", f"""
SELECT {_r('threshold')} AS threshold, CAST(cum_tp AS BIGINT) AS cum_tp,
  CAST(cum_fp AS BIGINT) AS cum_fp, {_r('cum_fp / max(cum_fp) OVER ()')} AS fpr,
  {_r('cum_tp / max(cum_tp) OVER ()')} AS tpr
FROM curve UNION ALL SELECT NULL, 0, 0, 0, 0
""", "curve")


def _area(source: str) -> str:
    return f"""
SELECT {_r("count(*) FILTER (p.score > n.score) / count(*) + count(*) FILTER (p.score = n.score) / count(*) / 2")}
  AS auc
FROM (SELECT score FROM {source} WHERE label = 'TP') p
CROSS JOIN (SELECT score FROM {source} WHERE label = 'FP') n
"""


_oracle("roc_auc", _area("scored"), "scored")
# Precision, recall and F1 of each class, from its hits, false calls and misses.
_CLASS_METRICS = ", ".join(
    f"coalesce({hit} / nullif({hit} + {wrong}, 0), 0) AS precision_{side}, "
    f"coalesce({hit} / nullif({hit} + {missed}, 0), 0) AS recall_{side}, "
    f"coalesce(2 * {hit} / nullif(2 * {hit} + {wrong} + {missed}, 0), 0) AS f1_{side}, "
    f"{hit} + {missed} AS support_{side}"
    for side, hit, wrong, missed in (("TP", "tp", "fp", "fn"), ("FP", "tn", "fn", "fp")))
_METRICS = ("precision", "recall", "f1")
_SHOWN = ", ".join([
    *(_r(f"{m}_{side}") + f' AS "{m}_{side}"' for m in _METRICS for side in ("TP", "FP")),
    *(_r(f"({m}_TP + {m}_FP) / 2") + f" AS {m}_macro" for m in _METRICS),
    *(_r(f"({m}_TP * support_TP + {m}_FP * support_FP) / nullif(support_TP + support_FP, 0)")
      + f" AS {m}_weighted" for m in _METRICS)])
def _prediction_metrics(source: str) -> str:
    return f"""
SELECT tp, fp, fn, tn, {_r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy,
  "support_TP", "support_FP", {_SHOWN}
FROM (SELECT *, {_CLASS_METRICS} FROM (
  SELECT count(*) FILTER (label = 'TP' AND score > 0.5e0) AS tp,
    count(*) FILTER (label = 'FP' AND score > 0.5e0) AS fp,
    count(*) FILTER (label = 'TP' AND score <= 0.5e0) AS fn,
    count(*) FILTER (label = 'FP' AND score <= 0.5e0) AS tn
  FROM {source}))
"""


_oracle("prediction_metrics", _prediction_metrics("scored"), "scored")
_oracle(
    "logreg_metrics",
    f"SELECT * FROM ({_prediction_metrics('fit_scored')}) CROSS JOIN ({_area('fit_scored')})", "fit_scored")

_oracle(
    "vcf_text_scan",
    "SELECT * REPLACE ('call.' || vcf_source_id AS vcf_source_id) FROM records", "records",
)
_oracle("bed_text_scan", "SELECT * FROM bed", "bed")
_oracle("source_id", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE name WHEN '' THEN '.vcf' ELSE name END
  WHEN 1 THEN name
  ELSE CASE WHEN contains(name, '.')
    THEN substr(name, 1, length(name) - position('.' IN reverse(name))) ELSE name END
  END AS source_id
FROM (SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages)
""")
_oracle(
    "pass_filter", f"SELECT vcf_source_id, chrom, pos, filter FROM records WHERE {_PASSING}", "records"
)
_oracle(
    "strict_pass_filter",
    "SELECT vcf_source_id, chrom, pos, filter FROM records WHERE filter = 'PASS'", "records",
)
_oracle(
    "region_filter",
    "SELECT vcf_source_id, chrom, pos, ref FROM records WHERE chrom = 'chr2'", "records",
)
_oracle(
    "alt_explode", "SELECT vcf_source_id, chrom, pos, ref, alt, allele_index FROM alleles", "alleles"
)
_oracle(
    "variant_type", "SELECT vcf_source_id, chrom, pos, ref, alt, variant_type FROM alleles", "alleles"
)
_oracle(
    "ad_filter",
    f"SELECT vcf_source_id, chrom, pos, ref, alt FROM alleles WHERE {_SUPPORTED}", "alleles",
)
for _name in ("bed_filter", "bed_filter_shuffled"):
    _oracle(_name, """
SELECT vcf_source_id, chrom, pos, ref, alt FROM records a WHERE EXISTS (
  SELECT 1 FROM bed b WHERE b.chrom = a.chrom AND a.pos - 1 >= b.start_pos AND a.pos - 1 < b.end_pos)
""", "records", "bed")
_oracle("semi_join_positions", """
SELECT vcf_source_id, chrom, pos, ref, alt FROM records
WHERE (chrom, pos) IN (SELECT (chrom, pos) FROM positions)
""", "records", "positions")
_oracle("variant_load", f"""
SELECT chrom, pos, ref, alt, variant_type, vcf_source_id, 0e0 AS allele_freq,
  coalesce(greatest(TRY_CAST(qual AS DOUBLE), 0), 0) AS qual
FROM in_bed WHERE {_PASSING} AND {_SUPPORTED}
""", "in_bed")
_oracle("variant_sort", "SELECT chrom, pos, variant_type, alt FROM variants", "variants")

_oracle("sam_text_scan", """
SELECT qname, flag, rname, pos, mapq, cigar, seq, mm, array_to_string(ml, ',') AS ml, hp_type,
  hp_value, orig_hp, ps FROM aln
""", "aln")
_oracle("tag_sample", """
SELECT count(*) AS sampled, count(mm) AS mm, count(ml) AS ml, count(hp_value) AS hp, count(ps) AS ps
FROM (SELECT * FROM aln ORDER BY ord_block, ord_row LIMIT 100)
""", "aln")
_oracle("read_flags", """
SELECT qname, flag, mapq, (flag & 2308) = 0 AND mapq >= 10 AS fetchable,
  (flag & 1796) = 0 AS usable, CASE WHEN (flag & 16) > 0 THEN '-' ELSE '+' END AS strand FROM aln
""", "aln")
_oracle(
    "haplotype_tag",
    f"SELECT qname, hp_type, hp_value, orig_hp, {_TAG} AS haplotype_tag FROM aln", "aln",
)
_oracle("read_span", "SELECT qname, cigar, start0, end0 FROM spans", "spans")
_oracle("cigar_blocks", "SELECT qname, pos, query_start, ref_start, length FROM blocks", "blocks")
_oracle("basemod_explode", """
SELECT a.qname, CAST(c.ref_pos AS INT) AS ref_pos, CAST(c.qual AS INT) AS qual
FROM calls c JOIN aln a USING (ord_block, ord_row) WHERE abs(c.ref_pos - a.pos) <= 2000
""", "calls", "aln")
for _name in ("interval_join", "interval_join_shuffled"):
    _oracle(_name, f"SELECT {_PAIR} FROM pairs", "pairs")
_oracle("depth_cap_topn", f"""
SELECT {_PAIR} FROM pairs QUALIFY row_number() OVER (
  PARTITION BY chrom, somatic_pos, ref, alt, variant_type, vcf_source_id, bam_source_id
  ORDER BY pos, ord_block, ord_row) <= 3
""", "pairs")
_oracle("allele_call", """
SELECT qname, chrom, somatic_pos, ref, alt, vcf_source_id, base AS somatic_base_at_variant,
  somatic_allele_type FROM touching_alleles
""", "touching_alleles")
_oracle(
    "level1_sites",
    f"SELECT * REPLACE ({_r('meth_call')} AS meth_call), {_state('meth_call')} AS meth_state FROM found", "found",
)
_oracle("level2_from_reads", f"""
SELECT * REPLACE ({_r('mean_methylation')} AS mean_methylation) FROM ({_summary('found').strip()})
""", "found")
