"""Input views of the registered queries.

The given tables hold no genomics data, so sites, variant records, reads, regions and positions
are derived from them, row by row over the whole tables. The same text runs in both engines; the
placeholders stand for type names and array functions. Only where the SQL stops, at parts whose
position leaves the 4-byte range, has Spark a text that goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Setting for small test tables of a single split: the number of parts to cut them into. Unset, as it
#: should be for tables of real size, they are read as they are.
PARTITIONS_KEY = "spark.strandloom.viewPartitions"

_SITE_TEXT = """
SELECT 'chr' || CAST({number} AS {str}) AS chrom,
  CAST({part} * 5000 + 10000 + (l_suppkey % 41) * 100 - 2000 AS INT) AS methyl_pos,
  CAST({part} * 5000 + 10000 AS INT) AS somatic_pos,
  CASE l_partkey % 40 % 4 WHEN 0 THEN 'INS' WHEN 1 THEN 'DEL' ELSE 'SNV' END AS variant_type,
  CASE WHEN l_partkey % 80 < 40 THEN 'tp' ELSE 'fp' END AS vcf_source_id,
  CASE WHEN l_linestatus = 'O' THEN 'tumor' ELSE 'normal' END AS bam_source_id,
  CASE WHEN l_returnflag = 'A' THEN 'alt' ELSE 'ref' END AS somatic_allele_type,
  CASE l_orderkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '1-1'
    WHEN 4 THEN '2-1' WHEN 5 THEN '3' ELSE 'un' END AS haplotype_tag,
  CAST(CAST((CAST(l_quantity AS INT) * 5 + l_linenumber) % 256 AS DOUBLE) / 255 AS {float})
    AS meth_call,
  CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  'r' || CAST(l_orderkey AS {str}) AS read_id
FROM lineitem
"""

_RECORDS = """
SELECT 'chr' || CAST(o_custkey % 3 + 1 AS {str}) AS chrom,
  CAST((o_orderkey * 37) % 2000000000 + 1 AS INT) AS pos,
  '.' AS id,
  CASE WHEN o_orderkey % 8 < 2 THEN 'AT'
    ELSE substr('ACGT', CAST(o_custkey % 4 AS INT) + 1, 1) END AS ref,
  CASE o_orderkey % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'GC' WHEN 2 THEN 'AT' WHEN 3 THEN 'G,T'
    WHEN 4 THEN '.' WHEN 5 THEN 'C' WHEN 6 THEN 'G' ELSE 'T' END AS alt,
  CASE WHEN o_orderkey % 11 = 0 THEN '.'
    ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS {str}) END AS qual,
  CASE o_orderkey % 5 WHEN 0 THEN 'LowQual' WHEN 1 THEN '.' WHEN 2 THEN 'PASS;Germline'
    ELSE 'PASS' END AS filter,
  'SOMATIC' AS info,
  CASE WHEN o_orderkey % 7 = 0 THEN 'GT:DP' ELSE 'GT:AD:DP' END AS format,
  CASE WHEN o_orderkey % 7 = 0 THEN '0/1:30' WHEN o_orderkey % 7 = 1 THEN '0/1:.:30'
    ELSE '0/1:' || CAST(o_custkey % 20 AS {str}) || ',' || CAST(o_orderkey % 13 AS {str})
      || CASE WHEN o_orderkey % 8 = 3 THEN ',' || CAST(o_custkey % 13 AS {str}) ELSE '' END
      || ':30' END AS sample,
  CASE WHEN o_orderkey % 2 = 0 THEN 'tp' ELSE 'fp' END AS vcf_source_id
FROM orders
"""

_READS = """
SELECT CASE WHEN l_linestatus = 'O' THEN 'tumor' ELSE 'normal' END AS bam_source_id,
  l_orderkey * 10 + l_linenumber AS ord_block,
  l_partkey * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS ord_row,
  'q' || CAST(l_orderkey AS {str}) || '/' || CAST(l_linenumber AS {str}) AS qname,
  CAST(CASE l_partkey % 16 WHEN 0 THEN 4 WHEN 1 THEN 256 WHEN 2 THEN 2048 WHEN 3 THEN 512
    WHEN 4 THEN 1024 WHEN 5 THEN 16 WHEN 6 THEN 16 WHEN 7 THEN 16 WHEN 8 THEN 16 WHEN 9 THEN 16
    ELSE 0 END AS INT) AS flag,
  'chr' || CAST(l_partkey % 3 + 1 AS {str}) AS rname,
  CAST((l_orderkey * 37 + l_linenumber * 3) % 2000000000 + 1 AS INT) AS pos,
  CAST(CAST(l_quantity AS INT) + 5 AS INT) AS mapq,
  CASE l_linenumber WHEN 1 THEN '20M' WHEN 2 THEN '5S15M' WHEN 3 THEN '8M2I10M'
    WHEN 4 THEN '10M3D10M' WHEN 5 THEN '3S5M2I4M1D6M' WHEN 6 THEN '4H12=8X'
    ELSE '6M100N14M' END AS cigar,
  CASE l_suppkey % 4 WHEN 0 THEN 'ACGTCGATCGCCGTACGGTC' WHEN 1 THEN 'CCGGACGTTACGCGCATCGA'
    WHEN 2 THEN 'TTGCCGATTCGAGCCTAGCG' ELSE 'GATTACAGGCTTCCGGAACT' END AS seq,
  CASE l_partkey % 7 WHEN 0 THEN 'C+m,0,1,0;' WHEN 1 THEN 'C+m?,1,0;' WHEN 2 THEN 'C+mh,0,0;'
    WHEN 3 THEN 'C+m,0;C+h,0;' WHEN 4 THEN 'C+m.,0,0,1;' WHEN 5 THEN 'A+a,0;C+m,1;' END AS mm,
  CASE WHEN l_suppkey % 10 = 0 OR l_partkey % 7 = 6 THEN NULL ELSE {slice}({arr}(
    CAST((CAST(l_quantity AS INT) * 5 + l_linenumber) % 256 AS INT),
    CAST((l_orderkey * 37) % 256 AS INT), CAST((l_suppkey * 51) % 256 AS INT),
    CAST((l_partkey * 17) % 256 AS INT)),
    1, CASE l_partkey % 7 WHEN 0 THEN 3 WHEN 2 THEN 4 WHEN 4 THEN 3 ELSE 2 END) END AS ml,
  CASE l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Z' ELSE 'i' END AS hp_type,
  CASE l_orderkey % 5 WHEN 0 THEN NULL
    WHEN 1 THEN CASE l_suppkey % 6 WHEN 0 THEN 'UN' WHEN 1 THEN 'un' WHEN 2 THEN '1-1'
      WHEN 3 THEN '2-1' WHEN 4 THEN 'x' ELSE 'H1' END
    ELSE CASE l_suppkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3'
      WHEN 4 THEN '-1' ELSE '7' END END AS hp_value,
  CASE l_partkey % 4 WHEN 0 THEN '1-1' WHEN 1 THEN '2-1' WHEN 2 THEN 'other' END AS orig_hp,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(l_orderkey AS {str}) END AS ps
FROM lineitem
"""

_REGIONS = """
SELECT 'chr' || CAST(c_custkey % 3 + 1 AS {str}) AS chrom,
  CAST((c_custkey * 370) % 2000000000 AS INT) AS start_pos,
  CAST((c_custkey * 370) % 2000000000 + c_nationkey * 40 - 40 AS INT) AS end_pos
FROM customer
"""

_POSITIONS = """
SELECT 'chr' || CAST(l_suppkey % 3 + 1 AS {str}) AS chrom,
  CAST((l_partkey * 37) % 2000000000 + 1 AS INT) AS pos
FROM lineitem
"""

#: Parts whose sites all have a 4-byte position on one chromosome.
PLACES = 429_495


def _site_text(part: str, number: str = "l_partkey % 3 + 1") -> str:
    return _SITE_TEXT.replace("{part}", part).replace("{number}", number)


VIEWS = {
    "sites": _site_text("(l_partkey % 40)"),
    "sparse_sites": _site_text("l_partkey"),
    "records": _RECORDS,
    "aln": _READS,
    "regions": _REGIONS,
    "positions": _POSITIONS,
}
#: The next PLACES parts lie on three further chromosomes, and so on: no two parts share a position.
SPARK_VIEWS = VIEWS | {
    "sparse_sites": _site_text(
        f"(l_partkey % {PLACES})", f"l_partkey % 3 + 1 + l_partkey DIV {PLACES} * 3"
    ),
}
BASE = {
    "sites": "lineitem", "sparse_sites": "lineitem", "records": "orders", "aln": "lineitem",
    "regions": "customer", "positions": "lineitem",
}


def spark_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One view as a DataFrame over the Parquet tables in ``folder``."""
    base = BASE[name]
    text = SPARK_VIEWS[name].replace(f"FROM {base}", f"FROM {{{base}}}")
    for place, value in (("{str}", "string"), ("{float}", "float"), ("{arr}", "array"),
                         ("{slice}", "slice")):
        text = text.replace(place, value)
    table = spark.read.parquet(f"{folder}/{base}.parquet")
    parts = spark.conf.get(PARTITIONS_KEY, None)
    if parts and base == "lineitem":
        table = table.repartition(int(parts))
    return spark.sql(text, **{base: table})


def duckdb_view(name: str) -> str:
    """The same view as SQL text for DuckDB."""
    text = VIEWS[name]
    for place, value in (("{str}", "varchar"), ("{float}", "float"), ("{arr}", "list_value"),
                         ("{slice}", "list_slice")):
        text = text.replace(place, value)
    return text.strip()
