"""Input views on tables whose keys go far beyond those of the given ones."""

from pyspark.sql import functions as F

from strandloom.workload import queries as Q, views as W

GIVEN = "/root/testdata/sf0.001/lineitem.parquet"


def shifted(spark, folder, *starts):
    """The given rows once per start, their parts counted from there."""
    rows = spark.read.parquet(GIVEN)
    tables = [rows.withColumn("l_partkey", F.col("l_partkey") + start) for start in starts]
    stacked = tables[0]
    for other in tables[1:]:
        stacked = stacked.unionAll(other)
    stacked.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_sparse_sites_of_given_keys_are_those_of_the_sql_text(spark, tmp_path):
    # Up to the last part that the text of the SQL can place.
    top = spark.read.parquet(GIVEN).agg(F.max("l_partkey")).first()[0]
    folder = shifted(spark, tmp_path, 0, W.PLACES - 1 - top)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = W.VIEWS["sparse_sites"].replace("FROM lineitem", "FROM {lineitem}")
    text = text.replace("{str}", "string").replace("{float}", "float")
    want, got = spark.sql(text, lineitem=lines), W.spark_view(spark, folder, "sparse_sites")
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_parts_beyond_one_chromosome_keep_their_own_position(spark, tmp_path):
    starts = (0, W.PLACES - 5, 1_200_000, 20_000_000)
    folder = shifted(spark, tmp_path, *starts)
    parts = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey").distinct().count()
    seen = W.spark_view(spark, folder, "sparse_sites")
    assert seen.select("chrom", "somatic_pos").distinct().count() == parts
    ends = seen.agg(F.min("methyl_pos"), F.max("methyl_pos"), F.max("somatic_pos")).first()
    assert ends[0] >= 0 and max(ends[1:]) < 2**31
    near = F.col("methyl_pos") - F.col("somatic_pos")
    assert seen.where((near < -2000) | (near > 2000)).isEmpty()


def test_contrast_over_large_part_keys(spark, tmp_path):
    base = Q.contrast(spark, shifted(spark, tmp_path / "a", 0)).count()
    # A multiple of 240 leaves type and label of a part as they are.
    both = Q.contrast(spark, shifted(spark, tmp_path / "b", 0, 1_200_000))
    assert both.count() == 2 * base
    assert {r[0] for r in both.select("chrom").distinct().collect()} == {f"chr{n}" for n in (1, 2, 3, 7, 8, 9)}
