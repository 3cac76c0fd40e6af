"""Work of the interval join besides the join itself."""

import pytest

from strandloom.operators import overlap as O
from strandloom.workload import queries as Q

FOLDER = "/root/testdata/sf0.001"


def test_a_given_bin_size_needs_no_pass_over_the_reads(spark, monkeypatch):
    monkeypatch.setattr(O, "bin_size_for", lambda *a: pytest.fail("read for a bin size that is given"))
    assert Q.interval_join_shuffled(spark, FOLDER).columns == Q._PAIR_COLUMNS


@pytest.mark.parametrize("name", ["interval_join", "interval_join_shuffled"])
def test_join_reads_written_spans_and_windows(spark, name):
    files = Q.QUERIES[name](spark, FOLDER).inputFiles()
    assert any("/spans-" in f for f in files) and any("/windows-" in f for f in files)
    assert not any("lineitem" in f or "orders" in f for f in files)
