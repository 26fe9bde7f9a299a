"""Every registered query against its SQL, on the smallest tables; the flagship and facts on the middle ones."""

import __spark_entry__ as driver
import pytest

from checks.compare import compare, duck
from checks.queries import QUERIES
from copyloom.fixtures import view

# Heavier chains whose own tests are in the other files.
ROWS_ONLY = {
    "profile_components",
    "density_groups",
    "case_strengths",
    "expected_counts",
    "poisson_factor_bic",
    "call_poisson_scan",
    "cohort_calls",
    "cohort_calls_clusters_only",
    "reads_to_gene_table",
}


@pytest.fixture(scope="module")
def connection(small):
    return duck(small)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ROWS_ONLY])
def test_query_agrees_with_sql(spark, connection, small, name):
    same, text = compare(spark, connection, small, name)
    assert same, text


def test_registry_is_consistent():
    own = set(driver.queries()) - set(driver.LLM_QUERIES)
    assert own - set(driver.oracle_sql()) == ROWS_ONLY
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_the_sixteen_columns(spark):
    table = driver.entry(spark)
    assert len(table.columns) == 16 and table.columns[0] == "call_id" and table.columns[-1] == "gene_biotype"
    assert table.count() == 62


def test_fixture_facts(spark, middle):
    counts = QUERIES["overlap_counts"](spark, middle).toPandas()
    assert len(counts) == 4800 and counts.n.sum() == 42176 and counts.n.max() == 27 and (counts.n == 0).sum() == 85
    qc = QUERIES["region_qc"](spark, middle).toPandas()
    assert (qc.gc.between(20, 80) & (qc.mapp >= 0.9) & qc.width.between(20, 2000)).sum() == 87
    reads = QUERIES["usable_reads_single_end"](spark, middle).toPandas().set_index("sample_name")
    assert reads.all_reads["S00"] == 3023 and reads.all_reads["S01"] == 3047 and reads.first_mates["S01"] == 0
    assert view(spark, middle, "fx_reads").where("sample_name = 'S00' AND (flag & 64) = 64").count() == 2855


def test_flagship_facts(spark, middle):
    table = QUERIES["gene_deletion_table"](spark, middle).toPandas()
    assert len(table) == 9687 and table.gene_id.nunique() == 497 and table.sample_cnt.max() == 20
    assert (table.gene_biotype == "protein_coding").sum() == 6430
    assert (table.codex_lratio.notna() & table.exomedepth_bf.notna()).sum() == 3265
