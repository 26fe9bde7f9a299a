"""Input views for the checks, derived from the TPC-H-like driver tables.

The text is the same for Spark SQL and DuckDB. FIXTURES.md describes every view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

REGION = "CAST(floor(p_partkey / 10.0) AS BIGINT)"
READ_REGION = "CAST(floor(l_partkey / 10.0) AS BIGINT)"
GENE = "CAST(floor(p_partkey / 4.0) AS BIGINT)"

# Order-like rows laid out as calls that do not overlap within a sample and contig.
CALL_SLOTS = """(SELECT o_orderkey, o_custkey,
   concat('S', lpad(CAST(o_custkey % 24 AS VARCHAR(8)), 2, '0')) AS sample_name,
   CAST(1 + o_orderkey % 10 AS VARCHAR(8)) AS contig,
   CAST(row_number() OVER (PARTITION BY o_custkey % 24, o_orderkey % 10 ORDER BY o_orderkey) * 1000
     + o_orderkey % 200 AS BIGINT) AS st FROM orders) o"""

VIEWS = {
    "fx_targets": f"""SELECT DISTINCT {REGION} AS region_id,
 CAST(1 + {REGION} % 10 AS VARCHAR(8)) AS contig,
 CAST(1 + {REGION} * 300 AS BIGINT) AS start_bp,
 CAST(1 + {REGION} * 300 + 19 + ({REGION} * 37) % 180 AS BIGINT) AS end_bp,
 CAST(15 + ({REGION} * 31) % 70 AS DOUBLE) AS gc,
 CAST(80 + {REGION} % 21 AS DOUBLE) / 100 AS mapp
FROM part""",
    "fx_reads": f"""SELECT concat('S', lpad(CAST(l_suppkey % 24 AS VARCHAR(8)), 2, '0')) AS sample_name,
 CAST(1 + {READ_REGION} % 10 AS VARCHAR(8)) AS contig,
 CAST(1 + {READ_REGION} * 300 + (l_orderkey * 7 + l_linenumber * 13) % 60 AS BIGINT) AS pos,
 CAST(50 + l_quantity AS BIGINT) AS qwidth,
 CAST(CASE WHEN l_suppkey % 24 >= 12 AND {READ_REGION} % 3 = 0 AND l_orderkey % 4 <> 0 THEN 5
           WHEN l_suppkey % 24 = 5 AND {READ_REGION} % 10 = 3 AND l_orderkey % 2 = 0 THEN 5
           WHEN l_orderkey % 40 = 7 THEN 10 ELSE 60 END AS INT) AS mapq,
 CAST(CASE WHEN l_suppkey % 24 = 1 THEN 0 WHEN l_orderkey % 20 = 3 THEN 129 ELSE 65 END
    + CASE WHEN l_orderkey % 50 = 4 THEN 1024 ELSE 0 END
    + CASE WHEN l_orderkey % 50 = 1 THEN 4 ELSE 0 END
    + CASE WHEN l_orderkey % 50 = 2 THEN 512 ELSE 0 END AS INT) AS flag
FROM lineitem""",
    "fx_poisson_calls": f"""SELECT sample_name, concat('chr', contig) AS chr,
 CASE WHEN o_orderkey % 3 = 0 THEN 'dup' ELSE 'del' END AS cnv,
 st AS st_bp, CAST(st + 50 + o_custkey % 700 AS BIGINT) AS ed_bp,
 CAST(100 + o_orderkey * 31 % 5000 AS DOUBLE) AS raw_cov, CAST(200 + o_orderkey * 17 % 5000 AS DOUBLE) AS norm_cov,
 CAST(o_orderkey % 2 AS INT) AS copy_no, CAST(o_orderkey * 37 % 9000 AS DOUBLE) / 100 AS lratio
FROM {CALL_SLOTS}""",
    "fx_ratio_calls": f"""SELECT sample_name, contig AS chromosome,
 CASE WHEN o_orderkey % 3 = 0 THEN 'duplication' ELSE 'deletion' END AS type,
 CAST(1 + o_custkey % 12 AS INT) AS nexons,
 CAST(st + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 25 END AS BIGINT) AS start_bp,
 CAST(st + 50 + o_custkey % 700 AS BIGINT) AS end_bp,
 CAST(o_orderkey * 41 % 9000 AS DOUBLE) / 100 AS bf,
 CAST(30 + o_custkey % 50 AS DOUBLE) / 100 AS reads_ratio
FROM {CALL_SLOTS}""",
    "fx_exons": f"""SELECT concat('ENSG', lpad(CAST({GENE} AS VARCHAR(12)), 6, '0')) AS gene_id,
 concat('GENE', CAST({GENE} % 400 AS VARCHAR(12))) AS gene_name,
 concat('ENST', CAST(p_partkey AS VARCHAR(12))) AS transcript_id, CAST(1 + p_partkey % 4 AS INT) AS exon_number,
 CASE WHEN p_partkey % 5 = 0 THEN 'insdc' WHEN p_partkey % 5 = 1 THEN 'havana'
      WHEN p_partkey % 5 = 2 THEN 'ensembl' ELSE 'ensembl_havana' END AS source,
 CASE WHEN {GENE} % 3 = 0 THEN 'lincRNA' ELSE 'protein_coding' END AS gene_biotype,
 CAST(1 + {GENE} % 10 AS VARCHAR(8)) AS contig,
 CAST(1 + ({GENE} * 7919) % 60000 + (p_partkey % 4) * 200 AS BIGINT) AS start_bp,
 CAST(1 + ({GENE} * 7919) % 60000 + (p_partkey % 4) * 200 + 20 + p_size * 2 AS BIGINT) AS end_bp
FROM part""",
    "fx_genes": """SELECT gene_id, gene_name, gene_biotype, contig, min(start_bp) AS start_bp, max(end_bp) AS end_bp
FROM fx_exons GROUP BY gene_id, gene_name, gene_biotype, contig""",
    "fx_pli": """SELECT concat('GENE', CAST(c_custkey % 400 AS VARCHAR(12))) AS gene,
 CAST(max(c_custkey) * 7 % 1000 AS DOUBLE) / 1000 AS pli, CAST(max(c_custkey) * 13 % 1000 AS DOUBLE) / 1000 AS prec
FROM customer GROUP BY c_custkey % 400""",
    "fx_hi": """SELECT concat(concat('GENE', CAST(s_suppkey * 3 % 400 AS VARCHAR(12))), '|',
 CAST(CAST(s_suppkey * 11 % 1000 AS DOUBLE) / 1000 AS VARCHAR(24)), '|', CAST(s_suppkey % 100 AS VARCHAR(8)), '%') AS name_field
FROM supplier""",
    "fx_panel": "SELECT concat('GENE', CAST(n_nationkey * 16 AS VARCHAR(12))) AS symbol FROM nation",
    "fx_manifest": """SELECT concat('S', lpad(CAST(c_custkey % 26 AS VARCHAR(8)), 2, '0')) AS sample_name,
 CASE WHEN c_custkey % 26 < 13 THEN 'projA' ELSE 'projB' END AS sample_project_name,
 (c_custkey % 26 IN (3, 17)) AS paired_reads_exclude
FROM customer""",
    "fx_common_cnvs": """SELECT concat('CNVR', CAST(p_partkey AS VARCHAR(12))) AS name, CAST(1 + p_partkey % 10 AS VARCHAR(8)) AS contig,
 CAST(1 + (p_partkey * 6007) % 60000 AS BIGINT) AS start_bp, CAST(1 + (p_partkey * 6007) % 60000 + 100 + p_size * 20 AS BIGINT) AS end_bp
FROM part""",
    # Two capture kits; the label stands in for a cluster of the grouping step.
    "fx_clusters": """SELECT sample_name, CAST(CASE WHEN sample_name < 'S12' THEN 0 ELSE 1 END AS INT) AS label
FROM (SELECT DISTINCT sample_name FROM fx_reads) s""",
    # The last embedding label stands in for the samples no cluster took.
    "fx_points": """SELECT vec_id AS sample_id, embedding, CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS INT) AS label
FROM embeddings""",
}


def referenced(sql: str, names) -> set[str]:
    return set(re.findall(r"\b\w+\b", sql)) & set(names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame; Catalyst prunes its columns like those of any other query."""
    sql = VIEWS[name]
    for needed in sorted(referenced(sql, VIEWS)):
        view(spark, sf_dir, needed).createOrReplaceTempView(needed)
    for needed in sorted(referenced(sql, TABLES)):
        table(spark, sf_dir, needed).createOrReplaceTempView(needed)
    return spark.sql(sql)
