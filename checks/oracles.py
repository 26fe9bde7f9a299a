"""DuckDB statements the Spark queries are compared with, on the same Parquet tables."""

from __future__ import annotations

import re

from copyloom.fixtures import VIEWS, referenced
from copyloom.operators.annotate import POISSON_COLUMNS, RATIO_COLUMNS

# Named steps, in dependency order; a statement takes the ones it refers to.
STEPS: dict[str, str] = dict(VIEWS)


def r6(expression: str) -> str:
    return f"(floor(({expression}) * 1e6 + 0.5) / 1e6)"


def plain(number: str) -> str:
    """A whole number without a point."""
    return f"CASE WHEN {number} = floor({number}) THEN CAST(CAST({number} AS BIGINT) AS VARCHAR) ELSE CAST({number} AS VARCHAR) END"


LABEL_TEXT = "concat({0}, ':', CAST({1} AS VARCHAR), '-', CAST({2} AS VARCHAR))"
CALL_ID = LABEL_TEXT.format("contig", "start_bp", "end_bp")
OVERLAP = "a.contig = b.contig AND a.start_bp <= b.end_bp AND b.start_bp <= a.end_bp"
CURATED = "source IN ('ensembl', 'ensembl_havana', 'havana')"
MIN_MEAN = 8
NEIGHBOURS = 8
MIN_CLUSTER = 8
LMAX = 400

STEPS |= {
    "usable": """SELECT r.* FROM fx_reads r JOIN (SELECT sample_name, bool_or(flag & 64 = 64) AS paired
  FROM fx_reads WHERE flag & 1540 = 0 GROUP BY sample_name) s ON r.sample_name = s.sample_name
WHERE flag & 1540 = 0 AND (NOT paired OR flag & 64 = 64)""",
    "hits": """SELECT r.sample_name, t.region_id, count(*) AS n FROM usable r JOIN fx_targets t
  ON r.contig = t.contig AND r.pos <= t.end_bp AND t.start_bp <= r.pos + r.qwidth - 1
WHERE r.mapq >= 20 GROUP BY r.sample_name, t.region_id""",
    "counts": """SELECT s.sample_name, t.region_id, CAST(coalesce(h.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT sample_name FROM fx_reads) s CROSS JOIN fx_targets t
LEFT JOIN hits h ON h.sample_name = s.sample_name AND h.region_id = t.region_id""",
    "labelled": "SELECT c.sample_name, c.region_id, c.n, l.label FROM counts c JOIN fx_clusters l ON c.sample_name = l.sample_name",
    "coverage": "SELECT sample_name, CAST(sum(n) AS BIGINT) AS sum_rc, avg(n) AS mean_rc FROM counts GROUP BY sample_name",
    "scaled": """SELECT sample_name, region_id, n * CAST(1000 AS DOUBLE) / total AS v FROM (
  SELECT *, sum(n) OVER (PARTITION BY sample_name) AS total, max(n) OVER (PARTITION BY region_id) AS most FROM counts) c
WHERE most > 0 AND total > 0""",
    "zscored": """SELECT sample_name, region_id, CASE WHEN sd > 1e-12 THEN (v - m) / sd ELSE CAST(0 AS DOUBLE) END AS z FROM (
  SELECT *, avg(v) OVER (PARTITION BY region_id) AS m, stddev_pop(v) OVER (PARTITION BY region_id) AS sd FROM scaled) p""",
    "poisson_calls": """SELECT sample_name, regexp_replace(chr, 'chr', '') AS contig, cnv, st_bp AS start_bp, ed_bp AS end_bp,
  raw_cov, norm_cov, copy_no, lratio FROM fx_poisson_calls""",
    "ratio_calls": """SELECT sample_name, regexp_replace(chromosome, 'chr', '') AS contig, type, nexons, start_bp, end_bp, bf, reads_ratio
FROM fx_ratio_calls""",
    "poisson_labels": f"""SELECT sample_name, contig, start_bp, end_bp, concat_ws('|', {CALL_ID}, cnv,
  {plain("((end_bp - start_bp) / 1000)")}, {plain("raw_cov")}, {plain("norm_cov")},
  CAST(copy_no AS VARCHAR), {plain("lratio")}, 'NA') AS label FROM poisson_calls""",
    "ratio_labels": f"""SELECT sample_name, contig, start_bp, end_bp, concat_ws('|', {CALL_ID}, substring(type, 1, 3),
  {plain("((end_bp - start_bp) / 1000)")}, 'NA', 'NA', {plain("reads_ratio")}, {plain("bf")},
  CAST(nexons AS VARCHAR), 'NA') AS label FROM ratio_calls""",
    "cuts": """SELECT sample_name, contig, start_bp AS cut_bp FROM poisson_calls UNION SELECT sample_name, contig, end_bp FROM poisson_calls
UNION SELECT sample_name, contig, start_bp FROM ratio_calls UNION SELECT sample_name, contig, end_bp FROM ratio_calls""",
    "elementary": """SELECT sample_name, contig, cut_bp AS start_bp,
  lead(cut_bp) OVER (PARTITION BY sample_name, contig ORDER BY cut_bp) AS end_bp FROM cuts""",
    "segments": """SELECT e.sample_name, e.contig, e.start_bp, e.end_bp, a.label AS label_a, b.label AS label_b FROM elementary e
LEFT JOIN poisson_labels a ON a.sample_name = e.sample_name AND a.contig = e.contig AND a.start_bp < e.end_bp AND e.start_bp < a.end_bp
LEFT JOIN ratio_labels b ON b.sample_name = e.sample_name AND b.contig = e.contig AND b.start_bp < e.end_bp AND e.start_bp < b.end_bp
WHERE e.end_bp IS NOT NULL AND (a.label IS NOT NULL OR b.label IS NOT NULL)""",
    "curated": f"SELECT * FROM fx_exons WHERE {CURATED}",
    "hits_poisson": f"""SELECT b.sample_name, {LABEL_TEXT.format("b.contig", "b.start_bp", "b.end_bp")} AS call_id, a.gene_id,
  a.transcript_id, a.exon_number, b.lratio, b.copy_no FROM curated a JOIN poisson_calls b ON {OVERLAP} WHERE b.cnv = 'del'""",
    "hits_ratio": f"""SELECT b.sample_name, {LABEL_TEXT.format("b.contig", "b.start_bp", "b.end_bp")} AS call_id, a.gene_id,
  a.transcript_id, a.exon_number, b.bf, b.reads_ratio FROM curated a JOIN ratio_calls b ON {OVERLAP} WHERE b.type = 'deletion'""",
    "genes_poisson": """SELECT DISTINCT sample_name, gene_id, call_id, lratio AS codex_lratio, copy_no AS codex_copy_number
FROM hits_poisson""",
    "genes_ratio": """SELECT DISTINCT sample_name, gene_id, call_id, bf AS exomedepth_bf, reads_ratio AS exomedepth_ratio
FROM hits_ratio""",
    "keys": """SELECT sample_name, gene_id, call_id FROM genes_poisson UNION SELECT sample_name, gene_id, call_id FROM genes_ratio""",
    "merged": """SELECT k.sample_name, k.gene_id, k.call_id, p.codex_lratio, p.codex_copy_number, r.exomedepth_bf, r.exomedepth_ratio,
  g.gene_name, g.gene_biotype FROM keys k
LEFT JOIN genes_poisson p ON p.sample_name = k.sample_name AND p.gene_id = k.gene_id AND p.call_id = k.call_id
LEFT JOIN genes_ratio r ON r.sample_name = k.sample_name AND r.gene_id = k.gene_id AND r.call_id = k.call_id
JOIN fx_genes g ON g.gene_id = k.gene_id""",
    "gene_counts": """SELECT gene_id, gene_name, count(DISTINCT sample_name) AS sample_cnt FROM merged GROUP BY gene_id, gene_name""",
    "hi": """SELECT split_part(name_field, '|', 1) AS gene_name, CAST(split_part(name_field, '|', 2) AS DOUBLE) AS hi_score,
  split_part(name_field, '|', 3) AS pc FROM fx_hi""",
    "scored": """SELECT c.gene_id, c.gene_name, c.sample_cnt, p.pli AS "pLI", p.prec AS "pRec", CAST(NULL AS DOUBLE) AS "pNull",
  CAST(NULL AS DOUBLE) AS oe_lof_upper, h.hi_score FROM gene_counts c
LEFT JOIN fx_pli p ON p.gene = c.gene_name LEFT JOIN hi h ON h.gene_name = c.gene_name""",
    # The flagship keeps only calls of samples that the manifest does not exclude.
    "active": "SELECT DISTINCT sample_name, sample_project_name FROM fx_manifest WHERE NOT paired_reads_exclude",
    "active_names": "SELECT DISTINCT sample_name FROM active",
    "flag_p": "SELECT * FROM genes_poisson WHERE sample_name IN (SELECT sample_name FROM active_names)",
    "flag_r": "SELECT * FROM genes_ratio WHERE sample_name IN (SELECT sample_name FROM active_names)",
    "flag_keys": "SELECT sample_name, gene_id, call_id FROM flag_p UNION SELECT sample_name, gene_id, call_id FROM flag_r",
    "flag_rows": """SELECT k.sample_name, k.gene_id, k.call_id, p.codex_lratio, p.codex_copy_number, r.exomedepth_bf, r.exomedepth_ratio,
  g.gene_name, g.gene_biotype FROM flag_keys k
LEFT JOIN flag_p p ON p.sample_name = k.sample_name AND p.gene_id = k.gene_id AND p.call_id = k.call_id
LEFT JOIN flag_r r ON r.sample_name = k.sample_name AND r.gene_id = k.gene_id AND r.call_id = k.call_id
JOIN fx_genes g ON g.gene_id = k.gene_id""",
    "flag_counts": "SELECT gene_id, gene_name, count(DISTINCT sample_name) AS sample_cnt FROM flag_rows GROUP BY gene_id, gene_name",
    "flag_scored": """SELECT c.gene_id, c.sample_cnt, p.pli, p.prec, h.hi_score,
  c.gene_name IN (SELECT symbol FROM fx_panel) AS in_gene_panel FROM flag_counts c
LEFT JOIN fx_pli p ON p.gene = c.gene_name LEFT JOIN hi h ON h.gene_name = c.gene_name""",
    "flagship": """SELECT r.call_id, r.gene_id, r.gene_name, r.sample_name, s.sample_cnt, s.in_gene_panel, r.codex_lratio,
  r.codex_copy_number, r.exomedepth_bf, r.exomedepth_ratio, s.hi_score, s.pli AS "pLI", s.prec AS "pRec",
  CAST(NULL AS DOUBLE) AS "pNull", CAST(NULL AS DOUBLE) AS oe_lof_upper, r.gene_biotype
FROM flag_rows r LEFT JOIN flag_scored s ON s.gene_id = r.gene_id""",
    "members": """SELECT sample_id, label, unnest(generate_series(0, len(embedding) - 1)) AS dim,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM fx_points""",
    "apart": """SELECT CAST(q.sample_id AS VARCHAR) AS sample_name, m.label, sum(abs(q.v - m.v)) / count(DISTINCT m.sample_id) AS distance
FROM members q JOIN members m ON q.dim = m.dim WHERE q.label = -1 AND m.label <> -1 GROUP BY q.sample_id, m.label""",
    "likely": """SELECT CAST(p.sample_id AS VARCHAR) AS sample_name, p.label,
  CASE WHEN p.label <> -1 THEN p.label ELSE coalesce(a.label, p.label) END AS likely, a.distance FROM fx_points p
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sample_name ORDER BY distance, label) AS nr FROM apart) a
  ON a.sample_name = CAST(p.sample_id AS VARCHAR) AND a.nr = 1""",
    "pair_dots": """SELECT a.sample_name, b.sample_name AS partner, sum(a.z * b.z) AS dot FROM zscored a JOIN zscored b
  ON a.region_id = b.region_id GROUP BY a.sample_name, b.sample_name""",
    "pair_distances": """SELECT d.sample_name, d.partner, floor(sqrt(greatest(a.dot + b.dot - 2 * d.dot, 0)) * 1e9) / 1e9 AS distance
FROM pair_dots d JOIN pair_dots a ON a.sample_name = d.sample_name AND a.partner = d.sample_name
JOIN pair_dots b ON b.sample_name = d.partner AND b.partner = d.partner WHERE d.sample_name <> d.partner""",
    "neighbours": f"""SELECT * FROM (SELECT sample_name, partner AS neighbour, distance,
  CAST(row_number() OVER (PARTITION BY sample_name ORDER BY distance, partner) AS INT) AS rank FROM pair_distances) d
WHERE rank <= {NEIGHBOURS}""",
    "pair_corr": """SELECT a.label, a.sample_name, b.sample_name AS partner, corr(a.n, b.n) AS r FROM labelled a JOIN labelled b
  ON a.label = b.label AND a.region_id = b.region_id GROUP BY a.label, a.sample_name, b.sample_name""",
    "ranked": """SELECT label, sample_name, partner, row_number() OVER (PARTITION BY label, sample_name
  ORDER BY floor(coalesce(r, -2) * 1e9) DESC, partner) AS m FROM pair_corr WHERE sample_name <> partner""",
    "running": """SELECT k.label, k.sample_name, k.region_id, k.n, r.m, sum(o.n) OVER (
  PARTITION BY k.label, k.sample_name, k.region_id ORDER BY r.m) AS ref FROM labelled k
JOIN ranked r ON r.label = k.label AND r.sample_name = k.sample_name
JOIN labelled o ON o.sample_name = r.partner AND o.region_id = k.region_id""",
    "prefixes": """SELECT label, sample_name, m, CAST(sum(n) AS DOUBLE) AS x, CAST(sum(ref) AS DOUBLE) AS ref,
  sum(CASE WHEN n + ref > 0 THEN CAST(n * n AS DOUBLE) / (n + ref) ELSE 0 END) AS x2t,
  CAST(sum(CASE WHEN n + ref > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS used
FROM running GROUP BY label, sample_name, m""",
    "prefix_shares": "SELECT *, x + ref AS t, x / (x + ref) AS p, 0.5 * x / (x + ref) / (1 - x / (x + ref) + 0.5 * x / (x + ref)) AS h FROM prefixes",
    "prefix_scores": """SELECT *, CASE WHEN x > 0 AND ref > 0 THEN t * (h * ln(h / p) + (1 - h) * ln((1 - h) / (1 - p)))
  / greatest(1, (x2t - p * x) / (p * (1 - p)) / greatest(used - 1, 1)) / ln(10) ELSE 0 END AS score FROM prefix_shares""",
    "chosen": """SELECT label, sample_name, m, score FROM (SELECT *, row_number() OVER (
  PARTITION BY label, sample_name ORDER BY score DESC, m) AS nr FROM prefix_scores) s WHERE nr = 1""",
    "chosen_refs": """SELECT c.label, c.sample_name, r.partner, r.m FROM chosen c JOIN ranked r
  ON r.label = c.label AND r.sample_name = c.sample_name AND r.m <= c.m""",
    "with_refs": """SELECT k.label, k.sample_name, k.region_id, k.n, CAST(sum(o.n) AS BIGINT) AS ref_n FROM labelled k
JOIN chosen_refs r ON r.label = k.label AND r.sample_name = k.sample_name
JOIN labelled o ON o.sample_name = r.partner AND o.region_id = k.region_id
GROUP BY k.label, k.sample_name, k.region_id, k.n""",
    "others": """SELECT label, sample_name, region_id, n,
  CAST(sum(n) OVER (PARTITION BY label, region_id) - n AS BIGINT) AS ref_n FROM labelled""",
    "passed_regions": """SELECT l.label, t.region_id, t.contig, t.start_bp, t.end_bp, t.gc FROM (
  SELECT label, region_id, quantile_cont(n, 0.5) AS median_rc FROM labelled GROUP BY label, region_id) l
JOIN fx_targets t ON t.region_id = l.region_id
WHERE median_rc BETWEEN 4 AND 4000 AND t.end_bp - t.start_bp + 1 BETWEEN 20 AND 2000 AND t.mapp >= 0.9 AND t.gc BETWEEN 20 AND 80""",
    "passed": """SELECT k.label, k.sample_name, k.region_id, k.n, p.contig, p.gc FROM labelled k
JOIN passed_regions p ON p.label = k.label AND p.region_id = k.region_id""",
    "size_factors": """SELECT label, sample_name, quantile_cont(ratio, 0.5) AS size_factor FROM (
  SELECT label, sample_name, n / exp(avg(ln(n)) OVER (PARTITION BY label, region_id)) AS ratio
  FROM (SELECT *, min(n) OVER (PARTITION BY label, region_id) AS least FROM passed) p WHERE least > 0) r
GROUP BY label, sample_name""",
    "region_effects": """SELECT p.label, p.region_id, quantile_cont(p.n / f.size_factor, 0.5) AS region_effect FROM passed p
JOIN size_factors f ON f.label = p.label AND f.sample_name = p.sample_name WHERE f.size_factor > 0 GROUP BY p.label, p.region_id""",
    "bases": """SELECT p.*, f.size_factor, e.region_effect, f.size_factor * e.region_effect AS base, floor(p.gc / 5) AS gc_bin FROM passed p
JOIN size_factors f ON f.label = p.label AND f.sample_name = p.sample_name AND f.size_factor > 0
JOIN region_effects e ON e.label = p.label AND e.region_id = p.region_id AND e.region_effect > 0""",
    "gc_effects": """SELECT label, sample_name, gc_bin, quantile_cont(n / base, 0.5) AS effect FROM bases GROUP BY label, sample_name, gc_bin""",
    "expected": """SELECT b.*, CASE WHEN g.effect > 0 THEN g.effect ELSE 1 END AS gc_effect,
  b.base * CASE WHEN g.effect > 0 THEN g.effect ELSE 1 END AS expected FROM bases b
JOIN gc_effects g ON g.label = b.label AND g.sample_name = b.sample_name AND g.gc_bin = b.gc_bin""",
    "mean_ratios": "SELECT label, sum(n) / sum(size_factor) AS mean_ratio FROM expected GROUP BY label",
    "group_fits": """SELECT e.label, count(DISTINCT sample_name) AS s, count(DISTINCT region_id) AS r, count(DISTINCT gc_bin) AS b,
  sum(n * ln(size_factor * mean_ratio) - size_factor * mean_ratio) AS l0, sum(n * ln(base) - base) AS l1,
  sum(n * ln(expected) - expected) AS l2 FROM expected e JOIN mean_ratios m ON m.label = e.label GROUP BY e.label""",
    "bics": """SELECT label, CAST(0 AS INT) AS k, 2 * l0 - s * ln(s * r) AS bic FROM group_fits
UNION ALL SELECT label, CAST(1 AS INT), 2 * l1 - (s + r) * ln(s * r) FROM group_fits
UNION ALL SELECT label, CAST(2 AS INT), 2 * l2 - (s * (b + 1) + r) * ln(s * r) FROM group_fits""",
    "placed": """SELECT label, region_id, row_number() OVER (PARTITION BY label, contig ORDER BY start_bp, end_bp, region_id) - 1 AS ord
FROM passed_regions p WHERE EXISTS (SELECT 1 FROM region_effects e WHERE e.label = p.label AND e.region_id = p.region_id AND e.region_effect > 0)""",
    "sums": """SELECT e.label, e.sample_name, e.contig, e.region_id, p.ord,
  sum(e.n) OVER w AS y, sum(e.expected) OVER w AS l, e.n, e.expected FROM expected e
JOIN placed p ON p.label = e.label AND p.region_id = e.region_id
WINDOW w AS (PARTITION BY e.label, e.sample_name, e.contig ORDER BY p.ord)""",
    "spans": f"""SELECT a.label, a.sample_name, a.contig, a.region_id, a.ord AS st_ord, b.ord AS ed_ord,
  CAST(b.y - a.y + a.n AS DOUBLE) AS raw_cov, b.l - a.l + a.expected AS norm_cov
FROM sums a JOIN sums b ON a.label = b.label AND a.sample_name = b.sample_name AND a.contig = b.contig
  AND b.ord BETWEEN a.ord AND a.ord + {LMAX - 1}""",
    "span_scores": """SELECT *, CASE WHEN raw_cov > 0 THEN raw_cov * ln(raw_cov / norm_cov) ELSE 0 END - (raw_cov - norm_cov) AS lratio
FROM spans WHERE round_even(2 * raw_cov / norm_cov, 0) <> 2""",
    "best_spans": """SELECT label, sample_name, contig, region_id, st_ord, ed_ord, raw_cov, norm_cov, lratio FROM (
  SELECT *, row_number() OVER (PARTITION BY label, sample_name, contig, st_ord ORDER BY lratio DESC, ed_ord) AS nr FROM span_scores) s
WHERE nr = 1""",
}


def likelihoods(source: str) -> str:
    """Log-likelihoods of the three states, from a step with n and ref_n."""
    shifted = "({q} * p / (1 - p + {q} * p))"
    states = ", ".join(
        f"n * ln({shifted.format(q=q)}) + ref_n * ln(1 - {shifted.format(q=q)}) AS ll_{name}"
        for name, q in (("normal", "1e0"), ("deletion", "5e-1"), ("duplication", "1.5e0"))
    )
    return f"""SELECT label, sample_name, region_id, n, ref_n, p * (n + ref_n) AS expected, {states} FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY label, sample_name) AS DOUBLE)
    / sum(n + ref_n) OVER (PARTITION BY label, sample_name) AS p FROM {source}) w WHERE n + ref_n > 0 AND p > 0 AND p < 1"""


STEPS |= {
    "other_ll": likelihoods("others"),
    "chosen_ll": likelihoods("with_refs"),
    "target_ord": """SELECT region_id, contig, start_bp, end_bp,
  row_number() OVER (PARTITION BY contig ORDER BY start_bp, end_bp, region_id) - 1 AS ord FROM fx_targets""",
    "states": """SELECT l.*, t.contig, t.start_bp, t.end_bp, t.ord, CASE WHEN ll_normal >= ll_deletion AND ll_normal >= ll_duplication THEN 0
  WHEN ll_deletion >= ll_duplication THEN 1 ELSE 2 END AS state FROM other_ll l JOIN target_ord t ON t.region_id = l.region_id""",
    "islands": """SELECT *, row_number() OVER (PARTITION BY label, sample_name, contig ORDER BY ord)
  - row_number() OVER (PARTITION BY label, sample_name, contig, state ORDER BY ord) AS island FROM states""",
}

SQL: dict[str, str] = {
    "targets_sorted": """SELECT CAST(row_number() OVER (ORDER BY CASE WHEN n.n_nationkey IS NULL THEN 1 ELSE 0 END, n.n_nationkey DESC,
  t.start_bp, t.end_bp) - 1 AS BIGINT) AS region_id, t.contig, t.start_bp, t.end_bp
FROM fx_targets t LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = t.contig""",
    "counts_roundtrip": "SELECT * FROM counts",
    "counts_labelled": f"""SELECT c.sample_name, {CALL_ID} AS region, c.n FROM counts c JOIN fx_targets t ON t.region_id = c.region_id""",
    "alignments_read": """SELECT sample_name, contig, count(*) AS reads, CAST(sum(pos) AS BIGINT) AS pos_sum,
  CAST(sum(qwidth) AS BIGINT) AS qwidth_sum, CAST(sum(mapq) AS BIGINT) AS mapq_sum, CAST(sum(flag) AS BIGINT) AS flag_sum
FROM fx_reads GROUP BY sample_name, contig""",
    "count_files_read": "SELECT * FROM counts",
    "count_files_reported": """SELECT sample_name, count(*) AS rows, count(*) AS matched, (SELECT count(*) FROM fx_targets) AS targets,
  count(*) = (SELECT count(*) FROM fx_targets) AS complete FROM counts GROUP BY sample_name""",
    "samples_discovered": "SELECT DISTINCT substring(sample_name, 2) AS sample_name FROM counts",
    "manifest_read": "SELECT * FROM fx_manifest",
    "gene_panel_read": "SELECT symbol FROM fx_panel",
    "gene_scores_read": "SELECT gene, pli AS pLI, prec AS pRec, CAST(NULL AS DOUBLE) AS pNull FROM fx_pli",
    "hi_scores_highest": "SELECT gene_name, hi_score, rank() OVER (ORDER BY hi_score DESC NULLS LAST) AS rank FROM hi",
    "poisson_call_files": "SELECT *, (ed_bp - st_bp) / 1000 AS length_kb FROM fx_poisson_calls",
    "ratio_call_files": "SELECT *, CAST(NULL AS VARCHAR) AS common_cnv FROM fx_ratio_calls",
    "cluster_call_files": """SELECT c.sample_name, l.label, c.chr, c.st_bp, c.ed_bp, c.cnv, c.lratio FROM fx_poisson_calls c
JOIN fx_clusters l ON l.sample_name = c.sample_name""",
    "reference_intervals_read": "SELECT contig, start_bp, end_bp, name FROM fx_common_cnvs",
    "gene_table_written": "SELECT * FROM flagship",
    "annotated_written_in_order": f"""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS out_of_order FROM (
  SELECT DISTINCT b.sample_name, b.contig, b.start_bp, b.end_bp FROM poisson_calls b JOIN fx_exons a ON {OVERLAP}) x""",
    "sample_names_parsed": "SELECT c_custkey, c_name AS sample_name FROM customer",
    "gtf_attributes": """SELECT contig, source, start_bp, end_bp, gene_id, gene_name, gene_biotype, transcript_id, exon_number,
  CAST(NULL AS VARCHAR) AS transcript_biotype, CAST(NULL AS VARCHAR) AS ccds_id FROM fx_exons""",
    "hi_scores_parsed": "SELECT * FROM hi",
    "hi_scores_read": "SELECT * FROM hi",
    "canonical_flag": """SELECT e.transcript_id, e.gene_id, CASE WHEN s.s_suppkey IS NOT NULL THEN 'YES' END AS is_canonical
FROM fx_exons e LEFT JOIN supplier s ON e.transcript_id = concat('ENST', CAST(s.s_suppkey AS VARCHAR))""",
    "external_counts_joined": """SELECT g.gene_id, g.gene_name, x.ext_sample_hom_cnt, x.ext_sample_het_cnt FROM fx_genes g
LEFT JOIN (SELECT concat('GENE', CAST(c_custkey % 300 AS VARCHAR)) AS gene_name,
  count(*) FILTER (c_acctbal < 0) AS ext_sample_hom_cnt, count(*) FILTER (c_acctbal >= 0) AS ext_sample_het_cnt
  FROM customer GROUP BY 1) x ON x.gene_name = g.gene_name""",
    "calls_per_sample": """SELECT c.sample_name, l.label, c.chr, c.st_bp, c.ed_bp, c.cnv FROM fx_poisson_calls c
JOIN fx_clusters l ON l.sample_name = c.sample_name AND l.label = c.st_bp % 2""",
    "clusters_exploded": "SELECT label, CAST(sample_id AS VARCHAR) AS sample_name FROM fx_points",
    "sample_stats": f"""SELECT m.sample_name, concat('bams/', m.sample_name, '.bam') AS bam_file, {r6("c.mean_rc")} AS mean_read_count,
  l.label AS cluster_label, l.label AS closest_cluster_label,
  coalesce(k.calls, CASE WHEN l.label IS NOT NULL THEN 0 END) AS "CODEX2_cnv_count"
FROM (SELECT DISTINCT sample_name FROM fx_manifest) m LEFT JOIN coverage c ON c.sample_name = m.sample_name
LEFT JOIN fx_clusters l ON l.sample_name = m.sample_name
LEFT JOIN (SELECT sample_name, count(*) AS calls FROM fx_poisson_calls GROUP BY sample_name) k ON k.sample_name = m.sample_name""",
    "counts_wide": "PIVOT counts ON sample_name USING CAST(sum(n) AS BIGINT) GROUP BY region_id",
    "settled_files": "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00' - INTERVAL 3600 SECOND",
    "usable_reads": """SELECT sample_name, flag, mapq, count(*) AS reads, CAST(sum(pos) AS BIGINT) AS pos_sum FROM usable
GROUP BY sample_name, flag, mapq""",
    "usable_reads_single_end": """SELECT a.sample_name, a.all_reads, u.kept_reads, u.first_mates FROM (
  SELECT sample_name, count(*) AS all_reads FROM fx_reads GROUP BY sample_name) a LEFT JOIN (
  SELECT sample_name, count(*) AS kept_reads, count(*) FILTER (flag & 64 = 64) AS first_mates FROM usable GROUP BY sample_name) u
ON u.sample_name = a.sample_name""",
    "overlap_counts": "SELECT * FROM counts",
    "overlap_counts_sweep": "SELECT * FROM counts",
    "samples_passed": f"SELECT sample_name, sum_rc, {r6('mean_rc')} AS mean_rc FROM coverage WHERE mean_rc > {MIN_MEAN}",
    "samples_failed": f"SELECT sample_name, {r6('mean_rc')} AS mean_rc FROM coverage WHERE NOT mean_rc > {MIN_MEAN}",
    "region_qc": """SELECT t.region_id, t.contig, t.start_bp, t.end_bp, t.gc, t.mapp, c.median_rc, t.end_bp - t.start_bp + 1 AS width,
  c.median_rc BETWEEN 4 AND 4000 AND t.end_bp - t.start_bp + 1 BETWEEN 20 AND 2000 AND t.mapp >= 0.9 AND t.gc BETWEEN 20 AND 80 AS pass
FROM (SELECT region_id, quantile_cont(n, 0.5) AS median_rc FROM counts GROUP BY region_id) c JOIN fx_targets t ON t.region_id = c.region_id""",
    "profiles": f"SELECT sample_name, region_id, {r6('v')} AS v FROM scaled",
    "profiles_zscored": f"SELECT sample_name, region_id, {r6('z')} AS z FROM zscored",
    "library_size_factor": f"""SELECT sample_name, {r6("quantile_cont(ratio, 0.5)")} AS size_factor FROM (
  SELECT sample_name, n / exp(avg(ln(n)) OVER (PARTITION BY region_id)) AS ratio
  FROM (SELECT *, min(n) OVER (PARTITION BY region_id) AS least FROM counts) c WHERE least > 0) r GROUP BY sample_name""",
    "calls_autosomal": """SELECT sample_name, concat('chr', CAST(st_bp % 26 AS VARCHAR)) AS chr, st_bp, ed_bp FROM fx_poisson_calls
WHERE st_bp % 26 BETWEEN 1 AND 22""",
    "deletions": """SELECT sample_name, contig, start_bp, end_bp, 'poisson' AS caller FROM poisson_calls WHERE cnv = 'del'
UNION ALL SELECT sample_name, contig, start_bp, end_bp, 'ratio' FROM ratio_calls WHERE type = 'deletion'""",
    "curated_exons": "SELECT * FROM curated",
    "active_samples": "SELECT * FROM active",
    "first_regions": "SELECT * FROM counts WHERE region_id < 10000",
    "strip_chr": """SELECT sample_name, st_bp, regexp_replace(chr, 'chr', '') AS contig,
  regexp_replace(concat('alt_', chr, '_', chr), 'chr', '') AS first_only FROM fx_poisson_calls""",
    "call_fields": f"""SELECT sample_name, {CALL_ID} AS call_id, (end_bp - start_bp) / 1000 AS length_kb,
  substring(type, 1, 3) AS short_type FROM ratio_calls""",
    "call_labels": "SELECT * FROM poisson_labels UNION ALL SELECT * FROM ratio_labels",
    "contig_prefixed": "SELECT region_id, concat('chr', contig) AS contig, 'GRCh38' AS build FROM fx_targets",
    "gc_percent": f"""SELECT doc_id, gc_count, acgt_count, {r6("gc_count * 100 / nullif(acgt_count, 0)")} AS gc FROM (
  SELECT doc_id, CAST(length(regexp_replace(lower(text), '[^gc]', '', 'g')) AS BIGINT) AS gc_count,
  CAST(length(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS BIGINT) AS acgt_count FROM documents) d""",
    "gc_percent_regions": f"""SELECT region_id, acgt AS bases, {r6("gc * 100 / nullif(acgt, 0)")} AS gc FROM (
  SELECT region_id, CAST(length(regexp_replace(part, '[^gc]', '', 'g')) AS BIGINT) AS gc,
    CAST(length(regexp_replace(part, '[^acgt]', '', 'g')) AS BIGINT) AS acgt FROM (
    SELECT doc_id * 1000 + i AS region_id, lower(substring(text, i * 700 + 1, 700)) AS part FROM (
      SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 700) AS BIGINT))) AS i FROM documents) t) s) d""",
    "mappability": f"""SELECT a.region_id, a.contig, a.start_bp, a.end_bp, {r6("sum(score * shared) / sum(shared)")} AS mean_mapp FROM fx_targets a
LEFT JOIN (SELECT a.region_id, (b.end_bp - b.start_bp) % 100 / 100 AS score,
  least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp) + 1 AS shared FROM fx_targets a JOIN fx_common_cnvs b ON {OVERLAP}) s
ON s.region_id = a.region_id GROUP BY a.region_id, a.contig, a.start_bp, a.end_bp""",
    "exon_hits_poisson": "SELECT * FROM hits_poisson",
    "exon_hits_ratio": "SELECT * FROM hits_ratio",
    "calls_with_genes": f"""SELECT b.sample_name, b.contig, b.start_bp, b.end_bp,
  string_agg(DISTINCT b.cnv, ',' ORDER BY b.cnv) AS copy_type,
  string_agg(DISTINCT CAST(b.copy_no AS VARCHAR), ',' ORDER BY CAST(b.copy_no AS VARCHAR)) AS copy_number,
  string_agg(DISTINCT a.gene_name, ',' ORDER BY a.gene_name) AS gene_names,
  string_agg(DISTINCT a.gene_id, ',' ORDER BY a.gene_id) AS gene_ids
FROM poisson_calls b JOIN fx_exons a ON {OVERLAP} GROUP BY b.sample_name, b.contig, b.start_bp, b.end_bp""",
    "calls_common_variants": f"""SELECT concat(a.sample_name, '/', {LABEL_TEXT.format("a.contig", "a.start_bp", "a.end_bp")}) AS call_key,
  a.contig, a.start_bp, a.end_bp, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS common_cnv FROM ratio_calls a
LEFT JOIN fx_common_cnvs b ON {OVERLAP}
  AND least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp) + 1 >= 0.5 * (a.end_bp - a.start_bp + 1)
GROUP BY a.sample_name, a.contig, a.start_bp, a.end_bp""",
    "calls_exon_names": f"""SELECT concat(a.sample_name, '/', {LABEL_TEXT.format("a.contig", "a.start_bp", "a.end_bp")}) AS call_key,
  a.contig, a.start_bp, a.end_bp, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS exon_names FROM ratio_calls a
LEFT JOIN (SELECT concat(gene_name, '_', CAST(exon_number AS VARCHAR)) AS name, contig, start_bp, end_bp FROM fx_exons) b ON {OVERLAP}
  AND least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp) + 1 >= 0.0001 * (a.end_bp - a.start_bp + 1)
GROUP BY a.sample_name, a.contig, a.start_bp, a.end_bp""",
    "targets_annotated": f"""SELECT region_id, contig, start_bp, end_bp, gc, CASE WHEN EXISTS (
  SELECT 1 FROM fx_common_cnvs b WHERE {OVERLAP}) THEN CAST(0.5 AS DOUBLE) END AS mapp FROM fx_targets a""",
    "gene_calls_merged": "SELECT * FROM merged",
    "gene_counts_scored": "SELECT * FROM scored",
    "gene_panel_flag": "SELECT gene_id, gene_name, gene_name IN (SELECT symbol FROM fx_panel) AS in_gene_panel FROM fx_genes",
    "gene_deletion_table": "SELECT * FROM flagship",
    "gene_deletions_protein_coding": "SELECT * EXCLUDE (gene_biotype) FROM flagship WHERE gene_biotype = 'protein_coding'",
    "calls_for_active_samples": "SELECT * FROM fx_ratio_calls WHERE sample_name IN (SELECT sample_name FROM active)",
    "unprocessed_samples": """SELECT CAST(c_custkey AS VARCHAR) AS sample_name FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    "reference_counts": "SELECT * FROM others",
    "grown_reference_counts": "SELECT * FROM others",
    "grown_correlation": f"SELECT label, sample_name, partner, {r6('r')} AS r FROM pair_corr",
    "noise_distances": f"SELECT sample_name, label, {r6('distance')} AS distance FROM apart",
    "read_length": "SELECT sample_name, round_even(avg(qwidth), 0) AS read_length FROM usable GROUP BY sample_name",
    "sample_coverage": f"SELECT sample_name, sum_rc, {r6('mean_rc')} AS mean_rc FROM coverage",
    "gene_calls_poisson": "SELECT * FROM genes_poisson",
    "gene_calls_ratio": "SELECT * FROM genes_ratio",
    "gene_sample_counts": "SELECT * FROM gene_counts",
    "label_counts": "SELECT label, count(*) AS sample_cnt FROM fx_points GROUP BY label",
    "noise_assigned": f"SELECT sample_name, label, likely, {r6('distance')} AS distance FROM likely",
    "cluster_members": """SELECT label, string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY CAST(sample_id AS VARCHAR)) AS members
FROM fx_points GROUP BY label""",
    "sample_correlation": """SELECT label, sample_name, string_agg(partner, ',' ORDER BY partner) AS partners,
  string_agg(CAST(CAST(floor(r * 1e6 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY partner) AS corrs FROM pair_corr GROUP BY label, sample_name""",
    "union_intervals": "SELECT * FROM segments",
    "call_keys": "SELECT * FROM keys",
    "null_model_bic": f"SELECT label, k, {r6('bic')} AS bic FROM bics",
    "best_k": f"""SELECT label, k, {r6('bic')} AS bic FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY bic DESC, k) AS nr FROM bics) b WHERE nr = 1""",
    "profile_gram": """SELECT sample_name, string_agg(partner, ',' ORDER BY partner) AS partners,
  string_agg(CAST(CAST(floor(dot * 1e6 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY partner) AS dots FROM pair_dots GROUP BY sample_name""",
    "sample_neighbours": f"SELECT sample_name, neighbour, {r6('distance')} AS distance, rank FROM neighbours",
    "batch_samples": f"""WITH RECURSIVE mutual AS (
  SELECT a.sample_name, a.neighbour FROM neighbours a JOIN neighbours b ON a.neighbour = b.sample_name AND b.neighbour = a.sample_name),
reach AS (SELECT DISTINCT sample_name, sample_name AS other FROM neighbours
  UNION SELECT r.sample_name, m.neighbour FROM reach r JOIN mutual m ON m.sample_name = r.other),
roots AS (SELECT sample_name, min(other) AS root FROM reach GROUP BY sample_name),
numbered AS (SELECT root, CAST(row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS INT) AS label FROM roots
  GROUP BY root HAVING count(*) >= {MIN_CLUSTER})
SELECT r.sample_name, coalesce(n.label, -1) AS label FROM roots r LEFT JOIN numbered n ON n.root = r.root""",
    "density_tree": f"""WITH RECURSIVE core AS (SELECT sample_name, max(distance) AS core FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_name ORDER BY distance) AS nr FROM pair_distances) d WHERE nr <= {MIN_CLUSTER} GROUP BY sample_name),
e AS (SELECT *, row_number() OVER (ORDER BY weight, a, b) AS o FROM (
  SELECT p.sample_name AS a, p.partner AS b, greatest(p.distance, x.core, y.core) AS weight FROM pair_distances p
  JOIN core x ON x.sample_name = p.sample_name JOIN core y ON y.sample_name = p.partner WHERE p.sample_name < p.partner) w),
links AS (SELECT o, a AS x, b AS y FROM e UNION ALL SELECT o, b, a FROM e),
reach AS (SELECT o, a AS start, a AS node FROM e UNION SELECT o, b, b FROM e
  UNION SELECT r.o, r.start, f.y FROM reach r JOIN links f ON f.x = r.node AND f.o < r.o),
sizes AS (SELECT o, start, count(*) AS size FROM reach GROUP BY o, start),
tree AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.o = e.o AND r.start = e.a AND r.node = e.b))
SELECT t.a, t.b, {r6('t.weight')} AS weight, row_number() OVER (ORDER BY t.o) - 1 AS rank, least(x.size, y.size) AS smaller,
  greatest(x.size, y.size) AS larger FROM tree t JOIN sizes x ON x.o = t.o AND x.start = t.a JOIN sizes y ON y.o = t.o AND y.start = t.b""",
    "clusters_to_process": """SELECT label, string_agg(sample_name, ',' ORDER BY sample_name) AS members FROM likely WHERE label IN (
  SELECT label FROM likely WHERE sample_name NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events) AND label <> -1
  UNION SELECT likely FROM likely WHERE sample_name NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events) AND likely <> -1)
GROUP BY label""",
    "reference_rank": "SELECT label, sample_name, string_agg(partner, ',' ORDER BY m) AS refs FROM ranked GROUP BY label, sample_name",
    "reference_prefix_sums": f"""SELECT label, sample_name, CAST(m AS INT) AS m, {r6('score')} AS score, CAST(ref AS BIGINT) AS ref_n,
  {r6('x2t')} AS x2t FROM prefix_scores""",
    "select_references": f"""SELECT c.label, c.sample_name, CAST(c.m AS INT) AS m, {r6('c.score')} AS score,
  (SELECT string_agg(r.partner, ',' ORDER BY r.m) FROM chosen_refs r WHERE r.label = c.label AND r.sample_name = c.sample_name) AS refs
FROM chosen c""",
    "state_likelihoods": f"""SELECT label, sample_name, region_id, n, ref_n, {r6('expected')} AS expected, {r6('ll_normal')} AS ll_normal,
  {r6('ll_deletion')} AS ll_deletion, {r6('ll_duplication')} AS ll_duplication FROM other_ll""",
    "state_likelihoods_overdispersed": f"""WITH RECURSIVE s AS (SELECT label, sample_name, region_id, n, ref_n, expected, n + ref_n AS t,
  expected / (n + ref_n) AS p, 20 + 15 * CAST(substr(sample_name, 2, 2) AS DOUBLE) AS s FROM other_ll),
q AS (SELECT s.*, ratio, ratio * p / (1 - p + ratio * p) AS q FROM s, (VALUES (1.0), (0.5), (1.5)) r(ratio)),
l AS (SELECT *, lgamma(n + q * s) - lgamma(q * s) + lgamma(t - n + (1 - q) * s) - lgamma((1 - q) * s) - lgamma(t + s) + lgamma(s) AS ll FROM q)
SELECT label, sample_name, region_id, n, ref_n, {r6('any_value(expected)')} AS expected, {r6('max(ll) FILTER (ratio = 1.0)')} AS ll_normal,
  {r6('max(ll) FILTER (ratio = 0.5)')} AS ll_deletion, {r6('max(ll) FILTER (ratio = 1.5)')} AS ll_duplication
FROM l GROUP BY label, sample_name, region_id, n, ref_n""",
    "state_segments": f"""SELECT label, sample_name, contig, CAST(state AS INT) AS state, min(ord) AS first_ord, max(ord) AS last_ord,
  min(start_bp) AS start_bp, max(end_bp) AS end_bp, count(*) AS nexons, {r6('sum(expected)')} AS expected,
  CAST(sum(n) AS DOUBLE) AS observed FROM islands GROUP BY label, sample_name, contig, state, island""",
    "expected_counts_k0": f"""SELECT label, sample_name, region_id, {r6('region_effect')} AS region_effect, {r6('gc_effect')} AS gc_effect,
  {r6('expected')} AS expected FROM expected""",
    "scan_windows": f"""SELECT label, sample_name, contig, region_id, st_ord, ed_ord, raw_cov, {r6('norm_cov')} AS norm_cov,
  {r6('lratio')} AS lratio FROM best_spans""",
    "best_scan_window": f"""SELECT label, sample_name, contig, st_ord, ed_ord, raw_cov, {r6('norm_cov')} AS norm_cov, {r6('lratio')} AS lratio,
  CAST(round_even(2 * raw_cov / norm_cov, 0) AS INT) AS copy_no FROM (SELECT *, row_number() OVER (
  PARTITION BY label, sample_name, contig ORDER BY lratio DESC, st_ord, ed_ord) AS nr FROM span_scores) s WHERE nr = 1""",
    "copy_number": """SELECT label, sample_name, region_id, CAST(round_even(2 * n / expected, 0) AS INT) AS copy_no FROM expected""",
}


def best_of(a: str, b: str, c: str) -> str:
    """Index of the largest, ties to the first."""
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


STAY, SWITCH = "ln(1 - 2 * 1e-4)", "ln(1e-4)"
# Score of coming from state i to state j, and the columns of one forward step.
MOVES = [[f"f.s{i} + {STAY if i == j else SWITCH}" for i in range(3)] for j in range(3)]
STEP_SCORES = ", ".join(f"greatest({', '.join(MOVES[j])}) + c.ll{j} AS s{j}" for j in range(3))
STEP_BACK = ", ".join(f"{best_of(*MOVES[j])} AS b{j}" for j in range(3))

STEPS |= {
    "chain": """SELECT l.label, l.sample_name, t.contig, t.start_bp, t.end_bp, t.ord, l.n, l.expected,
  ll_normal AS ll0, ll_deletion AS ll1, ll_duplication AS ll2,
  row_number() OVER (PARTITION BY l.label, l.sample_name, t.contig ORDER BY t.ord) AS seq
FROM chosen_ll l JOIN target_ord t ON t.region_id = l.region_id""",
}
SQL["call_read_ratio"] = f"""WITH RECURSIVE forward AS (
  SELECT label, sample_name, contig, seq, {STAY} + ll0 AS s0, {SWITCH} + ll1 AS s1, {SWITCH} + ll2 AS s2, 0 AS b0, 0 AS b1, 0 AS b2
  FROM chain WHERE seq = 1
  UNION ALL SELECT c.label, c.sample_name, c.contig, c.seq, {STEP_SCORES}, {STEP_BACK} FROM forward f
  JOIN chain c ON c.label = f.label AND c.sample_name = f.sample_name AND c.contig = f.contig AND c.seq = f.seq + 1),
path AS (
  SELECT label, sample_name, contig, seq, {best_of('s0', 's1', 's2')} AS state FROM forward f
  WHERE seq = (SELECT max(seq) FROM chain c WHERE c.label = f.label AND c.sample_name = f.sample_name AND c.contig = f.contig)
  UNION ALL SELECT p.label, p.sample_name, p.contig, p.seq - 1, CASE p.state WHEN 0 THEN f.b0 WHEN 1 THEN f.b1 ELSE f.b2 END FROM path p
  JOIN forward f ON f.label = p.label AND f.sample_name = p.sample_name AND f.contig = p.contig AND f.seq = p.seq WHERE p.seq > 1),
runs AS (
  SELECT c.*, p.state, p.seq - row_number() OVER (PARTITION BY c.label, c.sample_name, c.contig, p.state ORDER BY p.seq) AS run FROM path p
  JOIN chain c ON c.label = p.label AND c.sample_name = p.sample_name AND c.contig = p.contig AND c.seq = p.seq)
SELECT sample_name, min(ord) + 1 AS start_p, max(ord) + 1 AS end_p,
  concat('chr', contig, ':', CAST(min(start_bp) AS VARCHAR), '-', CAST(max(end_bp) AS VARCHAR)) AS id,
  CASE state WHEN 1 THEN 'deletion' ELSE 'duplication' END AS type, CAST(count(*) AS INT) AS nexons,
  min(start_bp) AS start_bp, max(end_bp) AS end_bp, contig AS chromosome,
  {r6("sum(CASE state WHEN 1 THEN ll1 ELSE ll2 END - ll0) / ln(10)")} AS bf, {r6("sum(expected)")} AS reads_expected,
  CAST(sum(n) AS BIGINT) AS reads_observed, {r6("sum(n) / sum(expected)")} AS reads_ratio
FROM runs WHERE state > 0 GROUP BY label, sample_name, contig, state, run"""
SQL["call_read_ratio_one_case"] = SQL["call_read_ratio"].replace("WHERE state > 0", "WHERE state > 0 AND sample_name = 'S05'")


FULL_SPLIT = """SELECT s.*, {names}, g.gene_name, CAST(coalesce(g.gene_count, 0) AS BIGINT) AS gene_count,
  CAST(coalesce(g.overlap_bp, 0) AS BIGINT) AS overlap_bp, 'full' AS annotation_mode FROM {source} s LEFT JOIN (
  SELECT segment_id, string_agg(gene_name, ',' ORDER BY gene_name) AS gene_name, count(*) AS gene_count, sum(overlap_bp) AS overlap_bp
  FROM {hits} GROUP BY segment_id) g ON g.segment_id = s.segment_id
UNION ALL SELECT s.*, {names}, h.gene_name, 1, h.overlap_bp, 'split' FROM {source} s JOIN {hits} h ON h.segment_id = s.segment_id"""


def gene_hits(source: str, last: str = "end_bp") -> str:
    return f"""SELECT a.segment_id, b.gene_name, max(least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp) + 1) AS overlap_bp
FROM (SELECT segment_id, contig, start_bp, {last} AS end_bp FROM {source}) a JOIN fx_genes b ON {OVERLAP} GROUP BY a.segment_id, b.gene_name"""


def unpacked(label: str, names: list[str]) -> str:
    return ", ".join(
        f"coalesce(nullif(split_part({label}, '|', {i + 1}), ''), 'NA') AS \"{name}\"" for i, name in enumerate(names)
    )


UNPACKED = f"{unpacked('label_a', POISSON_COLUMNS)}, {unpacked('label_b', RATIO_COLUMNS)}"
STEPS |= {
    "call_segments": f"SELECT concat(sample_name, '/', {CALL_ID}) AS segment_id, contig, start_bp, end_bp FROM poisson_calls",
    "call_gene_hits": gene_hits("call_segments"),
    "piece_segments": f"SELECT *, concat(sample_name, '/', {CALL_ID}) AS segment_id FROM segments",
    "piece_gene_hits": gene_hits("piece_segments", "end_bp - 1"),
}
SQL |= {
    "call_labels_unpacked": f"SELECT sample_name, contig, start_bp, end_bp, {UNPACKED} FROM segments",
    "calls_full_split": FULL_SPLIT.format(source="call_segments", hits="call_gene_hits", names="1 AS one").replace(", 1 AS one", ""),
    "annotated_sample_calls": "SELECT * EXCLUDE (segment_id, label_a, label_b) FROM ("
    + FULL_SPLIT.format(
        source="piece_segments", hits="piece_gene_hits", names=f"{UNPACKED}, (end_bp - start_bp) / 1000 AS length_kb"
    )
    + ") x",
}


SQL |= {
    "region_qc_written": SQL["region_qc"],
    "annotated_written": SQL["calls_with_genes"],
    "sample_stats_written": SQL["sample_stats"],
}


def statement(sql: str) -> str:
    wanted: set[str] = set()
    front = referenced(sql, STEPS)
    while front:
        wanted |= front
        front = set().union(*(referenced(STEPS[name], STEPS) for name in front)) - wanted
    steps = [f"{name} AS (\n{STEPS[name]}\n)" for name in STEPS if name in wanted]
    if not steps:
        return sql
    if re.match(r"\s*WITH RECURSIVE\b", sql):
        return "WITH RECURSIVE " + ",\n".join(steps) + ",\n" + re.sub(r"^\s*WITH RECURSIVE\b", "", sql)
    return "WITH " + ",\n".join(steps) + "\n" + sql


def oracle_sql() -> dict[str, str]:
    return {name: statement(sql) for name, sql in SQL.items()}
