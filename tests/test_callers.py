"""Both callers against brute force, and on the planted deletion."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.queries import COVERAGE, QUERIES, labelled, qc_passed
from copyloom.fixtures import view
from copyloom.operators import poisson_caller as pc
from copyloom.operators import ratio_caller as rc
from copyloom.plans import pipeline
from copyloom.session import cut

# Both callers' calls over the middle tables. Only the one on S05 and contig 4 is planted; caller B's others are single
# or neighbouring regions with low counts whose scores lie between 5.5 and 7.3, just above the floor.
COHORT_CALLS = [
    ("poisson", "S03", "2", 42301, 42497, "dup"),
    ("poisson", "S05", "4", 3901, 49011, "del"),
    ("poisson", "S06", "9", 53401, 56536, "dup"),
    ("poisson", "S15", "6", 37501, 37645, "del"),
    ("poisson", "S17", "4", 42901, 42991, "dup"),
    ("poisson", "S18", "8", 41101, 41149, "dup"),
    ("ratio", "S05", "4", 901, 58041, "del"),
]


def test_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    moves = rc.switching(1e-2)
    for _ in range(20):
        ll = rng.normal(scale=4, size=(7, 3))

        def value(path):
            return sum(moves[a, b] + ll[i, b] for i, (a, b) in enumerate(zip((0, *path), path)))

        best = max(itertools.product(range(3), repeat=7), key=value)
        assert tuple(rc.best_path(ll, moves, 0)) == best
        scores = rc.chunk_scores(ll, moves)
        assert np.isclose(scores[0].max(), value(best))


def test_bound_states_of_a_thousand_chunks(spark):
    rng = np.random.default_rng(9)
    size, rows, expected = len(rc.STATES), [], {}
    for chain, count in (("one", 1), ("two", 2), ("many", 1000), ("gaps", 700)):
        tables = rng.integers(-9, 9, size=(count, size, size)).astype(float)  # with ties
        chunks = sorted(rng.choice(1000, size=count, replace=False).tolist()) if chain == "gaps" else list(range(count))
        rows += [(chain, c, t.ravel().tolist()) for c, t in zip(chunks, tables, strict=True)]
        best = np.array([0.0] + [-np.inf] * (size - 1))
        for t in tables:
            best = (best[:, None] + t).max(axis=0)
        expected[chain] = (chunks, tables, best.max())
    scored = spark.createDataFrame(rows, "chain string, chunk long, scores array<double>")
    found = rc.bound_states(scored, ["chain"]).orderBy("chain", "chunk").collect()
    for chain, (chunks, tables, best) in expected.items():
        mine = [r for r in found if r.chain == chain]
        assert [r.chunk for r in mine] == chunks and mine[0].entry_state == 0
        assert all(a.leave_state == b.entry_state for a, b in zip(mine, mine[1:]))
        assert sum(t[r.entry_state, r.leave_state] for r, t in zip(mine, tables, strict=True)) == best


def test_chunked_paths_equal_whole_chains(spark):
    rng = np.random.default_rng(7)
    rows = []
    for sample in ("S1", "S2"):
        state = np.repeat(rng.integers(0, 3, size=12), rng.integers(3, 15, size=12))
        for i, s in enumerate(state):
            ll = rng.normal(scale=2.0, size=3)
            ll[s] += 4
            rows.append((sample, "A", i, 100 * i, 100 * i + 50, *map(float, ll)))
    names = [f"ll_{s}" for s in rc.STATES]
    schema = "sample_name string, contig string, ord long, start_bp long, end_bp long, " + ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame(rows, schema)
    whole = pd.DataFrame(rows, columns=["sample_name", "contig", "ord", "start_bp", "end_bp", *names])
    expected = []
    for sample, part in whole.groupby("sample_name"):
        path = rc.best_path(part[names].to_numpy(), rc.switching(1e-3), 0)
        for state, run in itertools.groupby(range(len(path)), key=lambda i: path[i]):
            run = list(run)
            expected.append((sample, int(state), run[0], run[-1], len(run), round(part["ll_deletion"].iloc[run].sum(), 6)))
    for chunk in (5, 16, 10_000):
        found = rc.most_likely_paths(df, ["sample_name", "contig"], names, 1e-3, chunk).collect()
        assert sorted(
            (x.sample_name, x.state, x.first_ord, x.last_ord, x.nexons, round(x.ll_deletion, 6)) for x in found
        ) == sorted(expected)


def test_state_segments_do_not_depend_on_chunks(spark, middle):
    df = cut(
        rc.positioned(rc.state_likelihoods(rc.leave_one_out(labelled(spark, middle))), view(spark, middle, "fx_targets"))
        .withColumn("state", rc.most_likely_state())
    )
    forms = [
        sorted(map(tuple, rc.state_segments(df, rc.SEGMENT_KEYS, ["observed"], chunk).collect())) for chunk in (3, 7, 4096)
    ]
    assert forms[0] == forms[1] == forms[2]


def test_reference_choice_in_blocks(spark, middle, monkeypatch):
    counts = cut(labelled(spark, middle).select("label", "sample_name", "region_id", "n"))
    one = sorted(map(tuple, rc.select_references(counts).select("sample_name", "m", F.round("score", 6), "refs").collect()))
    monkeypatch.setattr(rc, "CASE_BLOCK", 5)
    monkeypatch.setattr(rc, "REGION_BLOCK", 64)
    many = sorted(map(tuple, rc.select_references(counts).select("sample_name", "m", F.round("score", 6), "refs").collect()))
    assert one == many
    chosen = {name: refs for name, _, _, refs in one}
    totals = rc.reference_totals(counts, rc.select_references(counts)).toPandas()
    wide = counts.toPandas().pivot(index="region_id", columns="sample_name", values="n")
    assert len(totals) == 4800
    for name, part in totals.groupby("sample_name"):
        part = part.set_index("region_id").sort_index()
        assert (part.n == wide[name]).all() and (part.ref_n == wide[chosen[name]].sum(axis=1)).all()


def test_choice_uses_all_regions_unless_asked(spark):
    counts = spark.range(1000).selectExpr("2 * id + 1 AS region_id", "0 AS label", "'S' AS sample_name", "1L AS n")
    assert rc.thinned(counts, 300).count() == 250 and rc.thinned(counts, 1000).count() == 1000


def test_whole_contig_bayes_factor_of_the_planted_deletion(spark, middle):
    others = rc.leave_one_out(labelled(spark, middle)).where("label = 0")
    ll = rc.positioned(rc.state_likelihoods(others), view(spark, middle, "fx_targets"))
    bf = (
        ll.groupBy("sample_name", "contig")
        .agg((F.sum(F.col("ll_deletion") - F.col("ll_normal")) / math.log(10)).alias("bf"))
        .toPandas()
        .sort_values("bf", ascending=False)
    )
    top, second = bf.iloc[0], bf.iloc[1]
    assert (top.sample_name, top.contig) == ("S05", "4") and round(top.bf, 1) == 14.4 and round(second.bf, 1) == -6.3


def test_caller_a_finds_the_planted_deletion_only(spark, middle):
    calls = QUERIES["call_read_ratio"](spark, middle).collect()
    assert [(c.sample_name, c.chromosome, c.type, c.nexons) for c in calls] == [("S05", "4", "deletion", 20)]
    counts = cut(labelled(spark, middle))
    with_refs = cut(rc.leave_one_out(counts))
    targets = view(spark, middle, "fx_targets")
    one = rc.call_read_ratio(with_refs, targets, samples=["S05"]).collect()
    every = rc.call_read_ratio(with_refs, targets, chunk=7).where("sample_name = 'S05'").collect()
    assert [c[:6] for c in one] == [c[:6] for c in every] and len(one) == 1


def brute_windows(n, expected, lmax):
    out = []
    for i in range(len(n)):
        for j in range(i, min(len(n), i + lmax)):
            y, l = float(sum(n[i : j + 1])), float(sum(expected[i : j + 1]))
            if round(2 * y / l) != 2:
                out.append(((y * math.log(y / l) if y else 0.0) - (y - l), i, j))
    return out


def test_scan_and_greedy_choice_against_all_windows(spark):
    rng = np.random.default_rng(11)
    rows, chains = [], {}
    for sample in ("S1", "S2", "S3"):
        expected = rng.uniform(4, 12, size=60)
        ratio = np.ones(60)
        ratio[10:22] = 0.4
        ratio[23:26] = 1.9
        ratio[50:53] = 0.0
        n = rng.poisson(expected * ratio)
        chains[sample] = (n, expected)
        rows += [(0, sample, "A", i, i, 100 * i, 100 * i + 60, int(n[i]), float(expected[i])) for i in range(60)]
    schema = "label int, sample_name string, contig string, region_id long, ord long, start_bp long, end_bp long, n long, expected double"
    df = spark.createDataFrame(rows, schema)
    for chunk in (8, 25, 1000):
        found = pc.scan_windows(df, lmax=20, chunk=chunk).toPandas()
        for sample, (n, expected) in chains.items():
            windows = brute_windows(n, expected, 20)
            mine = found[found.sample_name == sample].set_index("st_ord")
            for start in range(60):
                best = max((w for w in windows if w[1] == start), default=None)
                assert (best is None) == (start not in mine.index)
                if best:
                    assert np.isclose(mine.lratio[start], best[0]) and mine.ed_ord[start] == best[2]
        picked = pc.call_poisson_scan(df, lmax=20, chunk=chunk).toPandas()
        for sample, (n, expected) in chains.items():
            left, greedy = sorted(brute_windows(n, expected, 20), key=lambda w: (-w[0], w[1])), []
            while left and left[0][0] >= pc.MIN_LRATIO:
                top = left[0]
                greedy.append(top)
                left = [w for w in left if w[2] < top[1] or w[1] > top[2]]
            scores = np.array([w[0] for w in greedy])
            bic = pc.modified_bic(np.array([w[1] for w in greedy]), np.array([w[2] for w in greedy]), scores, 60)
            kept = greedy[: int(bic.argmax())]
            mine = picked[picked.sample_name == sample]
            assert sorted(zip(mine.st_exon - 1, mine.ed_exon - 1)) == sorted((w[1], w[2]) for w in kept)


def greedy_choice(n, expected, lmax, least):
    left, out = sorted(brute_windows(n, expected, lmax), key=lambda w: (-w[0], w[1], w[2])), []
    while left and left[0][0] >= least:
        top = left[0]
        out.append((top[1], top[2]))
        left = [w for w in left if w[2] < top[1] or w[1] > top[2]]
    return sorted(out)


def test_rounds_of_picks_equal_the_greedy_choice(spark):
    rng = np.random.default_rng(21)
    rows, chains = [], {}
    for sample, copies in (("whole", 0.5), ("gain", 1.5), ("mixed", None), ("none", 1.0), ("ties", 0.0)):
        expected = rng.uniform(4, 12, size=150) if sample != "ties" else np.full(150, 8.0)
        ratio = np.repeat(rng.choice([0.0, 0.5, 1.0, 1.5, 2.5], size=30), 5) if copies is None else np.full(150, copies)
        n = rng.poisson(expected * ratio)
        chains[sample] = (n, expected)
        rows += [(0, sample, "A", i, i, 100 * i, 100 * i + 60, int(n[i]), float(expected[i])) for i in range(150)]
    schema = "label int, sample_name string, contig string, region_id long, ord long, start_bp long, end_bp long, n long, expected double"
    df = cut(spark.createDataFrame(rows, schema))
    wanted = {sample: greedy_choice(n, e, 12, 3.0) for sample, (n, e) in chains.items()}
    assert len(wanted["whole"]) > 5 and len(wanted["mixed"]) > 5
    # Chunks shorter than a window, of some windows, and of a whole chain.
    for chunk in (8, 40, 1000):
        found = pc.pick_windows(df, lmax=12, least=3.0, chunk=chunk).toPandas()
        for sample in chains:
            mine = found[found.sample_name == sample]
            assert sorted(zip(mine.st_ord, mine.ed_ord)) == wanted[sample], (sample, chunk)


def test_no_window_to_pick(spark):
    schema = "label int, sample_name string, contig string, region_id long, ord long, start_bp long, end_bp long, n long, expected double"
    assert pc.call_poisson_scan(spark.createDataFrame([], schema)).count() == 0
    assert pc.call_poisson_scan(spark.createDataFrame([(0, "S", "1", 1, 0, 1, 9, 8, 8.0)], schema)).count() == 0


def test_caller_b_finds_the_planted_deletion(spark, middle):
    calls = QUERIES["call_poisson_scan"](spark, middle).toPandas()
    best = calls.sort_values("lratio", ascending=False).iloc[0]
    assert (best.sample_name, best.chr, best.cnv, best.copy_no) == ("S05", "4", "del", 1)


def test_size_factors_and_null_model_against_numpy(spark, middle):
    passed, factors = qc_passed(spark, middle)
    rows = passed.toPandas()
    found = factors.toPandas().set_index(["label", "sample_name"]).size_factor
    k0 = pc.expected_k0(passed, factors).toPandas()
    for label, part in rows.groupby("label"):
        wide = part.pivot(index="region_id", columns="sample_name", values="n")
        nonzero = wide[(wide > 0).all(axis=1)]
        n = (nonzero.div(np.exp(np.log(nonzero).mean(axis=1)), axis=0)).median()
        assert np.allclose(found[label].reindex(n.index), n)
        effect = wide.div(n, axis=1).median(axis=1)
        mine = k0[k0.label == label].set_index(["region_id", "sample_name"])
        base = wide.mul(0).add(n, axis=1).mul(effect, axis=0)
        for (region, sample), row in list(mine.iterrows())[:50]:
            assert np.isclose(row.base, base.loc[region, sample])


def test_latent_factors_against_numpy(spark, middle):
    passed, factors = qc_passed(spark, middle)
    k0 = cut(pc.expected_k0(passed, factors))
    models = pc.latent_models(k0, (0, 1, 3)).toPandas()
    bic, lone = {}, 0
    for (label, contig), part in models.groupby(["label", "contig"]):
        part = part.assign(residual=np.log((part.n + 0.5) / (part.expected + 0.5)))
        wide = part.pivot(index="sample_name", columns="region_id", values="residual")
        u, s, v = np.linalg.svd(wide.to_numpy(), full_matrices=False)
        shared = (u**2).max(axis=0) <= pc.LONE_SHARE
        lone += int((~shared[:3]).sum())
        start = part.pivot(index="sample_name", columns="region_id", values="expected").to_numpy()
        n = part.pivot(index="sample_name", columns="region_id", values="n").to_numpy()
        for i, k in enumerate((0, 1, 3)):
            fitted = start * np.exp((u[:, :k] * (s * shared)[:k]) @ v[:k])
            mine = part.assign(x=[m[i] for m in part.models]).pivot(index="sample_name", columns="region_id", values="x")
            assert np.allclose(mine.to_numpy(), fitted, rtol=1e-6)
            bic[label, contig, k] = 2 * (n * np.log(fitted) - fitted).sum() - k * sum(n.shape) * np.log(n.size)
    assert lone > 0
    found = pc.latent_bic(pc.latent_models(k0, (0, 1, 3)), (0, 1, 3)).toPandas()
    assert len(found) == len(bic)
    for row in found.itertuples():
        assert np.isclose(row.bic, bic[row.label, row.contig, row.k])
    chosen = pc.expected_counts(k0, (0, 1, 3)).select("label", "contig", "k").distinct().collect()
    for row in chosen:
        assert row.k == max((0, 1, 3), key=lambda k: (round(bic[row.label, row.contig, k], 6), -k))


@pytest.mark.parametrize(("raw", "expected", "copies"), [(5, 4.0, 2), (3, 4.0, 2), (0, 4.0, 0), (8, 4.0, 4), (13, 4.0, 6)])
def test_copy_number_halves_to_even(spark, raw, expected, copies):
    row = spark.range(1).select(pc.copy_number(F.lit(raw), F.lit(expected)).alias("c")).first()
    assert row.c == copies


def test_registered_chain_reports_the_planted_deletion(spark, middle):
    calls = QUERIES["cohort_calls"](spark, middle).toPandas()
    s05 = calls[(calls.sample_name == "S05") & (calls.contig == "4")]
    assert set(s05.caller) == {"ratio", "poisson"} and set(s05.kind) == {"del"}
    assert sorted(map(tuple, calls.itertuples(index=False))) == COHORT_CALLS


def test_reads_to_gene_table_has_the_genes_of_the_deletions(spark, middle):
    table = QUERIES["reads_to_gene_table"](spark, middle).toPandas()
    exons = view(spark, middle, "fx_exons").where("source IN ('ensembl', 'ensembl_havana', 'havana')").toPandas()
    expected = set()
    for _, sample, contig, start, end, kind in COHORT_CALLS:
        if kind == "del":
            hit = exons[(exons.contig == contig) & (exons.start_bp <= end) & (exons.end_bp >= start)]
            expected |= {(sample, gene) for gene in hit.gene_id}
    assert len(expected) > 10
    assert set(zip(table.sample_name, table.gene_id)) == expected


def test_calls_of_clusters_only(spark, middle):
    calls = QUERIES["cohort_calls_clusters_only"](spark, middle).toPandas()
    labels = QUERIES["batch_samples"](spark, middle).toPandas()
    assert set(calls.sample_name) <= set(labels[labels.label >= 0].sample_name)
    # The sample with the planted deletion is the one that no cluster took.
    assert labels[labels.label < 0].sample_name.tolist() == ["S05"] and len(calls) > 0


def test_chain_reports_failed_samples_and_annotates(spark, middle):
    found = pipeline.cohort_calls(
        view(spark, middle, "fx_targets"),
        view(spark, middle, "fx_reads"),
        min_mean_rc=8.9,
        min_cluster_size=4,
        coverage=COVERAGE,
        common=view(spark, middle, "fx_common_cnvs"),
    )
    failed, labels = found.failed.toPandas(), found.labels.toPandas()
    assert len(failed) > 0 and len(failed) + len(labels) == 24 and (failed.mean_rc <= 8.9).all()
    assert {"start_p", "end_p", "id", "common_cnv", "exon_names"} <= set(found.ratio.columns)
    assert not set(found.ratio.toPandas().sample_name) & set(failed.sample_name)


def test_one_case_equals_its_part_of_all_cases(spark, middle):
    counts, targets = cut(labelled(spark, middle)), view(spark, middle, "fx_targets")
    with_refs = cut(rc.reference_totals(counts, rc.select_references(counts)))
    every = rc.call_read_ratio(with_refs, targets).where("sample_name = 'S05'").collect()
    assert pipeline.one_case(targets, counts, "S05").collect() == every and every


def test_caller_b_leaves_sex_chromosomes_out(spark, middle):
    targets = view(spark, middle, "fx_targets").withColumn("contig", F.when(F.col("contig") == "4", "X").otherwise(F.col("contig")))
    reads = view(spark, middle, "fx_reads").withColumn("contig", F.when(F.col("contig") == "4", "X").otherwise(F.col("contig")))
    found = pipeline.cohort_calls(targets, reads, min_mean_rc=4, min_cluster_size=8, coverage=COVERAGE, include_likely=True)
    assert "X" not in set(found.poisson.toPandas().chr) and "X" in set(found.ratio.toPandas().chromosome)


def test_one_sample_carries_no_factor(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(10):
        for r in range(60):
            copies = 0.5 if s == 2 and 20 <= r < 40 else 1.0
            rows.append((0, f"S{s}", r, "1", 100 * r, 100 * r + 50, int(rng.poisson(200 * copies)), 200.0))
    schema = "label int, sample_name string, region_id long, contig string, start_bp long, end_bp long, n long, expected double"
    expected = pc.expected_counts(spark.createDataFrame(rows, schema), (1, 2))
    calls = pc.call_poisson_scan(pc.chains(expected)).toPandas()
    assert [(c.sample_name, c.cnv) for c in calls.itertuples()] == [("S2", "del")]
    assert abs(calls.st_exon[0] - 21) <= 1 and abs(calls.ed_exon[0] - 40) <= 1


def test_correlation_of_cases_alone_is_that_of_all(spark, middle):
    counts = cut(labelled(spark, middle))
    # One sample lacks regions, one is constant.
    counts = cut(counts.where("sample_name <> 'S03' OR region_id % 3 <> 0").withColumn("n", F.when(F.col("sample_name") == "S07", 5).otherwise(F.col("n"))))
    names = ["S03", "S05", "S07", "S15", "none"]
    found = {r.sample_name: r for r in rc.case_correlation(counts, names).collect()}
    whole = {r.sample_name: r for r in rc.sample_correlation(counts).collect()}
    assert found.keys() == set(names[:-1])
    for name, row in found.items():
        assert row.label == whole[name].label and row.partners == whole[name].partners
        np.testing.assert_array_equal(np.array(row.corrs), np.array(whole[name].corrs, dtype=float))
    assert sorted(rc.select_references(counts, samples=["S05"]).collect()) == [r for r in sorted(rc.select_references(counts).collect()) if r.sample_name == "S05"]
