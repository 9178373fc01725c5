"""Operators on tiny literal frames with answers worked out by hand."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitemill.functions import scalar
from sitemill.operators import chains, curate, encoders, evaluate, features, joins, models, splitting
from sitemill.sources import readers, sinks

ATOMS = "pdb_id string, line_no long, group string, comp string, asym string, seq_id int, auth_seq string, auth_asym string"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_keyword_and_list_flags(spark):
    df = spark.createDataFrame([("Human Virus",), ("Homo; some virus",), ("",), (None,)], "o string")
    got = df.select(curate.keyword_flag(F.col("o"), ["VIRUS"]).alias("k"), curate.all_items_match(F.col("o"), ";", ["virus"]).alias("a")).collect()
    assert [r["k"] for r in got] == [True, True, False, None]
    assert [r["a"] for r in got] == [True, False, True, None]  # an empty list matches


def test_split_by_predicate_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, v string")
    yes, no = curate.split_by_predicate(df, F.col("v") == "a")
    assert rows(yes, "i") == [(1,)] and rows(no, "i") == [(2,), (3,)]


def test_forbidden_terms_are_whole_words(spark):
    df = spark.createDataFrame([("a DYE here", None), ("dyed", "x"), (None, "the dye")], "a string, b string")
    assert [r[0] for r in df.select(curate.forbidden_term_flag([F.col("a"), F.col("b")], ["dye"])).collect()] == [True, False, True]


def test_allowed_type_and_waterfall(spark):
    df = spark.createDataFrame([("HETAIN", "NON-POLYMER"), ("?", "non-polymer"), ("hetain", "non-polymer"), ("HETAIN", "peptide")], "k string, c string")
    flag = curate.allowed_type_flag(F.col("k"), F.col("c"), ["HETAIN"], ["Non-Polymer"])
    assert [r[0] for r in df.select(flag).collect()] == [True, True, False, False]
    out = curate.rule_waterfall(df, [(F.col("k") == "?", "type"), (F.col("c") == "peptide", "chem")])
    assert [r["reason"] for r in out.collect()] == [None, "type", None, "chem"]
    assert rows(curate.count_by_reason(out)) == [("chem", 1), ("type", 1)]
    assert curate.review_rows(out, F.col("k") == "hetain").count() == 1


def test_smiles(spark):
    df = spark.createDataFrame([("CC(=O)Nc1ccc(Cl)cc1",), ("[Na+].[Cl-]",), ("[2H]O",), ("[nH]1cccc1",), ("[Se]",)], "s string")
    got = df.select(curate.smiles_elements(F.col("s")), curate.heavy_atom_count(F.col("s")), curate.allowed_elements_flag(F.col("s"))).collect()
    assert [r[0] for r in got] == [["C", "Cl", "N", "O"], ["Cl", "Na"], ["H", "O"], ["C", "N"], ["Se"]]
    assert [r[1] for r in got] == [11, 2, 1, 5, 1]
    assert [r[2] for r in got] == [True, False, True, True, False]


def test_preferred_descriptor(spark):
    kind = "descriptors array<struct<dtype:string,program:string,value:string>>"
    df = spark.createDataFrame([([("SMILES", "CACTVS", "b"), ("SMILES", "OpenEye 2", "a")],), ([("InChI", "x", "i")],)], kind)
    got = df.select(curate.preferred_descriptor(F.col("descriptors"), ["SMILES"], curate.SMILES_PROGRAMS)).collect()
    assert [r[0] for r in got] == ["a", None]


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "C", "i1"), (2, "C", "i2"), (3, "N", "i3"), (4, "N", "i3"), (5, "O", ""), (6, "S", ""), (7, "P", "i7"), (8, "F", "i7")], "id int, smiles string, inchi string")
    kept, removed = curate.resolve_conflicts(df, "id", "smiles", "inchi", "id")
    assert rows(kept, "id") == [(3,), (5,), (6,)] and rows(removed, "id") == [(1,), (2,), (4,), (7,), (8,)]
    assert rows(curate.duplicate_report(df, "inchi")) == [(2, 4, 4, 6)]


def test_resolution_binding_and_blanks(spark):
    df = spark.createDataFrame([(1, "2.5"), (2, "N/A"), (3, "5.0"), (4, "5.1"), (5, None)], "i int, resolution string")
    assert rows(curate.filter_resolution(df), "i") == [(1,), (3,)]
    assert curate.bind_columns(df, ["I", "Resolution"]).columns == ["I", "Resolution"]
    with pytest.raises(ValueError, match="missing columns: chain"):
        curate.bind_columns(df, ["i", "chain"])
    assert rows(curate.drop_blank(spark.createDataFrame([(1, " "), (2, "x"), (3, None)], "i int, v string"), ["v"]), "i") == [(2,)]


def test_solvent_first_model_and_structures(spark):
    a = spark.createDataFrame([("p", 1, "ATOM", "C", "ALA", "1"), ("p", 2, "HETATM", "O", "HOH", "1"), ("p", 3, "ATOM", "H", "ALA", "1"), ("p", 4, "ATOM", "C", "ALA", "2")], "pdb_id string, line_no int, group string, element string, comp string, model string")
    assert rows(curate.drop_solvent_and_hydrogen(a), "line_no") == [(1,), (4,)]
    assert rows(curate.first_model(a), "line_no") == [(1,), (2,), (3,)]


POINT = st.tuples(st.integers(0, 1), *[st.floats(-9, 9, allow_nan=False, width=32)] * 3)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(POINT, min_size=1, max_size=25), st.lists(POINT, min_size=1, max_size=25))
def test_grid_join_is_brute_force(spark, p, q):
    kind = "pdb_id int, x double, y double, z double, i int"
    a = spark.createDataFrame([(*x, i) for i, x in enumerate(p)], kind)
    b = spark.createDataFrame([(*x, i) for i, x in enumerate(q)], kind)
    want = sorted((i, j) for i, x in enumerate(p) for j, y in enumerate(q) if x[0] == y[0] and math.sqrt((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2) <= 4.5)
    assert rows(joins.contacts_within(a, b, 4.5), "p_i", "l_i") == want
    assert rows(joins.atom_pairs(a, b, 4.5).filter("interacting = 1"), "p_i", "l_i") == want


@pytest.mark.parametrize("swap", [False, True])
def test_crowded_cells_are_cut(spark, monkeypatch, swap):
    """A cell of a third of all atoms, cells around it, negative places, atoms on borders: as by brute force, with few far pairs."""
    monkeypatch.setattr(joins, "CROWD", 8)
    draw = np.random.default_rng(5)
    a = np.concatenate([draw.normal(-3.0, 0.7, (400, 3)), draw.uniform(-12, 12, (500, 3)), draw.integers(-3, 3, (60, 3)) * 1.5])
    b = np.concatenate([draw.normal(-3.0, 0.7, (150, 3)), draw.uniform(-12, 12, (100, 3)), draw.integers(-3, 3, (40, 3)) * 1.5])
    frame = lambda x: spark.createDataFrame([(1, *map(float, p), i) for i, p in enumerate(x)] + [(1, None, 0.0, 0.0, -1)], "pdb_id int, x double, y double, z double, i int")
    p, q = (frame(b), frame(a)) if swap else (frame(a), frame(b))
    apart = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    want = {(int(j), int(i)) if swap else (int(i), int(j)) for i, j in zip(*np.nonzero(apart <= 1.5), strict=True)}
    out = joins.contacts_within(p, q, 1.5)
    got = [(r["p_i"], r["l_i"]) for r in out.select("p_i", "l_i").collect()]
    assert set(got) == want and len(got) == len(want)
    cells = joins.crowded_cells(p.select("pdb_id", *[(F.col(c) / 1.5).alias(c) for c in "xyz"]), ["x", "y", "z"], "pdb_id").collect()
    assert cells and max(r["_level"] for r in cells) >= 1


def test_duplicates_of_a_hot_key(spark):
    """Blank and null keys, ties of the order, and a repeated row, which is a duplicate of itself."""
    data = [("i1", "", None, 1), ("i2", "", None, 1), ("i3", "", None, 2), ("i4", "c", "x", 5), ("i5", "c", "x", 4), ("i6", "d", "x", 1), ("i7", "e", "y", 1), ("i7", "e", "y", 1)]
    df = spark.createDataFrame(data, "id string, smiles string, inchi string, n int")
    out = curate.duplicate_ids(df, ["smiles", "inchi"], "n", "id")
    assert sorted(r["id"] for r in out.collect()) == ["i2", "i3", "i4", "i7"]
    assert "Window" not in out._jdf.queryExecution().toString()


def test_patch_lookup_and_sets(spark):
    df = spark.createDataFrame([("a", "unknown"), ("b", "unknown"), ("c", "man")], "k string, o string")
    fix = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], "k string, o string")
    assert rows(joins.patch_unknown(df, fix, ["k"], "o"), "k", "o", "patched") == [("a", "x", True), ("b", "unknown", False), ("c", "man", False)]
    assert rows(joins.lookup(df.select("k"), fix, "k", "o").filter("o is not null")) == [("a", "x"), ("c", "z")]
    with pytest.raises(ValueError, match="one side"):
        joins.require_same_keys(df.select("k"), fix.select("k"))
    assert rows(joins.except_keys(df.select("k"), fix.select("k"))) == [("b", "left")]


def test_check_sequence_and_zip(spark):
    fasta = spark.createDataFrame([("s", "AC"), ("t", "ACD")], "site string, sequence string")
    labels = spark.createDataFrame([("s", 2, "C"), ("s", 1, "A"), ("t", 1, "A"), ("u", 1, "A")], "site string, position int, residue_1l string")
    kept, skipped = joins.check_sequence(labels, fasta, ["site"], ["site"])
    assert rows(kept, "site") == [("s",), ("s",)] and rows(skipped) == [("t",), ("u",)]
    df = spark.createDataFrame([("c", "ACDE", "ALA-CYS-ASP", "5-x-7-8")], "id string, one string, three string, pos string")
    assert rows(joins.zip_residues(df, "one", "three", "pos")) == [("c", 0, "A", "ALA", 5), ("c", 1, "C", "CYS", 7), ("c", 2, "D", "ASP", 8)]


def test_chains_and_modified(spark):
    a = spark.createDataFrame(
        [("p", 1, "ATOM", "GLY", "A", 7, "1", "X"), ("p", 2, "ATOM", "GLY", "A", 7, "1", "X"), ("p", 3, "ATOM", "ALA", "A", 3, "2", "X"), ("p", 4, "HETATM", "MSE", "A", 9, "3", "X"), ("p", 5, "HETATM", "XXX", "A", 10, "4", "X"), ("q", 1, "ATOM", "ALA", "B", 1, "1", "Y")],
        ATOMS,
    )
    got = {r["pdb_id"]: tuple(r)[1:] for r in chains.build_chains(a).select("pdb_id", "sequence_3l", "sequence_1l", "positions", "ligand_id").collect()}
    assert got == {"p": ("GLY-ALA", "GA", "7-3", "MSE,XXX"), "q": ("ALA", "A", "1", curate.NO_LIGAND)}
    mods = spark.createDataFrame([("p", "A", 9, "MSE", "MET"), ("p", "A", 10, "XXX", "YYY")], "pdb_id string, asym string, seq_id int, comp string, parent string")
    out = joins.remap_modified(a, mods, list(scalar.AA3))
    assert rows(out.filter("pdb_id = 'p' and line_no > 3"), "line_no", "group", "comp", "ambiguous") == [(4, "ATOM", "MET", False), (5, "HETATM", "XXX", True)]
    assert rows(chains.filter_ambiguous(out, F.col("ambiguous")).select("pdb_id").distinct()) == [("q",)]
    assert rows(chains.residue_author_map(a).filter("seq_id = 7")) == [("p", "A", 7, "1", "X")]
    kept = chains.filter_structures(a, a.select("pdb_id", "asym"), spark.createDataFrame([("MSE",)], "comp string"))
    assert rows(kept, "pdb_id", "line_no") == [("p", 1), ("p", 2), ("p", 3), ("p", 4), ("q", 1)]


def test_patterns(spark):
    labels = spark.createDataFrame([("s", 1, "A", 1), ("s", 2, "C", 1), ("t", 1, "A", 1), ("t", 3, "C", 1), ("u", 1, "A", 1), ("u", 2, "A", 0)], "site string, position int, residue_1l string, interacting int")
    assert rows(chains.filter_scattered(labels, ["site"])) == [("t",)]
    assert rows(chains.residue_pattern(labels, ["site"]).filter("site = 't'")) == [("t", ["1_A", "3_C"], 2)]
    assert rows(joins.keep_sites_with_contact(labels.filter("not (site = 'u' and position = 1)"), ["site"]).select("site").distinct()) == [("s",), ("t",)]


SITE = st.tuples(st.sampled_from("pq"), st.sampled_from("AB"), st.sampled_from("xy"), st.sampled_from("12"), st.sampled_from("KL"), st.sampled_from([1.0, 2.0, 2.0]))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(SITE, min_size=1, max_size=30))
def test_dedup_equals_greedy_loops(spark, sites):
    data = [(*s, f"r{i:02d}", "c") for i, s in enumerate(sites)]
    df = spark.createDataFrame(data, "pdb_id string, sequence_1l string, lig_id string, pattern string, lig_chain string, resolution double, row_id string, chain_id string")
    best = {}
    for s in sorted(data, key=lambda s: (s[4], s[6])):
        best.setdefault(s[:4], s)
    assert rows(chains.dedup_within_entry(df), "row_id") == sorted((s[6],) for s in best.values())
    across = {}
    for s in sorted(best.values(), key=lambda s: (s[5], s[0], s[7], s[4], s[6])):
        across.setdefault(s[1:4], s)
    assert rows(chains.dedup_across_entries(chains.dedup_within_entry(df)), "row_id") == sorted((s[6],) for s in across.values())
    assert chains.dedup_audit(df).count() == len(data) - len(across)


def test_feature_screen_mask_scale(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(1, [1.0, 5.0, nan, inf, None]), (2, [3.0, 5.0, 1.0, 2.0, 1.0])], "id int, features array<double>")
    assert rows(features.screen_features(v)) == [(0, False, False, False), (1, False, False, True), (2, True, False, True), (3, False, True, False), (4, True, False, True)]
    masked = features.apply_mask(v, features.feature_mask(v))
    assert rows(masked) == [(1, [1.0]), (2, [3.0])] and rows(features.verify_features(masked)) == [(0, 0, 0)]
    scaled = features.apply_scaler(v.withColumn("features", F.slice("features", 1, 2)), features.fit_scaler(v.withColumn("features", F.slice("features", 1, 2))))
    assert rows(scaled) == [(1, [-1.0, 0.0]), (2, [1.0, 0.0])]


def test_moments_merge_in_any_way(spark):
    """Against numpy over all rows: lengths that differ, nulls, NaNs, infinities, null and empty vectors, far means, many partitions."""
    draw = np.random.default_rng(8)
    data = [(1e9 + draw.normal(size=int(draw.choice([5, 5, 7])))).tolist() for _ in range(200)] + [None, [], [None] * 7, [float("nan"), 1.0], [1.0, float("inf")]]
    df = spark.createDataFrame([(v,) for v in data], "features array<double>")
    plan = features.fit_scaler(df)._jdf.queryExecution().toString()
    assert "explode" not in plan.lower() and "Generate" not in plan
    want = {}
    for pos in range(7):
        v = np.array([x[pos] for x in data if x and len(x) > pos and x[pos] is not None])
        missing = any(x[pos] is None for x in data if x and len(x) > pos)
        real = v[~np.isnan(v)]
        want[pos] = (float(v.mean()), float(v.std()), bool(missing or np.isnan(v).any()), bool(np.isinf(v).any()), bool(real.min() == real.max()))
    for parts in (1, 9):
        scaler = {r["pos"]: r for r in features.fit_scaler(df.repartition(parts)).collect()}
        screen = {r["pos"]: r for r in features.screen_features(df.repartition(parts)).collect()}
        assert scaler.keys() == screen.keys() == want.keys()
        for pos, (mean, std, *flags) in want.items():
            assert np.allclose([scaler[pos]["mean"], scaler[pos]["std"]], [mean, std], rtol=1e-12, atol=1e-6, equal_nan=True)
            assert [screen[pos][k] for k in ("has_nan", "has_inf", "is_constant")] == flags
    assert features.fit_scaler(df.limit(0)).collect() == [] and rows(features.fit_scaler(spark.createDataFrame([([None],)], "features array<double>"))) == [(0, None, None)]


def test_metrics_edges(spark):
    s = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 0, 0.9, 1), ("a", 0, 0.1, 0), ("b", 0, 0.2, 0)], "split string, label int, prob double, pred int")
    got = {r["split"]: r for r in evaluate.evaluate_splits(s).collect()}
    assert got["a"]["auc"] == 0.75 and got["a"]["average_precision"] == 0.5 and got["a"]["precision"] == 0.5
    assert math.isnan(got["b"]["auc"]) and got["b"]["f1"] == 0.0 and got["b"]["mcc"] == 0.0
    report = {r["class"]: r for r in evaluate.classification_report(s, ["split"]).filter("split = 'a'").collect()}
    assert report["1"]["support"] == 1 and report["macro avg"]["support"] == 3 and abs(report["accuracy"]["f1"] - 2 / 3) < 1e-12


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=2, max_size=60))
def test_auc_is_pairwise(spark, data):
    s = spark.createDataFrame([("x", y, p / 20) for y, p in data], "split string, label int, prob double")
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    got = evaluate.auc_roc(s, ["split"], buckets=8).first()["auc"]
    if pos and neg:
        assert abs(got - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))) < 1e-12
    else:
        assert math.isnan(got)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 9), min_size=1, max_size=80), st.integers(0, 99))
def test_assignment_contract(spark, sizes, seed):
    g = spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(sizes)], "group string, n long")
    out = {r["group"]: r for r in splitting.assign_balanced(g, 0.2, 0.3, seed).collect()}
    assert len(out) == len(sizes)  # every group once: atomic, disjoint and exhaustive
    total, got = sum(sizes), dict.fromkeys(("test", "val", "train"), 0)
    for r in out.values():
        got[r["split"]] += r["n"]
    targets = {"test": math.floor(total * 0.3 + 0.5), "val": math.floor(total * 0.2 + 0.5)}
    targets["train"] = total - sum(targets.values())
    bound = min((t for t in targets.values() if t > 0), default=0) / splitting.LARGE_PART
    large = sorted(((n, i) for i, n in enumerate(sizes) if n > bound), reverse=True)
    left = dict(targets)
    splitting.deal_large([(i, n) for n, i in large], left)
    small = max((n for n in sizes if n <= bound), default=0)
    # A target that large groups alone did not pass is missed by less than one small group on each side.
    if all(v >= 0 for v in left.values()):
        assert all(abs(got[k] - targets[k]) <= 2 * small for k in got)
    for k in got:
        assert got[k] - targets[k] <= max([small * 2, *(n for n, _ in large)])


def test_large_groups_go_where_most_is_wanted(spark):
    """A group of a third of all rows goes to train, whatever its hash; by a running sum it may fall to test."""
    sizes = {"huge": 3000, **{f"big{i}": 400 for i in range(5)}, **{f"g{i}": 1 for i in range(4000)}}
    g = spark.createDataFrame(list(sizes.items()), "group string, n long")
    for seed in range(4):
        out = {r["group"]: r["split"] for r in splitting.assign_balanced(g, 0.1, 0.1, seed).collect()}
        got = {s: sum(sizes[k] for k, v in out.items() if v == s) for s in ("test", "val", "train")}
        assert out["huge"] == "train" and got == {"test": 900, "val": 900, "train": 7200} and out.keys() == sizes.keys()
    assert splitting.assign_balanced(g.limit(0), 0.1, 0.1, 1).collect() == []


@pytest.mark.parametrize(("digits", "few"), [(3, 10_000), (1, 1), (1, 5)])
def test_sample_is_a_filter_of_the_smallest_hashes(spark, monkeypatch, digits, few):
    monkeypatch.setattr(splitting, "PREFIX_DIGITS", digits)
    monkeypatch.setattr(splitting, "FEW_KEYS", few)
    for n, share in ((1, 0.01), (7, 0.5), (700, 0.0), (700, 0.07), (700, 1.0)):
        data = [(f"k{i}",) for i in range(n)] * 2 + [(None,)]
        got = splitting.sample_keys(spark.createDataFrame(data, "k string"), "k", share, 3)
        want = sorted({k for (k,) in data if k}, key=lambda k: hashlib.md5(f"3{k}".encode()).hexdigest())[: max(1, int(share * n))]
        assert sorted(r["k"] for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert splitting.sample_keys(spark.createDataFrame([(None,)], "k string"), "k", 0.5, 1).collect() == []


def test_split_rules(spark):
    i = spark.createDataFrame(
        [("g1", "p1", "s1", "l1"), ("g2", "p1", "s1", "l9"), ("g3", "p2", "s2", "l1"), ("g4", "p3", "s1", "l1"), ("g5", "p3", "s1", "l8"), ("g6", "p4", "s4", "l7")], "group string, pdb_id string, sequence string, lig_id string"
    )
    key = lambda c, v: spark.createDataFrame([(v,)], f"{c} string")
    got = dict(rows(splitting.classify_base(i, key("pdb_id", "p1"), key("sequence", "s1"), key("lig_id", "l1")), "group", "category"))
    assert got == {"g1": "blind", "g2": "blind_protein", "g3": "blind_ligand", "g4": "test", "g5": "test", "g6": "candidate"}
    with pytest.raises(ValueError, match="several splits"):
        splitting.assert_disjoint(spark.createDataFrame([("k", "train"), ("k", "val")], "key string, split string"))
    ligands = spark.createDataFrame([("a", "f"), ("b", None), ("c", "g")], "lig_id string, scaffold string")
    assert rows(splitting.blind_ligands_by_scaffold(ligands, key("scaffold", "f"))) == [("a",)]
    assert rows(splitting.remove_leakage(ligands.withColumn("cluster_id", F.lit(1)), spark.createDataFrame([], "cluster_id int"), key("scaffold", "f")), "lig_id") == [("b",), ("c",)]
    assert splitting.sample_keys(ligands, "scaffold", 0.01, 1).count() == 1


def test_scalars(spark):
    assert one(spark, scalar.safe_name(F.lit("a b/c.d-e"))) == "a_b_c.d-e"
    assert one(spark, scalar.quoted_tokens(F.lit('a "b c"  d'))) == ["a", "b c", "d"]
    assert one(spark, scalar.clean_sequence(F.lit("a uB\nz"))) == "AXXX"
    assert one(spark, scalar.threshold_label(F.lit(0.5))) == 1 and one(spark, scalar.threshold_label(F.lit(0.5), strict=True)) == 0
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scalar.align_features(arr(1.0, float("nan"), float("inf")), arr("a", "b", "c"), arr("c", "a", "z", "b"))) == [0.0, 1.0, 0.0, 0.0]


def test_readers(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" 1ABC \n\n2def\n")
    assert rows(readers.read_id_list(spark, str(tmp_path / "ids.txt"))) == [("1abc",), ("2def",)]
    (tmp_path / "x.txt").write_text('abc\tname\n""\nABC q\n\nxyz\n')
    assert rows(readers.read_token_list(spark, str(tmp_path / "x.txt"))) == [("ABC",), ("XYZ",)]
    (tmp_path / "t.csv").write_text("pdb,chain\n1abc,NA\n2def,\n")
    assert rows(readers.read_table(spark, str(tmp_path / "t.csv"), "pdb string, chain string")) == [("1abc", "NA"), ("2def", "")]
    (tmp_path / "f.fa").write_text(">p_A some\nACD\nEF\n>q_B\nGG\n")
    assert rows(readers.read_fasta(spark, str(tmp_path / "f.fa"))) == [("p_A", "ACDEF"), ("q_B", "GG")]
    (tmp_path / "c.txt").write_text("Cluster# 0\n>1abc_A\n>2def_B_x\nCluster# one\n>3ghi_C\n")
    assert rows(readers.read_cluster_listing(spark, str(tmp_path / "c.txt"))) == [("0", "1abc:A"), ("0", "2def:B_x"), ("one", "3ghi:C")]


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of 4 KB."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, ("4096", "1", "64"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_headers_are_carried_over_splits(spark, tmp_path, small_splits):
    """Records far longer than a split, headers with a > inside, lines above the first header, several files."""
    members = [f"{i}_A_{i}" for i in range(20_000)]
    (tmp_path / "c1.txt").write_text("Cluster# 0\n" + "\n".join(f">{m}" for m in members) + "\nCluster# 1\nCluster# two\n>x_Y\n")
    (tmp_path / "c2.txt").write_text(">lost_A\nCluster# 9\n>z_B\n")
    lines = readers.numbered_lines(spark, str(tmp_path / "c1.txt"))
    assert lines.select("block").distinct().count() > 20 and lines.agg(F.max("line_no"), F.count_distinct("line_no")).first()[:] == (20_003, 20_004)
    got = readers.read_cluster_listing(spark, str(tmp_path / "c*.txt"))
    assert sorted(map(tuple, got.collect())) == sorted([("0", m.replace("_", ":", 1)) for m in members] + [("two", "x:Y"), ("9", "z:B")])
    draw = random.Random(2)
    sequences = {f"s{i}": "".join(draw.choices("ACDEFG", k=n)) for i, n in enumerate([0, 5, 9000, 60, 30_000])}
    fasta = "no header\n" + "".join(f">{k} a > b >c\n" + "".join(v[i : i + 60] + "\n" for i in range(0, len(v), 60)) for k, v in sequences.items())
    (tmp_path / "f.fa").write_text(fasta)
    assert {r["id"]: r["sequence"] for r in readers.read_fasta(spark, str(tmp_path / "f.fa")).collect()} == sequences
    (tmp_path / "e.fa").write_text("")
    assert readers.read_fasta(spark, str(tmp_path / "e.fa")).collect() == []
    blocks = "".join(f"data_L{i}\n" + "".join(f"L{i} atom {k}\n" for k in range(300)) + f"_chem_comp.type  'kind {i}'\n_chem_comp.name \"n {i}\"\n_chem_comp.pdbx_type HETAIN\n_chem_comp.type later\n"
                     + f'L{i} SMILES "a b" 1.7 "C{i}"\nOTHER SMILES x 1.0 "no"\nL{i} InChI p 1 I{i}\n' for i in range(30))
    (tmp_path / "comp.cif").write_text(blocks)
    got = {r["id"]: r for r in readers.read_components(spark, str(tmp_path / "comp.cif")).collect()}
    assert len(got) == 30
    for i in range(30):
        r = got[f"L{i}"]
        assert (r["type"], r["chem_type"], r["name"]) == ("HETAIN", f"kind {i}", f"n {i}")
        assert [tuple(d) for d in r["descriptors"]] == [("SMILES", "a b", f"C{i}"), ("InChI", "p", f"I{i}")]


def test_large_structure_file_in_many_tasks(spark, tmp_path, small_splits):
    head = CIF.split("ATOM C")[0]
    atoms = "".join(f"ATOM C \"C {i}\" ALA A {i % 50} {i}.5 -{i}.25 {i / 8}\n" for i in range(3000))
    (tmp_path / "9xyz.v1.cif").write_text("#\n\n" + head + atoms + "#\nATOM C X ALA A 1 1 2 3\n")
    (tmp_path / "1abc.cif").write_text(CIF)
    out = readers.read_atoms(spark, str(tmp_path / "*.cif"))
    got = {(r["pdb_id"], r["atom"]): (r["seq_id"], r["x"], r["y"], r["z"], r["line_no"]) for r in out.collect()}
    assert len(got) == 3002 and all(got["9xyz", f"C {i}"] == (i % 50, i + 0.5, -i - 0.25, i / 8, i + 13) for i in range(3000))
    plan = out.select("pdb_id", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "auth_seq_id" not in plan and "pdbx_PDB_model_num" not in plan  # columns that nobody reads are not looked up
    (tmp_path / "1abc.cif").write_text(CIF.replace("_atom_site.Cartn_z\n", ""))
    with pytest.raises(Exception, match="1abc: the atom loop lacks Cartn_z"):
        readers.read_atoms(spark, str(tmp_path / "*.cif")).collect()


CIF = """data_1ABC
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM C "C 1'" ALA A 1 1.0 2.0 3.0
HETATM O 'O 2' HOH B . 1.5 2.5 3.5
ATOM C CA ALA A 2 bad 2.0 3.0
short line
#
loop_
_pdbx_struct_mod_residue.label_asym_id
_pdbx_struct_mod_residue.label_seq_id
_pdbx_struct_mod_residue.label_comp_id
_pdbx_struct_mod_residue.parent_comp_id
A 5 MSE MET
#
"""


def test_structure_files(spark, tmp_path):
    (tmp_path / "1abc.cif").write_text(CIF)
    got = rows(readers.read_atoms(spark, str(tmp_path / "*.cif")), "pdb_id", "group", "atom", "seq_id", "x")
    assert got == [("1abc", "ATOM", "C 1'", 1, 1.0), ("1abc", "HETATM", "O 2", -1, 1.5)]
    assert rows(readers.read_modified_residues(spark, str(tmp_path / "*.cif"))) == [("1abc", "A", "5", "MSE", "MET")]


def test_dataset_round_trip(spark, tmp_path):
    i = spark.createDataFrame([("k1", "train"), ("k2", "val")], "key string, split string")
    lig = spark.createDataFrame([("l", [1.0]), ("l", [1.0])], "lig_site string, features array<double>")
    sinks.write_dataset({"interactions": i, "ligand_features": lig}, str(tmp_path / "d"))
    back = sinks.read_dataset(spark, str(tmp_path / "d"), ["interactions", "ligand_features"])
    assert rows(back["interactions"], "key", "split") == rows(i) and back["ligand_features"].count() == 1


def test_encoders_and_models(spark):
    seqs = spark.createDataFrame([("ACX",), ("ACX",), (None,)], "sequence string")
    assert encoders.with_residue_vectors(seqs, encoders.one_hot_residues).count() == 3
    with pytest.raises(Exception, match="1 vectors for 3 residues"):
        encoders.with_residue_vectors(seqs, lambda s: [[1.0]]).collect()
    lig = encoders.with_ligand_vectors(spark.createDataFrame([("CCl",)], "smiles string"), encoders.count_tokens, encoders.TOKENS).first()
    assert lig["features"][0] == 1.0 and lig["features"][6] == 1.0
    data = spark.createDataFrame([([float(i % 2), float(i)], i % 2) for i in range(60)], "features array<double>, label int")
    model = models.train_boosted(data, data, {"maxIter": 3, "maxDepth": 2, "seed": 1})
    assert models.f1_of(model, data) == 1.0
    space, fitted = {"maxIter": [2], "maxDepth": [1, 2], "seed": [1]}, []
    fit = lambda *a: fitted.append(a[2]) or models.train_boosted(*a)
    best, f1, trials = models.search(data, data, space, 2, 0, fit)
    assert f1 == 1.0 and set(best) == {"maxIter", "maxDepth", "seed"} and [t[0] for t in trials] == [0, 1]
    done = len(fitted)
    assert models.search(data, data, space, 2, 0, fit, trials)[2] == trials and len(fitted) == done


def test_encoders_of_lists_get_like_lengths(spark):
    """Calls hold like lengths and bounded padding, results are those of one by one, and pairs are scored without texts in the exchange."""
    draw = random.Random(7)
    texts = ["".join(draw.choices("ACDEFG", k=draw.choice([0, 1, 30, 31, 33, 400, 9000, 20_000]))) for _ in range(60)]
    calls = list(encoders.like_lengths(sorted(enumerate(texts), key=lambda x: len(x[1]))))
    assert sum(map(len, calls)) == 60 and len(calls) < 20
    for call in calls:
        sizes = [len(s) for _, s in call]
        assert len(call) == 1 or max(sizes) * len(call) <= encoders.CALL_RESIDUES and max(sizes) <= encoders.LIKE * min(sizes)
    df = spark.createDataFrame([(s,) for s in texts if len(s) < 1000] + [(None,)], "sequence string")
    both = lambda texts: [encoders.one_hot_residues(s) for s in texts]
    assert rows(encoders.with_residue_vectors(df, both, lists=True)) == rows(encoders.with_residue_vectors(df, encoders.one_hot_residues))
    with pytest.raises(Exception, match="0 results for"):
        encoders.with_residue_vectors(df, lambda texts: [], lists=True).collect()
    data = spark.createDataFrame([([float(i % 2)] * 36, i % 2) for i in range(20)], "features array<double>, label int")
    model = models.train_boosted(data, data, {"maxIter": 1, "maxDepth": 1, "seed": 1})
    pairs = spark.createDataFrame([("p", "A", "l", "ACD", "CC")], "pdb string, chain string, lig_id string, sequence string, smiles string")
    ids = encoders.sequence_ids(pairs)
    out = models.score_pairs(pairs, ids, encoders.encode_sequences(ids, encoders.one_hot_residues), encoders.with_ligand_vectors(pairs, encoders.count_tokens, encoders.TOKENS), None, model)
    assert [r["residue"] for r in out.orderBy("position").collect()] == ["A", "C", "D"]
    scored = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Project" in scored and all("sequence#" not in line for line in scored.split("\n") if "_r#" in line)


def test_search_is_the_same_however_many_run_at_once(spark):
    """Ranges, rungs and resumes: scores hang on parameters alone, slow fits end last, and no stopped trial was among the best of its rung."""
    import time

    df, fitted = spark.createDataFrame([(1,)], "x int"), []

    def fit(train, val, params):
        fitted.append(params)
        time.sleep(0.05 * params["b"] / 9)
        return None, round(params["a"] * params["step"] + params["b"], 3) % 1

    space = {"a": models.Uniform(1e-4, 1.0, log=True), "b": models.Integers(3, 9, 3), "c": ["x", "y"]}
    rungs = models.Rungs("step", (1, 3, 9), 0.4)
    want = models.search(df, df, space, 12, 5, fit, rungs=rungs)
    n_fits = len(fitted)
    assert want[:2] == models.search(df, df, space, 12, 5, fit, parallelism=6, rungs=rungs)[:2]
    assert models.search(df, df, space, 12, 5, fit, parallelism=4, rungs=rungs)[2] == want[2]
    by = {r: [t for t in want[2] if t.rung == r] for r in range(3)}
    assert [len(by[r]) for r in range(3)] == [12, 5, 2] and n_fits <= 19
    for r in (0, 1):
        on = {t.number for t in by[r + 1]}
        assert max((-t.score, t.number) for t in by[r] if t.number in on) < min((-t.score, t.number) for t in by[r] if t.number not in on)
    assert want[1] == max(t.score for t in by[2])
    fitted.clear()
    assert models.search(df, df, space, 12, 5, fit, history=want[2], rungs=rungs) == want and not fitted
    draws = [models.drawn(space, 5, k) for k in range(300)]
    assert all(1e-4 <= p["a"] <= 1 and p["b"] in (3, 6, 9) for p in draws) and {p["b"] for p in draws} == {3, 6, 9} and {p["c"] for p in draws} == {"x", "y"}
    assert 0.4 < sum(p["a"] < 1e-2 for p in draws) / 300 < 0.6  # even in the logarithm
    assert models.search(df, df, space, 0, 5, fit)[0] == {}


def test_network_keeps_its_best_state_and_weighs_positives(spark, monkeypatch):
    rows = spark.createDataFrame([([float(i % 10 == 0), float(i % 7)], int(i % 10 == 0)) for i in range(200)], "features array<double>, label int")
    assert models._weighted(rows, 3.0).filter("label = 1").count() == 60 and models._weighted(rows, 1.5).filter("label = 0").count() == 180
    model, f1 = models.train_network(rows, rows, {"hidden": [4], "max_iter": 30, "step": 10, "seed": 1})
    assert f1 == 1.0 == models.f1_of(model, rows)
    told = iter([0.2, 0.6, 0.5, 0.4, 0.9])
    made = []
    monkeypatch.setattr(models, "f1_of", lambda m, v: made.append(m) or next(told))
    model, f1 = models.train_network(rows, rows, {"hidden": [4], "max_iter": 500, "step": 1, "patience": 2, "seed": 1})
    assert f1 == 0.6 and model is made[1] and len(made) == 4  # two epochs without a better one end the run


def test_metrics_where_scores_crowd(spark):
    """All scores in one equal-width bucket, ties among them, against all pairs."""
    rows = [(f"s{i % 2}", (i * i) % 17 / 1e6, int(i % 5 < 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "split string, prob double, label int").withColumn("pred", F.lit(1))
    got = {r["split"]: r for r in evaluate.evaluate_splits(df, 8).collect()}
    for s in ("s0", "s1"):
        pos, neg = ([p for x, p, y in rows if x == s and y == k] for k in (1, 0))
        won = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
        assert abs(got[s]["auc"] - won / (len(pos) * len(neg))) < 1e-12
        cuts = sorted({*pos, *neg}, reverse=True)
        at = lambda c, own: sum(p >= c for p in own)
        steps = [(at(c, pos) - (at(cuts[i - 1], pos) if i else 0)) / len(pos) * at(c, pos) / (at(c, pos) + at(c, neg)) for i, c in enumerate(cuts)]
        assert abs(got[s]["average_precision"] - sum(steps)) < 1e-12 and got[s]["recall"] == 1.0
