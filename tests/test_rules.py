"""Hand-sized fixtures for rules that SQL on the given tables does not reach."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions import blocks
from lociframe.functions import mathfns as M
from lociframe.operators import align, coalescent, conditionals, delimit, label_switch, likelihood, phase, pops, trace, trees
from lociframe.sources import adapters, sinks, text
from lociframe.streaming import monitor


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def make_trace(spark, values, chain="c", param="p"):
    return spark.createDataFrame([(chain, i + 1, param, None if v is None else float(v)) for i, v in enumerate(values)], "chain string, gen long, param string, value double")


def test_lgamma(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 3.3, 11.9, 12.0, 12.1, 50.0, 1e3, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", M.lgamma(F.col("x")).alias("y"))
    for x, y in rows(df):
        assert abs(y - math.lgamma(x)) <= 1e-9 * max(1, abs(math.lgamma(x)))


def direct_hpd(x):
    x, n = sorted(x), len(x)
    lo, hi = int(n * 0.025), int(n * 0.975)
    k, left, w = hi - lo, lo, x[hi] - x[lo]
    if n > 2:
        for start in range(n - k):
            if x[start + k] - x[start] < w:
                left, w = start, x[start + k] - x[start]
    return x[left], x[left + k]


@pytest.mark.parametrize("kind", ["ties", "smooth", "hot value", "tiny"])
def test_ranks_and_hpd(spark, kind):
    rng = random.Random(7)
    values = {
        "ties": [rng.randint(0, 9) for _ in range(400)],
        "smooth": [rng.gauss(0, 1) for _ in range(501)],
        "hot value": [0.0] * 300 + [rng.random() for _ in range(300)],
        "tiny": [3.0, 1.0],
    }[kind]
    tr = make_trace(spark, values)
    (_, _, lo, hi), = rows(trace.hpd_interval(tr))
    assert (lo, hi) == direct_hpd(values)
    s, n = sorted(values), len(values)
    (_, _, median, q1, q2), = rows(trace.trace_quantiles(tr))
    assert q1 == s[int(n * 0.025)] and q2 == s[int(n * 0.975)]
    assert median == (s[n // 2] if n % 2 else (s[n // 2] + s[n // 2 - 1]) / 2)


def direct_tau(y, max_lag=2000):
    n, m, sd = len(y), np.mean(y), np.std(y, ddof=1)
    x, tau, rho0 = (np.asarray(y) - m) / sd, -1.0, 1.0
    for i in range(1, min(max_lag, n - 10)):
        rho = float(np.dot(x[: n - i], x[i:])) / (n - i)
        if i % 2 == 1:
            if i > 10 and rho + rho0 < 0:
                break
            tau += 2 * (rho0 + rho)
        rho0 = rho
    return tau


def test_ess_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    y = [0.0]
    for e in rng.normal(size=699):
        y.append(0.8 * y[-1] + e)
    monkeypatch.setattr(trace, "LAG_BLOCK", 64)
    (_, _, tau, size, eff, _), = rows(trace.ess(make_trace(spark, y), max_lag=64))
    assert tau == pytest.approx(direct_tau(y, 64), rel=1e-9)
    assert size == pytest.approx(700 / tau) and eff == pytest.approx(1 / tau)


def test_ess_edge_cases(spark):
    (_, _, tau, _, _, rho1), = rows(trace.ess(make_trace(spark, [2.0] * 30)))
    assert tau == 30 and rho1 == 0
    (_, _, tau, *_), = rows(trace.ess(make_trace(spark, range(11))))
    assert tau is None


def test_running_totals_do_not_depend_on_blocks(spark):
    tr = make_trace(spark, [random.Random(5).random() for _ in range(200)])
    for size in (1, 7, 1000):
        out = blocks.running_totals(tr, ["chain", "param"], ["gen"], blocks.gen_block(size=size), {"n": F.lit(1)})
        assert [r[0] for r in rows(out.select("n"))] == list(range(1, 201))


def test_cumulative_by_count_with_many_ties(spark):
    df = spark.createDataFrame([(f"t{i}", 1 + i // 50) for i in range(100)], "topology string, n long")
    out = rows(blocks.cumulative_by_count(df, [], "n", "topology", "cum").select("cum", "n"))
    assert [c for c, _ in out] == list(range(2, 101, 2)) + list(range(101, 151))


def test_conditional_mixture_missing_rows(spark):
    data = [("c", g, "x", None, None) for g in range(20)] + [("c", g, "y", 3.0 + g % 4, 2.0) for g in range(20)]
    df = spark.createDataFrame(data, "chain string, gen long, param string, a1 double, b1 double")
    out = {r["param"]: r for r in conditionals.conditional_to_marginal(df, "gamma", bins=200).collect()}
    assert out["x"]["mean"] is None and out["y"]["mean"] == pytest.approx(4.5 / 2)
    half = spark.createDataFrame([("c", 1, "z", 2.0, None)], df.schema)
    with pytest.raises(Exception, match="bad conditional"):
        conditionals.conditional_to_marginal(half, "gamma").collect()


def one_event(spark, *more):
    events = [("e", "px", "py", "tx", "ty"), *more]
    return spark.createDataFrame(events, "event string, phi_x string, phi_y string, theta_x string, theta_y string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_label_switch_by_chain_and_event(spark):
    """Chains on different sides, a null chain, an event without thetas, and one of which a parameter is missing."""
    rng = random.Random(4)
    data, mirrored = [], {("a", "e"): 0, (None, "e"): 0, ("a", "f"): 0, (None, "f"): 0, ("a", "g"): 0}
    for chain in ("a", None):
        for g in range(120):
            v = [rng.betavariate(20, 80), rng.betavariate(30, 50), rng.gammavariate(20, 1e-3), rng.gammavariate(50, 1e-3)]
            w = [rng.betavariate(30, 60), rng.betavariate(10, 50)]
            if g % 4 == 0:
                v, mirrored[chain, "e"] = [1 - v[0], 1 - v[1], v[3], v[2]], mirrored[chain, "e"] + 1
            if g % 7 == (0 if chain else 3):
                w, mirrored[chain, "f"] = [1 - x for x in w], mirrored[chain, "f"] + 1
            data += [(chain, g, n, x) for n, x in zip(("px", "py", "tx", "ty", "qx", "qy", "other"), [*v, *w, 0.9])]
        data += [("a", g, "zx", 0.9) for g in range(3) if chain]
    df = spark.createDataFrame(data, "chain string, gen long, param string, value double")
    events = one_event(spark, ("f", "qx", "qy", None, "ty"), ("g", "zx", "zy", None, None))
    fixed, n = label_switch.label_switch(df, events)
    assert rows_of(n) == sorted(((c, e, k) for (c, e), k in mirrored.items()), key=repr)
    most = {r.param: r.m for r in fixed.groupBy("param").agg(F.max("value").alias("m")).collect()}
    assert fixed.count() == len(data) and most["px"] < 0.5 and most["qy"] < 0.5 and most["other"] == most["zx"] == 0.9
    with pytest.raises(ValueError, match="two events"):
        label_switch.label_switch(df, one_event(spark, ("f", "px", "qy", None, None)))


@pytest.mark.parametrize("samples", [0, 1, 5])
def test_label_switch_of_constant_columns(spark, samples):
    rows = [("c", g, p, v) for g in range(samples) for p, v in (("px", 0.2), ("py", 0.3), ("tx", 1.0), ("ty", 2.0))]
    df = spark.createDataFrame(rows, "chain string, gen long, param string, value double")
    fixed, n = label_switch.label_switch(df, one_event(spark))
    assert rows_of(n) == [("c", "e", 0)] * (samples > 0) and sorted(map(tuple, fixed.collect())) == sorted(rows)


@pytest.mark.parametrize("method", ["cog0", "cogn", "beta_gamma"])
def test_label_switch_recovers_sides(spark, method):
    rng = random.Random(1)
    data, mirrored = [], 0
    for g in range(300):
        v = [rng.betavariate(20, 80), rng.betavariate(30, 50), rng.gammavariate(20, 1e-3), rng.gammavariate(50, 1e-3)]
        if g % 3 == 0:
            v = [1 - v[0], 1 - v[1], v[3], v[2]]
            mirrored += 1
        data += [("c", g, n, x) for n, x in zip(("px", "py", "tx", "ty"), v)]
    df = spark.createDataFrame(data, "chain string, gen long, param string, value double")
    fixed, n = label_switch.label_switch(df, one_event(spark), method=method)
    assert rows_of(n) == [("c", "e", mirrored)]
    assert fixed.filter("param = 'px'").agg(F.max("value")).first()[0] < 0.5


def test_beta_and_gamma_fits():
    rng = np.random.default_rng(0)
    x, y = rng.beta(4, 9, 200_000), rng.gamma(6, 1 / 3, 200_000)
    p, q = label_switch.fit_beta(np.log(x).mean(), np.log(1 - x).mean(), (1.0, 1.0))
    a, b = label_switch.fit_gamma(y.mean(), np.log(y).mean(), (1.0, 1.0))
    assert (p, q) == pytest.approx((4, 9), rel=0.03) and (a, b) == pytest.approx((6, 3), rel=0.03)


def test_newick_attributes_and_kinds(spark):
    data = [(1, "((A:0.1[&phi=.2],B#0.02:0.1):0.2,(C:0.2,D)e:0.1)r;"), (2, "(A,B,(C,D));"), (3, "(A,B,C,D);"), (4, "no tree")]
    df = spark.createDataFrame(data, "gen int, newick string")
    one = {r["label"]: r for r in trees.newick_nodes(df, ["gen"]).filter("gen = 1 and label is not null").collect()}
    assert one["A"]["attributes"] == "&phi=.2" and one["B"]["theta"] == 0.02 and one["e"]["n_leaves"] == 2 and one["r"]["parent_id"] is None
    assert rows(trees.classify_trees(df, ["gen"])) == [(1, "rooted binary"), (2, "unrooted binary"), (3, "n-ary")]


def test_labelled_histories_of_a_balanced_tree(spark):
    df = spark.createDataFrame([(1, "(((A,B),(C,D)),((E,F),(G,H)));"), (2, "((A,B),C);")], "gen int, newick string")
    out = dict(rows(trees.labelled_histories(trees.newick_nodes(df, ["gen"]), ["gen"])))
    assert out == {1: 20 * 2 * 2, 2: 1}


def test_majority_conflict_at_one_half(spark):
    df = spark.createDataFrame([("c", 1, "((A,B),C);"), ("c", 2, "((A,C),B);")], "chain string, gen long, newick string")
    post = trees.clade_posterior(trees.clade_counts(df), df)
    nested, conflicts = trees.majority_consensus(trees.majority_clades(post))
    assert nested.count() == 3 and rows(conflicts) == [("A,B", "A,C", 1)]
    with pytest.raises(ValueError, match="need not nest"):
        trees.majority_clades(post, 0.4)


def random_newick(rng, names):
    parts = list(names)
    while len(parts) > 1:
        k = min(len(parts), rng.choice([2, 2, 2, 3]))
        picked = [parts.pop(rng.randrange(len(parts))) for _ in range(k)]
        parts.append("(" + ",".join(picked) + ")")
    return parts[0] + ";"


def test_consensus_of_random_trees(spark):
    """Against comparing all pairs of clades; even numbers of trees give ties at one half."""
    rng = random.Random(5)
    for names, count in (("ABCDEF", 2), ("ABCDEFGH", 2), ("ABCDE", 4)):
        texts = [random_newick(rng, names) for _ in range(count)]
        df = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "chain string, gen long, newick string")
        majority = trees.majority_clades(trees.clade_posterior(trees.clade_counts(df), df)).cache()
        sets = [(frozenset(r.clade), ",".join(r.clade)) for r in majority.collect()]
        up = {k: min(((len(t), n) for t, n in sets if s < t), default=(0, None))[1] for s, k in sets}
        clash = sorted((a, b, len(s & t)) for s, a in sets for t, b in sets if a < b and s & t and not (s <= t or t <= s))
        nested, conflicts = trees.majority_consensus(majority)
        assert {r.key: r.parent for r in nested.collect()} == up
        assert rows(conflicts) == clash


def test_conflicts_of_every_clade(spark):
    """Rare clades count as well as those in half of the trees."""
    rng = random.Random(6)
    for names, count in (("ABCDEF", 5), ("ABCDEFGH", 7)):
        df = spark.createDataFrame([("c", i, random_newick(rng, names)) for i in range(count)], "chain string, gen long, newick string")
        post = trees.clade_posterior(trees.clade_counts(df), df).cache()
        sets = [(frozenset(r.clade), ",".join(r.clade)) for r in post.collect()]
        clash = sorted((a, b, len(s & t)) for s, a in sets for t, b in sets if a < b and s & t and not (s <= t or t <= s))
        assert clash and rows(trees.clade_conflicts(post)) == clash


def test_one_row_a_tree_and_node_tables_agree(spark):
    rng = random.Random(8)
    names = ["é", "b b", "C", "a1", "Z", "_", "ab", "a"]
    texts = [random_newick(rng, names[: rng.randint(2, 8)]) for _ in range(40)] + ["((x),y);", "x;", "(((a,b)));"]
    df = spark.createDataFrame(list(enumerate(texts)), "gen long, newick string")
    nodes = trees.newick_nodes(df, ["gen"]).cache()
    assert rows(trees.tree_topologies(df, ["gen"])) == rows(trees.canonical_topology(nodes, ["gen"]))
    by_text = trees.tree_taxa(df, ["gen"], proper=True).select("gen", "node_id", "clade", "n_leaves")
    assert rows(by_text) == rows(trees.clades(nodes, ["gen"]).select("gen", "node_id", "clade", "n_leaves"))


def test_awkward_newick_texts(spark):
    texts = [None, "", ";", "A;", "(A:1e-3,B:x[&r=1]#0.5)root:2;", "((A,B);", "(A,,B);", " ( A , B ) ;", "(A:.5,(B:1,C:1):0)0.9[n];"]
    df = spark.createDataFrame(list(enumerate(texts)), "gen long, newick string")
    got = {}
    for r in trees.newick_nodes(df, ["gen"]).orderBy("gen", "node_id").collect():
        got.setdefault(r.gen, []).append((r.parent_id, r.label, r.length, r.theta, r.attributes, r.first_tip, r.n_leaves, r.n_nodes, r.depth))
    assert got == {
        3: [(None, "A", None, None, None, 1, 1, 1, 0)],
        4: [(None, "root", 2.0, None, None, 1, 2, 3, 0), (1, "A", 0.001, None, None, 1, 1, 1, 1), (1, "B", None, 0.5, "&r=1", 2, 1, 1, 1)],
        5: [(None, None, None, None, None, 1, None, None, 0), (1, None, None, None, None, 1, 2, 3, 1), (2, "A", None, None, None, 1, 1, 1, 2), (2, "B", None, None, None, 2, 1, 1, 2)],
        6: [(None, None, None, None, None, 1, 2, 3, 0), (1, "A", None, None, None, 1, 1, 1, 1), (1, "B", None, None, None, 2, 1, 1, 1)],
        7: [(None, None, None, None, None, 1, 2, 3, 0), (1, "A", None, None, None, 1, 1, 1, 1), (1, "B", None, None, None, 2, 1, 1, 1)],
        8: [(None, "0.9", None, None, "n", 1, 3, 5, 0), (1, "A", 0.5, None, None, 1, 1, 1, 1), (1, None, 0.0, None, None, 2, 2, 3, 1),
            (3, "B", 1.0, None, None, 2, 1, 1, 2), (3, "C", 1.0, None, None, 3, 1, 1, 2)],
    }


def test_a_ladder_of_many_tips(spark):
    """No recursion: a tree as high as it has tips."""
    n = 2000
    text = "(" * (n - 1) + "t0000:1" + "".join(f",t{i:04d}:{i}):1" for i in range(1, n)) + ";"
    df = spark.createDataFrame([("c", 1, text, 5)], "chain string, gen long, newick string, n_species int")
    assert trees.tree_topologies(df, ["gen"]).collect()[0].topology.startswith("(" * (n - 1) + "t0000,t0001)")
    out = delimit.collapse_zero_branches(df.withColumn("newick", F.regexp_replace("newick", ":1$", "")), ["gen"], n).collect()[0]
    assert out.n_species == n and out.species[0] == "t0000"


def test_species_of_age_zero(spark):
    texts = [("((A:0,B:0):1,C:1);", 2), ("((A:0,B:0):0,C:0);", 1), ("((A:0,B:0):0,C:0);", 3), ("((B:1,A:1):1,C:2);", 3)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(texts)], "gen long, newick string, n_species int")
    out = delimit.collapse_zero_branches(df, ["gen"], 3)
    assert rows(out) == [
        (0, ["AB", "C"], "(AB,C);", 2), (1, ["ABC"], "ABC;", 1), (2, ["A", "B", "C"], "((A,B),C);", 3), (3, ["A", "B", "C"], "((A,B),C);", 3)
    ]
    assert rows(delimit.delimited_models(out).select("n", "tree")) == [(1, "(AB,C);"), (1, "ABC;"), (2, "((A,B),C);")]


def direct_resolve(sites):
    """Greedy phase fixing over ``site -> het sequences``, straight from the rule."""
    counts = {s: len(q) for s, q in sites.items()}
    singles = {}
    for q in itertools.chain(*sites.values()):
        singles[q] = singles.get(q, 0) + 1
    todo, fixed = set(singles), set()
    while todo:
        usable = sorted((-counts[s], s) for s in sites if sites[s] & todo)
        if not usable:
            break
        site = usable[0][1]
        seq = min((singles[q], q) for q in sites[site] & todo)[1]
        counts[site] -= 1
        todo.discard(seq)
        fixed.add((1, site, seq))
    return fixed


def test_phase_fix_matches_the_direct_rule(spark):
    rng = random.Random(11)
    for _ in range(3):
        patterns, sites = [], {}
        for p in range(60):
            column = "".join(rng.choice("1248359a") for _ in range(5))
            weight = rng.choice([1, 1, 2])
            patterns.append((1, column, p, weight))
            hets = {i for i, c in enumerate(column) if c in "3569ac"}
            if weight == 1 and hets:
                sites[p] = hets
        df = spark.createDataFrame(patterns, "locus long, column string, pattern_id long, weight long")
        dips = spark.createDataFrame([(1, i) for i in range(5)], "locus long, seq_idx int")
        assert {tuple(r) for r in phase.diploid_phase_fix(df, dips).collect()} == direct_resolve(sites)


NO_FIXES = "locus long, pattern_id long, seq_idx long"


def test_expansion_order(spark):
    df = spark.createDataFrame([(1, "33", 0, 1)], "locus long, column string, pattern_id long, weight long")
    dips = spark.createDataFrame([(1, 0), (1, 1)], "locus long, seq_idx int")
    out = rows(phase.diploid_expand(df, dips, spark.createDataFrame([], NO_FIXES)).columns.select("resolution_idx", "column"))
    assert out == [(0, "1212"), (1, "1221"), (2, "2112"), (3, "2121")]


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_expansion_in_stages(spark, bits):
    sites = [(1, "3" * 7 + "1", 0, 1), (1, "35112481", 1, 2), (2, "3" * 8, 0, 1), (2, "11111111", 3, 1)]
    df = spark.createDataFrame(sites, "locus long, column string, pattern_id long, weight long")
    dips = spark.createDataFrame([(i, k) for i in (1, 2) for k in range(8)], "locus long, seq_idx int")
    fixed = spark.createDataFrame([(2, 0, 5)], NO_FIXES)
    out = phase.diploid_expand(df, dips, fixed, bits=bits).columns.collect()
    by_site = {}
    for r in out:
        by_site.setdefault((r.locus, r.site), []).append((r.resolution_idx, r.column))
    assert {k: [i for i, _ in sorted(v)] for k, v in by_site.items()} == {
        (1, 0): [*range(128)], (1, 1): [*range(4)], (2, 0): [*range(128)], (2, 3): [0]
    }
    for index, column in by_site[2, 0]:
        bits_left = f"{index:07b}"
        want = "".join("12" if i == 5 or bits_left[i - (i > 5)] == "0" else "21" for i in range(8))
        assert column == want


def test_thirty_heterozygotes(spark):
    """2**30 columns of one site neither fail nor pass through one task; loci beyond all storage are told apart."""
    df = spark.createDataFrame([(1, "3" * 30, 0, 1), (2, "3" * 70, 0, 1), (2, "3" + "1" * 69, 1, 1)], "locus long, column string, pattern_id long, weight long")
    dips = spark.createDataFrame([(1, k) for k in range(30)] + [(2, k) for k in range(70)], "locus long, seq_idx int")
    out = phase.diploid_expand(df, dips, spark.createDataFrame([], NO_FIXES), rows_a_task=1 << 26)
    assert rows(out.counts.select("locus", "site", "h", "n_columns", "fits")) == [
        (1, 0, 30, 2.0**30, True), (2, 0, 70, 2.0**70, False), (2, 1, 1, 2.0, False)
    ]
    assert {r.locus for r in out.columns.limit(3000).collect()} == {1}
    assert rows(phase.diploid_expand(df.filter("locus = 2"), dips, spark.createDataFrame([], NO_FIXES)).columns) == []


NETWORK = "gen long, node_id string, parent_id string, tau double, event int, mirror_id string, horizontal boolean, bidirectional boolean"


def test_branches_in_networks_of_two_samples(spark):
    """A bidirectional event: above X and Y at one time a lineage may change sides along edges without duration."""
    def sample(gen, f):
        return [
            (gen, "a", "X", 0.0, None, None, None, None), (gen, "b", "Y", 0.0, None, None, None, None),
            (gen, "X", "R", 1.0 * f, 0, "Xm", False, True), (gen, "Xm", "Y", 1.0 * f, 0, None, True, True),
            (gen, "Y", "R", 1.0 * f, 1, "Ym", False, True), (gen, "Ym", "X", 1.0 * f, 1, None, True, True),
            (gen, "R", None, 3.0 * f, None, None, None, None),
        ]

    pops = spark.createDataFrame(sample(1, 1.0) + sample(2, 2.0), NETWORK)
    nodes = [(g, 5, 1, 3, 0.5, "a", m) for g, m in ((1, 0), (2, 1))] + [(g, 5, 2, 3, 0.0, "b", None) for g in (1, 2)]
    nodes += [(g, 5, 3, None, 7.0, "R", None) for g in (1, 2)]
    genes = spark.createDataFrame(nodes, "gen long, locus long, node_id int, parent_id int, time double, pop_id string, hpath long")
    got = rows(coalescent.branch_population_segments(genes, pops).select("gen", "node_id", "segment_pop", "t0", "t1"))
    assert got == [
        (1, 1, "R", 3.0, 7.0), (1, 1, "X", 1.0, 3.0), (1, 1, "a", 0.5, 1.0), (1, 2, "R", 3.0, 7.0), (1, 2, "Y", 1.0, 3.0), (1, 2, "b", 0.0, 1.0),
        (2, 1, "R", 6.0, 7.0), (2, 1, "Y", 2.0, 6.0), (2, 1, "a", 0.5, 2.0), (2, 2, "R", 6.0, 7.0), (2, 2, "Y", 2.0, 6.0), (2, 2, "b", 0.0, 2.0),
    ]
    rates = pops.select("gen", F.lit(5).alias("locus"), "node_id", F.lit(2.0).alias("rate"), F.lit(1.0).alias("mu"), F.lit(0.5).alias("nu"))
    per_rate = -0.5 * math.log(2 * math.pi * 0.5) - math.log(2) - (math.log(2) + 0.25) ** 2
    lnp = [r.lnp for r in coalescent.branch_rate_log_prior(rates, pops, "lognormal").collect()]
    assert lnp == pytest.approx([5 * per_rate] * 2)  # mirrors have no rate of their own
    with pytest.raises(ValueError, match="networks"):
        coalescent.branch_rate_log_prior(rates, pops, "corr_gamma")
    with pytest.raises(Exception, match="no such population: c"):
        coalescent.branch_population_segments(genes.withColumn("pop_id", F.lit("c")), pops).collect()


def _climbed(branch, tree):
    """The pieces of one branch, one population at a time."""
    pop, t0, end, mask = branch
    pieces = []
    while pop is not None and t0 < end:
        up = tree[pop][0]
        t1 = end if up is None or tree[up][1] is None else min(end, tree[up][1])
        if t1 > t0:
            pieces.append((pop, t0, t1))
        event, mirror = tree[up][2:] if up is not None else (None, None)
        pop, t0 = mirror if mirror is not None and mask >> event & 1 else up, max(t0, t1)
    return pieces


def _random_network(rng, size):
    """Ages rise with the number; null ages, hybridizations and edges without duration included."""
    ages = [float(i // 2) for i in range(size)]
    tree = {}
    for i in range(size):
        up = rng.randrange(i + 1, size) if i < size - 1 else None
        other = rng.randrange(i + 1, size) if i < size - 1 and rng.random() < 0.4 else None
        tree[f"p{i}"] = (up and f"p{up}", None if i and rng.random() < 0.1 else ages[i], None if other is None else rng.randrange(64), other and f"p{other}")
    return tree


@pytest.mark.parametrize("parts", [1, 3])
def test_segments_across_arrow_batches(spark, parts):
    """Trees and their branches are cut by the ends of batches; branches without a tree or an age have no segment."""
    rng = random.Random(11)
    trees = {gen: _random_network(rng, 2 + 5 * gen) for gen in range(8)}
    nodes, want = [], []
    for gen, locus in itertools.product(range(9), range(12)):
        mask = rng.getrandbits(63)
        pop = f"p{rng.randrange(len(trees.get(gen, 'ab')))}"
        time, end = rng.random() * 5, rng.random() * 40
        nodes += [(gen, locus, 1, 2, time, pop, mask), (gen, locus, 2, None, end, "p1", None), (gen, locus, 3, 2, None, "p0", None)]
        if gen in trees:
            want += [(gen, locus, 1, *piece) for piece in _climbed((pop, time, end, mask), trees[gen])]
    genes = spark.createDataFrame(nodes, "gen long, locus long, node_id int, parent_id int, time double, pop_id string, hpath long")
    pops = [(gen, p, up, tau, event, mirror) for gen, tree in trees.items() for p, (up, tau, event, mirror) in tree.items()]
    pops = spark.createDataFrame(pops, "gen long, node_id string, parent_id string, tau double, event int, mirror_id string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = rows(coalescent.branch_population_segments(genes, pops, parts))
        one = rows(coalescent.branch_population_segments(genes.filter("gen = 7"), pops.filter("gen = 7").drop("gen")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert many == sorted(want)
    assert one == sorted(w for w in want if w[0] == 7)


def test_segments_climb_outside_expressions(spark):
    """A branch's climb is no expression that is interpreted element by element (F17, F18)."""
    pops = spark.createDataFrame([(1, "a", None, 0.0)], "gen long, node_id string, parent_id string, tau double")
    genes = spark.createDataFrame([(1, 1, 1, None, 1.0, "a")], "gen long, locus long, node_id int, parent_id int, time double, pop_id string")
    plan = coalescent.branch_population_segments(genes, pops)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "collect_list" not in plan


def test_common_ancestors_of_random_trees(spark):
    rng = random.Random(3)
    nodes, want = [], {}
    for gen in range(6):
        size = 40 if gen else 1
        tops, time, parent, next_id = [rng.randrange(100) * 100 + k for k in range(size)], 0.0, {}, 20_000
        tips, when = list(tops), {t: 0.01 * (t % 3) for t in tops}
        stop = 2 if gen == 5 else 1  # the last one is two trees
        while len(tops) > stop:
            time += 1 + rng.random()
            chain = gen == 1  # a ladder
            joined = [tops.pop(0), tops.pop(0)] if chain else [tops.pop(rng.randrange(len(tops))) for _ in range(2)]
            for t in joined:
                parent[t] = next_id
            when[next_id] = time
            tops.insert(0, next_id)
            next_id += 1
        nodes += [(gen, 1, t, parent.get(t), when[t], f"s{tips.index(t)}" if t in tips else None) for t in when]
        line = lambda t: [t, *line(parent[t])] if t in parent else [t]  # noqa: B023, E731
        for a, b in itertools.combinations(range(size), 2):
            shared = [t for t in line(tips[a]) if t in line(tips[b])]
            if shared:
                want[f"s{a}", f"s{b}", gen] = when[shared[0]] - min(when[tips[a]], when[tips[b]])
    pairs = spark.createDataFrame([(f"s{a}", f"s{b}") for a, b in itertools.combinations(range(41), 2)], "label1 string, label2 string")
    df = spark.createDataFrame(nodes, "gen long, locus long, node_id long, parent_id long, time double, label string")
    got = {(r.label1, r.label2, r.gen): r.t for r in coalescent.pairwise_coalescence_time(df, pairs).collect()}
    assert got == pytest.approx(want)


def test_two_lineage_density(spark):
    ev = spark.createDataFrame([(1, 1, "A", 0.3, "COAL", -1)], "gen int, locus int, pop_id string, time double, kind string, delta_n int")
    seqin = spark.createDataFrame([(1, 1, "A", 2, 0.0, None)], "gen int, locus int, pop_id string, seqin int, tau double, parent_tau double")
    pop = spark.createDataFrame([("A", 0.5)], "pop_id string, theta double")
    got = coalescent.msc_log_density(coalescent.coalescent_waiting(coalescent.lineages_through_time(ev, seqin)), pop).first()["logpr"]
    assert got == pytest.approx(math.log(2 / 0.5) - 2 * 0.3 / 0.5)


def test_general_matrices_and_gamma_rates(spark):
    rng = np.random.default_rng(2)
    pi = rng.dirichlet(np.ones(20))
    models = spark.createDataFrame([("m", rng.random(190).tolist(), pi.tolist())], "model_id string, rates array<double>, freqs array<double>")
    br = spark.createDataFrame([("m", 0.0), ("m", 0.3), ("m", 50.0)], "model_id string, t double")
    mats = {r["t"]: np.array(r["p"]).reshape(20, 20) for r in likelihood.transition_probs_general(br, models).collect()}
    assert np.allclose(mats[0.0], np.eye(20)) and np.allclose(mats[0.3].sum(axis=1), 1) and np.allclose(mats[50.0], pi, atol=1e-6)
    for alpha in (0.05, 0.5, 1.0, 7.0):
        g = likelihood.gamma_rates(alpha, 4)
        assert g.mean() == pytest.approx(1) and all(np.diff(g) > 0)
    # Gamma(1): slices of the exponential have closed-form means
    cuts = [0, *(-math.log(1 - i / 4) for i in (1, 2, 3))]
    means = [4 * ((1 + a) * math.exp(-a) - (1 + b) * math.exp(-b)) for a, b in zip(cuts, cuts[1:])]
    assert likelihood.gamma_rates(1.0, 4)[:3] == pytest.approx(means)


def test_protein_likelihood_of_two_tips(spark):
    nodes = spark.createDataFrame(
        [(1, 1, 0, 2, 0.0, 0), (1, 1, 1, 2, 0.0, 1), (1, 1, 2, None, 0.2, None)],
        "gen int, locus long, node_id int, parent_id int, time double, seq_idx int",
    )
    pi = [0.05] * 20
    models = spark.createDataFrame([("m", [1.0] * 190, pi)], "model_id string, rates array<double>, freqs array<double>")
    br = coalescent.branches(nodes).select("gen", "locus", "node_id", F.lit("m").alias("model_id"), F.lit(0.2).alias("t"))
    pm = likelihood.transition_probs_general(br, models).select("gen", "locus", "node_id", F.lit(0).alias("cat"), "p")
    pats = spark.createDataFrame([(1, "AR", 0, 1), (1, "AA", 1, 1), (1, "XX", 2, 1)], "locus long, column string, pattern_id long, weight long")
    freqs = spark.createDataFrame([(1, pi)], "locus long, pi array<double>")
    lnl = likelihood.pattern_log_likelihood(likelihood.conditional_likelihoods(nodes, pats, pm, "AA"), freqs)
    got = {r["pattern_id"]: r["lnl"] for r in lnl.collect()}
    same = 0.05 + 0.95 * math.exp(-0.4 * 20 / 19)
    assert got[1] == pytest.approx(math.log(0.05 * same)) and got[2] == pytest.approx(0)
    assert got[0] == pytest.approx(math.log(0.05 * (1 - same) / 19))


def test_closure_of_a_long_chain(spark):
    df = spark.createDataFrame([(1, i, i + 1 if i < 10 else None) for i in range(11)], "t int, node_id int, parent_id int")
    out = pops.ancestor_closure(df, ["t"])
    assert out.count() == 66 and out.agg(F.max("dist")).first()[0] == 10


def test_alignment_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 6\na^x  ACG\nTAC\nb^y  AC-GRN\n\n1 4\nc^z acgt\ntrailing words\n")
    got = rows(text.read_alignments(spark, str(tmp_path / "a.txt")).select("locus", "seq_idx", "label", "sequence"))
    assert got == [(1, 0, "a^x", "ACGTAC"), (1, 1, "b^y", "AC-GRN"), (2, 0, "c^z", "acgt")]
    (tmp_path / "i.txt").write_text("2 6\na ACG\nb TTT\n\nTAC\nGGG\n")
    got = rows(text.read_alignments(spark, str(tmp_path / "i.txt"), interleaved=True).select("label", "sequence"))
    assert got == [("a", "ACGTAC"), ("b", "TTTGGG")]
    for bad in ("2 4\na ACGT\n", "1 4\na AC.T\n", "1 5\na ACGT\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match="too few|wrong length"):
            text.read_alignments(spark, str(tmp_path / "bad.txt")).collect()


def test_side_files(spark, tmp_path):
    (tmp_path / "imap").write_text("# note\na A\n\n* x\nb B\n")
    assert rows(text.read_imap(spark, str(tmp_path / "imap"))) == [("a", "A"), ("b", "B")]
    (tmp_path / "dup").write_text("a A\na B\n")
    with pytest.raises(Exception, match="duplicate"):
        text.read_imap(spark, str(tmp_path / "dup")).collect()
    (tmp_path / "parts").write_text("1-3, DNA, JC69\n4, AA, lg\n")
    parts = text.read_partitions(spark, str(tmp_path / "parts"))
    assert rows(parts) == [(1, 3, "DNA", "JC69"), (4, 4, "AA", "LG")] and align.validate_partitions(parts).count() == 0
    (tmp_path / "traits").write_text("2 3 D\nA 01{02}\nB ?-1\n2 1 C 0.5 1.25\nA 0.1\nB -2\n")
    traits = text.read_traits(spark, str(tmp_path / "traits"))
    assert rows(traits.filter("dtype = 'D'").select("label", "state_mask")) == [("A", 1), ("A", 2), ("A", 5), ("B", 2), ("B", 1023), ("B", 1023)]
    assert rows(traits.filter("dtype = 'C'").select("label", "value", "ldet")) == [("A", 0.1, 1.25), ("B", -2.0, 1.25)]


def test_bad_trace_rows(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("Gen\ta\tb\n1\t1\t2\n2\t1\n3\t3\t4\t9\n4\t5\tx\n5\t6\t-\n")
    assert rows(text.read_trace(spark, str(path)).select("gen", "param", "value").na.fill(-9.0)) == [
        (1, "a", 1.0), (1, "b", 2.0), (3, "a", 3.0), (3, "b", 4.0), (5, "a", 6.0), (5, "b", -9.0)
    ]
    for lines in ("Gen\ta\n1\n2\t1\n", "Gen\ta\n1\t1\n2\n3\n4\t1\n"):
        path.write_text(lines)
        with pytest.raises(Exception, match="bad rows"):
            text.read_trace(spark, str(path)).collect()


def test_trace_text_layout(spark):
    df = make_trace(spark, [0.123456789], param="theta:1").unionByName(make_trace(spark, [-10.98765], param="lnL"))
    assert rows(sinks.wide_trace(df, ["theta:1", "lnL"])) == [("c", 1, "0.123457", "-10.988")]


def test_migration_history_text(spark, tmp_path):
    (tmp_path / "x.L7.txt").write_text("A:0.1*B&A$0.3*C&B;A:;C:0.2*D&C;\n")
    history = text.read_migration_history(spark, str(tmp_path / "x.L7.txt"))
    got = rows(text.mark_crossings(history, spark.createDataFrame([("B", "C")], "label string, parent string")).na.fill(-1).na.fill("-"))
    assert sorted(got) == [
        (7, 1, 0, "A", 0, 0.1, "A", "B", False), (7, 1, 0, "A", 1, 0.3, "B", "C", True), (7, 1, 1, "A", -1, -1.0, "-", "-", False),
        (7, 1, 2, "C", 0, 0.2, "C", "D", False),
    ]


def test_missing_samples_take_no_part(spark):
    values = [None, 1.0, 2.0, 3.0, None, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, None]
    df = make_trace(spark, values, param="a").unionByName(make_trace(spark, [None, None], param="b"))
    got = {x.param: (x["median"], x.q025, x.q975) for x in trace.trace_quantiles(df).collect()}
    assert got == {"a": (5.0, 1.0, 9.0), "b": (None, None, None)}
    assert {x.param: x.hpd_lo for x in trace.hpd_interval(df).collect()} == {"a": 1.0, "b": None}
    long = [float((i * 37) % 61) for i in range(61)]
    some = make_trace(spark, [*long[:20], None, *long[20:]], param="a")
    assert trace.ess(some).collect()[0].ess is not None


def test_control_characters_are_fatal(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1 4\na^A A\x01CGT\n")
    with pytest.raises(Exception, match="control character"):
        text.read_alignments(spark, str(tmp_path / "c.txt")).collect()


def test_t92_uses_the_gc_share_only(spark):
    p = [
        likelihood.transition_probs(
            spark.createDataFrame([("T92", 0.3, 2.0, f)], "model string, t double, kappa double, freqs array<double>")
        ).collect()[0].p
        for f in ([0.3, 0.2, 0.15, 0.35], [0.35, 0.15, 0.2, 0.3])
    ]
    assert p[0] == pytest.approx(p[1]) and all(sum(p[0][i : i + 4]) == pytest.approx(1) for i in range(0, 16, 4))


def pooled(spark, chains):
    data = [(c, i + 1, "p", float(v)) for c, values in chains.items() for i, v in enumerate(values)]
    out = trace.multi_chain_summary(spark.createDataFrame(data, "chain string, gen long, param string, value double"))
    return {(r.pooled, r.chain): r for r in out.collect()}


def test_pool_of_chains_with_and_without_names(spark):
    rng = random.Random(2)
    chains = {None: [rng.gauss(0, 1) for _ in range(40)], "": [rng.gauss(1, 1) for _ in range(30)], "b": [rng.gauss(2, 1) for _ in range(50)]}
    got = pooled(spark, chains)
    assert set(got) == {(False, None), (False, ""), (False, "b"), (True, None)}
    every = sum(chains.values(), [])
    one = trace.trace_summary(make_trace(spark, every)).collect()[0]
    whole = got[True, None]
    assert whole.n == 120 and all(whole[c] == pytest.approx(one[c]) for c in trace.STATISTICS)
    for name, values in chains.items():
        one = trace.trace_summary(make_trace(spark, values)).collect()[0]
        assert all(got[False, name][c] == pytest.approx(one[c]) for c in trace.STATISTICS)


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", ["written", "committed"])
def test_samples_survive_a_failure_inside_a_batch(spark, tmp_path, step):
    """Whether the data or also the manifest was written: the replay gives every sample once."""
    source, ck, sink = (str(tmp_path / x) for x in ("in", "ck", "out"))
    want = {("c", g, p): float(g) for g in range(1, 41) for p in ("x", "y")}
    data = spark.createDataFrame([(c, g, p, v) for (c, g, p), v in want.items()], monitor.TRACE_SCHEMA)
    for low, high in ((31, 40), (1, 20), (11, 30)):  # files out of order, and a run that went back
        data.filter(F.col("gen").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        calls = []

        def fail(at):
            calls.append(at)
            if at == step:
                raise Lost(at)

        stream = monitor.stream_trace(spark, source)
        with pytest.raises(Exception, match="Lost"):
            monitor.stream_resume(stream, ck, sink, on_step=fail).awaitTermination()
        assert calls[-1] == step
        before = monitor.durable_samples(spark, sink)
        assert before.count() == before.dropDuplicates().count()
        monitor.stream_resume(monitor.stream_trace(spark, source), ck, sink).awaitTermination()
        if low == 1:
            monitor.compact(spark, sink)
            monitor.compact(spark, sink)
    got = monitor.durable_samples(spark, sink).collect()
    assert len(got) == len(want) and {(r.chain, r.gen, r.param): r.value for r in got} == want


def test_tree_counts_survive_a_failure(spark, tmp_path):
    source, ck, sink = (str(tmp_path / x) for x in ("in", "ck", "out"))
    assert [df.count() for df in monitor.topology_state(spark, sink)] == [0, 0]
    for part in range(5):
        texts = [("c", part * 10 + i, "((A,B),C);" if i % 2 else "(B,(A,C));") for i in range(4)]
        spark.createDataFrame(texts, monitor.TREE_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = lambda **kw: monitor.stream_topology_posterior(
            monitor.stream_trace(spark, source, monitor.TREE_SCHEMA), ck, sink, available_now=True, slots=2, **kw
        ).awaitTermination()
        if part == 2:
            def fail(at):
                raise Lost(at)

            with pytest.raises(Exception, match="Lost"):
                stream(on_step=fail)
            assert rows(monitor.topology_state(spark, sink)[0]) == [("((A,B),C);", 4), ("((A,C),B);", 4)]
        stream()
        topologies, found = monitor.topology_state(spark, sink)
        n = 2 * (part + 1)
        assert rows(topologies) == [("((A,B),C);", n), ("((A,C),B);", n)]
        assert rows(found) == [(["A", "B"], n), (["A", "C"], n)]


@pytest.mark.parametrize("tile", [1, 2, 3, 128])
def test_differences_of_tiles(spark, tile):
    rng = random.Random(9)
    data = [(locus, "".join(rng.choice("12489") for _ in range(n)), k, rng.randint(1, 5)) for locus, n in ((1, 7), (2, 2), (3, 1)) for k in range(25)]
    data.append((4, "é1\U0001f600", 0, 2))
    df = spark.createDataFrame(data, "locus long, column string, pattern_id long, weight long").repartition(5)
    want = {}
    for locus, column, _, weight in data:
        for j1 in range(len(column)):
            for j2 in range(j1):
                old = want.get((locus, j1, j2), (0, 0))
                want[locus, j1, j2] = old[0] + weight * (column[j1] != column[j2]), old[1] + weight
    got = {(r.locus, r.j1, r.j2): (r.diff, r.p) for r in align.pairwise_differences(df, tile).collect()}
    assert got == {k: (d, pytest.approx(d / n)) for k, (d, n) in want.items()}


def test_gamma_rates_of_many_shapes_at_once():
    shapes = np.array([0.02, 0.3, 1.0, 2.5, 40.0])
    together = likelihood.gamma_rates(shapes, 5)
    assert together.shape == (5, 5) and np.allclose(together.mean(axis=1), 1)
    for alpha, rates in zip(shapes, together):
        assert rates == pytest.approx(likelihood.gamma_rates(float(alpha), 5), rel=1e-12)
    # P(2, x) = 1 - (1 + x) exp(-x), on both sides of the change of method
    x = np.array([0.0, 1e-9, 0.5, 2.9, 3.1, 30.0])
    assert likelihood._gamma_p(np.full(6, 2.0), x) == pytest.approx(1 - (1 + x) * np.exp(-x), abs=1e-14)
    assert likelihood.gamma_rates(0.7, 1).tolist() == [1.0]


@pytest.mark.parametrize("registry", [1000, 1])
def test_protein_models_from_files(spark, tmp_path, monkeypatch, registry):
    """The published layout: a lower triangle and frequencies; many models are joined, few are sent to the tasks."""
    monkeypatch.setattr(likelihood, "REGISTRY_MODELS", registry)
    rng = np.random.default_rng(6)
    lower = {name: np.tril(rng.random((20, 20)), -1) for name in ("one", "two")}
    pi = {name: rng.dirichlet(np.ones(20)) for name in lower}
    for name, triangle in lower.items():
        lines = [" ".join(f"{x:.12f}" for x in triangle[i, :i]) for i in range(1, 20)]
        (tmp_path / f"{name}.dat").write_text("\n".join(lines) + "\n\n" + " ".join(f"{x:.12f}" for x in pi[name]) + "\n\nA R N D are the states\n")
    models = text.read_protein_models(spark, str(tmp_path))
    br = spark.createDataFrame([("one", 0.3, 1), ("two", 0.0, 2), ("two", 1.7, 3), ("one", 2.5, 4)], "model_id string, t double, n int")
    for row in likelihood.transition_probs_general(br, models).collect():
        q = (lower[row.model_id] + lower[row.model_id].T) * pi[row.model_id]
        q -= np.diag(q.sum(axis=1))
        q /= -(pi[row.model_id] * np.diag(q)).sum()
        expected = np.linalg.matrix_power(np.eye(20) + q * row.t / 2**24, 2**24)
        assert np.allclose(np.array(row.p).reshape(20, 20), expected, atol=1e-5)
    (tmp_path / "short.dat").write_text("1 2 3\n")
    with pytest.raises(Exception, match="not 190 rates"):
        text.read_protein_models(spark, str(tmp_path)).collect()


def test_protein_summary(spark):
    pats = spark.createDataFrame([(1, "AR", 0, 2), (1, "AB", 1, 1), (2, "XX", 0, 1)], "locus long, column string, pattern_id long, weight long")
    models = spark.createDataFrame([(1, "free"), (2, "m")], "locus long, model string")
    fixed = spark.createDataFrame([("m", [0.05] * 20)], "model_id string, freqs array<double>")
    one, two = align.protein_summary(pats, models, fixed).orderBy("locus").collect()
    assert one[:6] == (1, "free", 2, 3, 1, 2) and two[:6] == (2, "m", 2, 1, 1, 1)
    # three A, two R, one B that is N or D
    assert one.freqs[:4] == pytest.approx([3 / 7, 2 / 7, 1 / 7, 1 / 7]) and sum(one.freqs) == pytest.approx(1)
    assert two.freqs == [0.05] * 20


def test_many_sampled_trees_of_one_locus(spark, monkeypatch):
    """The trees of a locus are dealt to several tasks; each still meets every pattern block once."""
    trees = [(g, 1, n, p, t * (1 + g / 10), s) for g in range(12) for n, p, t, s in ((0, 2, 0.0, 0), (1, 2, 0.0, 1), (2, None, 0.1, None))]
    nodes = spark.createDataFrame(trees, "gen int, locus long, node_id int, parent_id int, time double, seq_idx int")
    br = coalescent.branches(nodes).select("gen", "locus", "node_id", (F.col("parent_time") - F.col("time")).alias("t"), F.lit("JC69").alias("model"))
    pm = likelihood.transition_probs(br).select("gen", "locus", "node_id", F.lit(0).alias("cat"), "p")
    pats = spark.createDataFrame([(1, "11", 0, 3), (1, "12", 1, 2), (1, "ff", 2, 1)], "locus long, column string, pattern_id long, weight long")
    freqs = spark.createDataFrame([(1, [0.25] * 4)], "locus long, pi array<double>")
    monkeypatch.setattr(likelihood, "PATTERN_BLOCK", 2)
    monkeypatch.setattr(likelihood, "TREE_BLOCK", 4)
    root = likelihood.conditional_likelihoods(nodes, pats, pm)
    assert root.count() == 36
    for row in likelihood.locus_log_likelihood(root, freqs).collect():
        e = math.exp(-4 / 3 * 0.2 * (1 + row.gen / 10))
        assert row.logl == pytest.approx(3 * math.log(0.25 * (0.25 + 0.75 * e)) + 2 * math.log(0.25 * (0.25 - 0.25 * e)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_populations_deal_no_rows(spark):
    """A species tree's rates and sizes reach the rows as they lie: no shuffle by population, which would be a task a population."""
    life = [("A", 0.0, 0.05), ("R", 0.0, 0.05), ("S", 0.05, None)]
    lifetimes = spark.createDataFrame(life, "node_id string, tau double, parent_tau double")
    ltt = spark.createDataFrame([(1, 0, "A", 0.0, 0.02, 3, "COAL"), (1, 0, "R", 0.01, 0.07, 2, "TAU")], "gen long, locus long, pop_id string, t0 double, t1 double, n long, kind string")
    pops = spark.createDataFrame([("A", 0.01), ("R", 0.02)], "pop_id string, theta double")
    spec = spark.createDataFrame([("R", "A", 0.5, 2.0, 4.0), ("A", "R", 0.7, 2.0, 4.0)], "source string, target string, rate double, alpha double, beta double")
    counts = spark.createDataFrame([(1, 0, "R", "A", 2)], "gen long, locus long, source string, target string, n long")
    exposure = coalescent.migration_exposure(ltt, lifetimes, spec)
    assert rows(exposure.select("source", "target", F.round("w_time", 9))) == [("A", "R", 0.08), ("R", "A", 0.06)]
    density = coalescent.msc_migration_log_density(ltt, pops, spec.select("source", "target", "rate"), counts, lifetimes)
    conditional = coalescent.migration_conditional(counts, exposure, spec)
    assert rows(conditional.select("source", "a1", F.round("b1", 9))) == [("A", 2.0, 4.08), ("R", 4.0, 4.06)]
    assert density.count() == 2
    by_pop = coalescent.msc_log_density(coalescent.coalescent_waiting(ltt), pops)
    for df, key, joins in ((exposure, "pop_id", 1), (by_pop, "pop_id", 1), (density, "pop_id", 2), (density, "source", 1), (conditional, "source", 1)):
        assert plan(df).count(f"BroadcastHashJoin [{key}#") >= joins


def test_nodes_deal_no_rates(spark):
    sample = spark.createDataFrame([("c", 1, "W:1->2", 3.0), ("c", 1, "theta:4", 2.0)], "chain string, gen long, param string, value double")
    out = trace.w_to_m(sample, spark.createDataFrame([("2", "4")], "node string, linked_to string"))
    assert rows(out) == [("c", 1, "M:1->2", 1.5)] and "hashpartitioning(node#" not in plan(out)


def test_factors_deal_no_iterations(spark):
    schema = "chain string, gen long, param string"
    theta, w = (spark.createDataFrame([("c", g, p) for g in gens], schema) for p, gens in (("t", (1, 2)), ("w", (2, 3))))
    out = conditionals.unmatched_iterations(theta, w, spark.createDataFrame([("M", "t", "w")], "param string, theta string, w string"))
    assert rows(out) == [("c", "M", 1, "theta"), ("c", "M", 3, "w")]
    assert "hashpartitioning(theta#" not in plan(out) and "hashpartitioning(w#" not in plan(out)


def test_records_of_a_long_locus_are_folded_line_by_line():
    lines = [x for name in "ab" for x in (f" {name}^x\tAC j-", *["GT" * 30] * 20_000)]
    assert text._records([*lines, "text after the locus"], 2, 1_200_003, False) == [(f"{name}^x", "AC-" + "GT" * 600_000) for name in "ab"]
    turns = ["a AC", "b GT", *["AAAA", "CCCC"] * 20_000, "more"]
    assert text._records(turns, 2, 80_002, True) == [("a", "AC" + "A" * 80_000), ("b", "GT" + "C" * 80_000)]
    assert text._records(["a AC"], 0, 4, True) == text._records([], 2, 4, False) == []


def test_columns_of_uneven_and_other_characters(spark):
    df = spark.createDataFrame([(7, 1, "AC𝔾T"), (7, 0, "ééN"), (7, 2, ""), (8, 0, "A" * 600), (9, 0, None)], "locus long, seq_idx int, sequence string")
    got = rows(align.site_columns(df.filter("locus <> 8")))
    assert got == [(7, 0, "éA"), (7, 1, "éC"), (7, 2, "N𝔾"), (7, 3, "T")]
    plan = align.site_columns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(sequence(" not in plan  # not a lambda for every site
    (one,) = align.compress_patterns(align.site_columns(df.filter("locus = 8"))).collect()
    assert (one.column, one.pattern_id, one.weight) == ("1", 0, 600)


@pytest.mark.parametrize("jc69", [False, True])
def test_patterns_are_made_where_columns_are(spark, monkeypatch, jc69):
    """No column is shuffled; loci of several runs, uneven, repeated and null ones give the same patterns."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    df = [(1, 0, text(700)), (1, 1, text(650)), (2, 0, text(40)), (2, 0, text(40)), (None, 0, text(300)), (3, 0, None), (4, 0, ""), (5, 1, "AC"), (5, 0, "GGT")]
    columns = align.site_columns(spark.createDataFrame(df, "locus long, seq_idx int, sequence string"), 16)
    plain = rows(align.compress_patterns(columns.select("*"), jc69=jc69).fillna(-1))
    monkeypatch.setattr(align, "SITES_A_TASK", 64)
    out = align.compress_patterns(columns, jc69=jc69)
    assert rows(out.fillna(-1)) == plain and len({r[0] for r in plain}) == 4
    assert "min(site" not in out._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="illegal sequence characters"):
        one = align.site_columns(spark.createDataFrame([(1, 0, "Aß")], "locus long, seq_idx int, sequence string"))
        align.compress_patterns(one, "AA").collect()


def test_segments_meet_the_rates_of_a_sample_in_one_shuffle(spark):
    segments = spark.createDataFrame(
        [(g, l, n, p, 0.0, 1.0 + (g or 0) + n) for g in (1, 2, None) for l in (1, 2) for n in (1, 2) for p in ("A", "B", None)],
        "gen long, locus long, node_id int, segment_pop string, t0 double, t1 double",
    )
    # a rate that comes twice counts twice, as in a join; B has none in sample 2
    rates = spark.createDataFrame([(1, "A", 2.0), (1, "A", 3.0), (1, "B", None), (2, "A", 1.5), (3, "A", 1.0), (None, "A", 1.0), (1, None, 1.0)], "gen long, segment_pop string, rate double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = coalescent.relaxed_branch_lengths(segments, rates)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert rows(out) == [(g, l, n, (1.0 + g + n) * f) for g, f in ((1, 5.0), (2, 1.5)) for l in (1, 2) for n in (1, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_empty_sequence_has_no_characters(spark):
    df = spark.createDataFrame([(1, 0, "AN"), (1, 1, ""), (2, 0, None), (3, 0, "")], "locus long, seq_idx int, sequence string")
    assert rows(align.encode_states(align.sites_long(df))) == [(1, 0, 0, "A", 1), (1, 0, 1, "N", 15)]
    with pytest.raises(Exception, match="illegal character: "):
        align.encode_states(spark.createDataFrame([(1, 0, 0, "")], "locus long, seq_idx int, site int, base string")).collect()


@pytest.mark.parametrize("bad", ["A1", "E", "é"])
def test_codes_are_no_characters_of_an_alignment(spark, bad):
    with pytest.raises(Exception, match="illegal sequence characters"):
        align.compress_patterns(spark.createDataFrame([(1, 0, bad)], "locus long, site long, column string")).collect()


def test_expansion_reads_its_patterns_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(column):
        read.add(1)
        return column

    pats = spark.createDataFrame([(1, 0, "5", 1), (2, 0, "1", 2)], "locus long, pattern_id long, column string, weight long")
    pats = pats.withColumn("column", F.udf(count)("column"))
    dips = spark.createDataFrame([(1, 0), (2, 0)], "locus long, seq_idx int")
    out = phase.diploid_expand(pats, dips, spark.createDataFrame([], "locus long, pattern_id long, seq_idx long")).columns
    assert rows(out.select("locus", "resolution_idx", "column")) == [(1, 0, "14"), (1, 1, "41"), (2, 0, "11")]
    assert read.value == 2


def test_sequences_follow_the_regular_expressions(spark, tmp_path):
    texts = [None, "", "a", "no été 𝔾𝔾 - qQzZ~\n ÿĀ then EeAaTt", "x" * 9]
    docs = [(i, "s", t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.locus, x.seq_idx): x.sequence for x in adapters.sequences(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        for k, (pattern, groups) in enumerate(adapters.DEALS):
            padded = None if t is None else t + "~" * (-len(t) % 4)
            kept = padded and re.sub(pattern, lambda m: "".join(x or "" for x in m.groups()), padded)
            coded = kept and re.sub("[^ACGTYN-]", "N", kept.translate(str.maketrans(adapters.LETTERS, adapters.BASES)))
            assert got[i, k] == coded, (i, k)
