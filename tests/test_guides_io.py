import math
import random

from kinetoflow.functions import dna
from kinetoflow.operators import align, diffexp, es, guides, peptides
from kinetoflow.options import EngineOptions, from_arguments
from kinetoflow.sources import readers, writers
from kinetoflow.streaming import histogram
import numpy as np
from pyspark.sql import functions as F
import pytest


def score(a, b):
    return sum(2 if x == y else 1 if (x, y) in (("A", "G"), ("C", "T")) else -2 for x, y in zip(a, b))


def test_window_scores_against_all_pairs(spark):
    rnd = random.Random(5)
    m = "".join(rnd.choice("ACGT") for _ in range(70))
    g = "GG" + m[10:45] + "TTACG"
    got = {(r["g"], r["m"], r["score"]) for r in guides.window_scores(spark.createDataFrame([("g", g)], "guide string, gseq string"), spark.createDataFrame([("m", m)], "target string, mseq string")).collect()}
    want = {(i, j, s) for i in range(len(g) - 25) for j in range(len(m) - 25) if (s := score(g[i : i + 25], m[j : j + 25])) > 32}
    assert got == want and want


@pytest.mark.parametrize("k,least", [(25, 32), (25, 44), (12, 10), (12, 23), (7, 3)])
def test_window_scores_of_planted_and_random_texts(spark, k, least):
    rnd = random.Random(k * least)
    texts = ["".join(rnd.choice("ACGTNR-" if j % 3 == 0 else "ACGT") for _ in range(rnd.randint(0, 90))) for j in range(9)] + [None, "", "A" * 40, "T" * 40]
    guides_ = [(f"g{j}", t) for j, t in enumerate(texts[:5])]
    for j, t in enumerate(texts[:9]):  # copies with wobble pairs and changes
        guides_.append((f"p{j}", "".join(rnd.choice({"T": "CT", "G": "AG"}.get(c, c)) if rnd.random() < 0.5 else rnd.choice("ACGT") if rnd.random() < 0.1 else c for c in t[5:60])))
    targets_ = [(f"m{j}", t) for j, t in enumerate(texts)]
    got = sorted(tuple(r) for r in guides.window_scores(spark.createDataFrame(guides_, "guide string, gseq string"), spark.createDataFrame(targets_, "target string, mseq string"), k, least).collect())
    want = []
    for a, g in guides_:
        for b, m in targets_:
            for i in range(len(g or "") - k):
                for j in range(len(m or "") - k):
                    pairs = [2 if x == y else 1 if (x, y) in (("A", "G"), ("C", "T")) else -2 for x, y in zip(g[i : i + k], m[j : j + k])]
                    if sum(pairs) > least:
                        want.append((a, b, i, j, sum(pairs), pairs.count(1), pairs.count(-2)))
    assert got == sorted(want) and want


def test_extended_windows_gain_and_end_where_they_should(spark):
    rnd = random.Random(8)
    m = "".join(rnd.choice("ACGT") for _ in range(120))
    g = m[3:50] + "".join(rnd.choice("ACGT") for _ in range(20)) + m[60:110]
    own, other = spark.createDataFrame([("g", g)], "guide string, gseq string"), spark.createDataFrame([("m", m)], "target string, mseq string")
    hits = guides.extend_hits(guides.window_scores(own, other), own, other).collect()
    options = EngineOptions()
    for h in hits:
        assert h.gr - h.gl == h.mr - h.ml and (h.g - h.gl) % 4 == 0 and (h.gr - h.g - 25) % 4 == 0 and h.ml - h.gl == h.m - h.g
        pairs = [2 if x == y else 1 if (x, y) in (("A", "G"), ("C", "T")) else -2 for x, y in zip(g[h.gl : h.gr], m[h.ml : h.mr])]
        assert (pairs.count(1), pairs.count(-2)) == (h.gu, h.mm)
        if h.gu < options.gu_max and h.mm < options.mm_max:  # it ended as neither side gains
            assert h.gl <= 4 or h.ml <= 4 or score(g[h.gl - 4 : h.gl], m[h.ml - 4 : h.ml]) <= 0
            assert h.gr + 4 >= len(g) or h.mr + 4 >= len(m) or score(g[h.gr : h.gr + 4], m[h.mr : h.mr + 4]) <= 0
    assert any(h.gr - h.gl > 40 for h in hits)
    with pytest.raises(ValueError):
        guides.window_scores(own, other, 40, 70)


def expand(w, rf, at, state, s, out):
    """All states of a duplex, by the rules, without any bound."""
    score_, gu, mm, text, action = state
    i, last = len(action), at == len(rf) - 1
    if score_ >= 20 and i >= 5 and score_ >= 2.5 * i and "**" not in action and (i == len(w) - 1 or not last):
        out.add((score_, text, action))
    if i == len(w) - 1 or last:
        return
    c, n = w[i], rf[at + 1]
    if c in "TC":
        expand(w, rf, at, (score_ + 4, gu + (c == "C"), mm, text + "T", action + "+"), s, out)
    kind = "M" if c == n else "U" if (c, n) == ("A", "G") else "*"
    expand(w, rf, at + 1, (score_ + (-7 if kind == "*" else 4), gu, mm, text + n, action + kind), s, out)


def test_edit_graph_against_expansion(spark):
    w, rf = "ACTCGATCA", "GACCGAGCAGA"
    g = spark.createDataFrame([("g", w + "A")], "guide string, gseq string")
    m = spark.createDataFrame([("m", rf, [0] * (len(rf) + 1))], "target string, letters string, runs array<int>")
    got = {(r["rf_begin"], r["score"], r["aligned_rf"], r["action"]) for r in guides.edit_graph_hits(g, m, window=9, least=5, scoring=guides.Scoring(score_min=20)).collect()}
    want = set()
    for begin in range(len(rf)):
        out = set()
        expand(w, rf, begin, (0, 0, 0, "", ""), None, out)
        want |= {(begin, *x) for x in out}
    assert got == want and want


def test_edit_classes_count_the_duplexes(spark):
    rnd = random.Random(11)
    gs = [(f"g{k}", "".join(rnd.choice("ACGTT") for _ in range(14))) for k in range(3)] + [("none", None), ("brief", "ACG")]
    ms = [(f"m{k}", (t := "".join(rnd.choice("ACG") for _ in range(12))), [0] * (len(t) + 1)) for k in range(2)] + [("none", None, None), ("empty", "", [0])]
    g, m = spark.createDataFrame(gs, "guide string, gseq string"), spark.createDataFrame(ms, "target string, letters string, runs array<int>")
    scoring = guides.Scoring(score_min=10, mm_max=1, gu_max=2)
    found = guides.edit_graph_classes(g, m, window=9, least=4, scoring=scoring).collect()
    got = {tuple(r)[:-1]: r.n for r in found}
    want = {}
    for h in guides.edit_graph_hits(g, m, window=9, least=4, scoring=scoring).collect():
        marks = h.action
        wobbles = sum(a == "U" or (a == "+" and c == "C") for a, c in zip(marks, h.aligned_rd))
        key = (h.target, h.rf_begin, h.guide, h.p, len(marks), h.rf_begin + len(marks) - marks.count("+"), h.score, wobbles, marks.count("*"))
        want[key] = want.get(key, 0) + 1
    assert got == want and len(want) > 20
    assert guides.edit_graph_classes(g.limit(0), m).collect() == []


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\r\nACGT\nttaa\n\n>two\nGG\n")
    rows = [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "a.fa"), cut_names=True).orderBy("ref_idx").collect()]
    assert rows == [(0, "one", "ACGTTTAA", 8), (1, "two", "GG", 2)]
    (tmp_path / "b.fa").write_text(">one\nACXT\n")
    with pytest.raises(Exception, match="one at 3"):
        readers.read_fasta(spark, str(tmp_path / "b.fa"), strict=True).collect()
    (tmp_path / "r.fq").write_text("@a\nACGT\n+\nJJJJ\n@b\nACNT\n+\nJJJJ\nc\nAC\n+\nJJ\n@d\nAAA\n+\nJJJ\n")
    assert [(r["rd_id"], r["seq"]) for r in readers.read_fastq(spark, str(tmp_path / "r.fq")).orderBy("rd_id").collect()] == [(1, "ACGT"), (4, "AAA")]
    (tmp_path / "f.gff").write_text("#x\nc\ta\tgene\t2\t9\t.\t+\t.\tID=RPS12;Name=n\n")
    feature = readers.get_feature(readers.read_gff(spark, str(tmp_path / "f.gff")), "RPS12").first()
    assert (feature["s"], feature["tags"]["Name"]) == (2, "n")
    with pytest.raises(KeyError):
        readers.get_feature(readers.read_gff(spark, str(tmp_path / "f.gff")), "none")
    refs = align.encode_refs(readers.read_fasta(spark, str(tmp_path / "a.fa")))
    aligned = spark.createDataFrame([(0, 7, 0, 3, [1, 0, 2])], "ref_idx int, rd_id long, ref_s int, ref_e int, dr array<int>")
    writers.write_taf(aligned, refs, str(tmp_path / "taf"))
    back = readers.read_taf(spark, str(tmp_path / "taf")).first()
    assert (back["ref_s"], back["dr"]) == (0, [1, 0, 2])
    assert readers.read_taf(spark, str(tmp_path / "taf"), "path").first()["ref_s"] == -1
    writers.write_dest(es.counts(es.es_long(aligned)), refs.where("ref_idx = 0"), str(tmp_path / "one.dest"))
    table = readers.read_dest(spark, str(tmp_path / "one.dest"))
    assert table.count() == 40 * 5 and table.agg(F.sum("n")).first()[0] == 3
    lines = histogram.stream_histogram(histogram.stream_taf(spark, str(tmp_path / "taf")))
    q = lines.writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hist").count() == 3


def test_peptide_graph_and_checks(spark):
    df = spark.createDataFrame([("s", 1, "ABCDEFGHIJ"), ("s", 2, "XABCDEFGH"), ("t", 1, None)], "set string, ord long, pep string")
    edges = {(r["set"], r["k1"], r["k2"]): r["weight"] for r in peptides.kmer_graph(df, 2).collect()}
    assert edges[("s", "AB", "CD")] == 2 and all(k[0] == "s" for k in edges)
    p = spark.createDataFrame([("a", "MK-"), ("b", "M")], "name string, seq string")
    c = spark.createDataFrame([("a", "ATGAAA--", 1)], "name string, seq string, ord long")
    assert [tuple(r) for r in peptides.check_proteins(p, c).orderBy("name").collect()] == [("a", True, True), ("b", False, False)]


def test_differential(spark):
    rows = [(f"{i}:20", s, 50) for i in range(40) for s in "abcd"] + [("x:1", s, n) for s, n in zip("abcd", (2, 3, 90, 95))]
    df = spark.createDataFrame(rows, "key string, sample string, n long")
    assert all(abs(r["factor"] - 1) < 0.1 for r in diffexp.tmm_factors(df).collect())
    tested = diffexp.exact_test(df, {"a": "u", "b": "u", "c": "v", "d": "v"}, "u", "v")
    first = diffexp.top(tested, 1).first()
    assert first["key"] == "x:1" and first["fdr"] < 0.001 and first["log_fc"] > 3
    assert diffexp.exact_p(0, 0, 2, 2, 0.1) == 1.0 and abs(diffexp.exact_p(5, 5, 2, 2, 0.1) - 1.0) < 1e-9


def test_false_discovery_against_loops(spark):
    rnd = random.Random(4)
    p = [rnd.choice((rnd.random() ** 3, 0.25, 1.0, 0.0)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(p)) + [(900, None)], "key int, p_value double").repartition(5)
    found = {r["key"]: r["fdr"] for r in diffexp.false_discovery(rows).collect()}
    for k, own in enumerate(p):
        wanted = min(1.0, min(q * len(p) / sum(x <= q for x in p) for q in p if q >= own))
        assert abs(found[k] - wanted) < 1e-12
    assert found[900] is None and len(found) == 301
    assert diffexp.false_discovery(rows.limit(0)).collect() == []


def test_moderated_dispersion_against_sums_over_all_rows(spark):
    rnd = np.random.default_rng(5)
    mean, samples = rnd.choice([2, 30, 400], 150), "abcdef"
    y = np.stack([rnd.poisson(mean * rnd.gamma(1 / d, d, len(mean))) for d in [0.2] * 6], axis=1)
    y[:3] = 0
    rows = [(f"k{i:03d}", s, int(y[i, j])) for i in range(len(y)) for j, s in enumerate(samples)]
    conditions = {s: "u" if s < "d" else "v" for s in samples}
    counts = spark.createDataFrame(rows, "key string, sample string, n long").repartition(3)
    tested = {r["key"]: r for r in diffexp.exact_test(counts, conditions, "u", "v").collect()}
    sizes = {r["sample"]: r["total"] * r["factor"] for r in diffexp.library_sizes(counts).join(diffexp.tmm_factors(counts), "sample").collect()}
    common = math.exp(sum(math.log(x) for x in sizes.values()) / 6)
    scaled = np.array([[math.floor(y[i, j] * (common / sizes[s]) + 0.5) for j, s in enumerate(samples)] for i in range(len(y))], float)

    def likelihood(row, d):
        """Log probability of each group's counts given their sum, up to what does not depend on the dispersion."""
        r = 1 / d
        return sum(sum(math.lgamma(v + r) - math.lgamma(r) for v in g) - math.lgamma(sum(g) + 3 * r) + math.lgamma(3 * r) for g in (row[:3], row[3:]))

    level = [min(max(round(math.log2(sum(r) / 6 + 0.5)), 0), diffexp.LEVELS - 1) for r in scaled]
    own = [[likelihood(r, d) for d in diffexp.GRID] for r in scaled]
    full = [i for i, r in enumerate(scaled) if sum(r)]
    for i in range(len(y)):
        weights = {k: 1 / (1 + abs(level[k] - level[i])) for k in full if abs(level[k] - level[i]) <= diffexp.SPAN}
        mean_of = [sum(w * own[k][g] for k, w in weights.items()) / sum(weights.values()) for g in range(len(diffexp.GRID))]
        score = [own[i][g] + diffexp.PRIOR_DF / 4 * mean_of[g] for g in range(len(diffexp.GRID))]
        used = diffexp.GRID.index(tested[f"k{i:03d}"]["dispersion"])
        assert score[used] >= max(score) - 1e-6
    assert 0.1 < np.median([r["dispersion"] for r in tested.values()]) < 0.4
    x = np.array([1e-3, 0.3, 1.0, 7.5, 1e4, 1e7])
    assert np.allclose(diffexp._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_differential_without_replicates_or_rows(spark):
    df = spark.createDataFrame([("k1", "a", 5), ("k1", "b", 5), ("k2", "a", 90), ("k2", "b", 90), ("k3", "a", 0), ("k3", "b", 0)], "key string, sample string, n long").repartition(7)
    found = {r["key"]: r for r in diffexp.exact_test(df, {"a": "u", "b": "v"}, "u", "v").collect()}
    assert len(found) == 3 and {r["dispersion"] for r in found.values()} == {0.1} and found["k3"]["p_value"] == found["k3"]["fdr"] == 1.0
    four = {s: "u" if s < "c" else "v" for s in "abcd"}
    assert diffexp.exact_test(df.limit(0), four, "u", "v").collect() == []
    assert len(diffexp.exact_test(df, four, "u", "v").collect()) == 3  # samples without rows count as zeros


def test_options():
    assert from_arguments(["--seed", "8", "--mode", "editing"]).seed == 8
    for bad in ({"seed": "x"}, {"overlap_min": -1}, {"mode": "none"}):
        with pytest.raises(ValueError):
            EngineOptions().set(**bad)
    with pytest.raises(KeyError):
        EngineOptions().set(nothing=1)


def test_fastq_records_lie_in_the_order_of_their_numbers(spark, tmp_path):
    """Also where the join that numbers records shuffles them."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        r = align.encode_refs(spark.createDataFrame([(0, "r", "ACGTTACGGATTTACAG" * 9)], "ref_idx int, ref_name string, seq string"))
        own = spark.range(900).select(F.lit(0).alias("ref_idx"), ((F.col("id") * 7919) % 900).alias("rd_id"), (F.col("id") % 50).cast("int").alias("ref_s"), F.array([F.lit(0)] * 12).alias("dr"))
        own = own.repartition(11).withColumn("ref_e", F.col("ref_s") + 12)
        writers.write_fastq(own, r, str(tmp_path / "fq"))
        found = sorted(map(tuple, readers.read_fastq(spark, str(tmp_path / "fq")).select("rd_id", "name").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == [(i, f"tal{i}") for i in range(1, 901)]


def test_edit_graph_expands_each_window_once(spark):
    """Windows are dealt out before they are expanded, equal ones of several guides once; paths are those of their actions."""
    m = spark.createDataFrame([("m0", "GGACAGAAGCA", [1, 0, 2, 0, 1, 0, 0, 3, 0, 1, 0, 2]), ("m1", "AGGACAG", [0] * 8)], "target string, letters string, runs array<int>")
    seq = "GATCATTAGAATCA"
    names = [f"g{i}" for i in range(5)]
    g = spark.createDataFrame([(n, seq) for n in names] + [("g0", seq), ("other", "A" + seq)], "guide string, gseq string").coalesce(1)
    hits = guides.edit_graph_hits(g, m, window=9, least=5, scoring=guides.Scoring(score_min=20))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(w" in plan[plan.index("MapInPandas") :]
    rows = hits.withColumn("again", F.array_join(dna.edit_path(F.col("action"), F.col("rf_begin"), F.when(F.col("target") == "m1", F.array([F.lit(0)] * 8)).otherwise(F.array(*[F.lit(x) for x in (1, 0, 2, 0, 1, 0, 0, 3, 0, 1, 0, 2)]))).cast("array<string>"), ",")).collect()
    assert all(r["path"] == r["again"] for r in rows)
    by = {n: sorted((r["target"], r["rf_begin"], r["p"], r["score"], r["aligned_rf"], r["action"]) for r in rows if r["guide"] == n) for n in [*names, "other"]}
    assert by["g0"] and all(by[n] == by["g0"] for n in names) and len(set(by["g0"])) == len(by["g0"])
    assert [(t, b, p + 1, *x) for t, b, p, *x in by["g0"]] == [x for x in by["other"] if x[2] > 0]


def test_edit_graph_classes_grow_each_window_once(spark, monkeypatch):
    """States are kept for windows, not for each guide that has them; guides of one name, and repeated ones, add up."""
    m = spark.createDataFrame([("m0", "GGACAGAAGCA"), ("m1", "AGGACAG")], "target string, letters string")
    seq, scoring = "GATCATTAGAATCA", guides.Scoring(score_min=20)
    one = lambda rows: {tuple(r)[:2] + tuple(r)[3:-1]: r["n"] for r in guides.edit_graph_classes(spark.createDataFrame(rows, "guide string, gseq string"), m, window=9, least=4, scoring=scoring).collect()}
    sizes, real = [], guides.keep

    def counted(df):
        kept = real(df)
        sizes.extend([kept.count()] if "score" in df.columns else [])
        return kept

    monkeypatch.setattr(guides, "keep", counted)
    alone = one([("g", seq)])
    small, sizes[:] = list(sizes), []
    rows = guides.edit_graph_classes(spark.createDataFrame([(f"g{i}", seq) for i in range(7)], "guide string, gseq string"), m, window=9, least=4, scoring=scoring).collect()
    assert sizes == small and alone and len(rows) == 7 * len(alone)
    assert all(alone[tuple(r)[:2] + tuple(r)[3:-1]] == r["n"] for r in rows)
    other = one([("g", "TTAGGAATTCAGGA")])
    both = {k: 2 * alone.get(k, 0) + other.get(k, 0) for k in alone | other}
    assert one([("g", seq), ("g", seq), ("g", "TTAGGAATTCAGGA")]) == both
