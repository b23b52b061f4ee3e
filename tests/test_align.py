import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kinetoflow.functions import dna
from kinetoflow.operators import align, assembly, es
from kinetoflow.operators.store import keep
from kinetoflow.options import EngineOptions

SMALL = EngineOptions(seed=4, min_segment=5)  # the worked examples skip the length gate of reads, 8 + 4 letters
REF = "AAAGGTTTGGATTTCGCCGATGC"


def refs(spark, *seqs):
    return align.encode_refs(spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(seqs)], "ref_idx int, ref_name string, seq string"))


def reads(spark, *seqs):
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(seqs)], "rd_id long, seq string")


def test_worked_alignment(spark):
    r = refs(spark, REF)
    found = align.align(reads(spark, "AGTTGGTTGTTACTTGCTTTCG"), r, SMALL)
    a = found.first()
    assert (a["ref_s"], a["ref_e"], a["dr"], a["mm"], a["esd"], a["exact"], a["match_ref"]) == (2, 12, [0, 2, -3, 2, 2, -3, 2, 0, 3, 0], 0, 7, True, False)
    line = align.taf(found, r, numeric=True, read_name=F.lit("@tal")).first()
    assert tuple(line) == ("0", "@tal", 2, 12, "0;2;-3;2;2;-3;2;0;3;0;", "AGTTGGTTGTTACTTGCTTTCG", 2, 18)
    v = found.join(r, "ref_idx").select(dna.pair_view(F.col("letters"), F.col("runs"), F.col("ref_s"), F.col("dr")).alias("v")).first()["v"]
    assert (v["ref_row"], v["read_row"]) == ("AAAG--GTTTG--G--ATTTC--GC---CGATGC", "--AGttG---GttGttA---CttGCtttCG----")


def test_overlap_and_merge(spark):
    r = refs(spark, "TTTCGACAGTTGACGGATTTCCAACGTGGACGCAGCAGTTTTT")
    found = align.align(reads(spark, "TCTTTGATTTCTTATTGGTTACTTGTT", "ATTGGTTACTTGTTGACCTATATTTCGGGTTTACTTT"), r, SMALL)
    by = {a["rd_id"]: a for a in found.collect()}
    assert (by[1]["ref_s"], by[1]["ref_e"], by[1]["dr"]) == (0, 9, [3, 0, 3, 2, 2, -2, 2, 0, 2])
    assert (by[2]["ref_s"], by[2]["ref_e"]) == (4, 21)
    options = EngineOptions(seed=4, min_segment=8, overlap_min=4, extension_min=3)
    edge = assembly.overlap_edges(found, options).first()
    assert (edge["src"], edge["dst"], edge["overlap"], edge["extend"]) == (1, 2, 5, 12)
    path = assembly.trace_paths(found, assembly.overlap_edges(found, options), r, options).where("n = 2").first()
    assert path["dr"] == [3, 0, 3, 2, 2, -2, 2, 0, 2, 2, 0, -3, 0, 1, 1, 3, 0, -1, 0, 3, 0]
    seq = assembly.call_orfs(assembly.trace_paths(found, assembly.overlap_edges(found, options), r, options).where("n = 2"), r, options).first()["seq"]
    assert seq == "CTTTGATTTCTTATTGGTTACTTGTTGACCTATATTTCGGGTTTAC"


def unlike(rd, rf, d, places):
    """Places of the read whose letter differs from the reference's on the diagonal ``d``."""
    return [x for x in places if rd[x] != rf[x + d]]


def test_extension_keeps_its_rules(spark):
    rnd = random.Random(3)
    rf = "".join(rnd.choice("ACG") for _ in range(60))
    cases = {}
    for i in range(120):
        s, m = rnd.randrange(0, 40), rnd.randrange(12, 30)
        rd = [c if rnd.random() > 0.12 else rnd.choice("ACG") for c in (rf + "".join(rnd.choice("ACG") for _ in range(10)))[s : s + m]]
        at = next((x for x in range(0, len(rd) - 4, 4) if "".join(rd[x : x + 4]) == rf[s + x : s + x + 4]), None)
        if at is not None and s + at + 4 <= len(rf):
            cases[i] = ("".join(rd), at, s)
    both = spark.createDataFrame([(i, False, rd, [0] * (len(rd) + 1)) for i, (rd, _, _) in cases.items()], "rd_id long, reversed boolean, letters string, runs array<int>")
    best = spark.createDataFrame([(i, False, 0, at, s + at, 4) for i, (_, at, s) in cases.items()], "rd_id long, reversed boolean, ref_idx int, pos int, p int, covered int")
    for most in (0, 1, 2, 5):
        allowed, seen = min(most, 2), set()
        for r in align.extend(best, both, refs(spark, rf), EngineOptions(mismatch_max=most, min_segment=1, min_percent=0)).collect():
            rd, at, d = cases[r["rd_id"]]
            left, right, last = r["ref_s"] - d, r["ref_e"] - d, min(len(rd), len(rf) - d) - 1
            assert 0 <= left <= at and at + 3 <= right <= last
            before = unlike(rd, rf, d, range(left + 1, at + 1))
            stop = next(iter(unlike(rd, rf, d, range(at + 4, last + 1))), last + 1) - 1  # the exact match ends here
            after = unlike(rd, rf, d, range(stop, right))
            assert r["mm"] == len(before) + len(after) <= allowed
            assert left == (at if most == 0 else 0) or (len(before) == allowed and before[0] == left + 1)
            spent = len(before) == allowed
            assert right == stop if spent else right == last or (r["mm"] == allowed and after[-1] == right - 1)
            seen.add(r["rd_id"])
        assert len(seen) > 60


def test_hot_kmers_are_dealt_without_loss(spark, monkeypatch):
    rnd = random.Random(6)
    low = "AAAAAAAAGAAAAAAAAAAAAAAACAAAAAAA" * 12
    r = refs(spark, low, "".join(rnd.choice("ACGT") for _ in range(300)), low[5:200])
    own = reads(spark, *(low[k : k + 60] for k in range(30)), *("".join(rnd.choice("ACG") for _ in range(60)) for _ in range(5)))
    both, kmers = align.strands(own), align.index_kmers(r, 10)
    want = sorted(map(tuple, align.seed_hits(both, kmers, 10).collect()))
    monkeypatch.setattr(align, "BROADCAST_KMERS", 10)
    monkeypatch.setattr(align, "HOT_PLACES", 20)
    monkeypatch.setattr(align, "PARTS", 5)
    dealt = align.seed_hits(both, kmers, 10)
    assert sorted(map(tuple, dealt.collect())) == want and len(want) > 5_000


def test_empty_reads_and_short_references(spark):
    none = reads(spark, "").where("rd_id < 0")
    assert align.align(none, refs(spark, REF), SMALL).count() == 0
    assert align.index_kmers(refs(spark, "ACG", "T", ""), 4).count() == 0
    assert align.align(reads(spark, None, "", "NNNN", "ACGT"), refs(spark, REF), SMALL).count() == 0


def test_edges_against_all_pairs(spark):
    rnd = random.Random(4)
    truth = [rnd.choice((0, 0, 1, 2)) for _ in range(60)]
    rows = []
    for i in range(60):
        s = rnd.randrange(0, 40)
        dr = [x if rnd.random() > 0.02 else 9 for x in truth[s : s + rnd.randrange(8, 20)]]
        rows.append((0, i, s, s + len(dr), dr, sum(x != 0 for x in dr)))
    df = spark.createDataFrame(rows, "ref_idx int, rd_id long, ref_s int, ref_e int, dr array<int>, esd int")
    o = EngineOptions(overlap_min=4, extension_min=2)
    got = {(e["src"], e["dst"], e["overlap"], e["extend"]) for e in assembly.overlap_edges(df, o).collect()}
    want = set()
    for _, i, ls, le, ld, _ in rows:
        for _, j, rs, re_, rd, _ in rows:
            ov = le - rs
            if i != j and ls <= rs and ov > 4 and re_ - le > 2 and ld[rs - ls :] == rd[:ov]:
                want.add((i, j, ov, len(rd) - ov))
    assert got == want and want


def test_overlaps_against_all_pairs(spark):
    rnd = random.Random(7)
    rows = [(k % 2, k, s := rnd.randrange(0, 300), s + rnd.choice([0, 1, 5, 40, 200])) for k in range(150)] + [(0, 900, 10, 20), (0, 901, 10, 20)]
    for width in (1, 16, 64, 1000):
        got = sorted(map(tuple, assembly.overlaps(spark.createDataFrame(rows, "ref_idx int, rd_id long, ref_s int, ref_e int"), width).collect()))
        want = []
        for a in rows:
            for b in rows:
                shared = min(a[3], b[3]) - max(a[2], b[2])
                if a[0] == b[0] and shared > 0 and (a[2], -a[3], a[1]) < (b[2], -b[3], b[1]):
                    want.append((a[0], a[1], b[1], "within" if b[3] <= a[3] else "dovetail", shared, max(0, b[3] - a[3])))
        assert got == sorted(want) and {x[3] for x in got} == {"within", "dovetail"}


def test_paths_are_counted_before_they_are_made(spark):
    depth = 17  # two ways at each step: 131,072 paths
    rows = [(0, 2 * k + j, 10 * k, 10 * k + 30, [j] * 30) for k in range(depth + 1) for j in (0, 1)]
    own = spark.createDataFrame(rows, "ref_idx int, rd_id long, ref_s int, ref_e int, dr array<int>")
    edges = spark.createDataFrame([(0, 2 * k + i, 2 * k + 2 + j, 20, 10, 10) for k in range(depth) for i in (0, 1) for j in (0, 1)], "ref_idx int, src long, dst long, overlap int, extend int, value int")
    r = refs(spark, "ACG" * 200)
    wide = EngineOptions(search_depth=2, start_share=0.001)
    found = {x.n: int(x.paths) for x in assembly.count_paths(own, edges, r, wide).where("paths > 0").collect()}
    assert found == {depth + 1: 2 ** (depth + 1)}
    with pytest.raises(ValueError, match="262144 paths"):
        assembly.trace_paths(own, edges, r, wide, most=100_000)
    cut = EngineOptions(search_depth=2, start_share=0.001, max_path=6)
    paths = assembly.trace_paths(own, edges, r, cut, most=64).collect()
    assert len(paths) == 64 and all(p.truncated and p.n == 6 and len(p.dr) == 80 for p in paths) and len({tuple(p.nodes) for p in paths}) == 64
    assert all(p.dr == [p.nodes[0] % 2] * 30 + [x % 2 for x in p.nodes[1:] for _ in range(10)] for p in paths)
    assert {tuple(p.nodes) for p in assembly.trace_paths(own, edges, r, EngineOptions(start_share=0.001, max_path=1)).collect()} == {(0,), (1,)}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_support_and_dedup(spark):
    df = spark.createDataFrame([(0, 1, 0, 2, [1, 0]), (0, 2, 0, 2, [1, 0]), (0, 3, 0, 2, [2, 0])], "ref_idx int, rd_id long, ref_s int, ref_e int, dr array<int>")
    assert sorted(r["rd_id"] for r in es.dedup(df).collect()) == [2, 3]
    assert {r["rd_id"]: r["support"] for r in es.support_index(df).collect()} == {1: 1, 2: 1, 3: 0}
    assert {r["rd_id"]: r["support"] for r in es.support_index(df, edited=False).collect()} == {1: 2, 2: 2, 3: 1}


def test_longest_chains_without_hits(spark, monkeypatch):
    """The longest chains equal those of all hits, for long strands, several references and repeats, and hits of small references are not made."""
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("AAAACG") for _ in range(n))
    seqs = [text(150), text(90) + "A" * 60, "ACG" * 40, "AC", ""]
    r = refs(spark, *seqs)
    own = [rnd.choice(seqs[:3])[s : s + rnd.randrange(9, 110)] for s in (rnd.randrange(0, 60) for _ in range(150))] + ["A" * 70, text(80), "G" * 40]
    own = ["".join(c if rnd.random() > 0.03 else rnd.choice("ACG") for c in x) for x in own]
    both = align.strands(reads(spark, *own), SMALL)
    wanted = align.best_chains(align.seed_chains(align.seed_hits(both, align.index_kmers(r, 4), 4), 4))
    columns = ["rd_id", "reversed", "ref_idx", "pos", "p", "covered"]
    wanted = sorted(map(tuple, wanted.select(columns).collect()))
    assert max(x[-1] for x in wanted) > 40
    monkeypatch.setattr(align, "seed_hits", None)
    for most in (2, 5, 16):
        monkeypatch.setattr(align, "WINDOWED", most)
        assert sorted(map(tuple, align.longest_chains(both, r, 4).select(columns).collect())) == wanted
    assert align.align(reads(spark, *own), r, SMALL).count() > 50


def test_graph_of_kept_alignments_is_shuffled(spark):
    """A file of states is far smaller than its rows: no side of the overlap join is sent to all, and paths keep only edges they can follow."""
    rows = [(0, i, i, i + 30, [1] * 30, 30) for i in range(40)]
    own = keep(spark.createDataFrame(rows, "ref_idx int, rd_id long, ref_s int, ref_e int, dr array<int>, esd int"))
    edges = assembly.overlap_edges(own, EngineOptions())
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    met = assembly.meeting(own).select("src", "dst", F.size("ldr").alias("l"), F.size("rdr").alias("r")).collect()
    assert len(met) == edges.count() == sum(10 < b - a < 20 for a in range(40) for b in range(40)) and all(x.l == x.r == 30 for x in met)
    steps = {r["src"]: r["rank"] for r in assembly._steps(edges, EngineOptions()).collect()}
    assert len(steps) == assembly._steps(edges, EngineOptions()).count() == 29 and set(steps.values()) == {1}
    r = refs(spark, "A" * 100)
    paths = {p.start: (p.nodes, len(p.dr)) for p in assembly.trace_paths(own, edges, r, EngineOptions()).collect()}
    assert paths[0] == ([0, 19, 38], 68) and paths[35] == ([35], 30) and len(paths) == 40
    assert {x.n: int(x.paths) for x in assembly.count_paths(own, edges, r, EngineOptions()).where("paths > 0").collect()} == {n: sum(len(p[0]) == n for p in paths.values()) for n in {len(p[0]) for p in paths.values()}}


def test_pair_view_of_a_long_reference(spark):
    """Rows cost the aligned letters, not the square of the reference's: 300 rows of 20,000 letters end within seconds."""
    rnd = random.Random(8)
    seq = "".join(rnd.choice("ACGT") for _ in range(27_000))
    r = refs(spark, seq).withColumn("places", dna.letter_places(F.col("seq")))
    runs = [len(x) for x in re.split("[^T]", seq)]
    letters = seq.replace("T", "")
    places = [i for i, c in enumerate(seq) if c != "T"]
    cases = [(i, s := rnd.randrange(0, len(letters) - 50), [rnd.randrange(-runs[s + j + 1], 3) for j in range(rnd.randrange(0, 45))]) for i in range(300)]
    own = spark.createDataFrame(cases, "rd_id long, ref_s int, dr array<int>").repartition(4).crossJoin(F.broadcast(r))
    begun = time.time()
    found = own.select("rd_id", dna.pair_view(F.col("letters"), F.col("runs"), F.col("ref_s"), F.col("dr"), F.col("seq"), F.col("places")).alias("v")).collect()
    assert time.time() - begun < 30
    for x in found:
        _, s, dr = cases[x.rd_id]
        assert len(x.v.ref_row) == len(x.v.read_row) and x.v.ref_row.replace("-", "") == seq
        a, b = places[s], len(seq) - places[s + len(dr)] - 1
        assert x.v.read_row[:a] == "-" * a and x.v.read_row[len(x.v.read_row) - b :] == "-" * b
        assert x.v.read_row.replace("-", "").upper() == letters[s] + "".join("T" * (runs[s + j + 1] + d) + letters[s + j + 1] for j, d in enumerate(dr))


def test_lines_of_a_long_reference(spark):
    """Places of both ends come from one pass over the reference, not from a sum for each line: 2,000 lines of 100,000 letters end within seconds."""
    rnd = random.Random(9)
    seq = "".join(rnd.choice("ACGT") for _ in range(130_000))
    places = [i for i, c in enumerate(seq) if c != "T"]
    own = spark.createDataFrame([(0, i, s := rnd.randrange(0, len(places) - 12), s + 11, [0] * 11) for i in range(2_000)], "ref_idx int, rd_id long, ref_s int, ref_e int, dr array<int>").repartition(4)
    begun = time.time()
    found = align.taf(own, refs(spark, seq)).collect()
    assert time.time() - begun < 30 and len(found) == 2_000
    assert all((x.s_seq, x.e_seq, x.seq) == (places[x.ref_s], places[x.ref_e], seq[places[x.ref_s] : places[x.ref_e] + 1]) for x in found)


def test_support_counts_windows_once(spark):
    rows = [(0, i, 0, 6, [0, 1, 0, 2, 0, i % 2]) for i in range(5)]
    own = spark.createDataFrame(rows, "ref_idx int, rd_id long, ref_s int, ref_e int, dr array<int>")
    found = es.support(own, own, 4)
    assert {r["rd_id"]: round(r["value"], 6) for r in found.collect()} == {i: round(2 + (1 + (2 if i % 2 else 3)) / 6, 6) for i in range(5)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and plan.count("Generate explode") == 3
    assert sorted(r["gram"] for r in es.grams(own.limit(1), 4).collect())[0].count(";") == 3
