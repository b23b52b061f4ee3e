import random

from pyspark.sql import functions as F

from kinetoflow.functions import dna
from kinetoflow.operators import peptides


def rows(spark, values, *columns):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "s string").select(*columns).collect()]


def test_tless_examples(spark):
    got = rows(spark, ["TTATTGCTGA", "AATGTTCGTTTATAGAT", "", "TTT"], dna.letters(F.col("s")), dna.runs(F.col("s")))
    assert got == [("AGCGA", [2, 2, 0, 1, 0, 0]), ("AAGCGAAGA", [0, 0, 1, 2, 0, 3, 1, 0, 0, 1]), ("", [0]), ("", [3])]


def test_tless_round_trip_and_places(spark):
    rnd = random.Random(1)
    seqs = ["".join(rnd.choice("ACGTT") for _ in range(rnd.randrange(40))) for _ in range(50)]
    got = rows(spark, seqs, "s", dna.untless(dna.letters(F.col("s")), dna.runs(F.col("s"))), F.size(dna.runs(F.col("s"))) - F.length(dna.letters(F.col("s"))), dna.revcomp(dna.revcomp(F.col("s"))))
    assert all(s == back == twice and extra == 1 for s, back, extra, twice in got)
    places = rows(spark, ["TTATTGCTGA"], dna.seq_place(dna.runs(F.col("s")), F.lit(2)), dna.letter_place(F.col("s"), F.lit(0)), dna.letter_place(F.col("s"), F.lit(6)))
    assert places == [(6, -1, 2)]


def test_translation_leaves_out_the_last_codon(spark):
    assert rows(spark, ["ATGGCC", "ATGGCCA", "AT", "ATGNNNGCCA"], dna.translate_frame(F.col("s"), 0)) == [("M",), ("MA",), ("",), ("MA",)]
    assert dna.genetic_code("none") == {} and dna.genetic_code("default-ATG")["ATG"] == ("M", True, False)


def test_codon_sites():
    sites = {c: round(n, 5) for c, n in peptides.codon_sites()}
    assert sites == sites | {"CGG": 1.66667, "TGG": 2.66667, "AAA": 2.66667, "TTT": 2.66667, "GTG": 2, "CGC": 2, "AGG": 2.33333, "TAC": 2.66667, "CAT": 2.66667, "GGA": 2}


def orf_by_loops(seq, starts=dna.STARTS["default"], stops=dna.STOPS):
    best = (0, 0)
    for f in range(3):
        begin = None
        for i in range(f, len(seq) - 3, 3):
            c = seq[i : i + 3]
            if c in stops:
                if begin is not None and (i - begin) // 3 > best[0]:
                    best = ((i - begin) // 3, begin)
                begin = None
            elif c in starts and i > 0 and begin is None:
                begin = i
    return best


def test_longest_orf_against_loops(spark):
    rnd = random.Random(2)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(rnd.randrange(300))) for _ in range(60)]
    got = rows(spark, seqs, "s", dna.longest_orf(F.col("s")))
    for s, o in got:
        aa, begin = orf_by_loops(s)
        assert (o["cds_len"], o["cds_begin"], o["complete"]) == (3 * (aa + 1), begin, aa > 30) and len(o["pep"]) == aa


def test_fields_subseq_and_slices(spark):
    assert rows(spark, ["a;b;", ";a", ""], dna.fields(F.col("s"), ";")) == [(["a", "b"],), (["", "a"],), ([],)]
    assert rows(spark, ["ACGTA"], dna.subseq(F.col("s"), F.lit(2), F.lit(4)), dna.strand_slice(F.col("s"), F.lit(2), F.lit(4), F.lit("-"))) == [("CGT", "ACG")]
    assert rows(spark, ["ACNT"], dna.revcomp(F.col("s")), dna.revcomp_known(F.col("s")), dna.is_dna(F.col("s"))) == [("ANGT", "AGT", False)]


def test_anchor_cuts(spark):
    g, m = "ACGTACGTACGTTTACG", "ACGTACGTACGTAAACG"
    df = spark.createDataFrame([(g, m)], "g string, m string")
    marks = df.select(dna.alignment_marks(F.col("g"), F.col("m")), dna.trim_anchor_marks(F.col("g"), F.col("m"))).first()
    assert tuple(marks) == ("||||||||||||##|||", "||||||||||||")
    cut = df.select(dna.trim_to_anchor(F.col("g"), F.lit(0), F.lit(17), F.col("m"), F.lit(0), F.lit(17)).alias("c")).first()["c"]
    assert cut["gr"] == cut["mr"] == 12
    assert rows(spark, ["MM+U*M"], dna.edit_path(F.col("s"), F.lit(0), F.array(*[F.lit(x) for x in (0, 1, 2, 3, 0, 1)]))) == [([-1, -2, 2 - 3, 0],)]


def test_signed_fold_change(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-2.0, 0.0), (3.0, 0.5)], "l double, f double")
    assert [r[0] for r in df.select(dna.signed_fold_change(F.col("l"), F.col("f"))).collect()] == [2.0, -4.0, 0.0]
