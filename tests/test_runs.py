import random

from kinetoflow import runs
from kinetoflow.operators import align, store
from kinetoflow.options import EngineOptions
from kinetoflow.sources import readers, writers
from kinetoflow.streaming import reads

SMALL = EngineOptions(seed=6, min_segment=8, overlap_min=5, extension_min=3, min_orf_length=10, start_share=0.9, each_orf_alignment=True)


def fastq(path, seqs):
    path.write_text("".join(f"@r{k}\n{s}\n+\n{'J' * len(s)}\n" for k, s in enumerate(seqs)))


def edited(rnd, seq):
    """The same letters, other runs of T."""
    return "".join(("" if c == "T" and rnd.random() < 0.5 else c) + ("TT" if rnd.random() < 0.1 else "") for c in seq)


def data(tmp_path, seed=1):
    rnd = random.Random(seed)
    ref = "".join(rnd.choice("ACGT") for _ in range(500))
    (tmp_path / "ref.fa").write_text(f">one first\n{ref[:300]}\n{ref[300:]}\n")
    seqs = [edited(rnd, ref[s : s + 90]) for s in (rnd.randrange(0, 400) for _ in range(60))] + ["ACGNACGT", "A" * 50]
    (tmp_path / "reads").mkdir()
    fastq(tmp_path / "reads/a.fq", seqs[:25])
    fastq(tmp_path / "reads/b.fq", seqs[25:])
    return ref, seqs


def test_numbers_of_records_and_rows(spark, tmp_path):
    _, seqs = data(tmp_path)
    found = readers.read_fastq(spark, str(tmp_path / "reads"), dna_only=False).orderBy("rd_id").collect()
    assert [(r.rd_id, r.seq) for r in found] == list(enumerate(seqs, 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # records cross the splits
    try:
        split = readers.read_fastq(spark, str(tmp_path / "reads"), dna_only=False).orderBy("rd_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert split == found
    rows = spark.createDataFrame([(k * 7 % 50, "x") for k in range(200)], "k int, v string").repartition(5)
    numbers = store.numbered(rows, "k").orderBy("number").collect()
    assert [r.number for r in numbers] == list(range(1, 201)) and [r.k for r in numbers] == sorted(k * 7 % 50 for k in range(200))
    assert store.numbered(rows.limit(0), "k").collect() == []


def test_align_run(spark, tmp_path):
    data(tmp_path)
    out = str(tmp_path / "out")
    counters = runs.align_run(spark, str(tmp_path / "reads"), str(tmp_path / "ref.fa"), out, SMALL)
    refs = align.encode_refs(readers.read_fasta(spark, str(tmp_path / "ref.fa")))
    found = align.align(readers.read_fastq(spark, str(tmp_path / "reads")), refs, SMALL).collect()
    assert counters == {"reads": 61, "aligned": len(found), "reversed": sum(r.reversed for r in found), "exact": sum(r.exact for r in found), "match_ref": sum(r.match_ref for r in found)} and len(found) > 40
    lines = spark.read.text(f"{out}/taf").collect()
    assert len(lines) == len(found)
    again = readers.read_fastq(spark, f"{out}/fastq").collect()
    assert sorted(r.name for r in again) == sorted(f"tal{k}" for k in range(1, len(found) + 1))
    assert sorted(r.seq for r in again) == sorted(r.value.split("\t")[5] for r in lines)
    table = [r.value.split("\t") for r in spark.read.text(f"{out}/dest").collect()]
    assert len(table) == 40 * refs.first().letters.__len__() and sum(int(n) for _, n in table) > 0
    assert spark.read.text(f"{out}/matrix").count() == 40


def test_assemble_run_writes_frames_and_their_reads(spark, tmp_path):
    data(tmp_path, 5)
    out = str(tmp_path / "out")
    counters = runs.assemble_run(spark, str(tmp_path / "reads"), str(tmp_path / "ref.fa"), out, SMALL)
    assert counters["edges"] > 0
    peptides = readers.read_fasta(spark, f"{out}/pep").collect()
    assert len(peptides) == counters["frames"] == spark.read.text(f"{out}/taf").count()
    if peptides:
        assert spark.read.option("sep", "\t").csv(f"{out}/orf_alignments").count() > 0


def test_differential_run(spark, tmp_path):
    rnd = random.Random(9)
    ref = "".join(rnd.choice("ACGT") for _ in range(200))
    (tmp_path / "ref.fa").write_text(f">one\n{ref}\n")
    samples = {}
    for k in range(4):
        fastq(tmp_path / f"{k}.fq", [ref[20:110] if k < 2 or j % 4 == 0 else ref[20:60] + "TTT" + ref[60:110] for j in range(40)])
        samples[f"s{k}"] = ("control" if k < 2 else "treated", str(tmp_path / f"{k}.fq"))
    tested = runs.differential_run(spark, samples, str(tmp_path / "ref.fa"), str(tmp_path / "out"), "control", "treated", SMALL)
    best = tested.orderBy("p_value").first()
    assert best.fdr < 0.001 and abs(best.log_fc) > 1 and best.fold != 0
    assert all(spark.read.text(str(tmp_path / f"out/dest/s{k}")).count() == 40 * len(ref.replace("T", "")) for k in range(4))


def test_align_stream_equals_the_batch_run(spark, tmp_path):
    data(tmp_path, 3)
    out, kept = str(tmp_path / "out"), str(tmp_path / "kept")
    refs = store.keep(align.encode_refs(readers.read_fasta(spark, str(tmp_path / "ref.fa"))))
    (tmp_path / "come").mkdir()
    columns = ("name", "ref_idx", "reversed", "ref_s", "ref_e", "dr", "mm")
    for name in ("a.fq", "b.fq"):  # the second run goes on after the first
        (tmp_path / "come" / name).write_text((tmp_path / "reads" / name).read_text().replace("@r", f"@{name[0]}"))
        query = reads.align_stream(spark, str(tmp_path / "come"), refs, out, kept, SMALL)
        assert query.awaitTermination(120) and query.exception() is None
    found = spark.read.parquet(out)
    batch = readers.read_fastq(spark, str(tmp_path / "come"))
    wanted = align.align(batch, refs, SMALL).join(batch.select("rd_id", "name"), "rd_id")
    rows = found.select(*columns).collect()
    assert sorted(map(str, rows)) == sorted(map(str, wanted.select(*columns).collect())) and len(rows) > 40
    assert found.select("rd_id").distinct().count() == len(rows) and found.select("batch").distinct().count() == 2
    fastq(tmp_path / "come" / "c.fq", ["ACGNACGT", "NN"])  # no valid read
    query = reads.align_stream(spark, str(tmp_path / "come"), refs, out, kept, SMALL)
    assert query.awaitTermination(120) and query.exception() is None
    assert spark.read.parquet(out).count() == len(rows) and spark.read.schema(wanted.schema).parquet(f"{out}/batch=2").count() == 0
