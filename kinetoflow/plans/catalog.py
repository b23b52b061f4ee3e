"""The registered queries over the given tables and the SQL that gives the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import align, assembly, diffexp, es, guides, kmers, peptides
from ..operators.store import folder, keep, once
from ..options import EngineOptions
from ..sources import readers, writers
from . import inputs
from .inputs import ALIGNED, RUNS, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def text(values, sep: str = ";"):
    """An array as text, so that engines compare alike."""
    return F.array_join(values.cast("array<string>"), sep)


_JOIN = "array_to_string({0}, ';')"

# --- encodings and strings -------------------------------------------------------------------------------------------


@query(sql(f"select doc_id, replace(seq, 'T', '') as letters, array_to_string({RUNS.format(s='seq')}, ';') as runs from docs_dna", "docs_dna"))
def tless_encode(spark, d):
    return inputs.docs_dna(spark, d).select("doc_id", dna.letters(F.col("seq")).alias("letters"), text(dna.runs(F.col("seq"))).alias("runs"))


@query(sql("select doc_id, seq, true as same, length(seq) - length(replace(seq, 'T', '')) as ts from docs_dna", "docs_dna"))
def tless_roundtrip(spark, d):
    rows = inputs.docs_dna(spark, d).withColumn("t", dna.tless(F.col("seq")))
    back = dna.untless(F.col("t.letters"), F.col("t.runs"))
    return rows.select("doc_id", back.alias("seq"), (back == F.col("seq")).alias("same"), F.aggregate("t.runs", F.lit(0), lambda a, x: a + x).alias("ts"))


@query(sql(f"""select doc_id, p, p + cast(list_sum(runs[1:p + 1]) as bigint) as place, p as back from (
  select doc_id, seq, runs, unnest(range(0, length(replace(seq, 'T', '')))) as p from (select doc_id, seq, {RUNS.format(s='seq')} as runs from docs_dna))""", "docs_dna"))
def tless_places(spark, d):
    """Every letter of each document: its place in the sequence, and how many letters stand before that place."""
    rows = inputs.docs_dna(spark, d).select("doc_id", F.posexplode(dna.runs(F.col("seq"))).alias("p", "run"), F.length(dna.letters(F.col("seq"))).alias("n")).where("p < n")
    place = (F.col("p") + F.sum("run").over(W.partitionBy("doc_id").orderBy("p"))).cast("long")
    rows = rows.select("doc_id", "p", place.alias("place"))
    return rows.select("doc_id", "p", "place", (F.row_number().over(W.partitionBy("doc_id").orderBy("place")) - 1).alias("back"))


@query(sql("""select d.doc_id, reverse(translate(s.seq, 'ACGT', 'TGCA')) as rc, reverse(translate(regexp_replace(d.text, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) as rc_all from documents d join docs_dna s using (doc_id)""", "docs_dna"))
def revcomp(spark, d):
    """Reverse complements: of the known letters of a document, and of all its characters with others as N."""
    rows = inputs.table(spark, d, "documents").select("doc_id", "text")
    return rows.select("doc_id", dna.revcomp_known(dna.upper_dna(F.col("text"))).alias("rc"), dna.revcomp(F.col("text")).alias("rc_all"))


@query("select doc_id, not regexp_matches(upper(text), '[^ACGT]') as is_dna, length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) as known from documents")
def sanity_filter(spark, d):
    rows = inputs.table(spark, d, "documents").withColumn("u", F.upper("text"))
    return rows.select("doc_id", dna.is_dna(F.col("u")).alias("is_dna"), F.length(F.regexp_replace("u", "[^ACGT]", "")).alias("known"))


_CODE = "map {" + ", ".join(f"'{c}': '{a}'" for c, a in dna.CODONS.items()) + "}"


def _frame(f: int) -> str:
    return f"array_to_string(list_transform(range({f}, greatest(length(seq) - 3, {f}), 3), lambda i: code[substr(seq, i + 1, 3)]), '')"


@query(sql(f"select doc_id, {_frame(0)} as frame0, {_frame(1)} as frame1, {_frame(2)} as frame2 from docs_dna, (select {_CODE} as code)", "docs_dna"))
def codon_translate(spark, d):
    rows = inputs.docs_dna(spark, d)
    return rows.select("doc_id", *[dna.translate_frame(F.col("seq"), f).alias(f"frame{f}") for f in range(3)])


_CODE = ", ".join(f"('{codon}', '{acid}')" for codon, acid in dna.CODONS.items())


@query(sql(f"""select doc_id, count(*) as codons, round(sum(sites), 6) as nonsyn_sites from (
  select doc_id, substr(seq, i + 1, 3) as codon from (select doc_id, seq, unnest(range(0, length(seq) - 2, 3)) as i from docs_dna)) join (
  select a.codon, count(*) filter (where a.acid <> b.acid) / 3.0 as sites from (values {_CODE}) a(codon, acid) join (values {_CODE}) b(codon, acid) on hamming(a.codon, b.codon) = 1 group by a.codon) using (codon) group by doc_id""", "docs_dna"))
def codon_nonsyn_sites(spark, d):
    """Non-synonymous sites summed over each document's codons."""
    table = spark.createDataFrame(peptides.codon_sites(), "codon string, sites double")
    rows = inputs.docs_dna(spark, d).select("doc_id", "seq", F.explode(dna.count_to(F.floor(F.length("seq") / 3))).alias("i"))
    rows = rows.select("doc_id", F.expr("substring(seq, 3 * i + 1, 3)").alias("codon")).join(F.broadcast(table), "codon")
    return rows.groupBy("doc_id").agg(F.count("*").alias("codons"), F.round(F.sum("sites"), 6).alias("nonsyn_sites"))


@query("select user_id, run, letter, count(*) as n, min(event_id) as first_event from (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, letter order by ts, event_id) as island, 0 as run0 from letters), lateral (select island as run) group by user_id, run, letter".replace("select user_id, run, letter", "with letters as (select user_id, ts, event_id, case event_type when 'view' then 'T' when 'click' then 'A' when 'purchase' then 'C' when 'signup' then 'G' end as letter from events where event_type in ('view', 'click', 'purchase', 'signup')) select user_id, run, letter", 1))
def event_runs(spark, d):
    """Run lengths of equal letters in each user's events."""
    from pyspark.sql import Window as W

    rows = inputs.event_letters(spark, d)
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - F.row_number().over(W.partitionBy("user_id", "letter").orderBy("ts", "event_id"))
    return rows.withColumn("run", at.cast("long")).groupBy("user_id", "run", "letter").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


# --- alignment ---------------------------------------------------------------------------------------------------------


@query(sql("select ref_idx, p, substr(letters, p + 1, 10) as kmer from (select ref_idx, letters, unnest(range(0, length(letters) - 10)) as p from bench_ref)", "bench_ref"))
def ref_kmer_index(spark, d):
    return align.index_kmers(inputs.bench_ref(spark, d), 10)


_DOC_SEEDS = """doc_seeds as (select doc_id, i * 10 as pos, substr(letters, i * 10 + 1, 10) as kmer from (select doc_id, letters, unnest(range(0, length(letters) // 10 - 1)) as i from (select doc_id, replace(seq, 'T', '') as letters from docs_dna))),
bench_kmers as (select ref_idx, p, substr(letters, p + 1, 10) as kmer from (select ref_idx, letters, unnest(range(0, length(letters) - 10)) as p from bench_ref)),
doc_hits as (select doc_id, pos, ref_idx, p from doc_seeds join bench_kmers using (kmer))"""


def _doc_hits(spark, d):
    docs = inputs.docs_dna(spark, d).select(F.col("doc_id").alias("rd_id"), F.lit(False).alias("reversed"), dna.letters(F.col("seq")).alias("letters"))
    return align.seed_hits(docs, align.index_kmers(inputs.bench_ref(spark, d), 10), 10)


@query(sql("select doc_id, ref_idx, count(*) as hits, min(p - pos) as least_diagonal, max(p - pos) as most_diagonal from doc_hits group by doc_id, ref_idx", "docs_dna", "bench_ref", recursive=_DOC_SEEDS).replace("with recursive", "with", 1))
def seed_hits(spark, d):
    hits = _doc_hits(spark, d).groupBy(F.col("rd_id").alias("doc_id"), "ref_idx")
    return hits.agg(F.count("*").alias("hits"), F.min(F.col("p") - F.col("pos")).alias("least_diagonal"), F.max(F.col("p") - F.col("pos")).alias("most_diagonal"))


@query(sql("select doc_id, ref_idx, min(pos) as pos, min(p) as p, count(*) * 10 as covered from (select *, pos // 10 - row_number() over (partition by doc_id, ref_idx, p - pos order by pos) as island from doc_hits) group by doc_id, ref_idx, p - pos, island", "docs_dna", "bench_ref", recursive=_DOC_SEEDS).replace("with recursive", "with", 1))
def seed_chains(spark, d):
    return align.seed_chains(_doc_hits(spark, d), 10).select(F.col("rd_id").alias("doc_id"), "ref_idx", "pos", "p", "covered")


@query(sql("select ref_idx, rd_id, reversed, ref_s, ref_e, array_to_string(dr, ';') as dr, mm, esd, mm = 0 as exact, esd = 0 as match_ref from aligned", *ALIGNED))
def align_best(spark, d):
    found, _ = inputs.alignments(spark, d)
    return found.withColumn("dr", text(F.col("dr")))


_ALIGNED_SEQ = "array_to_string(list_transform(range(0, len(dr)), lambda j: substr(letters, ref_s + j + 1, 1) || repeat('T', dr[j + 1] + runs[ref_s + j + 2])), '') || substr(letters, ref_e + 1, 1)"


@query(sql(f"select ref_name as ref, '@' || rd_id as read, ref_s, ref_e, array_to_string(dr, ';') || ';' as dr, {_ALIGNED_SEQ} as seq, ref_s + cast(list_sum(runs[1:ref_s + 1]) as integer) as s_seq, ref_e + cast(list_sum(runs[1:ref_e + 1]) as integer) as e_seq from aligned join crypto using (ref_idx)", *ALIGNED))
def align_taf(spark, d):
    return align.taf(*inputs.alignments(spark, d))


@query(sql("select reversed, count(*) as n, sum(ref_e - ref_s) as sites from aligned group by reversed", *ALIGNED))
def align_strand_pick(spark, d):
    found, _ = inputs.alignments(spark, d)
    return found.groupBy("reversed").agg(F.count("*").alias("n"), F.sum(F.col("ref_e") - F.col("ref_s")).alias("sites"))


@query(sql("select rd_id, esd >= 10 as many, esd / len(dr) >= 0.3 as large_share from aligned", *ALIGNED))
def split_by_esd(spark, d):
    """Both halves of the splits by edit count and by edit share."""
    found, _ = inputs.alignments(spark, d)
    many, few = align.split(found, align.by_edit_count(10))
    return many.withColumn("many", F.lit(True)).unionByName(few.withColumn("many", F.lit(False))).select("rd_id", "many", align.by_edit_share(0.3).alias("large_share"))


@query(sql("select count(*) as aligned, count(*) filter (where esd = 0) as matching from aligned", *ALIGNED))
def split_match_ref(spark, d):
    found, _ = inputs.alignments(spark, d)
    return es.matching_reads(found)


@query()
def pair_views(spark, d):
    """Gapped rows of reference and read for each alignment."""
    found, refs = inputs.alignments(spark, d)
    rows = found.join(F.broadcast(refs.withColumn("places", dna.letter_places(F.col("seq")))), "ref_idx")
    view = dna.pair_view(F.col("letters"), F.col("runs"), F.col("ref_s"), F.col("dr"), F.col("seq"), F.col("places"))
    return once(rows.select("rd_id", view.alias("v"))).select("rd_id", "v.*")


# --- editing states ----------------------------------------------------------------------------------------------------

_LONG, _INNER = (*ALIGNED, "long"), (*ALIGNED, "inner_long", "table_long")


def _inner(spark, d):
    """States of trimmed alignments inside the reference, in the rows of a dense table; and the reference."""
    found, refs = inputs.alignments(spark, d)
    sites = refs.select("ref_idx", F.length("letters").alias("sites"))
    return es.in_table(es.es_long(es.trimmed(found))).join(F.broadcast(sites), "ref_idx").where("pos < sites").drop("sites"), refs


@query(sql("select ref_idx, pos, es, count(*) as n from long join crypto using (ref_idx) where abs(es) <= 16 and pos < sites group by ref_idx, pos, es", *_LONG))
def es_histogram(spark, d):
    found, refs = inputs.alignments(spark, d)
    return es.histogram(es.es_long(found), refs)


_DENSE = "grid as (select ref_idx, x, y from crypto, lateral (select unnest(range(0, sites)) as x), lateral (select unnest(range(0, 40)) as y)),\ncells as (select ref_idx, pos as x, 20 - es as y, count(*) as n from {0} group by ref_idx, pos, es),\ndense as (select ref_idx, x, y, coalesce(n, 0) as n from grid left join cells using (ref_idx, x, y))"


@query(sql("select ref_idx, y, chr(9) || string_agg(cast(n as varchar), chr(9) order by x) as line from dense group by ref_idx, y", *_LONG, recursive="short as (select l.* from long l join crypto using (ref_idx) where abs(es) <= 16 and pos < sites),\n" + _DENSE.format("short")).replace("with recursive", "with", 1))
def es_matrix_lines(spark, d):
    found, refs = inputs.alignments(spark, d)
    return es.matrix_lines(es.dense(es.histogram(es.es_long(found), refs), refs))


@query(sql("select ref_idx, x || ':' || y as site, n from dense", *_INNER, recursive=_DENSE.format("table_long")).replace("with recursive", "with", 1))
def dest_dense(spark, d):
    long, refs = _inner(spark, d)
    return es.dense(es.counts(long), refs).select("ref_idx", F.concat_ws(":", "x", "y").alias("site"), "n")


_CALM = "calm as (select * from (select *, count(es) over w as c, max(abs(es)) over w as m from table_long window w as (partition by ref_idx, rd_id order by j rows between 8 preceding and 1 preceding)) where c = 8 and m = 0)"


@query(sql("select ref_idx, pos, es, count(*) as n from calm group by ref_idx, pos, es", *_INNER, recursive=_CALM).replace("with recursive", "with", 1))
def productive_sites(spark, d):
    long, _ = _inner(spark, d)
    return es.counts(es.productive(long))


@query(sql("select ref_idx, pos, es, round(case when es <> 0 and n > 20 then coalesce(c, 0) / (1.0 + n) else 0 end, 6) as share from (select ref_idx, pos, es, count(*) as n from table_long group by ref_idx, pos, es) left join (select ref_idx, pos, es, count(*) as c from calm group by ref_idx, pos, es) using (ref_idx, pos, es)", *_INNER, recursive=_CALM).replace("with recursive", "with", 1))
def productive_share(spark, d):
    long, _ = _inner(spark, d)
    return es.productive_share(es.counts(long), es.counts(es.productive(long))).withColumn("share", F.round("share", 6))


@query(sql("select ref_idx, pos, count(*) filter (where es = 0) as unedited, count(*) filter (where es <> 0) as edited from table_long group by ref_idx, pos", *_INNER))
def coverage_bars(spark, d):
    long, _ = _inner(spark, d)
    return es.coverage(long)


_STEPS = "steps as (select *, lag(es) over w as prev_es, lead(es) over w as next_es from table_long window w as (partition by ref_idx, rd_id order by j)),\ncompass as (select ref_idx, pos, es, prev_es, count(*) as n from steps where prev_es is not null group by ref_idx, pos, es, prev_es),\nflow as (select ref_idx, pos, es, next_es, case when es = 0 and next_es = 0 then 1 else count(*) end as weight from steps where next_es is not null group by ref_idx, pos, es, next_es)"


@query(sql("select * from compass", *_INNER, recursive=_STEPS).replace("with recursive", "with", 1))
def compass_transitions(spark, d):
    long, _ = _inner(spark, d)
    return es.transitions(long)


@query(sql("select ref_idx, pos, es, prev_es, n, rank from (select *, row_number() over (partition by ref_idx, pos, es order by n desc, prev_es) as rank, max(n) over (partition by ref_idx, pos, es) as most from compass) where rank <= 3 and n >= 10 and most - n <= 0.2 * most", *_INNER, recursive=_STEPS).replace("with recursive", "with", 1))
def compass_top3(spark, d):
    long, _ = _inner(spark, d)
    return es.top_transitions(es.transitions(long))


@query(sql("select * from flow", *_INNER, recursive=_STEPS).replace("with recursive", "with", 1))
def flow_edges(spark, d):
    long, _ = _inner(spark, d)
    return es.flow(long)


@query(sql("select f.* from flow f join (select ref_idx, median(weight) as middle from flow group by ref_idx) using (ref_idx) where weight > middle", *_INNER, recursive=_STEPS).replace("with recursive", "with", 1))
def flow_strong(spark, d):
    long, _ = _inner(spark, d)
    return es.strong_flow(es.flow(long))


@query(sql("""select ref_idx, reversed, pos, count(*) as n from (select ref_idx, reversed, case when reversed then length(seq) - p else p end as pos from (
  select ref_idx, reversed, seq, unnest(range(ref_s + cast(list_sum(runs[1:ref_s + 1]) as bigint), ref_e + cast(list_sum(runs[1:ref_e + 1]) as bigint))) as p from aligned join crypto using (ref_idx))) group by ref_idx, reversed, pos""", *ALIGNED))
def base_coverage(spark, d):
    found, refs = inputs.alignments(spark, d)
    rows = found.join(F.broadcast(refs), "ref_idx")
    spans = rows.select("ref_idx", "reversed", F.length("seq").alias("length"), dna.seq_place(F.col("runs"), F.col("ref_s")).alias("s"), dna.seq_place(F.col("runs"), F.col("ref_e")).alias("e"))
    return es.base_coverage(spans)


_MAIN = "states as (select ref_idx, pos, es, count(*) as n from table_long group by ref_idx, pos, es),\nmain as (select ref_idx, pos, es as main_es from (select *, row_number() over (partition by ref_idx, pos order by n desc, es) as r from states where es <> 0) where r = 1)"


@query(sql("""select ref_idx, pos, case when calm then 0 else c end as canonical, case when calm then 0 else o end as other, case when calm then 100.0 else 0.0 end as unedited,
  round(case when calm then 0 else 100.0 * c / (1.0 + c + o) end, 6) as percent from (
  select g.ref_idx, g.pos, main_es is null or main_es = 0 as calm, coalesce(sum(n) filter (where es = main_es), 0) as c, coalesce(sum(n) filter (where es <> main_es and es <> 0), 0) as o
  from (select ref_idx, unnest(range(0, sites)) as pos from crypto) g left join main using (ref_idx, pos) left join states using (ref_idx, pos) group by g.ref_idx, g.pos, main_es)""", *_INNER, recursive=_MAIN).replace("with recursive", "with", 1))
def canonical_percent(spark, d):
    """Share of reads with the main state, the most frequent edited one of each site."""
    from pyspark.sql import Window as W

    long, refs = _inner(spark, d)
    n = es.counts(long)
    first = W.partitionBy("ref_idx", "pos").orderBy(F.desc("n"), "es")
    main = n.where("es <> 0").withColumn("r", F.row_number().over(first)).where("r = 1").select("ref_idx", "pos", F.col("es").alias("main_es"))
    out = es.canonical_percent(n, main, refs)
    return out.select("ref_idx", "pos", "canonical", "other", "unedited", F.round("percent", 6).alias("percent"))


_SUPPORT = "by_state as (select ref_idx, pos, es, count(*) as n from long group by ref_idx, pos, es),\nby_site as (select ref_idx, pos, count(*) as a from long group by ref_idx, pos),\nsupported as (select ref_idx, rd_id, sum((1.0 + n) / (1.0 + a)) as value from long join by_state using (ref_idx, pos, es) join by_site using (ref_idx, pos) group by ref_idx, rd_id)"


@query(sql("select ref_idx, rd_id, round(value, 6) as value from supported", *_LONG, recursive=_SUPPORT).replace("with recursive", "with", 1))
def mrna_support(spark, d):
    """Read support of every alignment as an mRNA."""
    found, _ = inputs.alignments(spark, d)
    return es.support(found, found).withColumn("value", F.round("value", 6))


_GRAMS = "grams as (select ref_idx, rd_id, array_to_string(dr[i + 1:i + 6], ';') as gram, ref_s + i + 3 as pos from (select *, unnest(range(0, len(dr) - 5)) as i from aligned))"


@query(sql("select ref_idx, rd_id, round(sum((1.0 + n) / (1.0 + a)), 6) as value from grams join (select ref_idx, pos, gram, count(*) as n from grams group by ref_idx, pos, gram) using (ref_idx, pos, gram) join (select ref_idx, pos, count(*) as a from grams group by ref_idx, pos) using (ref_idx, pos) group by ref_idx, rd_id", *ALIGNED, recursive=_GRAMS).replace("with recursive", "with", 1))
def mrna_support_kmer(spark, d):
    found, _ = inputs.alignments(spark, d)
    return es.support(found, found, 6).withColumn("value", F.round("value", 6))


@query(sql("select ref_idx, rd_id, round(value, 6) as value from (select *, row_number() over (partition by ref_idx order by value desc, rd_id) as r from (select ref_idx, rd_id, round(value, 6) as value from supported)) where r = 1", *_LONG, recursive=_SUPPORT).replace("with recursive", "with", 1))
def best_supported_mrna(spark, d):
    found, _ = inputs.alignments(spark, d)
    return es.best_supported(es.support(found, found).withColumn("value", F.round("value", 6)))


@query(sql("select ref_idx, rd_id, ref_s, ref_e, array_to_string(dr, ';') as dr from dedup", *ALIGNED, "dedup"))
def dedup_alignments(spark, d):
    found, _ = inputs.alignments(spark, d)
    return es.dedup(found).select("ref_idx", "rd_id", "ref_s", "ref_e", text(F.col("dr")).alias("dr"))


@query(sql("select ref_idx, rd_id, count(*) filter (where es <> 0 and es = mode) as support from long left join (select ref_idx, pos, es as mode from (select ref_idx, pos, es, row_number() over (partition by ref_idx, pos order by count(*) desc, es) as r from long where es <> 0 group by ref_idx, pos, es) where r = 1) using (ref_idx, pos) group by ref_idx, rd_id", *_LONG))
def support_index(spark, d):
    found, _ = inputs.alignments(spark, d)
    return es.support_index(found)


@query(sql(f"select row_number() over (order by rd_id, ref_name) as rd_id, 'tal' || row_number() over (order by rd_id, ref_name) as name, seq, repeat('J', length(seq)) as qual from (select rd_id, ref_name, {_ALIGNED_SEQ} as seq from aligned join crypto using (ref_idx))", *ALIGNED))
def fastq_round_trip(spark, d):
    """Aligned sequences written as FASTQ records and read back."""
    found, refs = inputs.alignments(spark, d)
    path = f"{folder(spark)}/fastq-{uuid.uuid4().hex}"
    writers.write_fastq(keep(found), refs, path)
    return readers.read_fastq(spark, path)


@query(sql(f"select 'crypto' as ref, '@' || rd_id as read, ref_s, ref_e, array_to_string(dr, ';') as dr, {_ALIGNED_SEQ} as seq from aligned join crypto using (ref_idx)", *ALIGNED))
def taf_round_trip(spark, d):
    """Alignment lines written and read back."""
    found, refs = inputs.alignments(spark, d)
    path = f"{folder(spark)}/taf-{uuid.uuid4().hex}"
    writers.write_taf(keep(found), refs, path)
    lines = readers.read_taf(spark, path)
    return lines.select("ref", "read", "ref_s", "ref_e", text(F.col("dr")).alias("dr"), "seq")


# --- assembly ----------------------------------------------------------------------------------------------------------

_OPTIONS = EngineOptions(min_orf_length=8)
_EDGES = (*ALIGNED, "dedup", "edges")


def _graph(spark, d, options=_OPTIONS):
    found, refs = inputs.alignments(spark, d)
    own = keep(assembly.nodes(found, options))
    return own, assembly.overlap_edges(own, options), refs


@query(sql("select ref_idx, src, dst, overlap, extend, value from edges", *_EDGES))
def overlap_edges(spark, d):
    return _graph(spark, d)[1]


@query(sql("select e.ref_idx, src, dst, overlap, extend, d.esd as value from edges e join dedup d on e.ref_idx = d.ref_idx and e.dst = d.rd_id", *_EDGES))
def overlap_edges_editing(spark, d):
    """Edges that prefer the next read with most edited sites."""
    found, _ = inputs.alignments(spark, d)
    options = EngineOptions(mode="editing")
    return assembly.overlap_edges(assembly.nodes(found, options), options)


@query(sql("""select l.ref_idx, l.rd_id as src, r.rd_id as dst, l.ref_e - r.ref_s as overlap, len(r.dr) - (l.ref_e - r.ref_s) as extend, l.ref_e - r.ref_s as value
  from aligned l join aligned r on l.ref_idx = r.ref_idx and l.rd_id <> r.rd_id and l.ref_s <= r.ref_s and r.ref_e - l.ref_e > 10 and l.ref_e - r.ref_s > 10 and l.dr[r.ref_s - l.ref_s + 1:len(l.dr)] = r.dr[1:l.ref_e - r.ref_s]""", *ALIGNED))
def edges_overlap(spark, d):
    """Edges that prefer the longest overlap, duplicates included."""
    return _graph(spark, d, EngineOptions(mode="overlap"))[1]


def _coverage(edited: bool) -> str:
    some = "es <> 0" if edited else "true"
    return sql(f"select e.ref_idx, e.src, e.dst, e.overlap, e.extend, cast(v.support as integer) as value from edges e join votes v on v.ref_idx = e.ref_idx and v.rd_id = e.dst", *_EDGES, recursive=f"""sites as (select ref_idx, rd_id, ref_s + j as pos, dr[j + 1] as es from (select *, unnest(range(0, len(dr))) as j from dedup)),
modes as (select ref_idx, pos, es as mode from (select ref_idx, pos, es, row_number() over (partition by ref_idx, pos order by count(*) desc, es) as r from sites where {some} group by ref_idx, pos, es) where r = 1),
votes as (select ref_idx, rd_id, count(*) filter (where {some} and es = mode) as support from sites left join modes using (ref_idx, pos) group by ref_idx, rd_id)""").replace("with recursive", "with", 1)


@query(_coverage(True))
def edges_coverage(spark, d):
    """Edges that prefer the next read that agrees with most edited sites' usual state."""
    return _graph(spark, d, EngineOptions(mode="coverage"))[1]


@query(_coverage(False))
def edges_coverage_unedited(spark, d):
    return _graph(spark, d, EngineOptions(mode="coverage_unedited"))[1]


@query(sql("""select l.ref_idx, l.rd_id as l, r.rd_id as r, case when r.ref_e <= l.ref_e then 'within' else 'dovetail' end as layout, least(l.ref_e, r.ref_e) - r.ref_s as overlap, greatest(0, r.ref_e - l.ref_e) as extend
  from dedup l join dedup r on l.ref_idx = r.ref_idx and l.ref_s <= r.ref_s and r.ref_s < l.ref_e and (l.ref_s < r.ref_s or l.ref_e > r.ref_e or (l.ref_e = r.ref_e and l.rd_id < r.rd_id))""", *_EDGES))
def overlap_layouts(spark, d):
    """All pairs of distinct alignments that share a site, with their layout."""
    found, _ = inputs.alignments(spark, d)
    return assembly.overlaps(keep(es.dedup(found)))


@query(sql("select ref_idx, src, dst, overlap, extend, value, rank from ranked where rank <= 3", *_EDGES))
def topk_edges(spark, d):
    return assembly.top_edges(_graph(spark, d)[1], 3)


_PATHS = """paths as (
  select a.ref_idx, a.rd_id as start, a.rd_id as head, [a.rd_id] as nodes, 1 as n, a.ref_s, a.dr from dedup a join crypto c using (ref_idx) where a.ref_s < c.sites * 0.4
  union all
  select p.ref_idx, p.start, e.dst, list_concat(p.nodes, [e.dst]), p.n + 1, p.ref_s, list_concat(p.dr, a.dr[e.overlap + 1:len(a.dr)])
  from paths p join ranked e on p.ref_idx = e.ref_idx and p.head = e.src and e.rank <= 1 join dedup a on a.ref_idx = e.ref_idx and a.rd_id = e.dst where p.n < 75),
ends as (select * from paths p where n = 75 or not exists (select 1 from edges e where e.ref_idx = p.ref_idx and e.src = p.head))"""


@query(sql("select ref_idx, start, array_to_string(nodes, ',') as nodes, n, ref_s, array_to_string(dr, ';') as dr from ends", *_EDGES, recursive=_PATHS))
def trace_paths(spark, d):
    own, edges, refs = _graph(spark, d)
    paths = assembly.trace_paths(own, edges, refs, _OPTIONS)
    return paths.select("ref_idx", "start", text(F.col("nodes"), ",").alias("nodes"), "n", "ref_s", text(F.col("dr")).alias("dr"))


_WIDE_OPTIONS = EngineOptions(search_depth=-1, max_path=11)
_WIDE = _PATHS.replace("e.rank <= 1", "e.rank <= 1 + cast(floor(0.03 * p.n) as integer) + cast(floor(0.01 * p.n * p.n) as integer) + cast(floor(0.002 * p.n * p.n * p.n) as integer)").replace("75", "11")


@query(sql("select ref_idx, start, array_to_string(nodes, ',') as nodes, n, ref_s, array_to_string(dr, ';') as dr from ends", *_EDGES, recursive=_WIDE))
def trace_adaptive(spark, d):
    """Paths of up to 11 nodes that follow more edges the longer they are."""
    own, edges, refs = _graph(spark, d, _WIDE_OPTIONS)
    paths = assembly.trace_paths(own, edges, refs, _WIDE_OPTIONS)
    return paths.select("ref_idx", "start", text(F.col("nodes"), ",").alias("nodes"), "n", "ref_s", text(F.col("dr")).alias("dr"))


@query(sql("select ref_idx, n, cast(count(*) as decimal(38, 0)) as paths from ends group by ref_idx, n", *_EDGES, recursive=_WIDE))
def path_counts(spark, d):
    """How many such paths of each number of nodes there are, counted without making them."""
    own, edges, refs = _graph(spark, d, _WIDE_OPTIONS)
    return assembly.count_paths(own, edges, refs, _WIDE_OPTIONS).where("paths > 0")


@query(sql("select l.ref_idx, e.src, e.dst, l.ref_s as ref_s, r.ref_e as ref_e, array_to_string(list_concat(l.dr, r.dr[e.overlap + 1:len(r.dr)]), ';') as dr from edges e join dedup l on l.ref_idx = e.ref_idx and l.rd_id = e.src join dedup r on r.ref_idx = e.ref_idx and r.rd_id = e.dst", *_EDGES))
def merge_paths(spark, d):
    """Merged alignments of both ends of each edge."""
    found, _ = inputs.alignments(spark, d)
    both = assembly.meeting(keep(assembly.nodes(found, _OPTIONS)), _OPTIONS)
    pairs = both.select("ref_idx", "src", "dst", F.col("ls").alias("l_s"), F.col("le").alias("l_e"), F.col("ldr").alias("l_dr"), F.col("site").alias("r_s"), F.col("re").alias("r_e"), F.col("rdr").alias("r_dr"))
    return assembly.merge_pairs(pairs).select("ref_idx", "src", "dst", "merged.ref_s", "merged.ref_e", text(F.col("merged.dr")).alias("dr"))


def _orf_sql(source: str) -> str:
    """Longest frames of (key, seq) in ``source`` as expressions named orfs."""
    starts, stops = ("(" + ", ".join(f"'{c}'" for c in x) + ")" for x in (dna.STARTS["default"], dna.STOPS))
    return f"""codons as (select key, seq, f, i, substr(seq, i + 1, 3) as codon from (select key, seq, f, unnest(range(f, greatest(length(seq) - 3, f), 3)) as i from {source}, (values (0), (1), (2)) t(f))),
segments as (select *, coalesce(sum(case when codon in {stops} then 1 else 0 end) over (partition by key, f order by i rows between unbounded preceding and 1 preceding), 0) as seg from codons),
frames as (select key, f, seg, min(i) filter (where codon in {starts} and i > 0) as b, max(i) filter (where codon in {stops}) as e from segments group by key, f, seg),
longest as (select * from (select *, row_number() over (partition by key order by (e - b) desc, f, e) as r from frames where b is not null and e is not null and b < e) where r = 1),
orfs as (select s.key, s.seq, coalesce((e - b) // 3, 0) as aa, coalesce(b, 0) as cds_begin from {source} s left join longest l on s.key = l.key)"""


_ORF = """aa > 30 as complete, cds_begin, 3 * (aa + 1) as cds_len, substr(seq, cds_begin + 1, 3 * (aa + 1)) as cds, array_to_string(list_transform(range(0, aa), lambda i: code[substr(seq, cds_begin + 3 * i + 1, 3)]), '') as pep"""


@query(sql(f"select key as doc_id, {_ORF} from orfs, (select {_CODE} as code)", "docs_dna", recursive="keyed as (select doc_id as key, seq from docs_dna),\n" + _orf_sql("keyed")).replace("with recursive", "with", 1))
def longest_orf(spark, d):
    """Longest complete reading frame of each document's letters."""
    rows = inputs.docs_dna(spark, d)
    return rows.select("doc_id", F.element_at(F.transform(F.array("seq"), lambda s: dna.longest_orf(s)), 1).alias("o")).select("doc_id", "o.*")


@query(sql(f"select ref_idx, start, n, seq, {_ORF} from orfs join (select ref_idx, start, n, start || ':' || n || ':' || array_to_string(nodes, ',') as key from ends) using (key), (select {_CODE} as code)", *_EDGES,
           recursive=_PATHS + f",\nkeyed as (select start || ':' || n || ':' || array_to_string(nodes, ',') as key, {_ALIGNED_SEQ.replace('ref_e + 1', 'ref_s + len(dr) + 1')} as seq from ends join crypto using (ref_idx)),\n" + _orf_sql("keyed")))
def path_orfs(spark, d):
    """Reading frames of the assembled paths."""
    own, edges, refs = _graph(spark, d)
    paths = assembly.trace_paths(own, edges, refs, _OPTIONS)
    return assembly.call_orfs(paths, refs, _OPTIONS).select("ref_idx", "start", "n", "seq", "complete", "cds_begin", "cds_len", "cds", "pep")


@query(sql(f"select number, 'docs_extension_ORF_' || number as name, doc_id, pep, length(pep) as aa from (select row_number() over (order by length(pep) desc, pep) as number, doc_id, pep from (select key as doc_id, pep, row_number() over (partition by pep order by key) as r from (select key, {_ORF} from orfs, (select {_CODE} as code)) where complete and length(pep) >= 40) where r = 1)",
           "docs_dna", recursive="keyed as (select doc_id as key, seq from docs_dna),\n" + _orf_sql("keyed")).replace("with recursive", "with", 1))
def orf_catalog(spark, d):
    """Distinct peptides of the documents' frames, numbered by length."""
    rows = inputs.docs_dna(spark, d).select("doc_id", F.element_at(F.transform(F.array("seq"), lambda s: dna.longest_orf(s)), 1).alias("o"))
    own = rows.select(F.lit(0).alias("ref_idx"), F.lit("docs").alias("ref_name"), F.col("doc_id").alias("start"), F.lit(1).alias("n"), F.lit("").alias("seq"), "o.*")
    return assembly.catalog(own, EngineOptions(min_orf_length=40)).select("number", "name", F.col("start").alias("doc_id"), "pep", F.length("pep").alias("aa"))


# --- guides ------------------------------------------------------------------------------------------------------------

_GUIDES = ("crypto", "mrnas", "guides")
_GO = EngineOptions(flank=8, min_length=24)


def _pair(a: str, b: str) -> str:
    return f"case when {a} = {b} then 2 when ({a} = 'A' and {b} = 'G') or ({a} = 'C' and {b} = 'T') then 1 else -2 end"


_SCORES = f"""gl as (select guide, gseq, length(gseq) as gn, i as g, substr(gseq, i + 1, 1) as gc from (select guide, gseq, unnest(range(0, length(gseq))) as i from guides)),
ml as (select target, length(mseq) as mn, i as m, substr(mseq, i + 1, 1) as mc from (select target, mseq, unnest(range(0, length(mseq))) as i from mrnas)),
prs as (select guide, target, gn, mn, g, m, {_pair('gc', 'mc')} as s from gl, ml),
sums as (select *, sum(s) over w as score, count(*) filter (where s = 1) over w as gu, count(*) filter (where s = -2) over w as mm from prs window w as (partition by guide, target, m - g order by g rows between current row and 24 following)),
scores as (select guide, target, g, m, score, gu, mm from sums where g < gn - 25 and m < mn - 25 and score > 32)"""


def _scores(spark, d):
    g, m = inputs.guides(spark, d), inputs.mrnas(spark, d)
    return guides.window_scores(g, m), g, m


@query(sql("select guide, target, g, m, score, gu, mm from scores", *_GUIDES, recursive=_SCORES).replace("with recursive", "with", 1))
def grna_window_scores(spark, d):
    return _scores(spark, d)[0]


def _four(what: str, a: str, b: str) -> str:
    """Sum over four letters from places a and b: score, wobble pairs or mismatches."""
    p = _pair(f"substr(gseq, {a} + i + 1, 1)", f"substr(mseq, {b} + i + 1, 1)")
    pick = {"score": p, "gu": f"case when ({p}) = 1 then 1 else 0 end", "mm": f"case when ({p}) = -2 then 1 else 0 end"}[what]
    return f"cast(list_sum(list_transform(range(0, 4), lambda i: {pick})) as integer)"


_EXTEND = _SCORES + f""",
grow as (
  select guide, target, g, m, gseq, mseq, g as gl, g + 25 as gr, m as ml, m + 25 as mr, cast(gu as integer) as gu, cast(mm as integer) as mm, 0 as step from scores join guides using (guide) join mrnas using (target)
  union all
  select guide, target, g, m, gseq, mseq, case when ls > rs then gl - 4 else gl end, case when ls > rs then gr else gr + 4 end, case when ls > rs then ml - 4 else ml end, case when ls > rs then mr else mr + 4 end,
    gu + case when ls > rs then {_four('gu', 'gl - 4', 'ml - 4')} else {_four('gu', 'gr', 'mr')} end, mm + case when ls > rs then {_four('mm', 'gl - 4', 'ml - 4')} else {_four('mm', 'gr', 'mr')} end, step + 1
  from (select *, case when gl - 4 > 0 and ml - 4 > 0 then {_four('score', 'gl - 4', 'ml - 4')} else 0 end as ls, case when gr + 4 < length(gseq) and mr + 4 < length(mseq) then {_four('score', 'gr', 'mr')} else 0 end as rs from grow where gu < 14 and mm < 4) where ls > 0 or rs > 0),
grown as (select guide, target, g, m, gl, gr, ml, mr, gu, mm from (select *, row_number() over (partition by guide, target, g, m order by step desc) as r from grow) where r = 1)"""


@query(sql("select guide, target, g, m, gl, gr, ml, mr, gu, mm from grown", *_GUIDES, recursive=_EXTEND))
def grna_extend(spark, d):
    return guides.extend_hits(*_scores(spark, d), _GO)


_CLUSTERS = _EXTEND + """,
opened as (select *, case when gl < lag(gr) over (partition by guide, target order by g, m) then 0 else 1 end as o from grown),
numbered as (select *, sum(o) over (partition by guide, target order by g, m rows unbounded preceding) as cluster from opened),
clustered as (select guide, target, cluster, gl, gr, ml, mr, gu, mm from (select *, row_number() over (partition by guide, target, cluster order by gr - gl desc, g, m) as r from numbered) where r = 1)"""


@query(sql("select guide, target, cluster, gl, gr, ml, mr, gu, mm from clustered", *_GUIDES, recursive=_CLUSTERS))
def grna_clusters(spark, d):
    return guides.cluster_hits(guides.extend_hits(*_scores(spark, d), _GO))


def _report(spark, d):
    scores, g, m = _scores(spark, d)
    return guides.report_hits(guides.cluster_hits(guides.extend_hits(scores, g, m, _GO)), g, m, _GO)


_MARKS = "array_to_string(list_transform(range(0, {n}), lambda i: case when substr({g}, i + 1, 1) = substr({m}, i + 1, 1) then '|' when (substr({g}, i + 1, 1) = 'A' and substr({m}, i + 1, 1) = 'G') or (substr({g}, i + 1, 1) = 'C' and substr({m}, i + 1, 1) = 'T') then ':' else '{o}' end), '')"
_REPORT = _CLUSTERS + f""",
scan as (select c.*, gseq, mseq, least(gr - gl, mr - ml) as k, array_to_string(list_transform(range(0, least(gr - gl, mr - ml)), lambda i: case when substr(gseq, gr - i + 1, 1) = substr(mseq, mr - i + 1, 1) and substr(gseq, gr - i + 1, 1) <> '' then '|' else '#' end), '') as back from clustered c join guides using (guide) join mrnas using (target)),
cut as (select *, case when strpos(back, '|||||') > 0 then strpos(back, '|||||') + 3 else k end as steps from scan),
cut2 as (select guide, gl, gr - steps + 5 as gr, target, ml, mr - steps + 5 as mr, gu, mm, gseq, mseq, gr - steps + 5 - gl as len from cut),
report as (select guide, gl, gr, substr(gseq, gl + 1, len) as gtext, target, ml, mr, substr(mseq, ml + 1, mr - ml) as mtext, gu, mm, len,
  case when gl - 8 > 0 then substr(gseq, gl - 7, 8) end as upstream, case when gr + 8 < length(gseq) then substr(gseq, gr + 1, 8) end as downstream from cut2 where -2 * mm + gu + 2 * (len - gu - mm) > 32 and len > 24)"""


@query(sql(f"select guide, gl, gr, gtext, target, ml, mr, mtext, gu, mm, len, {_MARKS.format(n='least(length(gtext), length(mtext))', g='gtext', m='mtext', o='#')} as marks, upstream, downstream from report", *_GUIDES, recursive=_REPORT))
def grna_report(spark, d):
    return _report(spark, d)


@query(sql("select target, guide, gl, ml, mm from (select *, substr(gseq, gr + 1, 15) as tail from report join guides using (guide)) where contains(tail, 'AAAGCCTAT') or contains(tail, 'AAAGCCTAC') or contains(tail, 'AAAGCCTGT') or contains(tail, 'AAAGCCTGC')", *_GUIDES, recursive=_REPORT))
def grna_motif(spark, d):
    """Reported hits with a motif in the 15 letters after them."""
    rows = _report(spark, d).join(inputs.guides(spark, d).select("guide", "gseq"), "guide")
    return rows.where(guides.has_motif(F.substring("gseq", F.col("gr") + 1, F.lit(15)))).select("target", "guide", "gl", "ml", "mm")


@query(sql(f"""select target, m_start, guide, g_start, substr(mtext, 1, n) as mtext, substr(gtext, 1, n) as gtext, length(regexp_replace(marks, '[^:]', '', 'g')) as gu, length(regexp_replace(marks, '[^\\^]', '', 'g')) as mm, strpos(gseq, gtext) - 1 as p_start from (
  select *, substr(all_marks, 1, n) as marks from (select *, case when length(all_marks) = 0 then 0 when strpos(back, '||||') > 0 then length(all_marks) - strpos(back, '||||') + 1 else length(regexp_extract(back, '(\\|*)$', 1)) + 1 end as n
   from (select *, reverse(substr(all_marks, 2)) as back from (select target, ml as m_start, guide, gl as g_start, mtext, gtext, gseq, {_MARKS.format(n='least(length(gtext), length(mtext))', g='gtext', m='mtext', o='^')} as all_marks from report join guides using (guide)))) where n >= 20)""", *_GUIDES, recursive=_REPORT))
def grna_anchor(spark, d):
    hits = _report(spark, d).select("target", F.col("ml").alias("m_start"), "guide", F.col("gl").alias("g_start"), "mtext", "gtext")
    circles = inputs.guides(spark, d).select(F.col("guide").alias("name"), F.col("gseq").alias("seq"))
    return guides.anchor_filter(hits, circles, 20)


@query()
def grna_edit_graph(spark, d):
    """Full duplexes of guide cores with mRNAs, Ts inserted freely, none of whose letters is a mismatch."""
    g = inputs.guides(spark, d).select("guide", F.col("core").alias("gseq"))
    m = inputs.mrnas(spark, d).select("target", dna.letters(F.col("mseq")).alias("letters"), dna.runs(F.col("mseq")).alias("runs"))
    return guides.edit_graph_hits(g, m, least=24, scoring=guides.Scoring(score_min=90))


def _edit_classes(window: int = 25, least: int = 19, need: int = 80) -> str:
    """States of the edit graph from every place of a target, level by level: those that agree are one, with a count."""
    parts = [f"""l0 as (select guide, p, substr(core, p + 1, {window}) as w, target, b, b as a, 0 as score, 0 as gu, 0 as mm, 1 as kind, 1 as n, rf from (select guide, core, unnest(range(0, length(core) - {window})) as p from guides),
  (select target, rf, unnest(range(0, length(rf))) as b from (select target, replace(mseq, 'T', '') as rf from mrnas)))"""]
    for i in range(window - 1):
        c, r = f"substr(w, {i + 1}, 1)", "substr(rf, a + 2, 1)"
        same, wobble = f"{c} = {r}", f"({c} = 'A' and {r} = 'G')"
        parts.append(f"""l{i + 1} as (select guide, p, w, target, b, a, score, gu, mm, kind, cast(sum(n) as bigint) as n, rf from (
  select guide, p, w, target, b, a, score + 4 as score, gu + case when {c} = 'C' then 1 else 0 end as gu, mm, 0 as kind, n, rf from l{i} where {c} in ('T', 'C') and mm <= 5 and gu <= 10 and a < length(rf) - 1
  union all select guide, p, w, target, b, a + 1, score + case when {same} or {wobble} then 4 else -7 end, gu + case when {wobble} then 1 else 0 end, mm + case when {same} or {wobble} then 0 else 1 end,
    case when {same} or {wobble} then 1 else 2 end, n, rf from l{i} where mm <= 5 and gu <= 10 and a < length(rf) - 1 and ({same} or {wobble} or kind <> 2)) where score + {4 * (window - 2 - i)} >= {need} group by all)""")
    ends = " union all ".join(f"select *, {i} as letters from l{i} where score >= {need} and score >= 2.5 * {i} and (a < length(rf) - 1 or mm > 5 or gu > 10 or {i} = {window - 1})" for i in range(least, window))
    return ",\n".join(parts) + f",\nends as ({ends})"


@query(sql("select target, b as rf_begin, guide, p, letters, a as rf_end, score, gu, mm, cast(sum(n) as bigint) as n from ends group by all", *_GUIDES, recursive=_edit_classes()).replace("with recursive", "with", 1))
def grna_edit_classes(spark, d):
    """Duplexes of guide cores with mRNAs that score 80 of 96 or more, Ts inserted freely, in classes with their numbers."""
    g = inputs.guides(spark, d).select("guide", F.col("core").alias("gseq"))
    m = inputs.mrnas(spark, d).select("target", dna.letters(F.col("mseq")).alias("letters"))
    return guides.edit_graph_classes(g, m, scoring=guides.Scoring(score_min=80))


# --- k-mers ------------------------------------------------------------------------------------------------------------

_LIB = "lib as (select substr(s, i + 1, 16) as kmer, count(*) as n from (select s, unnest(range(0, length(s) - 16)) as i from (select seq as s from reads where length(seq) > 16 union all select reverse(translate(seq, 'ACGT', 'TGCA')) from reads where length(seq) > 16)) group by kmer)"


@query(sql("select kmer, n from lib", "crypto", "reads", recursive=_LIB).replace("with recursive", "with", 1))
def kmer_library(spark, d):
    return kmers.library(inputs.sim_reads(spark, d))


@query(sql("""select rd_id, gseq, supported, max_support from (select rd_id, gseq, count(n) as supported, coalesce(max(n), 0) as max_support from (
  select rd_id, gseq, substr(gseq, i + 2, 16) as kmer from (select rd_id, seq as gseq, unnest(range(0, length(seq) - 18)) as i from reads)) left join (select * from lib where n >= 2) using (kmer) group by rd_id, gseq) where supported >= length(gseq) - 19""", "crypto", "reads", recursive=_LIB).replace("with recursive", "with", 1))
def kmer_verify(spark, d):
    """Reads, as guides, that the library of all reads supports."""
    reads = inputs.sim_reads(spark, d)
    return kmers.verify(reads.select(F.col("rd_id").alias("guide"), F.col("seq").alias("gseq")), kmers.library(reads)).withColumnRenamed("guide", "rd_id")


# --- features, links, peptides -------------------------------------------------------------------------------------------


@query("""select o_orderkey as pos, substr('ACGT', cast(o_custkey % 4 as integer) + 1, 1) as ref, substr('CGTA', cast(o_custkey % 4 as integer) + 1, 1) as alt, o_orderkey - gene_s as rel from orders, (select min(p_partkey) as gene_s from part where p_brand = (select min(p_brand) from part))""")
def snp_relative(spark, d):
    """Orders as SNPs, placed relative to the first part of the first brand."""
    part = inputs.table(spark, d, "part")
    first = part.agg(F.min("p_brand").alias("b"))
    genes = part.join(F.broadcast(first), F.col("p_brand") == F.col("b")).select(F.create_map(F.lit("ID"), F.lit("gene")).alias("tags"), F.col("p_partkey").alias("s"), F.col("p_partkey").alias("e"))
    k = (F.col("o_custkey") % 4).cast("int")
    snps = inputs.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), dna.letter(F.lit("ACGT"), k).alias("ref"), dna.letter(F.lit("CGTA"), k).alias("alt"))
    return peptides.snp_places(snps, genes, "gene")


@query(sql("""select p_partkey, case when p_size % 2 = 1 then reverse(translate(part_seq, 'ACGT', 'TGCA')) else part_seq end as seq from (
  select p_partkey, p_size, substr(seq, cast(p_partkey * 31 % 500 as integer) + 1, p_size + 10) as part_seq from part, crypto)""", "crypto"))
def gff_slice(spark, d):
    """Stretches of the reference by strand, one for each part."""
    s = (F.col("p_partkey") * 31 % 500 + 1)
    rows = inputs.table(spark, d, "part").crossJoin(F.broadcast(inputs.crypto(spark, d).select("seq")))
    strand = F.when(F.col("p_size") % 2 == 1, "-").otherwise("+")
    return rows.select("p_partkey", dna.strand_slice(F.col("seq"), s, s + F.col("p_size") + 9, strand).alias("seq"))


@query(sql("""select p.doc_id, p.name, c.n is not null as found, coalesce(c.n // 3 = p.aa, false) as fits
  from (select doc_id, source || ':' || lang as name, greatest(0, (length(seq) - 1) // 3) as aa from docs_dna join documents using (doc_id)) p
  left join (select source || ':' || lang as name, arg_min(length(seq), doc_id) as n from docs_dna join documents using (doc_id) group by 1) c on p.name = c.name""", "docs_dna"))
def pep_cds_check(spark, d):
    """Documents' translations as proteins against the first document of their source and language as coding sequence."""
    names = inputs.table(spark, d, "documents").select("doc_id", F.concat(F.col("source"), F.lit(":"), F.col("lang")).alias("name"))
    docs = inputs.docs_dna(spark, d).join(names, "doc_id")
    proteins = docs.select("name", dna.translate_frame(F.col("seq"), 0).alias("seq"), "doc_id")
    return peptides.check_proteins(proteins, docs.select("name", "seq", F.col("doc_id").alias("ord")))


@query("""with hits as (select l_partkey, cast(l_linenumber as bigint) as gl, cast(l_linenumber as bigint) + cast(l_quantity as bigint) as gr, l_suppkey, l_orderkey, l_returnflag from lineitem)
select 'c' || l_partkey as guide, gl, gr, 'm' || l_suppkey as target, l_orderkey as ml, l_orderkey + 1 as mr, 'ident=100.0' as ident from hits where l_returnflag <> 'R'
union all select 'c' || l_partkey, coalesce(p_size, 0) - gl, coalesce(p_size, 0) - gr, 'm' || l_suppkey, l_orderkey, l_orderkey + 1, 'ident=100.0' from hits left join (select * from part where p_size > 5) on l_partkey = p_partkey where l_returnflag = 'R'""")
def circos_links(spark, d):
    """Line items as links between parts and suppliers; returned ones are on the other strand."""
    rows = inputs.table(spark, d, "lineitem").select(F.concat(F.lit("c"), "l_partkey").alias("guide"), F.col("l_linenumber").cast("long").alias("gl"), (F.col("l_linenumber").cast("long") + F.col("l_quantity").cast("long")).alias("gr"), F.concat(F.lit("m"), "l_suppkey").alias("target"), F.col("l_orderkey").alias("ml"), (F.col("l_orderkey") + 1).alias("mr"), "l_returnflag")
    sizes = inputs.table(spark, d, "part").where("p_size > 5").select(F.concat(F.lit("c"), "p_partkey").alias("name"), F.col("p_size").alias("length"))
    return peptides.circos_links(rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'"), sizes)


@query(sql("select 'chr' || chr(9) || '-' || chr(9) || target || chr(9) || target || chr(9) || '0' || chr(9) || length(mseq) || chr(9) || 'green' as line from mrnas union all select 'chr' || chr(9) || '-' || chr(9) || guide || chr(9) || guide || chr(9) || '0' || chr(9) || length(gseq) || chr(9) || 'grey' from guides", *_GUIDES))
def circos_karyotype(spark, d):
    return peptides.karyotype(inputs.mrnas(spark, d).select(F.col("target").alias("name"), F.length("mseq").alias("length")), inputs.guides(spark, d).select(F.col("guide").alias("name"), F.length("gseq").alias("length")))


def _peptides(spark, d):
    docs = inputs.docs_dna(spark, d)
    sets = inputs.table(spark, d, "documents").select("doc_id", F.concat_ws(":", "source", "lang").alias("set"))
    return docs.join(sets, "doc_id").select("set", dna.translate_frame(F.col("seq"), 0).alias("pep"))


@query(sql(f"""select s as set, substr(pep, i + 1, 4) as k1, substr(pep, i + 5, 4) as k2, count(*) as weight, case when count(*) < 2 then 1.0 when count(*) < 5 then 3.0 when count(*) < 10 then 4.0 when count(*) < 20 then 6.0 when count(*) < 30 then 8.0 else 10.0 end::double as width from (
  select s, pep, unnest(range(0, length(pep) - 7)) as i from (
    select concat_ws(':', source, lang) as s, array_to_string(list_transform(range(0, greatest(0, (length(seq) - 1) // 3)), lambda j: map {{{', '.join(f"'{c}': '{a}'" for c, a in dna.CODONS.items())}}}[substr(seq, 3 * j + 1, 3)]), '') as pep from docs_dna join documents using (doc_id))) group by 1, 2, 3""", "docs_dna"))
def pep_kmer_graph(spark, d):
    """K-mer graph of the documents' translations, for each source and language, with pen widths."""
    return peptides.kmer_graph(_peptides(spark, d), 4).withColumn("width", peptides.pen_width(F.col("weight")))


# --- differential editing ------------------------------------------------------------------------------------------------

_SAMPLES = """samples as (select rd_id, 's' || (rd_id % 6) as sample from reads),
site_counts as (select pos || ':' || (20 - es) as key, sample, count(*) as n from table_long join samples using (rd_id) group by pos, es, sample)"""


def _site_counts(spark, d):
    """(key, sample, n): states of the reads of six samples."""
    long, _ = _inner(spark, d)
    return keep(long.groupBy(F.concat_ws(":", "pos", 20 - F.col("es")).alias("key"), F.concat(F.lit("s"), F.col("rd_id") % 6).alias("sample")).agg(F.count("*").alias("n")))


@query(sql("select key, coalesce(sum(n) filter (where sample = 's0'), 0) as s0, coalesce(sum(n) filter (where sample = 's1'), 0) as s1, coalesce(sum(n) filter (where sample = 's2'), 0) as s2, coalesce(sum(n) filter (where sample = 's3'), 0) as s3, coalesce(sum(n) filter (where sample = 's4'), 0) as s4, coalesce(sum(n) filter (where sample = 's5'), 0) as s5 from site_counts group by key", *_INNER, recursive=_SAMPLES).replace("with recursive", "with", 1))
def dest_samples(spark, d):
    """Dense tables of all samples bound by site."""
    names = [f"s{i}" for i in range(6)]
    return _site_counts(spark, d).groupBy("key").pivot("sample", names).agg(F.sum("n")).na.fill(0)


@query(sql("select sample, sum(n) as total, count(*) as sites from site_counts group by sample", *_INNER, recursive=_SAMPLES).replace("with recursive", "with", 1))
def library_sizes(spark, d):
    c = _site_counts(spark, d)
    return c.groupBy("sample").agg(F.sum("n").alias("total"), F.count("*").alias("sites"))


_TMM = """,
sizes as (select sample, cast(sum(n) as double) as total from site_counts group by sample),
shares as (select key, sample, n, total, n / total as share from site_counts join sizes using (sample)),
quartiles as (select sample, quantile_cont(share, 0.75) as q from shares group by sample),
chosen as (select sample as ref from quartiles order by abs(q - (select avg(q) from quartiles)), sample limit 1),
base as (select key, n as rn, total as rt from shares join chosen on sample = ref),
ratios as (select sample, key, log2(share / (rn / rt)) as m, (log2(share) + log2(rn / rt)) / 2 as a, (total - n) / total / n + (rt - rn) / rt / rn as v from shares join base using (key)),
ranked as (select *, row_number() over (partition by sample order by m, key) as rm, row_number() over (partition by sample order by a, key) as ra, count(*) over (partition by sample) as k from ratios),
middle as (select * from ranked where rm between floor(k * 0.3) + 1 and k - floor(k * 0.3) and ra between floor(k * 0.05) + 1 and k - floor(k * 0.05) and v > 0),
logs as (select sizes.sample, coalesce(sum(m / v) / sum(1 / v), 0) as ratio from sizes left join middle using (sample) group by sizes.sample)"""


@query(sql("select sample, round(pow(2, ratio - (select avg(ratio) from logs)), 6) as factor from logs", *_INNER, recursive=_SAMPLES + _TMM).replace("with recursive", "with", 1))
def de_tmm_factors(spark, d):
    """Scaling factors of the samples by trimmed means."""
    return diffexp.tmm_factors(_site_counts(spark, d)).select("sample", F.round("factor", 6).alias("factor"))


@query("""with tested as (select o_orderkey, pow((o_orderkey * 31 + o_custkey * 17) % 9973 + 1, 2) / pow(9973, 2) as p_value from orders),
quotients as (select p_value, p_value * count(*) over () / count(*) over (order by p_value) as q from tested)
select o_orderkey, round(fdr, 9) as fdr from tested join (select p_value, least(1, min(min(q)) over (order by p_value desc)) as fdr from quotients group by p_value) using (p_value)""")
def de_fdr(spark, d):
    """False discovery rates of p values, as the exact test gives them out."""
    p = F.pow((F.col("o_orderkey") * 31 + F.col("o_custkey") * 17) % 9973 + 1, F.lit(2)) / F.pow(F.lit(9973), F.lit(2))
    rows = inputs.table(spark, d, "orders").select("o_orderkey", p.alias("p_value"))
    return diffexp.false_discovery(rows).select("o_orderkey", F.round("fdr", 9).alias("fdr"))


_CONDITIONS = {f"s{i}": "control" if i < 3 else "treated" for i in range(6)}


@query()
def de_exact_test(spark, d):
    """Sites that differ between two halves of the samples, with signed fold changes."""
    tested = diffexp.exact_test(_site_counts(spark, d), _CONDITIONS, "control", "treated")
    return tested.withColumn("fold", dna.signed_fold_change(F.col("log_fc"), F.col("fdr")))


@query("select o_orderkey, round(case when fdr < 0.001 then case when lfc > 0 then pow(2, lfc) else -pow(2, -lfc) end else 0 end, 6) as fold from (select o_orderkey, (o_totalprice - 150000) / 50000 as lfc, (o_orderkey % 7) / 4000.0 as fdr from orders)")
def de_signed_fc(spark, d):
    """Signed fold changes from log ratios, where the FDR allows."""
    rows = inputs.table(spark, d, "orders").select("o_orderkey", ((F.col("o_totalprice") - 150000) / 50000).alias("lfc"), ((F.col("o_orderkey") % 7) / 4000.0).alias("fdr"))
    return rows.select("o_orderkey", F.round(dna.signed_fold_change(F.col("lfc"), F.col("fdr")), 6).alias("fold"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
