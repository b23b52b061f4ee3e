"""Sequence inputs derived from the given tables, as DataFrames and as SQL common table expressions.

- docs_dna: the A, C, G, T of every document; bench_ref: those of every benchmark item.
- crypto: one reference, all bench_ref strung together in the order of their ids.
- sim_reads: a read of crypto for each customer, edited by a program that depends on site and read group alone, so that
  overlapping reads of a group agree; every other customer repeats a read, every third is on the other strand, and some have one letter changed.
- mrnas: edited stretches of crypto, one for each region; guides: one for each supplier, from an mRNA with wobble pairs.
- events: letters of each user's events in the order of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import align
from ..operators.store import once, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dna(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^ACGT]", "")


def docs_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _dna(F.col("text")).alias("seq"))


def bench_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("ref_idx"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("ref_name"), _dna(F.col("text")).alias("seq"))
    return align.encode_refs(rows)


def crypto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_idx, ref_name, seq, letters, runs), one row: the benchmark is the reference, small beside the reads."""
    parts = table(spark, sf_dir, "benchmark").select(F.struct("item_id", _dna(F.col("text")).alias("seq")).alias("x"))
    joined = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["seq"]), "").alias("seq"))
    return align.encode_refs(joined.where("seq <> ''").select(F.lit(0).alias("ref_idx"), F.lit("crypto").alias("ref_name"), "seq"))


def edited(keys: DataFrame, refs: DataFrame) -> DataFrame:
    """(rd_id, k, seq): the read of crypto that key k stands for."""
    rows = keys.crossJoin(F.broadcast(refs.select("letters", "runs", F.length("letters").alias("n"))))
    rows = rows.withColumn("s", (F.col("k") * 7919 % (F.col("n") - 60)).cast("int")).withColumn("m", (40 + F.col("k") % 21).cast("int")).withColumn("g", (F.col("k") % 4).cast("int"))
    rows = once(rows.withColumn("letters", F.substring("letters", F.col("s") + 1, F.col("m") + 1)).withColumn("runs", F.slice("runs", F.col("s") + 1, F.col("m") + 2)))
    def part(j: Column) -> Column:
        p, g = F.col("s") + j, F.col("g")
        e = F.when((p * 31 + g * 17) % 7 == 0, (p + g) % 5 + 1).when((p * 13 + g) % 11 == 0, -1).otherwise(0)
        return F.concat(dna.letter(F.col("letters"), j), F.repeat(F.lit("T"), F.greatest(F.lit(0), F.get("runs", j + 1) + e)))
    seq = F.concat(F.array_join(F.transform(dna.count_to(F.col("m")), part), ""), dna.letter(F.col("letters"), F.col("m")))
    return once(rows.select("rd_id", "k", seq.alias("seq")))


def sim_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rd_id"), F.floor(F.col("c_custkey") / 2).alias("k"))
    rows = spread(edited(spread(keys, "rd_id"), crypto(spark, sf_dir)), "rd_id")  # a shuffle, so that no later step makes the reads again
    changed = F.when(F.col("k") % 5 == 0, F.concat(F.substring("seq", 1, 30), F.translate(F.substring("seq", 31, 1), "ACGT", "CGAA"), F.expr("substring(seq, 32)"))).otherwise(F.col("seq"))
    rows = rows.withColumn("seq", changed)
    return once(rows.select("rd_id", F.when(F.col("rd_id") % 3 == 0, dna.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq")))


def alignments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Alignments of sim_reads, and their reference."""
    refs = crypto(spark, sf_dir)
    return align.align(sim_reads(spark, sf_dir), refs), refs


def mrnas(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("rd_id"), F.col("r_regionkey").cast("long").alias("k"))
    return edited(keys, crypto(spark, sf_dir)).select(F.concat(F.lit("mrna"), F.col("rd_id").cast("string")).alias("target"), F.col("rd_id").alias("k"), F.col("seq").alias("mseq"))


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(guide, gseq, core): eight letters, forty of an mRNA with wobble pairs and some changes, and a tail with a motif for every other one."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("k"), (F.col("s_suppkey") * 13 % 17).cast("int").alias("at"))
    rows = rows.join(F.broadcast(mrnas(spark, sf_dir).select("k", "mseq")), "k")
    def part(i: Column) -> Column:
        c, x = dna.letter(F.col("mseq"), F.col("at") + i), i + F.col("s_suppkey")
        return F.when((c == "T") & (x % 3 == 0), "C").when((c == "G") & (x % 4 == 0), "A").when(x % 23 == 0, F.translate(c, "ACGT", "CAAG")).otherwise(c)
    core = F.array_join(F.transform(dna.count_to(40), part), "")
    tail = F.when(F.col("s_suppkey") % 2 == 0, "GAAAGCCTATGGACA").otherwise("CAGTCAGGTACACGG")
    return rows.select(F.concat(F.lit("guide"), F.col("s_suppkey").cast("string")).alias("guide"), F.concat(F.lit("GACCAGAC"), core, tail).alias("gseq"), core.alias("core"))


LETTERS = {"view": "T", "click": "A", "purchase": "C", "signup": "G"}


def event_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, event_id, letter) of the events that have a letter."""
    code = F.create_map([F.lit(x) for p in LETTERS.items() for x in p])
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.element_at(code, F.col("event_type")).alias("letter")).where("letter is not null")


# --- the same in SQL -------------------------------------------------------------------------------------------------

RUNS = "list_transform(string_split_regex({s}, '[^T]'), lambda x: cast(length(x) as integer))"
REVCOMP = "reverse(translate({s}, 'ACGT', 'TGCA'))"


def _edited(name: str, keys: str) -> str:
    e = "case when ((s + j) * 31 + g * 17) % 7 = 0 then (s + j + g) % 5 + 1 when ((s + j) * 13 + g) % 11 = 0 then -1 else 0 end"
    return f"""{name}_k as (select rd_id, k, letters, runs, k * 7919 % (length(letters) - 60) as s, 40 + k % 21 as m, k % 4 as g from ({keys}), crypto),
{name} as (select rd_id, k, array_to_string(list_transform(range(0, m), lambda j: substr(letters, s + j + 1, 1) || repeat('T', greatest(0, runs[s + j + 2] + {e}))), '') || substr(letters, s + m + 1, 1) as seq from {name}_k)"""


CTES = {
    "docs_dna": "docs_dna as (select doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') as seq from documents)",
    "bench_ref": f"bench_ref as (select cast(item_id as integer) as ref_idx, seq, replace(seq, 'T', '') as letters, {RUNS.format(s='seq')} as runs from (select item_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') as seq from benchmark))",
    "crypto": f"crypto as (select 0 as ref_idx, 'crypto' as ref_name, seq, replace(seq, 'T', '') as letters, {RUNS.format(s='seq')} as runs, length(replace(seq, 'T', '')) as sites from (select string_agg(regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g'), '' order by item_id) as seq from benchmark) where seq <> '')",
    "reads": _edited("raw_reads", "select c_custkey as rd_id, c_custkey // 2 as k from customer") + """,
reads as (select rd_id, case when rd_id % 3 = 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as seq from (
  select rd_id, case when k % 5 = 0 then substr(seq, 1, 30) || translate(substr(seq, 31, 1), 'ACGT', 'CGAA') || substr(seq, 32) else seq end as seq from raw_reads))""",
    "strands": f"""strands as (select * from (select rd_id, reversed, replace(seq, 'T', '') as letters, {RUNS.format(s='seq')} as runs from (
  select rd_id, false as reversed, seq from reads union all select rd_id, true, {REVCOMP.format(s='seq')} from reads)) where length(letters) > 20)""",
    "aligned": """kmers as (select ref_idx, p, substr(letters, p + 1, 10) as kmer from (select ref_idx, letters, unnest(range(0, length(letters) - 10)) as p from crypto)),
seeds as (select rd_id, reversed, i * 10 as pos, substr(letters, i * 10 + 1, 10) as kmer from (select rd_id, reversed, letters, unnest(range(0, length(letters) // 10 - 1)) as i from strands)),
hits as (select rd_id, reversed, pos, ref_idx, p from seeds join kmers using (kmer)),
islands as (select *, pos // 10 - row_number() over (partition by rd_id, reversed, ref_idx, p - pos order by pos) as island from hits),
chains as (select rd_id, reversed, ref_idx, min(pos) as pos, min(p) as p, count(*) * 10 as covered from islands group by rd_id, reversed, ref_idx, p - pos, island),
best as (select * from (select *, row_number() over (partition by rd_id, reversed order by covered desc, pos, ref_idx, p) as r from chains) where r = 1),
x0 as (select b.rd_id, b.reversed, b.ref_idx, b.pos, b.covered, b.p - b.pos as d, s.letters, s.runs, c.letters as rf, c.runs as rf_runs, length(s.letters) as m, greatest(0, b.pos - b.p) as lo, least(length(s.letters) - 1, length(c.letters) - 1 - (b.p - b.pos)) as hi
  from best b join strands s on b.rd_id = s.rd_id and b.reversed = s.reversed join crypto c on b.ref_idx = c.ref_idx),
x1 as (select *, list_filter(range(lo, hi + 1), lambda x: substr(letters, x + 1, 1) <> substr(rf, x + d + 1, 1)) as mis from x0),
x2 as (select *, list_reverse(list_filter(mis, lambda x: x <= pos and x > lo)) as bef, coalesce(list_min(list_filter(mis, lambda x: x > pos + covered - 1)) - 1, hi) as r0 from x1),
x3 as (select *, least(len(bef), 1) as mml, case when len(bef) >= 1 then bef[1] - 1 else lo end as lft, list_filter(mis, lambda y: y >= r0 and y < hi) as aft from x2),
x4 as (select *, case when mml = 1 then r0 when len(aft) >= 1 then aft[1] + 1 else hi end as rgt, mml + least(len(aft), 1 - mml) as mm from x3),
x5 as (select *, rgt - lft as ln, lft + d as ref_s from x4 where rgt - lft > 10 and rgt - lft > 0.75 * m),
x6 as (select ref_idx, rd_id, reversed, ref_s, ref_s + ln as ref_e, list_transform(range(0, ln), lambda i: runs[lft + i + 2] - rf_runs[ref_s + i + 2]) as dr, mm from x5),
aligned as (select ref_idx, rd_id, reversed, ref_s, ref_e, dr, mm, len(list_filter(dr, lambda x: x <> 0)) as esd from (select *, row_number() over (partition by rd_id order by ref_e - ref_s desc, reversed) as r from x6) where r = 1)""",
    "long": "long as (select ref_idx, rd_id, ref_s, j, ref_s + j as pos, dr[j + 1] as es from (select *, unnest(range(0, len(dr))) as j from aligned))",
    "inner_long": "inner_long as (select ref_idx, rd_id, j, ref_s + j as pos, dr[j + 2] as es from (select *, unnest(range(0, len(dr) - 3)) as j from aligned where not list_bool_or(list_transform(dr[2:len(dr) - 2], lambda x: x > 20))))",
    "table_long": "table_long as (select l.* from inner_long l join crypto using (ref_idx) where es between -19 and 20 and pos < sites)",
    "dedup": "dedup as (select * from (select *, row_number() over (partition by ref_idx, ref_s, ref_e, dr order by rd_id desc) as r from aligned) where r = 1)",
    "edges": """edges as (select l.ref_idx, l.rd_id as src, r.rd_id as dst, l.ref_e - r.ref_s as overlap, len(r.dr) - (l.ref_e - r.ref_s) as extend, len(r.dr) - (l.ref_e - r.ref_s) as value
  from dedup l join dedup r on l.ref_idx = r.ref_idx and l.rd_id <> r.rd_id and l.ref_s <= r.ref_s and r.ref_e - l.ref_e > 10 and l.ref_e - r.ref_s > 10
   and l.dr[r.ref_s - l.ref_s + 1:len(l.dr)] = r.dr[1:l.ref_e - r.ref_s]),
ranked as (select *, row_number() over (partition by ref_idx, src order by value desc, dst) as rank from edges)""",
    "mrnas": _edited("raw_mrnas", "select cast(r_regionkey as bigint) as rd_id, cast(r_regionkey as bigint) as k from region") + ",\nmrnas as (select 'mrna' || rd_id as target, rd_id as k, seq as mseq from raw_mrnas)",
    "guides": """guides as (select guide, 'GACCAGAC' || core || tail as gseq, core from (
  select 'guide' || s_suppkey as guide, case when s_suppkey % 2 = 0 then 'GAAAGCCTATGGACA' else 'CAGTCAGGTACACGG' end as tail,
   array_to_string(list_transform(range(0, 40), lambda i: case when substr(mseq, off + i + 1, 1) = 'T' and (i + s_suppkey) % 3 = 0 then 'C' when substr(mseq, off + i + 1, 1) = 'G' and (i + s_suppkey) % 4 = 0 then 'A'
     when (i + s_suppkey) % 23 = 0 then translate(substr(mseq, off + i + 1, 1), 'ACGT', 'CAAG') else substr(mseq, off + i + 1, 1) end), '') as core
  from (select s_suppkey, mseq, s_suppkey * 13 % 17 as off from supplier join mrnas on s_suppkey % 5 = k)))""",
    "letters": "letters as (select user_id, ts, event_id, case event_type when 'view' then 'T' when 'click' then 'A' when 'purchase' then 'C' when 'signup' then 'G' end as letter from events where event_type in ('view', 'click', 'purchase', 'signup'))",
}
ALIGNED = ("crypto", "reads", "strands", "aligned")


def sql(final: str, *ctes: str, recursive: str = "") -> str:
    """``final`` after the named expressions; ``recursive`` holds more of them that refer to themselves."""
    parts = [CTES[c] for c in ctes] + ([recursive] if recursive else [])
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + final
