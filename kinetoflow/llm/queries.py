"""The registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_text, line_dedup, manifest, mixing, packing, phrases, pii, quality, simhash_dedup, substring_dedup, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that repeat, even roughly, an earlier line."""
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: doc_id, fingerprint (16 hex digits), component_id."""
    groups = simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items: best window of each pair of document and item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data and secrets."""
    key = spark.conf.get("spark.kinetoflow.surrogate.key", "a key for trials only")
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key=key.encode())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids in packed rows, with segments and where positions start again."""
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.withColumn("position_resets", F.slice("cu_seqlens", 1, F.size("cu_seqlens") - 1))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest vectors found for every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives with revisit records and read back by the salvage reader."""
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that occur more than once: counts and a digest of what is kept."""
    kept = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its text, tampered with for a third of them, still gives the root."""
    docs = table(spark, sf_dir, "documents").select(*manifest.FIELDS)
    return manifest.manifest(docs, claimed={"text": manifest.tampered_text()})


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that stand out most by their weakest cut."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


#: What the archives must give back; base32 is four characters for every five hex digits.
WARC_SQL = """with p as (select page_id, url, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
f as (select hex, min(page_id) as first_id from p group by hex)
select page_id, url, cast(octet_length(encode(body)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(hex, 5 * (k // 4) + 1, 5) as integer) >> cast(15 - 5 * (k % 4) as integer)) & 31 as integer) + 1, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
from p join f using (hex)"""

SUBSTRING_SQL = r"""with d as (select doc_id, row_number() over () as u, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select u, unnest(range(1, len(w) - 33)) as i, unnest(list_transform(range(1, len(w) - 33), lambda k: md5(array_to_string(w[k:k + 34], ' ')))) as h from d where len(w) >= 35),
g as (select u, i, count(*) over (partition by h) as n from s),
p as (select d.doc_id, d.u, unnest(d.w) as word, unnest(range(1, len(d.w) + 1)) as i from d),
m as (select p.*, coalesce(max(case when g.n > 1 then 1 else 0 end) over (partition by p.u order by p.i rows between 34 preceding and current row), 0) as gone
  from p left join g on g.u = p.u and g.i = p.i)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join (select u, sum(gone) as n, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from m group by u) k on k.u = d.u"""

PHRASE_SQL = r"""with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from d),
g as (select lang, m, phrase, count(*) as f from (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase from p, (values (1), (2), (3)) as s(m) where len(w) >= m) group by lang, m, phrase),
n as (select lang, cast(sum(f) as bigint) as n from g where m = 1 group by lang),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from g where m > 1 and f >= 10),
k as (select *, unnest(range(1, m)) as k from c),
q as (select k.lang, k.phrase, k.m, k.a, k.k, x.f as l, y.f as r, cast(1000000 as hugeint) * k.a * k.a // (cast(x.f as hugeint) * y.f) as score from k
  join g x on x.lang = k.lang and x.phrase = array_to_string(k.w[1:k.k], ' ') join g y on y.lang = k.lang and y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b as (select * from q qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, array_to_string(w[j:j + 1], ' ') as phrase, max(a) as most from (select *, unnest([1, 2]) as j from c where m = 3) group by all),
o as (select b.* from b left join i using (lang, phrase) where i.most is null or 100 * i.most < 50 * b.a)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from (select o.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o) join n using (lang) where rank <= 2000"""


def manifest_sql(levels: int = 6, over: int = 3) -> str:
    """The manifest by a chain of groupings, one for each level: trees of up to 8^levels rows, up to 8^over trees."""
    field = lambda c: f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in manifest.FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "case when k % 8 = 0 then xor(c, ascii(substr(id, k // 8 + 1, 1))) else c end"
    crc = f"xor(4294967295, list_reduce(range(0, 8 * length(id)), lambda c, k: xor(({byte}) >> 1, 3988292384 * (({byte}) & 1)), 4294967295))"
    parts = [
        f"with a as (select *, cast(doc_id as varchar) as id, {leaf('text')} as leaf, row_number() over () as u from documents)",
        f"b as (select *, case when {crc} % 3 = 0 then {leaf(lower)} else leaf end as c0 from a)",
        "t as (select lang, row_number() over (order by lang nulls first) - 1 as tree from (select distinct lang from documents))",
        "d0 as (select u, tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, c0 as c, '' as proof from b join t on b.lang is not distinct from t.lang)",
        "n0 as (select tree, i, leaf as h, count(*) over (partition by tree) as n from d0 join b using (u))",
    ]

    def climb(k: int, d: str, n: str) -> tuple[str, str]:
        beside = f"coalesce(string_agg(h, '' order by n.i) filter (where n.i {{}} d.i), '')"
        parts.append(f"s{k} as (select u, max(n.n) as n, {beside.format('<')} as p, {beside.format('>')} as q from {d} d join {n} n on n.tree = d.tree and n.i // 8 = d.i // 8 group by u)")
        parts.append(f"d{k + 1} as (select u, tree, i // 8 as i, case when s.n = 1 then c else sha256(p || c || q) end as c, proof || p || q as proof from {d} d join s{k} s using (u))")
        parts.append(f"n{k + 1} as (select *, count(*) over (partition by tree) as n from (select tree, i // 8 as i, case when max(n) = 1 then max(h) else sha256(string_agg(h, '' order by i)) end as h from {n} group by tree, i // 8))")
        return f"d{k + 1}", f"n{k + 1}"

    d, n = "d0", "n0"
    for k in range(levels):
        d, n = climb(k, d, n)
    parts.append(f"e0 as (select u, 0 as tree, tree as i, c, proof from {d})")
    parts.append(f"r0 as (select 0 as tree, tree as i, h, count(*) over () as n from {n})")
    top, d, n = n, "e0", "r0"
    for k in range(levels + 1, levels + over + 1):
        d, n = climb(k, d, n)
    parts[-1] += f" select doc_id, leaf, x.h as subroot, y.h as root, sha256(proof) as proof_sha256, c as folded_root, c = y.h as verified from b join {d} z using (u) join t on b.lang is not distinct from t.lang join {top} x on x.tree = t.tree cross join {n} y"
    return ",\n".join(parts)


def oracle_sql() -> dict[str, str]:
    """Fingerprints, networks, tokenizers and random draws have no SQL form; tests/llm compares those with brute force."""
    return {"op10_warc": WARC_SQL, "op11_repeated_substrings": SUBSTRING_SQL, "op12_merkle_manifest": manifest_sql(), "op13_collocations": PHRASE_SQL}
