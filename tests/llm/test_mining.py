"""Repeated word sequences, the dataset manifest and phrases against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinetoflow.llm import manifest, phrases, substring_dedup

ODD = "doc_id string, text string, lang string, chunk long, key string, bits string, bucket int, size long"


def odd_rows(rows):
    """Rows with columns whose names the operators use themselves."""
    return [(i, t, g, 1, "k", "b", 2, 3) for i, t, g in rows]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed_by_loops(rows, length):
    texts = [words(t) for _, t, *_ in rows]
    seen = Counter(tuple(w[k : k + length]) for w in texts for k in range(len(w) - length + 1))
    out = []
    for row, w in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        out.append((row[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def texts_with_passages(seed, n=120, length=8):
    draw = random.Random(seed)
    some = [f"w{k}" for k in range(60)] + ["é", "naïve x", "日本"]
    passages = [" ".join(draw.choices(some, k=draw.randint(length - 1, 4 * length))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [" ".join(draw.choices(some, k=draw.randint(0, 3 * length)))]
        parts += draw.choices(passages, k=draw.choice([0, 0, 1, 2]))
        draw.shuffle(parts)
        rows.append((f"d{k}", draw.choice([" ", "\n", " \t "]).join(parts), draw.choice(["en", "de", None])))
    rows += [("null", None, "en"), ("empty", "", None), ("blank", " \n\t", "en"), (None, rows[3][1], "en"), (None, rows[4][1], "en"), rows[5], rows[5]]
    rows += [("long", " ".join(draw.choices(some, k=30_000)), "en"), ("periodic", "a b " * 50, "en")]
    return rows


@pytest.mark.parametrize("length", [5, 8, 35])
def test_repeated_windows_equal_loops(spark, monkeypatch, length):
    monkeypatch.setattr(substring_dedup, "PORTION", 4_000)
    monkeypatch.setattr(substring_dedup, "BUCKET", 3_000)
    rows = texts_with_passages(length, length=length)
    docs = spark.createDataFrame(odd_rows(rows), ODD).repartition(3)
    found = substring_dedup.dedup(docs, length, least=3).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in found], key=str) == removed_by_loops(rows, length)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)


def test_levels_never_more_than_double():
    for length in range(1, 200):
        found = substring_dedup.levels(length, 4)
        assert found[-1] == length and all(a < b <= 2 * a for a, b in zip(found, found[1:], strict=False))


def test_levels_go_on_until_nothing_repeats(spark):
    some = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(some[:100])), (2, "x " + " ".join(some[:100]) + " y"), (3, " ".join(some[200:206] + ["z"])), (4, " ".join(some[200:206])), (5, "alone")]
    found = {r.doc_id: r.longest for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 5, least=5, longest=True).collect()}
    assert found == {1: 80, 2: 80, 3: 5, 4: 5, 5: 0}


def test_no_rows_no_repeats(spark):
    schema = "doc_id long, text string"
    assert substring_dedup.dedup(spark.createDataFrame([], schema)).collect() == []
    one = substring_dedup.dedup(spark.createDataFrame([(1, "one text"), (2, None)], schema), 2).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text, r.spans) for r in one) == [(1, 2, 0, "one text", []), (2, 0, 0, "", [])]


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def proof_of(leaves, at):
    """(top, siblings of each level) of the leaf at ``at``."""
    path = []
    while len(leaves) > 1:
        first = at - at % 8
        path.append((leaves[first:at], leaves[at + 1 : first + 8]))
        leaves = [H("".join(leaves[k : k + 8])) for k in range(0, len(leaves), 8)]
        at //= 8
    return leaves[0], path


def manifest_by_loops(rows):
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = defaultdict(list)
    for row in rows:
        row["leaf"] = leaf_of(row, row["text"])
        trees[row["lang"]].append(row)
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        trees[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
    tops = [proof_of([r["leaf"] for r in trees[g]], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        root, above = proof_of(tops, k)
        for j, row in enumerate(trees[g]):
            text = row["text"]
            if row["doc_id"] is not None and text is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                text = text.translate(lowered)
            path = proof_of([r["leaf"] for r in trees[g]], j)[1] + above
            folded = leaf_of(row, text)
            for before, after in path:
                folded = H("".join([*before, folded, *after]))
            out.append((row["doc_id"], row["leaf"], tops[k], root, H("".join("".join(b + a) for b, a in path)), folded, folded == root))
    return sorted(out, key=str)


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, place long, tree int, node string"


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_equals_loops(spark, monkeypatch, depth):
    monkeypatch.setattr(manifest, "DEPTH", depth)
    monkeypatch.setattr(manifest, "SPAN", 8**depth)
    draw = random.Random(depth)
    langs = [None, "en", "de", "É", "zz", *(f"l{k}" for k in range(9))]
    rows = [{"doc_id": k, "source": draw.choice(["a", None]), "lang": draw.choice(langs[:3]), "n_chars": draw.choice([None, k]), "text": draw.choice([None, "", "Some Text", "ÄB é", "low"])} for k in range(900)]
    rows += [{"doc_id": 5000 + k, "source": "b", "lang": g, "n_chars": 1, "text": "One"} for k, g in enumerate(langs)]
    rows += [{"doc_id": None, "source": "b", "lang": "en", "n_chars": 2, "text": t} for t in ("X", "X", None)] + [dict(rows[7]), dict(rows[7]), dict(rows[8], text="other")]
    rows.append({"doc_id": 9000, "source": "b", "lang": "en", "n_chars": 7, "text": "Long é " * 200_000})
    table = spark.createDataFrame([(*r.values(), 1, 2, "n") for r in rows], MANIFEST).repartition(5)
    found = manifest.manifest(table, claimed={"text": manifest.tampered_text()})
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == manifest_by_loops(rows)


def test_manifest_of_one_row_and_of_none(spark):
    one = manifest.manifest(spark.createDataFrame([(1, None, None, None, None, 1, 1, "n")], MANIFEST), proofs=True).collect()
    (row,) = one
    assert row.leaf == row.subroot == row.root == row.folded_root == H("1:1----") and row.proof == [] and row.proof_sha256 == H("") and row.verified
    assert manifest.manifest(spark.createDataFrame([], MANIFEST)).collect() == []


def test_manifest_by_small_batches(spark, monkeypatch):
    monkeypatch.setattr(manifest, "DEPTH", 2)
    monkeypatch.setattr(manifest, "SPAN", 64)
    rows = [{"doc_id": k, "source": "a", "lang": [None, "en", "de"][k % 7 % 3], "n_chars": k, "text": f"Text {k}"} for k in range(700)]
    table = spark.createDataFrame([(*r.values(), 1, 2, "n") for r in rows], MANIFEST)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, "7")  # blocks begin and end inside batches
    try:
        found = manifest.manifest(table, claimed={"text": manifest.tampered_text()})
        assert sorted(map(tuple, found.collect()), key=str) == manifest_by_loops(rows)
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMap" not in plan  # no whole group of rows is handed over at once
    finally:
        spark.conf.set(key, own)


def collocations_by_loops(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in (1, 2, 3):
                f[lang or "und"].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        often = [p for p, a in count.items() if len(p) > 1 and a >= least]
        found = []
        for p in often:
            a = count[p]
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * count[q] >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in often):
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least", [2, 10])
def test_collocations_equal_loops(spark, monkeypatch, least):
    for name, value in (("PORTION", 3_000), ("HELD", 700), ("BURST", 20), ("PARTITION", 900)):
        monkeypatch.setattr(phrases, name, value)
    draw = random.Random(least)
    some = [f"w{k}" for k in range(30)] + ["É", "é", "日本", "A", "a", "x y", "Zz"]
    weights = [40] + [1] * (len(some) - 1)
    seps = [" ", " ", " ", " ", "\t", ", ", ". ", "\n", " ; "]
    rows = [("".join(w + draw.choice(seps) for w in draw.choices(some, weights, k=draw.randint(0, 60))), draw.choice(["en", "en", "de", None, "und"])) for _ in range(300)]
    rows += [(None, "en"), ("", None), (" \t.,!", "en"), ("hot pair " * 3_000, "en"), ("one", "rare"), ("new york city " * 9 + "new york", "fr"), rows[0], rows[0]]
    docs = spark.createDataFrame([(k, t, g, 1, "k", "b", 2, 3) for k, (t, g) in enumerate(rows)], ODD.replace("doc_id string", "doc_id long")).repartition(4)
    assert sorted(map(tuple, phrases.collocations(docs, least=least, top=40).collect())) == collocations_by_loops(rows, least, 40)


def test_collocations_of_nothing(spark):
    schema = "text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], schema)).collect() == []


def test_tries_burst_and_keep_their_counts():
    trie, keys = phrases.Trie(), np.random.default_rng(1).integers(0, 3_000, 60_000) << 42
    assert trie.add(keys[:30_000]) + trie.add(keys[30_000:]) == len(np.unique(keys)) == trie.size
    trie.burst() if trie.below is None else None
    found = Counter()
    for k, c in trie.items():
        found.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    assert found == Counter(keys.tolist())
