"""Column functions over DNA strings, their run-length form, and pairings.

The letters of a sequence other than T, and the array of T-run lengths before each of them and after the last, carry the
whole sequence: size(runs) = length(letters) + 1 for every string, the empty one too. Input is upper case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The genetic code, a fixed table: amino acids of the 64 codons in the order of their letters T, C, A, G; TGA codes for W.
AMINO_ACIDS = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
STOPS = ("TAA", "TAG")
#: Start codons of the three tables.
STARTS = {"default": ("ATG", "TTG", "GTG", "CTG", "ATA"), "default-ATG": ("ATG",), "default-GTG": ("GTG",)}
#: Motifs in the flank of a guide, as they read on its strand.
MOTIFS = ("AAAGCCTAT", "AAAGCCTAC", "AAAGCCTGT", "AAAGCCTGC")


def _ints(values: Column) -> Column:
    return values.cast("array<int>")


def count_to(n: Column | int) -> Column:
    """0 .. n - 1; empty for n <= 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def letter(s: Column, i: Column) -> Column:
    """Letter at 0-based place ``i``."""
    return F.substring(s, (i + 1).cast("int"), F.lit(1))


def letters(seq: Column) -> Column:
    return F.regexp_replace(seq, "T", "")


def runs(seq: Column) -> Column:
    return _ints(F.transform(F.split(seq, "[^T]", -1), F.length))


def tless(seq: Column) -> Column:
    return F.struct(letters(seq).alias("letters"), runs(seq).alias("runs"))


def untless(letters_: Column, runs_: Column) -> Column:
    """The sequence again."""
    parts = F.zip_with(runs_, F.split(letters_, ""), lambda n, c: F.concat(F.repeat(F.lit("T"), n), F.coalesce(c, F.lit(""))))
    return F.array_join(parts, "")


def dump_tless(letters_: Column, runs_: Column) -> Column:
    """Letters, a bar, and the runs with commas."""
    return F.concat(letters_, F.lit("|"), F.array_join(runs_.cast("array<string>"), ","))


def seq_place(runs_: Column, p: Column) -> Column:
    """Place in the sequence of letter ``p``: p plus the runs up to it."""
    return p + F.aggregate(F.slice(runs_, 1, (p + 1).cast("int")), F.lit(0), lambda a, x: a + x)


def letter_place(seq: Column, pos: Column) -> Column:
    """Number of the letter at place ``pos`` of the sequence; of the letter before it on a T, -1 if there is none."""
    return F.length(F.regexp_replace(F.substring(seq, F.lit(1), (pos + 1).cast("int")), "[Tt]", "")) - 1


def upper_dna(s: Column) -> Column:
    return F.upper(s)


def revcomp(s: Column) -> Column:
    """Reverse complement; letters other than A, C, G, T become N."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGT]", "N"), "ACGT", "TGCA"))


def revcomp_known(s: Column) -> Column:
    """Reverse complement of the letters A, C, G, T alone."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGT]", ""), "ACGT", "TGCA"))


def is_dna(s: Column) -> Column:
    return ~s.rlike("[^ACGT]")


def fields(s: Column, delimiter: str) -> Column:
    """Split at a delimiter; one empty field at the end is dropped, inner ones stay."""
    parts = F.split(s, f"\\Q{delimiter}\\E", -1)
    return F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def subseq(s: Column, a: Column, b: Column) -> Column:
    """Letters a to b, both included, counted from 1."""
    return F.substring(s, a.cast("int"), (b - a + 1).cast("int"))


def strand_slice(s: Column, a: Column, b: Column, strand: Column) -> Column:
    return F.when(strand == "-", revcomp(subseq(s, a, b))).otherwise(subseq(s, a, b))


def aligned_sequence(letters_: Column, runs_: Column, ref_s: Column, dr: Column) -> Column:
    """Sequence of an alignment: reference letters ref_s .. ref_s + size(dr), each but the last followed by its edited run."""
    own = F.split(F.substring(letters_, ref_s + 1, F.size(dr)), "")
    edited = F.zip_with(dr, F.slice(runs_, ref_s + 2, F.size(dr)), lambda d, r: F.repeat(F.lit("T"), d + r))
    return F.concat(F.array_join(F.zip_with(F.slice(own, 1, F.size(dr)), edited, lambda c, t: F.concat(c, t)), ""), letter(letters_, ref_s + F.size(dr)))


def letter_places(seq: Column) -> Column:
    """Places in the sequence of its letters other than T, in one pass."""
    return F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when((c != "T") & (c != ""), i)), lambda i: i.isNotNull())


def pair_view(letters_: Column, runs_: Column, ref_s: Column, dr: Column, seq: Column | None = None, places: Column | None = None) -> Column:
    """Struct of two rows of equal length: reference and read. Inserted runs are t over -, deleted ones - under T.

    Letters and runs outside the alignment stand over -; no run is lost. Only the aligned letters are gone through one by one. The reference's
    sequence and ``letter_places`` are made anew for each row where they are not given.
    """
    whole = untless(letters_, runs_) if seq is None else seq
    place = lambda p: seq_place(runs_, p) if places is None else F.coalesce(F.get(places, p), F.length(whole))
    m = F.least(F.size(dr), F.greatest(F.length(letters_) - ref_s, F.lit(0)))  # the last one may be the run after all letters
    dash = lambda k: F.repeat(F.lit("-"), k)
    ts = lambda c, k: F.repeat(F.lit(c), F.greatest(k, F.lit(0)))
    own = F.zip_with(F.split(F.substring(letters_, ref_s + 2, F.size(dr)), ""), F.slice(runs_, ref_s + 2, F.size(dr)), lambda c, r: F.struct(F.coalesce(c, F.lit("")).alias("c"), r.alias("r")))

    def both(x: Column, e: Column) -> Column:
        top = F.concat(ts("T", x["r"]), ts("-", e), x["c"])
        bottom = F.concat(ts("T", F.least(x["r"], x["r"] + e)), dash(F.greatest(-e, F.lit(0))), ts("t", e), x["c"])
        return F.struct(top.alias("top"), bottom.alias("bottom"))

    def out(x: Column) -> Column:
        first, after = x["first"], x["last"] + 2
        top = F.concat(F.substring(whole, F.lit(1), first + 1), F.array_join(x["parts"]["top"], ""), F.substring(whole, after, F.length(whole)))
        bottom = F.concat(dash(first), letter(letters_, ref_s), F.array_join(x["parts"]["bottom"], ""), dash(F.length(whole) - after + 1))
        return F.struct(top.alias("ref_row"), bottom.alias("read_row"))

    parts = F.slice(F.zip_with(F.slice(own, 1, m), F.slice(dr, 1, m), both), 1, m)
    return F.element_at(F.transform(F.array(F.struct(parts.alias("parts"), place(ref_s).alias("first"), place(ref_s + F.size(dr)).alias("last"))), out), 1)


def codon_map() -> Column:
    return F.create_map([F.lit(x) for pair in CODONS.items() for x in pair])


def genetic_code(table: str) -> dict[str, tuple[str, bool, bool]]:
    """codon -> (amino acid, is start, is stop); empty for an unknown table."""
    return {c: (a, c in STARTS[table], c in STOPS) for c, a in CODONS.items()} if table in STARTS else {}


def codons(seq: Column, frame: int) -> Column:
    """The codons at frame, frame + 3, ... that end before the last letter."""
    found = F.regexp_extract_all(F.substring(seq, frame + 1, 2**31 - 1), F.lit("(?s)..."), F.lit(0))
    return F.slice(found, 1, F.greatest(F.lit(0), F.floor((F.length(seq) - 1 - frame) / 3).cast("int")))


def translate_frame(seq: Column, frame: int) -> Column:
    """Amino acids of the codons at frame, frame + 3, ... that end before the last letter; unknown codons give nothing."""
    code = codon_map()
    return F.array_join(F.transform(codons(seq, frame), lambda c: F.coalesce(F.element_at(code, c), F.lit(""))), "")


def longest_orf(seq: Column, table: str = "default") -> Column:
    """Struct (complete, cds_begin, cds_len, cds, pep) of the longest frame from start to stop codon.

    In each frame a reading frame ends at a stop and begins at the left-most start after the stop before it, not at place
    0 of the sequence; the longest wins, then the lower frame, then the earlier stop. complete: over 30 amino acids.
    """
    starts, stops = F.array(*[F.lit(s) for s in STARTS[table]]), F.array(*[F.lit(s) for s in STOPS])
    best = F.struct(F.lit(0).alias("aa"), F.lit(0).alias("begin"))

    def in_frame(frame: int) -> Column:
        def step(acc: Column, codon: Column) -> Column:
            i = acc["at"]
            is_stop = F.array_contains(stops, codon)
            size = ((i - acc["start"]) / 3).cast("int")
            longer = is_stop & (acc["start"] >= 0) & (size > acc["aa"])
            begun = F.when(is_stop, F.lit(-1)).when((acc["start"] < 0) & (i > 0) & F.array_contains(starts, codon), i).otherwise(acc["start"])
            return F.struct((i + 3).alias("at"), begun.alias("start"), F.when(longer, size).otherwise(acc["aa"]).alias("aa"), F.when(longer, acc["start"]).otherwise(acc["begin"]).alias("begin"))

        blank = F.struct(F.lit(frame).alias("at"), F.lit(-1).alias("start"), F.lit(0).alias("aa"), F.lit(0).alias("begin"))
        return F.aggregate(codons(seq, frame), blank, step, lambda acc: F.struct(acc["aa"].alias("aa"), acc["begin"].alias("begin")))

    found = F.aggregate(F.array(*[in_frame(f) for f in range(3)]), best, lambda a, x: F.when(x["aa"] > a["aa"], x).otherwise(a))
    code = codon_map()

    def out(b: Column) -> Column:
        cds = F.substring(seq, b["begin"] + 1, 3 * (b["aa"] + 1))
        pep = F.array_join(F.transform(F.slice(F.regexp_extract_all(cds, F.lit("(?s)..."), F.lit(0)), 1, b["aa"]), lambda c: F.element_at(code, c)), "")
        return F.struct((b["aa"] > 30).alias("complete"), b["begin"].alias("cds_begin"), (3 * (b["aa"] + 1)).alias("cds_len"), cds.alias("cds"), pep.alias("pep"))

    return F.element_at(F.transform(F.array(found), out), 1)


def wobble(guide: Column, target: Column) -> Column:
    """G:U pair as it shows on the DNA of both: C over T, A over G."""
    return ((guide == "C") & (target == "T")) | ((guide == "A") & (target == "G"))


def pair_mark(guide: Column, target: Column, other: str = "#") -> Column:
    return F.when(guide == target, "|").when(wobble(guide, target), ":").otherwise(other)


def pair_score(guide: Column, target: Column) -> Column:
    return F.when(guide == target, 2).when(wobble(guide, target), 1).otherwise(-2)


def alignment_marks(guide: Column, target: Column, other: str = "#") -> Column:
    """A mark for each letter of two strings, up to the shorter's end."""
    n = F.least(F.length(guide), F.length(target))
    return F.array_join(F.transform(count_to(n), lambda i: pair_mark(letter(guide, i), letter(target, i), other)), "")


def marks_score(marks: Column) -> Column:
    """Struct (score, gu, mm): 2 for a match, 1 for a wobble pair, -2 for a mismatch."""
    gu = F.length(F.regexp_replace(marks, "[^:]", ""))
    mm = F.length(F.regexp_replace(marks, "[|:]", ""))
    return F.struct((2 * (F.length(marks) - gu - mm) + gu - 2 * mm).alias("score"), gu.alias("gu"), mm.alias("mm"))


def is_valid_hit(length: Column, gu: Column, mm: Column, min_score: int = 32, min_length: int = 24) -> Column:
    return ((-2 * mm + gu + 2 * (length - gu - mm)) > min_score) & (length > min_length)


def trim_to_anchor(guide: Column, gl: Column, gr: Column, target: Column, ml: Column, mr: Column, anchor: int = 5, wobble_anchor: bool = False) -> Column:
    """Struct (gr, mr): right ends cut to the right-most run of ``anchor`` matches at or before them.

    The scan begins at the letters on the right ends, one past the segment. Without such a run the ends are those of
    a scan that stopped at the left ends: left end plus ``anchor``.
    """
    n = F.least(gr - gl, mr - ml)  # letters to scan; the left-most one of the segment is not
    marks = F.array_join(F.transform(count_to(n), lambda i: F.when((letter(guide, gr - i) == letter(target, mr - i)) & (letter(guide, gr - i) != ""), "|").when(F.lit(wobble_anchor) & wobble(letter(guide, gr - i), letter(target, mr - i)), "|").otherwise("#")), "")
    at = F.instr(marks, "|" * anchor)  # 1-based start of the run, scanning leftwards
    steps = F.when(at > 0, at + anchor - 2).otherwise(n)
    return F.struct((gr - steps + anchor).alias("gr"), (mr - steps + anchor).alias("mr"))


def trim_anchor_marks(guide: Column, target: Column, anchor: int = 4) -> Column:
    """Marks up to the right-most run of ``anchor`` matches; the first letter is not part of the search.

    Without such a run the marks of the letters that a scan had matched when it came to the first letter stay, with the first.
    """
    marks = alignment_marks(guide, target, "^")
    n = F.length(marks)
    back = F.reverse(F.substring(marks, F.lit(2), n))  # the scan: last letter first, never the first letter
    at = F.instr(back, "|" * anchor)
    head = F.length(F.regexp_extract(back, r"(\|*)$", 1))
    return F.when(n == 0, "").when(at > 0, F.substring(marks, F.lit(1), n - at + 1)).otherwise(F.substring(marks, F.lit(1), head + 1))


def edit_path(action: Column, rf_begin: Column, runs_: Column) -> Column:
    """Runs that a guide asks for, less those of the reference: one value for each matched or mismatched letter."""
    zero = F.struct(F.lit(0).alias("held"), (rf_begin + 1).alias("at"), F.array().cast("array<int>").alias("path"))
    steps = F.transform(count_to(F.length(action)), lambda i: letter(action, i))

    def step(acc: Column, a: Column) -> Column:
        moves = a.isin("M", "*")
        return F.struct(F.when(moves, 0).otherwise(acc["held"] + 1).alias("held"), F.when(moves, acc["at"] + 1).otherwise(acc["at"]).alias("at"), F.when(moves, F.concat(acc["path"], F.array(acc["held"] - F.coalesce(F.get(runs_, acc["at"]), F.lit(0))))).otherwise(acc["path"]).alias("path"))

    return F.aggregate(steps, zero, step, lambda acc: acc["path"])


def shift_place(pos: Column, offset: Column) -> Column:
    return pos - offset


def signed_fold_change(log_fc: Column, fdr: Column, most: float = 0.001) -> Column:
    """2^lfc for rises, -2^|lfc| for falls, 0 where the FDR is not below ``most``."""
    return F.when(fdr < most, F.when(log_fc > 0, F.pow(F.lit(2.0), log_fc)).otherwise(-F.pow(F.lit(2.0), -log_fc))).otherwise(0.0)


def stamp(full: bool = False) -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss" if full else "HH:mm:ss")
