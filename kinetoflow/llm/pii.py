"""Personal data and secrets: keyed surrogates of the same type, gender, script and format.

Formatted entities (addresses, numbers, keys) go through a keyed permutation of all strings of their own format: a Feistel network on
the string's index in the mixed-radix space of its character classes, walked until it lands in the space again. Being
one to one it keeps distinct entities distinct without looking at others, and equal ones equal in every document. Person
names take names of their script and gender. First names of the lists are permuted within their list; other names are
built of syllables, and since such names can meet, the distinct ones of the whole corpus are checked together: of
those with one surrogate all but the smallest draw again, until none meet. Exceptions from the first draw, if any, reach
their documents by a join.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches

_MEMO = 200_000
_MOST_ROUNDS = 200

# Formats of entities, titles with their gender, first names by gender and script.
EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)")
MAC = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
IPV6_SHORT = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*::)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:]|\.\d)")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d(?:[ .-]?\d){5,12}(?!\d)|(?<![\w(+.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])")
KEYS = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bsk-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}")
ASSIGNED = re.compile(r"\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[:=]\s*(?:\"([^\"\n]{4,})\"|'([^'\n]{4,})'|([^\s\"',;]{6,}))", re.I)
TITLES = {"Mr": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Madame": "f", "Mme": "f", "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f"}
FIRST_NAMES = {
    ("latin", "f"): "Alice Amelia Barbara Carmen Charlotte Claudia Elizabeth Emma Hannah Isabella Jennifer Julia Katherine Laura Linda Margaret Maria Patricia Sophie Susan".split(),
    ("latin", "m"): "Andrew Antonio Benjamin Carlos Charles Christopher Daniel David Edward Felix George Heinrich James John Joseph Matthew Michael Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
#: Syllables of built names by script, and endings by gender where the script has them.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we".split(),
    "cyrillic": "ба бе бо да де до ва ве во га ка ко ла ле ло ма ме мо на не но па ра ре ро са се со та те то".split(),
    "greek": "βα βε γα δα δε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε το".split(),
}
ENDINGS = {"latin": {"n": "ton ley ford mann son well er".split()}, "cyrillic": {"m": "ов ин ский".split(), "f": "ова ина ская".split(), "n": "ко".split()}, "greek": {"n": "ης ος ας".split()}}
_UPPER = "A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-ЯЁ"
NAME = rf"[{_UPPER}]\w+(?:['’-]\w+)?"
TITLED = re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ({NAME})(?: ({NAME}))?")
#: What comes right before a full name of any two capitalised words.
CUE = re.compile(rf"\b(?:[Mm]y name is|[Mm]eet|[Ss]igned(?: by)?|[Ww]ritten by|[Rr]egards|[Ss]incerely|[Cc]ontact|[Aa]uthor|[Nn]ame|[Pp]atient|[Cc]ustomer)[,:]?\s+({NAME}) ({NAME})(?: and ({NAME}) ({NAME}))?")
PAIR = re.compile(rf"\b({NAME}) (?=({NAME}))")
GENDER = {name: (script, gender) for (script, gender), names in FIRST_NAMES.items() for name in names}


def script_of(word: str) -> str:
    return next((s for s, low, high in (("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ")) if any(low <= c <= high for c in word)), "latin")


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _stream(x: int, bits: int, label: str, key: bytes) -> int:
    """Keyed hash of ``x`` of as many bits as asked for."""
    raw, out = label.encode("utf-8", "surrogatepass") + b"|" + x.to_bytes((bits + 7) // 8 + 1, "big"), b""
    for n in range((bits + 511) // 512):
        out += hashlib.blake2b(raw + n.to_bytes(4, "big"), key=key, digest_size=64).digest()
    return int.from_bytes(out, "big") & ((1 << bits) - 1)


def permute(x: int, size: int, tweak: str, key: bytes, back: bool = False) -> int:
    """Keyed permutation of range(size), a Feistel network with halves of any length; ``back`` undoes it."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(7, -1, -1) if back else range(8):
            if back:
                left, right = right ^ _stream(left, half, f"{r}|{tweak}", key), left
            else:
                left, right = right, left ^ _stream(right, half, f"{r}|{tweak}", key)
        x = left << half | right
        if x < size:
            return x


def move(x: int, size: int, tweak: str, key: bytes) -> int:
    """Keyed permutation of range(size) in one cycle: nothing stays where it is, if size is over 1."""
    return permute((permute(x, size, tweak, key) + 1) % size, size, tweak, key, back=True)


@lru_cache(4096)
def _class(c: str) -> str:
    """Characters that may stand for ``c``: for a letter or digit outside ASCII those of its category in its 256 code points."""
    if c in "0123456789":
        return "0123456789"
    if c.isascii():
        return string.ascii_lowercase if c.islower() else string.ascii_uppercase if c.isupper() else ""
    kind = unicodedata.category(c)
    if kind not in ("Lu", "Ll", "Lo", "Lt", "Nd"):
        return ""
    first = ord(c) & ~0xFF
    same = "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == kind)
    return same if len(same) > 1 else ""


def same_format(text: str, kind: str, key: bytes, hexes: bool = False, fine: Callable[[str], bool] = lambda _: True) -> str:
    """Move ``text`` among the strings with its character classes for which ``fine`` holds (as it must for ``text``).

    One to one, and never ``text`` itself unless it is the only such string.
    """
    sets = [("0123456789abcdef" if c in "0123456789abcdef" else "") if hexes else _class(c) for c in text]
    x, size = 0, 1
    for c, s in zip(text, sets):
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    shape = kind + "|" + "".join(c if not s else {"0123456789": "d", "0123456789abcdef": "h"}.get(s, s[0]) for c, s in zip(text, sets))
    while True:
        x = move(x, size, shape, key)
        rest, out = x, []
        for c, s in zip(reversed(text), reversed(sets)):
            if s:
                rest, k = divmod(rest, len(s))
                out.append(s[k])
            else:
                out.append(c)
        found = "".join(reversed(out))
        if fine(found):
            return found


def _card(text: str, key: bytes) -> str:
    """Keeps first digit and separators; the last digit is the Luhn digit of the others again."""
    at = [i for i, c in enumerate(text) if c.isdigit()]
    digits = "".join(text[i] for i in at)
    body = digits[0] + same_format(digits[1:-1], f"card{len(digits)}{digits[0]}", key)
    last = next(c for c in "0123456789" if luhn(body + c))
    out = list(text)
    for i, c in zip(at, body + last):
        out[i] = c
    return "".join(out)


def _octets(text: str) -> list[int]:
    return [int(x) for x in text.split(".")]


def _ip(text: str, key: bytes) -> str:
    """Private and special networks keep their network; others stay public."""

    def net(o: list[int]) -> int:
        if o[0] in (0, 10, 127) or o[0] >= 224:
            return 1
        return 2 if o[:2] in ([192, 168], [169, 254]) or (o[0] == 172 and 16 <= o[1] < 32) else 0

    o = _octets(text)
    keep = net(o)
    while True:
        x = 0
        for v in o[keep:]:
            x = x * 256 + v
        x = move(x, 256 ** (4 - keep), "ip" + ".".join(map(str, o[:keep])), key)
        o[keep:] = [x >> 8 * k & 255 for k in range(3 - keep, -1, -1)]
        if net(o) == keep:
            return ".".join(map(str, o))


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    *labels, top = domain.split(".")
    return same_format(local, "local", key) + "@" + ".".join([*(same_format(x, "label", key) for x in labels), top])


def _phone(text: str, key: bytes) -> str:
    """Keeps country code and separators."""
    head = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", text)[0]
    return head + same_format(text[len(head) :], "phone" + head, key)


def _iban(text: str, key: bytes) -> str:
    """Keeps country; check digits fit again."""
    body = same_format(text[4:], "iban" + text[:2], key)
    number = int("".join(str(int(c, 36)) for c in (body + text[:2]).replace(" ", "") + "00"))
    return text[:2] + f"{98 - number % 97:02d}" + body


def _secret(text: str, key: bytes) -> str:
    prefix = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|", text)[0]
    rest = text[len(prefix) :]
    return prefix + same_format(rest, "secret", key, hexes=bool(re.fullmatch(r"(?=.*\d)(?=.*[a-f])[0-9a-f]{8,}", rest)))


def built_name(name: str, script: str, gender: str, draw: int, key: bytes) -> str:
    """A name of syllables; more syllables in later draws, so draws never run out."""
    seed = int.from_bytes(hashlib.blake2b(f"name|{script}|{gender}|{name}|{draw}".encode(), key=key, digest_size=16).digest(), "big")
    parts, syllables = [], SYLLABLES[script]
    for _ in range(2 + draw // 8):
        seed, k = divmod(seed, len(syllables))
        parts.append(syllables[k])
    ends = ENDINGS[script].get(gender) or ENDINGS[script].get("n")
    return ("".join(parts) + ends[seed % len(ends)]).capitalize()


def first_name(name: str, script: str, gender: str, key: bytes) -> str:
    """Another name of the same list: the keyed order of the list, one place on."""
    order = sorted(FIRST_NAMES[script, gender], key=lambda n: hashlib.blake2b(f"{script}|{gender}|{n}".encode(), key=key, digest_size=8).digest())
    return order[(order.index(name) + 1) % len(order)]


def _surname(word: str, gender: str) -> str:
    """script/gender of a surname; without gender where the script's surnames have none."""
    script = script_of(word)
    return f"{script}/{gender if gender in ENDINGS[script] else 'n'}"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, extra) of the entities, in order and without overlaps; earlier kinds win.

    Later and earlier mentions of a part of a name found in the text, as whole words, are the same entity.
    """
    found: list[tuple[int, int, str, str]] = []
    if "AKIA" in text or "ASIA" in text or "_" in text or "-" in text or "eyJ" in text:
        found += [(m.start(), m.end(), "secret", "") for m in KEYS.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(g), "secret", "") for m in ASSIGNED.finditer(text) for g in (1, 2, 3) if m[g]]
    if "@" in text:
        found += [(m.start(), m.end(), "email", "") for m in EMAIL.finditer(text)]
    if re.search(r"\d", text):
        for kind, pattern in (("ip", IPV4), ("ssn", SSN), ("phone", PHONE)):
            found += [(m.start(), m.end(), kind, "") for m in pattern.finditer(text)]
        found += [(m.start(), m.end(), "card", "") for m in CARD.finditer(text) if luhn(re.sub(r"\D", "", m[0]))]
        found += [(m.start(), m.end(), "iban", "") for m in IBAN.finditer(text) if _iban_holds(m[0])]
        if ":" in text:
            found += [(m.start(), m.end(), kind, "") for kind, p in (("mac", MAC), ("ipv6", IPV6)) for m in p.finditer(text)]
    if "::" in text:
        found += [(m.start(), m.end(), "ipv6", "") for m in IPV6_SHORT.finditer(text) if _ipv6_holds(m[0])]
    for m in TITLED.finditer(text):
        gender = TITLES[m[1]]
        if m[3]:
            known = GENDER.get(m[2])
            found.append((*m.span(2), "first" if known else "name", "/".join(known or (script_of(m[2]), gender))))
            found.append((*m.span(3), "name", _surname(m[3], gender if gender != "n" else (known or ("", "n"))[1])))
        else:
            found.append((*m.span(2), "name", _surname(m[2], gender)))
    for m in CUE.finditer(text):
        for g in (1, 3):
            if m[g]:
                known = GENDER.get(m[g])
                found.append((*m.span(g), "first" if known else "name", "/".join(known or (script_of(m[g]), "n"))))
                found.append((*m.span(g + 1), "name", _surname(m[g + 1], (known or ("", "n"))[1])))
    for m in PAIR.finditer(text):
        if (known := GENDER.get(m[1])) is not None:
            found.append((*m.span(1), "first", "/".join(known)))
            found.append((*m.span(2), "name", _surname(m[2], known[1])))
    out, end = [], 0
    ranked = sorted(enumerate(found), key=lambda e: (e[1][0], e[0]))
    for _, e in ranked:
        if e[0] >= end:
            if e[2] in ("first", "name") and text[e[1] - 2 : e[1]] in ("'s", "’s"):  # the name without its possessive
                bare = text[e[0] : e[1] - 2]
                e = (e[0], e[1] - 2, e[2], e[3])
                if len(bare) < 2:
                    continue
            out.append(e)
            end = e[1]
    parts: dict[str, tuple[str, str]] = {}
    for start, end, kind, extra in out:
        if kind in ("first", "name"):
            parts.setdefault(text[start:end], (kind, extra))
    if not parts:
        return out
    mention = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(parts, key=len, reverse=True)))})\b")
    more, k = [], 0
    for m in mention.finditer(text):
        while k < len(out) and out[k][1] <= m.start():
            k += 1
        if k == len(out) or out[k][0] >= m.end():
            more.append((*m.span(), *parts[m[0]]))
    return sorted(out + more) if more else out


def _ipv6_holds(text: str) -> bool:
    """Whether ``text`` is an address with groups left out; needs a digit, as words of a to f with colons may be code."""
    try:
        return re.search(r"\d", text) is not None and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def _iban_holds(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def surrogate(value: str, kind: str, extra: str, key: bytes, draws: dict[str, str] | None = None) -> str:
    """The replacement of one entity; ``draws`` has the names that a first draw does not suit."""
    if kind == "email":
        return _email(value, key)
    if kind == "ip":
        return _ip(value, key)
    if kind == "card":
        return _card(value, key)
    if kind == "phone":
        return _phone(value, key)
    if kind == "iban":
        return _iban(value, key)
    if kind == "secret":
        return _secret(value, key)
    if kind in ("mac", "ipv6"):
        low = same_format(value.lower(), kind, key, hexes=True)
        return low if value == value.lower() else low.upper()
    if kind == "first":
        return first_name(value, *extra.split("/"), key)
    if kind == "name":
        return (draws or {}).get(f"{extra}/{value}") or built_name(value, *extra.split("/"), 0, key)
    return same_format(value, kind, key)


def replace(text: str, key: bytes, memo: dict, draws: dict[str, str] | None = None) -> tuple[str, int]:
    """``text`` with surrogates, and how many."""
    found = detect(text)
    if not found:
        return text, 0
    parts, at = [], 0
    for start, end, kind, extra in found:
        value = text[start:end]
        if draws and kind == "name":
            new = surrogate(value, kind, extra, key, draws)
        elif (new := memo.get((kind, extra, value))) is None:
            if len(memo) > _MEMO:
                memo.clear()
            new = memo[kind, extra, value] = surrogate(value, kind, extra, key)
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), len(found)


def name_exceptions(docs: DataFrame, text_col: str = "text", *, key: bytes) -> DataFrame:
    """(name, surrogate, mark): built names that do not keep their first draw, with the hash of each text that has them.

    Names are compared over the whole corpus, as ``script/gender/name``. A name whose draw is another's surrogate, or is
    itself a name of the corpus, draws again unless it is the smallest of those that share it.
    """
    small_batches(docs.sparkSession)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{x}/{t[s:e]}", m) for t, m in zip(b["text"], b["mark"]) if t for s, e, k, x in detect(t) if k == "name"]
            yield pd.DataFrame(rows, columns=["name", "mark"]).drop_duplicates()

    @F.pandas_udf("string")
    def drawn(name: pd.Series, draw: pd.Series) -> pd.Series:
        return pd.Series([built_name(n.split("/", 2)[2], *n.split("/", 2)[:2], d, key) for n, d in zip(name, draw)], dtype=object)

    seen = settle(docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).mapInPandas(names, "name string, mark long"), "names")
    known = settle(seen.select("name").distinct(), "known")
    plain = known.select(F.element_at(F.split("name", "/", 3), 3).alias("surrogate")).distinct()
    state = known.withColumn("draw", F.lit(0))
    for _ in range(_MOST_ROUNDS):
        state = settle(state.withColumn("surrogate", drawn("name", "draw")), "draws")
        least = state.groupBy("surrogate").agg(F.min(F.struct("draw", "name")).alias("keeps"), F.count("*").alias("n"))
        clash = state.join(least, "surrogate").where((F.col("n") > 1) & (F.struct("draw", "name") != F.col("keeps"))).select("name")
        clash = settle(clash.unionByName(state.join(plain, "surrogate", "left_semi").select("name")).distinct().withColumn("again", F.lit(1)), "clash")
        if clash.isEmpty():
            break
        state = state.drop("surrogate").join(clash, "name", "left").select("name", (F.col("draw") + F.coalesce("again", F.lit(0))).alias("draw"))
    else:
        raise RuntimeError("names still meet")
    odd = state.where("draw > 0").select("name", "surrogate")
    return seen.join(odd, "name").select("name", "surrogate", "mark").distinct()


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: bytes) -> DataFrame:
    """(id, text, n_replaced): every text with surrogates for its entities.

    Null texts stay null with 0 replaced, empty and clean texts stay as they are. Repeated rows give equal results; null ids stay
    null; an empty table gives no rows; other columns are ignored. ``key`` is secret: who has it can undo formats. Equal entities get equal surrogates in all
    documents, different ones of one kind different surrogates.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    odd = name_exceptions(docs, text_col, key=key).groupBy("mark").agg(F.map_from_entries(F.collect_set(F.struct("name", "surrogate"))).alias("draws"))
    odd = settle(odd, "odd")
    joined = own.withColumn("draws", F.lit(None).cast("map<string,string>")) if odd.isEmpty() else own.join(odd, "mark", "left")

    def replaced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for b in batches:
            rows = [(None, 0) if t is None else replace(t, key, memo, dict(d) if d is not None else None) for t, d in zip(b["text"], b["draws"])]
            yield pd.DataFrame({"id": b["id"], "text": pd.Series([r[0] for r in rows], index=b.index, dtype=object), "n_replaced": pd.Series([r[1] for r in rows], index=b.index, dtype="int32")})

    id_type = own.schema["id"].dataType.simpleString()
    out = joined.select("id", "text", "draws").mapInPandas(replaced, f"id {id_type}, text string, n_replaced int")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_replaced")
