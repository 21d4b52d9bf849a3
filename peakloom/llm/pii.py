"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base spans (email, ip, card, phone) are those that pass the checks of their kind and are always reported. The method
adds kinds whose pattern alone is weak: iban (confirmed by mod-97), card13 (13 digits, Luhn, and a word such as
"card" nearby), national_id (3-2-4 digits with a word such as "ssn" nearby) and secret (a long random value after a
word such as "token"). Each span has a score: what the pattern is worth, more with a passed checksum, more or less
with words found within CONTEXT characters; added spans need THRESHOLD.

Cases: null counts as the empty text, without spans. A null id stays null, repeated rows give repeated results, other
columns are not read. Each pattern takes time in proportion to the text's length, as matches start only where a run
of its characters starts. Spans are in code points, the end exclusive; those of different kinds may overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import in_slices, map_arrow, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card13", "national_id", "secret")
KINDS = BASE + ADDED
CONTEXT, THRESHOLD = 48, 0.6

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
#: Characters of an account code by country, from the public registry.
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "AE BG BH CR DE GB GE IE ME RS VA",
        23: "GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api_?key|access_?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_\-/+]{16,}+)")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Words that raise (+) or lower (-) the score of a kind when they stand near a span.
WORDS = {
    "email": (("mail", "contact", "write to"), ()),
    "ip": (("address", "host", "server", "client"), ("version", "release")),
    "card": (("card", "visa", "credit", "payment"), ("order", "invoice")),
    "phone": (("phone", "call", "tel", "mobile"), ()),
    "iban": (("iban", "account", "bank"), ("order",)),
    "card13": (("card", "visa", "credit", "payment"), ("order", "invoice", "isbn", "ean")),
    "national_id": (("ssn", "social security", "national id", "taxpayer"), ("order", "part")),
    "secret": (("token", "secret", "password", "key"), ("example",)),
}
#: What a match of the pattern is worth alone, and with the checksum of its kind.
WORTH = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "card13": 0.4, "national_id": 0.4, "secret": 0.4}


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn sum: from the right, each second one doubled, digits of products added."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account code passes mod 97: first four characters last, letters as 10 to 35, remainder 1."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account codes. A candidate can run on into words and numbers after it: of its parts that end where a group ends
    and pass mod 97, the one of the country's length, else, for a country without a known one, the longest; the whole
    candidate counts for any country."""
    at = 0
    while m := _IBAN.search(text, at):
        start, at, whole, best = m.start(), m.start() + 1, True, 0
        known = IBAN_LENGTHS.get(text[start : start + 2])
        for end in range(m.end(), start + 14, -1):
            if end < len(text) and text[end].isascii() and text[end].isalnum() or text[end - 1] == " ":
                continue
            n = end - start - text.count(" ", start, end)
            if n < 15 or known and n < known and not whole:
                break
            if (whole or not known or n == known) and mod97(text[start:end]):
                best = end
                if not known or n == known:
                    break
            whole = False
        if best:
            yield start, best
            at = best


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping: before each @ the longest run of local characters that an earlier match leaves."""
    at, free = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                free = m.end()
                yield start, free
                at = text.find("@", free)
                continue
        at = text.find("@", at + 1)


def _base(text: str) -> list[tuple[int, int, str]]:
    found = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return found


def _added(text: str) -> list[tuple[int, int, str]]:
    found = []
    if not _DIGIT.search(text):
        return found
    found += [(a, b, "iban") for a, b in _ibans(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and len(d := m[0].replace(" ", "").replace("-", "")) == 13 and luhn(d):
            found.append((m.start(), m.end(), "card13"))
    found += [(m.start(), m.end(), "national_id") for m in _NATIONAL.finditer(text)]
    for m in _SECRET.finditer(text):
        value = m[1]
        if len(set(value)) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            found.append((m.start(1), m.end(1), "secret"))
    return found


def score(text: str, start: int, end: int, kind: str) -> float:
    """WORTH of the kind, 0.3 more with a raising word within CONTEXT characters, 0.3 less with a lowering one."""
    near = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    up, down = WORDS[kind]
    value = WORTH[kind] + 0.3 * any(w in near for w in up) - 0.3 * any(w in near for w in down)
    return round(min(1.0, max(0.0, value)), 3)


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """All spans of a text as (start, end, kind, score), by start, then kind."""
    text = text or ""
    out = [(a, b, k, score(text, a, b, k)) for a, b, k in _base(text)]
    out += [x for a, b, k in _added(text) if (x := (a, b, k, score(text, a, b, k)))[3] >= THRESHOLD]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def redacted(text: str | None) -> str | None:
    """The text with each span, and spans that overlap as one, replaced by the first one's kind in angle brackets."""
    if text is None:
        return None
    out, at, until = [], 0, 0
    for a, b, kind, _ in spans(text):
        if a >= until:
            out += [text[at:a], f"<{kind}>"]
        at = until = max(until, b)
    return "".join([*out, text[at:]])


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and spans, an array of (start, end, kind, score)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:long,end:long,kind:string,score:double>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPAN_TYPE)], ["doc_id", "spans"])

    return map_arrow(rows, find, schema)


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, the list of all spans, whether there is any and the highest score (null without
    spans), from find_pii()'s rows."""
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        *map(count, ADDED),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") > 0).alias("has_personal_data"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with personal data in the text replaced; all other columns as they were."""
    at, names = docs.columns.index(text_col), docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with a dot would be taken apart

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            own = batch.schema.field(at).type
            texts = pa.array([redacted(t) for t in batch.column(at).to_pylist()], own)
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)

    return map_arrow(docs, clean, docs.schema).toDF(*names)


def digest_of(text: str | None) -> str:
    """The base digest of one text, for tests."""
    own = [f"{k}:{a}:{b}" for a, b, k, _ in spans(text) if k in BASE]
    return hashlib.sha256(",".join(own).encode()).hexdigest()
