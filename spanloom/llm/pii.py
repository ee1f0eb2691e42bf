"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Offsets are code points, ends exclusive.  The four base kinds follow fixed patterns and are always kept; the
further kinds (iban, ssn, secret) are kept when their score reaches ``THRESHOLD``.  Null and empty texts have no span;
repeated rows are each answered; extra columns are ignored.  Every pattern is linear in the text, so very long
texts and long runs of digits are safe.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import spread, table

THRESHOLD = 0.5
WINDOW = 48

# The kinds in output order with their start score, and the words that raise it.
BASE_KINDS = ("email", "ip", "card", "phone")
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "debit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "auth", "bearer", "credential"),
}
# The length of an IBAN by country (the public registry of ISO 13616).
IBAN_LENGTHS = {
    k: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,TL 24:AD,CZ,ES,MD,PK,SA,SE,SK,TN,VG 25:PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
    ).split())
    for k in countries.split(",")
}
RAISE = 0.3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
#: The rest of an IBAN after its four first characters, by its length: what follows may be anything but its like.
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORDS = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """The Luhn check over a string of ASCII digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 mod-97 check over an IBAN, spaces allowed."""
    s = iban.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """The email pattern's leftmost matches, found from each '@' outwards (linear for any text)."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _proposals(text: str):
    """(kind, start, end) of the confirmed candidates, kind by kind in output order."""
    for a, b in _emails(text):
        yield "email", a, b
    if not re.search("[0-9]", text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST[IBAN_LENGTHS[m[0][:2]]].match(text, m.end()) if m[0][:2] in IBAN_LENGTHS else None
        if rest and mod97(m[0] + rest[0]):
            yield "iban", m.start(), rest.end()
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if len(set(m[0])) >= 8:  # a key looks random; a ruler or a padded number doesn't
            yield "secret", m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start."""
    found = []
    for kind, a, b in _proposals(text or ""):
        near = set(_WORDS.findall(f"{text[max(0, a - WINDOW):a]} {text[b:b + WINDOW]}".lower()))
        score = min(1.0, START_SCORE[kind] + RAISE * any(w in near for w in CONTEXT[kind]))
        if kind in BASE_KINDS or score >= THRESHOLD:
            found.append((kind, a, b, score))
    return found


def redact(text: str | None) -> str | None:
    """The text with every span (overlapping ones merged) replaced by its kind in brackets."""
    if not text:
        return text
    out, last, end, kind = [], 0, 0, ""
    for a, b, k in [*sorted((a, b, k) for k, a, b, _ in find_spans(text)), (len(text) + 1, 0, "")]:
        if a < end:
            end = max(end, b)
            continue
        if kind:
            out.append(f"[{kind.upper()}]")
            last = end
        out.append(text[last:a])
        end, kind = b, k
    return "".join(out)


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs(doc_id, text)``."""

    def batches(it):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in it:
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, type=kind)], names=["doc_id", "spans"])

    return spread(docs.select("doc_id", "text")).mapInArrow(batches, f"doc_id long, spans {_SPANS}")


def redact_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with each text redacted and n_chars set to its new length; null texts stay null."""

    def batches(it):
        for b in it:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array([redact(t.as_py()) for t in b.column(i)], type=pa.string()))

    return spread(docs).mapInArrow(batches, docs.schema).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_pii(spark, sf_dir):
    """Counts, digest, spans and scores (in the order of spans) of every document."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = detect(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    scores = F.transform("spans", lambda s: F.round(s["score"], 2)).alias("scores")
    return found.select("doc_id", *map(_count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), scores)


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
