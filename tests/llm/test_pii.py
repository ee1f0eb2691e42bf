"""PII spans against the plain patterns, on hand-made and random texts and on whole tables."""

import hashlib
import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from spanloom.llm.pii import BASE_KINDS, detect, find_spans, luhn, mod97, op7_pii, redact


def plain(text):
    """The base kinds straight from their patterns."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def base(text):
    return [s[:3] for s in find_spans(text) if s[0] in BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.-+ ()9é0", max_size=60))
def test_random_texts(text):
    assert base(text) == plain(text)


def test_known_spans():
    text = "é mail a.b@c.de, 10.0.0.256 10.0.0.255 card 4111 1111 1111 1111 call +1 (499) 555-6503!"
    assert base(text) == plain(text)
    assert [s[0] for s in find_spans(text)] == ["email", "ip", "card", "phone"]


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82 WEST 1234 5698 7654 32") and not mod97("GB82 WEST 1234 5698 7654 33")


def test_context_decides_weak_kinds():
    assert not find_spans("number 123-45-6789")
    assert [s[0] for s in find_spans("social security 123-45-6789")] == ["ssn"]


def test_redact_merges_overlaps():
    assert redact("a x@y.zz b") == "a [EMAIL] b"
    assert redact(None) is None and redact("") == ""
    assert redact("x@y.zz") == "[EMAIL]"


def test_long_runs_are_linear():
    assert base("1" * 300_000 + "@" * 10_000 + "a" * 300_000) == []


def test_ibans_end_where_their_country_says():
    for after in ("", " BANK", " BANK ACCOUNT", ".", " 1234"):
        assert [s[:3] for s in find_spans(f"to AT61 1904 3002 3457 3201{after}") if s[0] == "iban"] == [("iban", 3, 27)]
    assert not [s for s in find_spans("AT61 1904 3002 3457 3202 BANK, XX61 1904 3002 3457 3201, AT611904300234573201A") if s[0] == "iban"]


def test_secrets_need_context():
    key = "40d78a45c418324758e099eb7cb89bc0f5fa9f62"
    assert [s[0] for s in find_spans(f'token = "{key}"')] == ["secret"] and not find_spans(f"commit {key}")
    assert not [s for s in find_spans("token " + "0" * 40) if s[0] == "secret"]


def test_query_against_plain_patterns(spark, odd_docs, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "x a@b.c " * 9000), (-2, "1.2.3.4")], "doc_id long, text string"))
    real.unionByName(odd).selectExpr("*", "'k' AS spans", "1 AS kind").write.parquet(f"file://{path}")
    want = Counter()
    for r in spark.read.parquet(f"file://{path}").collect():
        own = plain(r["text"] or "")
        n = Counter(s[0] for s in own)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        want[(r["doc_id"], *(n[k] for k in BASE_KINDS), digest)] += 1
    got = op7_pii(spark, f"file://{tmp_path}").collect()
    assert Counter((r["doc_id"], *(r[f"n_{k}"] for k in BASE_KINDS), r["base_sha256"]) for r in got) == want
    for r in got:
        base_only = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in BASE_KINDS)
        assert hashlib.sha256(base_only.encode()).hexdigest() == r["base_sha256"]
        assert len(r["scores"]) == (r["spans"].count(",") + 1 if r["spans"] else 0)
    assert detect(odd_docs.limit(0)).count() == 0
