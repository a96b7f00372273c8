import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import pii as P


def base(text):
    """The contract's patterns, word for word."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return found


def luhn(number):
    doubled = [sum(map(int, str(2 * int(c)))) if k % 2 else int(c) for k, c in enumerate(reversed(number))]
    return sum(doubled) % 10 == 0


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123456789.@+- ()aZ%é", max_size=60))
def test_base_spans_of_any_text(text):
    assert [s for s in P.propose(text) if s[0] in P.BASE_KINDS] == base(text)


def test_planted_spans_and_checksums():
    text = "mail: a.b%c@x-y.example.org, host 10.0.0.255 not 10.0.0.256; card 4539 1488 0343 6467 bad 4539148803436468 call +1 (743) 555-3824 iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789"
    kinds = [k for k, _, _ in P.propose(text)]
    assert kinds == ["email", "ip", "card", "phone", "iban", "ssn"]
    assert P.score(text, *P.propose(text)[2]) > P.SCORES["card"]
    assert not P.mod97("DE88370400440532013000") and P.mod97("GB82WEST12345698765432")


def test_ibans_end_with_the_length_of_their_country():
    for text, want in (
        ("DE89370400440532013000 IBAN OK", ["DE89370400440532013000"]),
        ("DE89 3704 0044 0532 0130 00 BIC DEUTDEFF", ["DE89 3704 0044 0532 0130 00"]),
        ("NO9386011117947 GB82WEST12345698765432, NO9386011117947", ["NO9386011117947", "GB82WEST12345698765432", "NO9386011117947"]),
        ("DE893704004405320130001", []),
        ("DE89 3704 0044 0532 0130", []),
        ("ZZ89370400440532013000", []),
    ):
        assert [text[a:b] for k, a, b in P.propose(text) if k == "iban"] == want


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" * 100_000, "a@" * 100_000, "." * 200_000 + "@x.y", "1." * 100_000):
        P.propose(text)


def test_report(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "x a@b.cd é 1.2.3.4", "c"), (3, "x a@b.cd é 1.2.3.4", "c"), (None, "no digits", "c"), (4, "\U0001f600 +49 30 1234567", "c")]
    found = P.pii_report(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(found) == len(rows)
    for r, (doc_id, text, _) in zip(found, rows, strict=True):
        want = base(text or "")
        assert r.doc_id == doc_id and r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in P.BASE_KINDS]
    assert P.pii_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
