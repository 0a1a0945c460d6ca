import re

from tessera.llm import pii
from tests.llm.tools import ODD, docs, rows


def kinds(text):
    return [(k, text[a:b]) for k, a, b in pii.find(text)]


def test_kinds():
    assert kinds("Mail jane.doe+x@mail.example.org, or bob@localhost; @handle a@b.c1") == [("email", "jane.doe+x@mail.example.org")]
    assert kinds("see https://a.example.com/x?y=1). or foo://bar, HTTP://B.de.") == [("url", "https://a.example.com/x?y=1"), ("url", "HTTP://B.de")]
    assert kinds("host 192.168.1.20 not 300.1.1.1 nor 1.2.3.4.5") == [("ip", "192.168.1.20")]
    assert kinds("card 4111 1111 1111 1111, not 4111 1111 1111 1112") [0] == ("card", "4111 1111 1111 1111")
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds("IBAN: DE89 3704 0044 0532 0130 00 BANK")
    assert kinds("call +1 415-555-0134 or 415-555-0199") == [("phone", "+1 415-555-0134"), ("phone", "415-555-0199")]
    assert kinds("ssn 123-45-6789, not 000-12-3456") == [("ssn", "123-45-6789")]
    assert kinds('api_key = "abcd1234efgh"; password: short') == [("secret", "abcd1234efgh")]
    assert kinds("account number: 12345678") == [("account", "12345678")]
    assert kinds("") == [] and kinds("@ :// 1 @@") == []


def test_emails_against_a_pattern():
    text = " ".join(f"u{k}@h{k % 7}.example.com, x{k} (a.b{k}@c-d.net)" for k in range(500))
    want = [m.span() for m in re.finditer(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", text)]
    assert [(a, b) for k, a, b in pii.find(text) if k == "email"] == want


def test_redaction():
    assert pii.redact("a b@c.de x") == "a <email> x" and pii.redact(None) is None and pii.redact("") == ""


def test_table(spark):
    given = [(1, "x@example.com " * 2), (1, "x@example.com"), (2, "y " * 300_000 + "z@example.com"), *ODD]
    found = rows(pii.personal_data(docs(spark, given)).select("doc_id", "kind", "start", "end", "value"))
    assert found == [(1, "email", 0, 13, "x@example.com"), (1, "email", 0, 13, "x@example.com"), (1, "email", 14, 27, "x@example.com"), (2, "email", 600_000, 600_013, "z@example.com")]
    assert rows(pii.personal_data(docs(spark, []))) == []
