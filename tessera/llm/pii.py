"""Personal data by anchors: Aho-Corasick finds cues, and local parsers expand each to the bounds of what it belongs to."""

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import over_texts, read, table

#: SQL has no such parsers; tested against brute force.
ORACLE = None
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "ldap", "smb")
SECRETS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key")
ACCOUNTS = ("account", "acct", "iban", "konto", "compte", "cuenta")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
_LOCAL = re.compile(r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*")
_LAST = re.compile(r"[A-Za-z]{2,63}\Z")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_HOST = re.compile(r"(?:[^\s/@\"'<>]+@)?(\[[0-9A-Fa-f:.]+\]|[^\s/:?#\"'<>\[\]]+)[^\s\"'<>]*")
_CARD = re.compile(r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![^\W_])")
_IPV4 = re.compile(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}(?![\d-])")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_VALUE = re.compile(r"[\"']?\s*(?:[:=]|is\b)\s*[\"']?([^\s\"'<>,;]+)", re.IGNORECASE)
_DIGITS = re.compile(r"\s*(?:[:=#]|no\.?|number|nr\.?)*\s*(\d[\d -]{4,32}\d)", re.IGNORECASE)


def luhn(number: str) -> bool:
    """Whether a card number's check digit is right."""
    digits = [int(c) for c in reversed(number)]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def iban(text: str) -> bool:
    """Whether an account number's check digits are right."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    """Every cue, in the ways in which it is written, with the parser that it calls for."""
    cues = ahocorasick.Automaton()
    for cue, parser in [("@", "email"), ("://", "url"), *((d, "number") for d in "0123456789"), *((w, "secret") for w in SECRETS), *((w, "account") for w in ACCOUNTS)]:
        for way in {cue, cue.upper(), cue.capitalize()}:
            cues.add_word(way, (parser, len(way)))
    cues.make_automaton()
    return cues


def _email(text: str, at: int) -> tuple[str, int, int] | None:
    local, domain = _LOCAL.search(text, max(0, at - 65), at), _DOMAIN.match(text, at + 1)
    if not local or not domain:
        return None
    a, b = local.start(), domain.end()
    while a < at and text[a] in ".'`{|/=":
        a += 1
    name, host = text[a:at], domain.group()
    labels = host.split(".")
    if 0 < len(name) <= 64 and name[-1] != "." and ".." not in name and len(labels) > 1 and _LAST.match(labels[-1]) and len(host) <= 253:
        return "email", a, b
    return None


def _url(text: str, at: int) -> tuple[str, int, int] | None:
    scheme, rest = _SCHEME.search(text, max(0, at - 12), at), _HOST.match(text, at + 3)
    if not scheme or not rest or scheme.group().lower() not in SCHEMES:
        return None
    b = rest.end()
    while b > rest.end(1) and text[b - 1] in ".,;:!?)]}":
        b -= 1
    host = rest.group(1).rstrip(".")
    if b == rest.end(1):
        b = rest.start(1) + len(host)
    return ("url", scheme.start(), b) if host and (host[0] == "[" or any(c.isalnum() for c in host)) else None


def _number(text: str, at: int) -> tuple[str, int, int] | None:
    """At the first digit of a run."""
    before = text[at - 1] if at else " "
    if not (before.isalnum() or before == "." and at > 1 and text[at - 2].isdigit()) and (m := _IPV4.match(text, at)):
        try:
            ipaddress.IPv4Address(m.group())
            return "ip", at, m.end()
        except ValueError:
            pass
    if at >= 2 and text[at - 2 : at].isascii() and text[at - 2 : at].isalpha() and (at < 3 or not text[at - 3].isalnum()) and (m := _IBAN.match(text, at - 2)):
        end = m.end()
        while end - at >= 13:  # the account may be followed by other words in capitals
            if iban(text[at - 2 : end]):
                return "iban", at - 2, end
            end = text.rfind(" ", at, end)
            if end < 0:
                break
    if before.isalnum() or before == "_":
        return None
    if (m := _SSN.match(text, at)) and before != "-" and m.group()[:3] not in ("000", "666") and m.group()[0] != "9":
        return "ssn", at, m.end()
    if m := _CARD.match(text, at):
        digits = re.sub(r"\D", "", m.group())
        if luhn(digits) and len(set(digits)) > 1:
            return "card", at, m.end()
    begin = at - 1 if before in "(+" else at
    if begin and text[begin - 1] == "+" and begin == at - 1:
        begin -= 1
    if (p := _PHONE.match(text, begin)) and 9 <= sum(c.isdigit() for c in p.group()) <= 15:
        return "phone", begin, p.end()
    return None


def _secret(text: str, end: int) -> tuple[str, int, int] | None:
    m = _VALUE.match(text, end)
    if m and len(m.group(1)) >= 8 and any(c.isdigit() for c in m.group(1)):
        return "secret", m.start(1), m.end(1)
    return None


def _account(text: str, end: int) -> tuple[str, int, int] | None:
    m = _DIGITS.match(text, end)
    if m and 6 <= sum(c.isdigit() for c in m.group(1)) <= 34:
        return "account", m.start(1), m.end(1)
    return None


_CUES: list[ahocorasick.Automaton] = []


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what a text holds, in order, without overlaps: of two that overlap, the one whose cue comes first."""
    if not _CUES:
        _CUES.append(automaton())
    out: list[tuple[str, int, int]] = []
    until = digits = 0
    for last, (parser, size) in _CUES[0].iter(text):
        at = last - size + 1
        if parser == "number":
            if at < digits:
                continue
            digits = at + 1
            while digits < len(text) and text[digits].isdigit():
                digits += 1
            if at and text[at - 1].isdigit():
                continue
            found = _number(text, at) if at >= until else None
        elif at < until:
            continue
        else:
            found = _email(text, at) if parser == "email" else _url(text, at) if parser == "url" else (_secret if parser == "secret" else _account)(text, last + 1)
        if found and found[1] < until:  # the number in an address that has only now been seen whole
            while out and out[-1][2] > found[1] and found[0] == "email":
                out.pop()
            found = found if not out or out[-1][2] <= found[1] else None
        if found:
            out.append(found)
            until = found[2]
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in over_texts(batches):
        rows = [(i, kind, a, b, text[a:b]) for i, text in zip(ids, texts) if text for kind, a, b in find(text)]
        if rows:
            yield table(dict(zip(_SCHEMA.names, map(list, zip(*rows)))), _SCHEMA)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value) of every e-mail and web address, IP, phone, card, account and social-security number, and secret.

    docs has doc_id and text; other columns are ignored. start and end count characters of the whole text. Null and empty
    texts hold nothing; each row is read by itself, also those with a null or repeated doc_id. An empty table gives no rows.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").where("text is not null")
    return texts.mapInArrow(_run, "doc_id long, kind string, start long, end long, value string")


def redact(text: str | None) -> str | None:
    """The text with the kind of each thing found in its place."""
    if not text:
        return text
    at, out = 0, []
    for kind, a, b in find(text):
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
