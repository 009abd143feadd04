"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, digits, plus signs, schemes and identifier
cues in any case. At each anchor a deterministic local parser reads outward to the boundaries of the value and checks it. Nothing
else of the text is looked at, so the cost besides the automaton follows the number of anchors.

Kinds, in order of report: email, ip, card, phone; then account (numbers and tokens after a cue such as "IBAN" or
"account no.", IBANs by their check digits), secret (a value assigned to a name such as token or api_key), login
(credentials inside a URL) and contact (addresses after mailto:, tel:, sip: and the like).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positional, record_batch, slices, texts_of, tidy

KINDS = ("email", "ip", "card", "phone", "account", "secret", "login", "contact")
Span = tuple[int, int]

# The cues and schemes that are looked for, in lower case.
ACCOUNT_CUES = ("iban", "account no", "account number", "account:", "acct", "routing number", "passport", "ssn", "social security", "kontonummer", "numéro de compte", "número de cuenta")
SECRET_CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "access_key")
CONTACT_SCHEMES = ("mailto:", "tel:", "sip:", "sips:", "xmpp:", "skype:")

# The length of an IBAN by its country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+((?:\.[0-9]+){3})")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT_LEAD = re.compile(r"[\s#:.=]{0,4}(?=[A-Za-z]{0,4}[0-9])")
ACCOUNT_PART = re.compile(r"[ -]?([A-Za-z0-9]+)")
SECRET_VALUE = re.compile(r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/.-]{16,})")
LOGIN_VALUE = re.compile(r"([^\s/?#@:]+:[^\s/?#@]+)@[A-Za-z0-9.-]+")
CONTACT_VALUE = re.compile(r"[A-Za-z0-9.@_%+-]{3,}")


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for words, what in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret"), (CONTACT_SCHEMES, "contact")):
        for w in words:
            found.add_word(w, what)
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text in lower case, character by character: places stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "").replace("-", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", v):
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def part_is_small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _matches(at: list[int], match: Callable[[int, int], Span | None]) -> Iterator[Span]:
    """Leftmost matches that don't overlap: match(anchor, end of the last one)."""
    end = 0
    for a in at:
        if a >= end and (m := match(a, end)):
            yield m
            end = m[1]


def _email(text: str, at: int, end: int) -> Span | None:
    start = at
    while start > end and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def find(text: str) -> dict[str, list[Span]]:
    """Spans of each kind in code points, end exclusive, by start. The first four kinds follow these patterns exactly.

    email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(.[A-Za-z0-9-]+)+; ip four dotted numbers up to 255; card 13 to 19 digits with
    single spaces or hyphens that pass Luhn; phone + and 9 to 15 digits: leftmost matches that don't overlap within a
    kind, and a match that fails its test is dropped without another try.
    """
    anchors: dict[str, list[int]] = {}
    runs: list[int] = []  # where runs of digits begin
    last = -2
    for end, what in automaton().iter(lowered(text)):
        if what == "digit":
            if end != last + 1:
                runs.append(end)
            last = end
        else:
            anchors.setdefault(what, []).append(end)
    found: dict[str, list[Span]] = {k: [] for k in KINDS}

    def by(pattern: re.Pattern) -> Callable[[int, int], Span | None]:
        return lambda a, _: m.span() if (m := pattern.match(text, a)) else None

    found["email"] = list(_matches(anchors.get("at", []), lambda a, e: _email(text, a, e)))
    if runs:
        found["ip"] = [(s, e) for s, e in _matches(runs, by(IP)) if all(map(part_is_small, text[s:e].split(".")))]
        for s, e in _matches(runs, by(CHAIN)):
            digits = text[s:e].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append((s, e))
    for s, e in _matches(anchors.get("plus", []), by(PHONE)):
        if 9 <= sum(c.isdigit() for c in text[s:e]) <= 15:
            found["phone"].append((s, e))
    _more(text, anchors, found)
    return found


def _account(text: str, start: int) -> Span | None:
    """The account value that begins at `start`: an IBAN by its country's length and check digits, or by these alone, or
    else all parts up to the last one with a digit, if they hold six digits.

    Parts are split by single blanks or hyphens. If it is no IBAN, a part with a lower-case letter, or of letters alone
    and over four of them, is not part of the value.
    """
    ends, at, size, plain = [], start, 0, True
    while (plain or size < 34) and (m := ACCOUNT_PART.match(text, at)) and (at > start or m.start(1) == start):
        at = m.end()
        size += len(m[1])
        digits = sum(c.isdigit() for c in m[1])
        plain = plain and not any(c.islower() for c in m[1]) and (digits > 0 or len(m[1]) <= 4)
        ends.append((at, size, digits, plain))
    length = IBAN_LENGTHS.get(text[start : start + 2].upper())
    short = [x for x in ends if x[1] <= 34 and (x[1] == length or x[2])]
    for e, *_ in sorted(short, key=lambda x: (x[1] != length, -x[0])):
        if iban(text[start:e]):
            return start, e
    value = [x for x in ends if x[3]]
    last = max((e for e, _, digits, _ in value if digits), default=start)
    return (start, last) if sum(digits for _, _, digits, _ in value) >= 6 else None


def _more(text: str, anchors: dict[str, list[int]], found: dict[str, list[Span]]) -> None:
    def values(what: str, pattern: re.Pattern, group: int = 1) -> Iterator[Span]:
        end = 0
        for a in anchors.get(what, ()):
            if a + 1 >= end and (m := pattern.match(text, a + 1)):
                yield m.span(group)
                end = m.end(group)

    end = 0
    for a in anchors.get("account", ()):
        if a + 1 >= end and (m := ACCOUNT_LEAD.match(text, a + 1)) and (span := _account(text, m.end())):
            found["account"].append(span)
            end = span[1]
    for s, e in values("secret", SECRET_VALUE):
        value = text[s:e]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            found["secret"].append((s, e))
    found["login"] = list(values("scheme", LOGIN_VALUE))
    for s, e in values("contact", CONTACT_VALUE, 0):
        if "@" in text[s:e] or sum(c.isdigit() for c in text[s:e]) >= 7:
            found["contact"].append((s, e))


def joined(found: dict[str, list[Span]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def redact(text: str, found: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first and longest counts."""
    out, at = [], 0
    for s, e, k in sorted(((s, e, k) for k, spans in found.items() for s, e in spans), key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for each row of documents' (doc_id, text).

    base lists the spans of the first four kinds, spans those of all kinds, as kind:start:end. A null text counts as
    empty and has none. Rows are independent: repeated or null doc_ids keep their rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [find(t) for t in texts_of(batch)]
            out = {f"n_{k}": [len(r[k]) for r in rows] for k in KINDS[:4]}
            yield record_batch(out | {"doc_id": batch.column(0).to_pylist(), "base": [joined(r, KINDS[:4]) for r in rows], "spans": [joined(r) for r in rows]}, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with its column text redacted, all other columns as they are; n_chars, if any, is recounted.

    A null text stays null, and so does its n_chars. Rows are independent; columns may have any names.
    """
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = [t if t is None else redact(t, find(t)) for t in batch.column(at).to_pylist()]
            columns = {at: pa.array(new, batch.schema.field(at).type)}
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays([columns.get(i, c) for i, c in enumerate(batch.columns)], schema=batch.schema)

    rows = positional(docs)
    return rows.mapInArrow(tidy(run), rows.schema).toDF(*docs.columns)
