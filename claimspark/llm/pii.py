"""Personal data by anchor expansion: one automaton finds anchors, local parsers expand and validate around each."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the span text; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "contact_url", "handle", "account", "address")

# Words that announce an account number, contact schemes, and words that end a street name.
ACCOUNT_CUES = (
    "iban", "account", "acct", "passport", "ssn", "social security", "routing", "license no", "tax id", "customer id",
    "user id", "member id", "konto", "cuenta", "compte",
)
SCHEMES = ("mailto:", "tel:", "sip:", "skype:", "sms:")
STREET_CUES = (" street", " avenue", " road", " boulevard", " lane", " drive", "straße", "strasse")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HANDLE = re.compile(r"@[A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@.])")
_CONTACT = re.compile(r"[A-Za-z0-9.+@%_()-]{3,}")
_ACCOUNT = re.compile(r"\s{0,2}(?i:no\.?|number|nr\.?|#)?[\s:=#]{0,3}([A-Z]{0,4}[0-9](?:[\x20-]?[A-Z0-9]){3,33})\b")
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?")
#: A-Z to a-z, so that the copy that anchors are looked for in has the text's places.
_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    """Two letters and two digits, then a remainder of 1 by 97 when the letters stand for 10 to 35."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@lru_cache(1)
def automaton():
    """Anchors of all kinds; built once per worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for anchor, what in (
        [("@", "at"), ("+", "plus")]
        + [(d, "digit") for d in "0123456789"]
        + [(s, "scheme") for s in SCHEMES]
        + [(c, "account") for c in ACCOUNT_CUES]
        + [(c, "street") for c in STREET_CUES]
    ):
        found.add_word(anchor, (what, len(anchor)))
    found.make_automaton()
    return found


def house_number(text: str, at: int, least: int) -> int | None:
    """Where the house number before a street name begins that ends at ``at``: words of letters, one blank or hyphen between
    them, to the left of it; None if something else comes first, or ``least``."""
    while at > least and text[at - 1].isalpha():
        at -= 1
    while at - 1 > least and text[at - 1] in " -":
        end = at - 1
        if text[at - 1] == " " and text[end - 1] == ",":
            end -= 1
        start = end
        while start > least and text[start - 1].isalnum():
            start -= 1
        word = text[start:end]
        if _HOUSE.fullmatch(word):
            return start if text[at - 1] == " " else None
        if not word.isalpha() or end != at - 1:
            return None
        at = start
    return None


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, sorted: kind is a place in ``KINDS``, end is exclusive.

    Anchors come in the order of their ends, so each parser goes from left to right over its own kind and remembers where
    its last match ended; the next begins there at the earliest. An email expands to the left from its at-sign, an
    address or card number from the first digit of a run, a phone number from its plus, a street from its last word back to
    its house number. Expansion to the right is a match at a known place, whose length is bounded by the run it is in.
    Words that announce something count in upper, lower and mixed case.
    """
    spans: list[tuple[int, int, int]] = []
    after = [0] * len(KINDS)  # where the last match of a kind ended, valid or not
    digits_to = -1  # end of the run of digits that was looked at last
    no_house = 0  # no street name has a house number before this place
    for last, (what, width) in automaton().iter(text.translate(_LOWER)):
        at = last - width + 1
        if what == "digit":
            if at < digits_to:
                continue
            digits_to = at + 1
            while digits_to < len(text) and text[digits_to] in _DIGIT:
                digits_to += 1
            if at >= after[1] and (m := _IP.match(text, at)):
                after[1] = m.end()
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    spans.append((1, at, m.end()))
            if at >= after[2] and (m := _CARD.match(text, at)):
                after[2] = m.end()
                number = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(number) <= 19 and luhn(number):
                    spans.append((2, at, m.end()))
        elif what == "plus":
            if at >= after[3] and (m := _PHONE.match(text, at)):
                after[3] = m.end()
                if 8 <= sum(c in _DIGIT for c in m[0]) <= 15:
                    spans.append((3, at, m.end()))
        elif what == "at":
            start = at
            while start > after[0] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                after[0] = m.end()
                spans.append((0, start, m.end()))
            elif (at == 0 or not text[at - 1].isalnum()) and (m := _HANDLE.match(text, at)):
                spans.append((5, at, m.end()))
        elif what == "scheme":
            if at >= after[4] and (at == 0 or not text[at - 1].isalnum()) and (m := _CONTACT.match(text, last + 1)):
                after[4] = m.end()
                spans.append((4, at, m.end()))
        elif what == "account":
            m = _ACCOUNT.match(text, last + 1)
            if at >= after[6] and (at == 0 or not text[at - 1].isalnum()) and m:
                number = re.sub("[ -]", "", m[1])
                iban = re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", number)
                if (valid_iban(number) if iban else sum(c in _DIGIT for c in number) >= 5):
                    after[6] = m.end(1)
                    spans.append((6, m.start(1), m.end(1)))
        elif not text[last + 1 : last + 2].isalnum():  # a street name ends here
            start = house_number(text, at, max(after[7], no_house))
            if start is not None:
                after[7] = last + 1
                spans.append((7, start, last + 1))
            else:  # a longer name can only have the word before this one as its number
                no_house = at
                while no_house > after[7] and text[no_house - 1].isalnum():
                    no_house -= 1
    spans.sort()
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``found``, the spans as (kind, start, end, value), by kind and start.

    Places are code points, ends exclusive. Spans of one kind don't overlap; spans of different kinds may. A null text is
    empty and has no spans; rows with equal or null ids give one row each; whole texts are read, however long. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
        for batch in batches:
            found = []
            for text in batch.column("text"):
                value = text.as_py() or ""
                found.append(
                    [{"kind": KINDS[k], "start": a, "end": b, "value": value[a:b]} for k, a, b in find(value)]
                )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "found"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        scan, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint,value:string>>"
    )


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; a null text stays null.

    Where spans overlap, the one that starts first (of those the longest) is replaced and the others go with it.
    """

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        parts, at = [], 0
        for k, a, b in sorted(find(text), key=lambda s: (s[1], -s[2])):
            if a >= at:
                parts += [text[at:a], f"[{KINDS[k]}]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            column = pa.array([clean(x.as_py()) for x in batch.column(k)], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), column)

    return docs.mapInArrow(apply, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text, from ``personal_data``."""
    as_text = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    base = "filter(found, s -> s.kind in ({}))".format(", ".join(f"'{k}'" for k in BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.expr(as_text.format(base)), 256).alias("base_sha256"),
        F.expr(as_text.format("found")).alias("spans"),
    )


def base_sha256(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined([s for s in spans if s[0] < len(BASE_KINDS)]).encode()).hexdigest()
