"""Personal data and license scans against regular expressions and brute force."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimspark.llm import licenses, pii
from claimspark.llm.text import ALNUM, SPACED, word_hash, words
from tests.llm.conftest import ODD

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((pii.KINDS.index(kind), m.start(), m.end()))
    return out


PARTS = st.sampled_from(
    ["a@b.co", "x.y+z@mail-1.example.org", "@", "a@b", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111",
     "4111-1111-1111-1112", "+49 (30) 1234-567", "+1", "12", " ", "-", "é", "漢", "🎉", "IBAN: DE89370400440532013000",
     "account no. 12345678", "12 Long Street", "mailto:a@b.de", "\n", "٣", "token"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join) | st.text("ab@.+-% 0123456789()é", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.find(text) if s[0] < 4] == base_spans(text)


def own_spans(text):
    """Spans of the other kinds, from every place a cue could stand at."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    edge = lambda k: k == 0 or not text[k - 1].isalnum()
    out, last = [], {"contact_url": 0, "account": 0, "address": 0}
    at_signs = {m.start() + m[0].index("@") for m in re.finditer(BASE["email"], text)}
    for end in range(1, len(text) + 1):
        for scheme in pii.SCHEMES:
            k = end - len(scheme)
            m = re.compile(r"[A-Za-z0-9.+@%_()-]{3,}").match(text, end)
            if k >= last["contact_url"] and low[:end].endswith(scheme) and edge(k) and m:
                out.append(("contact_url", k, m.end()))
                last["contact_url"] = m.end()
        if text[end - 1] == "@" and end - 1 not in at_signs and edge(end - 1):
            m = re.compile(r"[A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@.])").match(text, end)
            out += [("handle", end - 1, m.end())] if m else []
        for cue in pii.ACCOUNT_CUES:
            k = end - len(cue)
            if not low[:end].endswith(cue) or not edge(k) or k < last["account"]:
                continue
            m = re.compile(r"\s{0,2}(?:no\.|no|number|nr\.|nr|#)?[\s:=#]{0,3}", re.I).match(text, end)
            m = re.compile(r"([A-Z]{0,4}[0-9]([ -]?[A-Z0-9]){3,33})\b").match(text, m.end())
            number = re.sub("[ -]", "", m[1]) if m else ""
            iban = re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", number)
            if m and (pii.valid_iban(number) if iban else sum(c in "0123456789" for c in number) >= 5):
                out.append(("account", m.start(1), m.end(1)))
                last["account"] = m.end(1)
        for cue in pii.STREET_CUES:
            k = end - len(cue)
            if low[:end].endswith(cue) and not text[end : end + 1].isalnum():
                m = re.search(r"(?<![^\W_])[0-9]{1,5}[A-Za-z]?,? ([^\W\d_]+[ -])*[^\W\d_]*$", text[last["address"] : k])
                if m:
                    out.append(("address", last["address"] + m.start(), end))
                    last["address"] = end
    return sorted((pii.KINDS.index(kind), a, b) for kind, a, b in out)


OWN_PARTS = st.sampled_from(
    ["Account Number: 12345678", "ACCOUNT 12345678", "Passport No. X1234567", "Tax ID 123456789", "user id", "IBAN ", "SSN",
     "Social Security Number 123-45-6789", "DE89 3704 0044 0532 0130 00", "221 Baker Street", "12b The Very Long Old Winding Country Road",
     "5, Elm-Park avenue", "1234567 X STREET", "9 Kurfürstenstraße", " Main", " Street", " street", " 7", "7 ", "3a ", "-", ", ", "@home",
     "@a.b", "x@y.org", "SIP:bob@x.org", "Tel:+49", "mailto:", " ", "\n", "#", "é", "1", "Z9"]
)


@settings(max_examples=500, deadline=None)
@given(st.lists(OWN_PARTS, max_size=10).map("".join) | st.lists(OWN_PARTS, max_size=8).map(" ".join))
def test_spans_of_the_other_kinds_are_those_of_a_full_search(text):
    assert [s for s in pii.find(text) if s[0] >= 4] == own_spans(text)


@pytest.mark.parametrize(
    "text, value",
    [
        ("Account Number: 12345678", "12345678"),
        ("ACCOUNT 12345678", "12345678"),
        ("Passport No. X1234567", "X1234567"),
        ("Tax ID 123456789", "123456789"),
        ("Social Security Number 123-45-6789", "123-45-6789"),
        ("at 12 The Very Long Old Winding Country Road.", "12 The Very Long Old Winding Country Road"),
        ("at 7 " + "Long " * 40 + "Lane!", "7 " + "Long " * 40 + "Lane"),
        ("9B KURFÜRSTEN STREET", "9B KURFÜRSTEN STREET"),
    ],
)
def test_forms_that_announce_personal_data(text, value):
    assert value in [text[a:b] for k, a, b in pii.find(text) if k >= 4]


def test_long_texts_full_of_cues_take_time_in_proportion():
    import time

    start = time.perf_counter()
    assert not [s for s in pii.find("Long Street " * 100_000) if s[0] == 7]
    assert time.perf_counter() - start < 20


def test_own_kinds_are_found_and_checked():
    kinds = lambda text: {pii.KINDS[k]: text[a:b] for k, a, b in pii.find(text)}
    assert kinds("pay to IBAN: DE89 3704 0044 0532 0130 00 now")["account"] == "DE89 3704 0044 0532 0130 00"
    assert "account" not in kinds("IBAN: DE89370400440532013001")
    assert kinds("lives at 221 Baker Street, London")["address"] == "221 Baker Street"
    assert kinds("ask @some_one there")["handle"] == "@some_one"
    assert kinds("see sip:bob@example.org")["contact_url"] == "sip:bob@example.org"


def test_long_digit_runs():
    assert pii.find("1" * 6000 + ".1.1.1 " + "0" * 5000 + ".1.1.1") == [(1, 6007, 6007 + 5006)]


def test_personal_data_of_odd_rows(odd, documents):
    got = pii.digests(pii.personal_data(odd))
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows)
    assert pii.digests(pii.personal_data(documents([]))).count() == 0
    one = pii.digests(pii.personal_data(documents([(1, "é mail a@b.co or 1.2.3.4")]))).first()
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 0)
    assert one.spans == "email:7:13,ip:17:24" and one.base_sha256 == pii.base_sha256(pii.find("é mail a@b.co or 1.2.3.4"))


def test_redaction(documents):
    docs = documents([(1, "write a@b.co, call +49 30 1234567"), (2, None), (3, "clean")])
    got = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert got == {1: "write [email], call [phone]", 2: None, 3: "clean"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aB9 .\n\x0b\x00é漢-\x7f", max_size=20), max_size=5))
def test_words_are_those_of_the_patterns(texts):
    for inside, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words(pa.array(texts, pa.string()), inside)
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
        want = [re.findall(pattern, t) for t in lower]
        got = [[w.text(k) for k in range(a, b)] for a, b in zip(w.first, w.first[1:], strict=False)]
        assert got == want
        assert [word_hash(w.text(k)) for k in range(len(w.start))] == w.hashes().tolist()


VOCABULARY = sorted({w for t in licenses.PHRASES + licenses.NOTICES for w in t.text.split()})


def meets(text, template, threshold, slack):
    """Whether any block of the text meets the template, block by block."""
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    need = licenses.tokens(template)
    if template.exact:
        return [k for k in range(len(own)) if own[k : k + len(need)] == need]
    size = -(-slack * len(need) // 1)
    best = 0.0
    for k in range(len(own)):
        block = set(own[k : k + int(size)])
        best = max(best, len(block & set(need)) / len(set(need)))
    return best if best >= threshold - 1e-9 else None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*VOCABULARY, "x", "y", "MIT license", licenses.NOTICES[0].text, licenses.NOTICES[6].text]), max_size=60), st.integers(0, 3))
def test_links_are_all_blocks_that_meet(parts, seed):
    text = " ".join(parts)
    templates = licenses.PHRASES + licenses.NOTICES
    frequency = {w: (hash((w, seed)) % 5) for w in VOCABULARY}  # any order must give the same links
    found = licenses.Join(templates, 0.8, 1.25, frequency).links(words(pa.array([text]), ALNUM))
    for t, template in enumerate(templates):
        own = [x for x in found if x[1] == t]
        want = meets(text, template, 0.8, 1.25)
        if template.exact:
            assert sorted(x[2] for x in own) == want
        else:
            assert bool(own) == (want is not None)
            if own:
                assert max(x[4] for x in own) == pytest.approx(want)


def test_license_scan_of_odd_rows(odd, documents):
    rows = licenses.summary(licenses.license_links(odd)).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_words == by_id[4].n_words == 0 and by_id[7].n_words == 60_000
    assert all(r.n_base == 0 and r.first_word is None and r.base_labels == "" for r in rows)
    assert licenses.license_links(documents([])).count() == 0
    text = "Released under the MIT-License. Not the Apache license; the\nMIT license again. © GNU General Public License"
    one = licenses.summary(licenses.license_links(documents([(1, text)]))).first()
    assert (one.n_words, one.n_base, one.first_word, one.last_word) == (18, 4, 3, 15)
    assert one.base_labels == "apache,gpl,mit" and one.labels.startswith("apache,gpl,mit") and one.score == 1.0


def test_words_do_not_join_across_rows(documents):
    rows = licenses.summary(licenses.license_links(documents([(1, "the mit"), (2, "license of")]).coalesce(1))).collect()
    assert [r.n_base for r in rows] == [0, 0]
