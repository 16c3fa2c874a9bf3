import random
import re
from collections import Counter

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from syncohort.llm import pii

PARTS = st.sampled_from(
    ["a", "b.c", "@", "x@y.z", "@a.b", "1", "12", "255", "256", ".", "1.2.3.4", "-", " ", "+", "4111111111111111",
     "(555)", "+1 (555) 123-4567", "_", "é", "%", "\n", "00000000000000", "0001.1.1.1"]
)


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=14))
def test_finders_equal_the_patterns(parts):
    text = "".join(parts)
    spans = [s for s, _ in [pii._found(text)]][0]
    names = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert names == brute.personal(text)[2]


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts)
    extra = 0
    for r in got:
        counts, digest, joined = brute.personal(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == counts
        assert r.base_sha256 == digest
        spans = r.spans.split(",") if r.spans else []
        own = [s for s in spans if s.split(":")[0] in pii.KINDS]
        assert r.n_spans == len(spans)
        assert ",".join(own) == joined
        assert sorted(spans, key=lambda s: int(s.split(":")[1])) == spans
        for s in spans:
            if s.startswith("secret:"):
                _, a, b = s.split(":")
                found = texts[r.doc_id][int(a) : int(b)]
                assert re.match("password=|AKIA|[0-9a-f]{40}", found), found
                extra += 1
    planted = sum(t.count("password=") + t.count("AKIA") for t in texts.values() if t)
    assert extra >= 0.9 * planted


def test_odd_rows(odd_docs):
    rows = [(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "1.2.3.4"), (4, "9" * 200000 + "@" * 1000), (5, "é a@b.co\n+1 (555) 123-4567")]
    got = pii.personal_data(odd_docs(rows)).collect()
    empty = brute.personal("")[1]
    found = {(r.doc_id, r.spans): r for r in got}
    assert len(got) == 7 and found[1, ""].base_sha256 == empty == found[2, ""].base_sha256
    assert (3, "email:0:6") in found and (None, "ip:0:7") in found
    assert (5, "email:2:8,phone:9:26") in found
    assert pii.personal_data(odd_docs([])).collect() == []
    spans = pii.spans_of(odd_docs(rows)).collect()
    assert sorted((r.kind, r.start, r.end) for r in spans if r.doc_id == 5) == [("email", 2, 8), ("phone", 9, 26)]


def test_estimation_finds_reliable_labelers():
    """Votes drawn from known reliabilities: the chances separate the classes."""
    import random

    rng = random.Random(4)
    counts, truth = {}, {}
    for _ in range(20000):
        real = rng.random() < 0.3
        key = 0
        for p in range(len(pii.LABELERS)):
            right = rng.random() < (0.9 if p < 4 else 0.55)
            vote = 0 if rng.random() < 0.3 else (1 if real == right else -1)
            key = key * 3 + vote + 1
        counts[key] = counts.get(key, 0) + 1
        truth.setdefault(key, []).append(real)
    chances = pii.estimate(counts)
    right = sum(sum((chances[k] > 0.5) == x for x in rows) for k, rows in truth.items())
    assert right > 0.95 * 20000


@pytest.mark.parametrize("word", ["3.", "2.0.", "1999", "(12)", "50%"])
def test_plain_numbers_are_no_secrets(word):
    rows = [("password=9c82e4685ca7e26784", "the", pii.votes("password=9c82e4685ca7e26784", "the"))] * 50
    rows += [(w, "version", pii.votes(w, "version")) for w in ("3.", "4.0.", "2.0.", "17", "1998")] * 50
    counts = {}
    for *_, v in rows:
        counts[v] = counts.get(v, 0) + 1
    weights = pii.train([(*r, 1) for r in rows], pii.estimate(counts))
    assert weights[pii.features(word, "of")].sum() < 0
    assert weights[pii.features("password=ef5f08a44296d48198", "a")].sum() > 2.2


def test_very_long_numbers_are_read(odd_docs):
    zeros = "0" * 5000
    rows = [(1, f"a 1.2.3.{zeros}1 b"), (2, f"a 1.2.3.{zeros}256 b"), (3, f"a {'9' * 6000}.2.3.4 b")]
    got = {r.doc_id: r for r in pii.personal_data(odd_docs(rows)).collect()}
    assert [got[k].n_ip for k in (1, 2, 3)] == [1, 0, 0]
    for k, text in rows:
        assert brute.personal(text)[0][1] == got[k].n_ip


def test_planted_kinds_are_found_and_clean_documents_left_alone(odd_docs):
    """Names, grouped numbers, digit-free passwords and tokens among ordinary prose."""
    rng = random.Random(5)
    plain = "the report of this year says that section three was written in spring and nobody asked".split()
    given, family = ["Anna", "Hans", "María", "Pierre", "Emily"], ["Berger", "Lopez", "O'Neill", "Martin", "Kowalski"]
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(n):
        return "".join(rng.choice(letters) for _ in range(n))

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def planted(kind):
        return {
            "name": lambda: (f"{rng.choice(given)} {rng.choice(family)}", "{}"),
            "title": lambda: (f"{word(6).title()}", rng.choice(["Dr. {}", "Herr {}", "Mme {}"])),
            "iban": lambda: (f"DE{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}", "iban {}"),
            "ssn": lambda: (f"{number(3)} {number(2)} {number(4)}", "ssn: {}"),
            "password": lambda: (word(9), rng.choice(["password: {}", "Passwort: {}"])),
            "spaced": lambda: (word(9), "password = {}"),
            "assigned": lambda: (f"password={word(8)}", "{}"),
            "token": lambda: (f"AKIA{word(8).upper()}{number(8)}", "{}"),
        }[kind]()

    kinds = ["name", "title", "iban", "ssn", "password", "spaced", "assigned", "token"]
    rows, wanted = [], {}
    for k in range(640):
        text = [rng.choice(plain) for _ in range(40)]
        if k % 2:
            kind = kinds[k // 2 % len(kinds)]
            secret, form = planted(kind)
            before = " ".join(text[:20])
            rows.append((k, f"{before} {form.format(secret)} " + " ".join(text[20:])))
            at = rows[-1][1].index(secret, len(before))
            wanted[k] = (kind, at, at + len(secret))
        else:
            text[7], text[21] = f"{rng.randrange(1990, 2030)},", str(rng.randrange(300))
            rows.append((k, " ".join(text)))
    found = {r.doc_id: r.spans for r in pii.personal_data(odd_docs(rows)).collect()}
    hit = Counter()
    for k, (kind, a, b) in wanted.items():
        spans = [s.split(":") for s in found[k].split(",") if s]
        hit[kind] += any(int(x) < b and int(y) > a for _, x, y in spans)
    for kind in kinds:
        assert hit[kind] >= 0.9 * 40, hit
    clean = [k for k, _ in rows if k not in wanted]
    assert sum(found[k] != "" for k in clean) <= 0.02 * len(clean)
