import random

import brute
import pytest
from tokenizers import Tokenizer

from syncohort.llm import packing
from syncohort.llm.queries import TOKENIZER


def check(frame, rows, limit):
    got = frame.collect()
    want = brute.piece_rows(rows, Tokenizer.from_file(TOKENIZER), limit)
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_corpus(corpus, corpus_rows):
    used = check(packing.pack(corpus, TOKENIZER), corpus_rows, 4096)
    total = sum(r[3] for r in brute.piece_rows(corpus_rows, Tokenizer.from_file(TOKENIZER), 4096))
    assert used <= -(-total // 4096) + 2


def test_odd_rows(odd_docs):
    rows = [
        (1, None), (2, ""), (3, "word " * 500), (3, "word " * 500), (None, "x y"),
        (4, "İstanbul ΣΑΣ ﬁn <|endoftext|> don't Stop!!! 12.5€ naïve cafe\u0301 \u00a0\u2003 日本語 \U0001f600"),
        (5, "A'S we'll" + "z" * 3000), (6, "\x1c\x85 a\ufeffb"),
    ]
    check(packing.pack(odd_docs(rows), TOKENIZER, limit=64), rows, 64)
    assert packing.pack(odd_docs([]), TOKENIZER).collect() == []


def test_words_equal_the_tokenizer(corpus_rows):
    ids = packing.WordIds(TOKENIZER)
    assert ids.encoder is not None
    plain = Tokenizer.from_file(TOKENIZER)
    found = sorted({w for _, t in corpus_rows for w in brute.words(t)})
    got = ids.of([w.encode() for w in found])
    for word, raw in zip(found, got):
        want = plain.encode(word, add_special_tokens=False).ids
        assert raw == b"".join(i.to_bytes(4, "little") for i in want), word


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    limit = rng.choice([10, 50, 4096])
    counts = {rng.randint(1, limit): rng.choice([1, 2, 5, 1000]) for _ in range(rng.randint(1, 300))}
    plan = packing.Planner(counts, limit).run()
    used = {}
    for lengths, times in plan:
        assert 0 < sum(lengths) <= limit and times > 0
        for length in lengths:
            used[length] = used.get(length, 0) + times
    assert used == counts
    bins, total = sum(t for _, t in plan), sum(k * n for k, n in counts.items())
    assert bins <= max(2 * -(-total // limit), 1)


def test_exact_complements_first():
    plan = packing.Planner({6: 4, 4: 2, 3: 2, 1: 2, 5: 2}, 10).run()
    assert sum(t for _, t in plan) == 5 and all(sum(x) == 10 for x, _ in plan)


def test_hot_length(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 7)
    rows = [(k, "a b c") for k in range(100)] + [(1000 + k, "a b c d e f") for k in range(20)]
    assert check(packing.pack(odd_docs(rows), TOKENIZER, limit=11), rows, 11) == 60
