import brute
import pytest

from syncohort.llm import mixing


def place_all(rows, limit):
    """Every source's blocks, each with the place of its documents, from the result."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    return by_source


def test_corpus(corpus):
    chars = 5000
    rows = mixing.mix(corpus, block_chars=chars, slots=200).collect()
    first = [r.doc_id for r in rows if r.copy == 0]
    assert sorted(first) == sorted(r.doc_id for r in corpus.select("doc_id").collect())
    sources = place_all(rows, chars)
    slots = {}
    for source, own in sources.items():
        for r in own:
            assert slots.setdefault(r.slot, (source, r.block)) == (source, r.block)
            assert r.release <= r.slot < r.deadline
            assert 0 <= r.offset < chars
        # Within a copy, documents fill their source's stream without gaps.
        start = 0
        for r in sorted((r for r in own if r.copy == 0), key=lambda r: (r.block, r.offset)):
            assert r.block * chars + r.offset == start
            start += max(len(r.text or ""), 1)
    last = max(slots)
    for source, own in sources.items():
        blocks = -(-sum(max(len(r.text or ""), 1) for r in own if r.copy == 0) // chars)
        copies = {}
        for r in own:
            copies.setdefault(r.doc_id, set()).add(r.copy)
            assert r.block % blocks == r.block - r.copy * blocks
        assert all(c == set(range(len(c))) for c in copies.values())
        assert max(r.slot for r in own) <= last


def test_shares_follow_weights(spark, odd_docs):
    docs = odd_docs([(k, "x" * 100, "a" if k % 3 else "b") for k in range(300)])
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("zz", 9.0)], "source string, weight double")
    rows = mixing.mix(docs, weights, block_chars=100, slots=10).orderBy("slot").collect()
    done = {"a": 0, "b": 0}
    for t, r in enumerate(rows, 1):
        done[r.source] += 1
        assert all(abs(d - t / 2) < 1 for d in done.values())
    assert done == {"a": 200, "b": 200} or done == {"a": 200, "b": 199}


def test_odd_rows(odd_docs):
    rows = [(1, None, None), (2, "", "a"), (3, "x" * 100000, "b"), (3, "x" * 100000, "b"), (None, "abc", "a"), (4, None, "a")]
    docs = odd_docs(rows)
    got = mixing.mix(docs, block_chars=1000, slots=7).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in got if r.copy == 0) == sorted((str(d), str(s)) for d, _, s in rows)
    assert set(docs.columns) <= set(got[0].asDict())
    assert mixing.mix(odd_docs([])).collect() == []


def test_native(corpus):
    plan = mixing.mix(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_parts(corpus, monkeypatch):
    """Many small parts of a source give one stream without gaps."""
    monkeypatch.setattr(mixing, "ORDERED", 3)
    rows = mixing.mix(corpus, block_chars=700, slots=50).where("copy = 0").collect()
    assert len(rows) == corpus.count()
    for own in place_all(rows, 700).values():
        start = 0
        for r in sorted(own, key=lambda r: (r.block, r.offset)):
            assert r.block * 700 + r.offset == start
            start += max(len(r.text or ""), 1)


@pytest.mark.parametrize(
    "weights", [[1 / 3] + [2 / 57] * 19, [0.5] + [0.5 / 1499] * 1499, [0.7, 0.3 - 1e-6, 1e-6], [3.0, 2.0, 1.0]]
)
def test_exact_weights(weights):
    """Every source within one block of its weight at any time, over many slots and sources."""
    parts, whole = mixing.shares(weights)
    chars = [max(1, 20000 * p // whole) * 10 for p in parts]
    done, last = [0] * len(weights), -1
    for k, block, release, due, slot in mixing.schedule(weights, chars, 10):
        assert block == done[k] and slot == last + 1 and release <= slot < due
        assert release == block * whole // parts[k] and due == -(-(block + 1) * whole // parts[k])
        done[k], last = block + 1, slot
        if slot % 997 == 0:
            assert all(abs(d * whole - (slot + 1) * p) < whole for d, p in zip(done, parts))
    assert all(10 * d >= n for d, n in zip(done, chars))


def test_schedule_is_the_earliest_deadline_first():
    for quota in ([1], [3, 7], [333, 500, 167], [1] * 10 + [90]):
        got = [row[0] for row in mixing.schedule(quota, quota, 1)]
        assert got == brute.served(quota, sum(quota))


def test_many_small_sources(spark, odd_docs):
    """More than a thousand sources; a hot source keeps its weight, tiny ones are read once."""
    rows = [(k, "x" * 100, "hot") for k in range(1500)] + [(10000 + k, "x" * 100, f"s{k:04}") for k in range(1500)]
    weights = spark.createDataFrame(
        [("hot", 0.5), *[(f"s{k:04}", 0.5 / 1500) for k in range(1500)]], "source string, weight double"
    )
    got = mixing.mix(odd_docs(rows), weights, block_chars=100).orderBy("slot").collect()
    assert len(got) in (3000, 3001) and len({r.doc_id for r in got}) == 3000
    hot = 0
    for t, r in enumerate(got, 1):
        hot += r.source == "hot"
        assert abs(hot - t / 2) <= 1
    tiny = odd_docs([(k, "x" * 1000, "big") for k in range(50)] + [(99, "x", "tiny")])
    assert [r.copy for r in mixing.mix(tiny, block_chars=100).collect() if r.source == "tiny"] == [0]
