import random

from hypothesis import given, settings
from hypothesis import strategies as st

from syncohort.llm import line_dedup as ld

LINES = [f"Line number {k} has enough words to be worth something, {k * 7919}." for k in range(60)]


def run(frame, **more):
    return {r.doc_id: r for r in ld.line_dedup(frame, **more).collect()}


def test_blocks_go_from_the_later_document(odd_docs):
    rows = [
        (1, "\n".join(LINES[:10])),
        (2, "\n".join([LINES[20], *LINES[3:7], LINES[21]])),
        (3, "\n".join(LINES[30:35])),
        (4, "\n".join(LINES[:10])),
        (5, "\n".join([LINES[40], "", LINES[31], "", LINES[41]])),
    ]
    got = run(odd_docs(rows))
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "\n".join([LINES[20], LINES[21]]) and got[2].n_removed == 4
    assert got[4].text == "" and got[4].source_ids == [1]
    assert got[5].text == "\n".join([LINES[40], "", LINES[41]]) and got[5].source_ids == [3]
    assert got[2].n_lines == 6


def test_a_line_in_every_document_goes_at_every_size(odd_docs):
    """Neither the share of the holders nor their number decides."""
    common = "This very line stands at the top of every single document here."
    for count, every in ((9, 1), (10, 1), (11, 1), (200, 1), (200, 2)):
        rows = [
            (k, "\n".join([*([common] if k % every == 0 else []), f"Own words of document {k}, which nobody else has written {k}."]))
            for k in range(count)
        ]
        got = run(odd_docs(rows))
        assert [got[k].n_removed for k in range(count)] == [int(k > 0 and k % every == 0) for k in range(count)]
        assert all(got[k].text.endswith(f" {k}.") for k in range(count))


def test_query_equals_brute_force(odd_docs):
    """All blocks that any earlier document holds, by looking at every pair of documents."""
    rng = random.Random(4)
    words = [f"{c * rng.randrange(3, 30)}" for c in "abcdefghijkl"]
    rows = [(k, "\n".join(rng.choice(["", *words]) for _ in range(rng.randrange(14)))) for k in range(120)]
    lines = {k: [(n, x) for n, x in enumerate(t.split("\n")) if x] for k, t in rows}
    got = run(odd_docs(rows))
    for k, text in rows:
        gone, own = set(), [x for _, x in lines[k]]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(map(len, own[i:j])) < ld.MIN_BLOCK:
                    continue
                for e in range(k):
                    other = [x for _, x in lines[e]]
                    if any(other[a : a + j - i] == own[i:j] for a in range(len(other))):
                        gone |= {lines[k][n][0] for n in range(i, j)}
        kept = [x for n, x in enumerate(text.split("\n")) if x and n not in gone]
        assert got[k].n_removed == len(gone), k
        assert [x for x in got[k].text.split("\n") if x] == kept
        assert all(s < k for s in got[k].source_ids) and bool(got[k].source_ids) == bool(gone)


def test_a_source_of_many_documents_is_split(odd_docs, monkeypatch):
    monkeypatch.setattr(ld, "PAIRS", 7)
    rows = [(k, "\n".join([*LINES[:4], f"Own {k}."])) for k in range(100)]
    got = run(odd_docs(rows))
    assert [got[k].n_removed for k in range(100)] == [0] + [4] * 99


def test_large_group_of_copies(odd_docs):
    """A third of all rows near-copies of one text: each meets the earliest holder only."""
    rng = random.Random(1)
    rows = []
    for k in range(300):
        own = list(LINES[:12])
        own[rng.randrange(12)] = f"Changed line {k} of this one document, only here {k}."
        rows.append((k, "\n".join(own)))
    rows += [(1000 + k, f"Unrelated document {k} with one line of its own {k * k}.") for k in range(600)]
    got = run(odd_docs(rows))
    assert all(got[k].n_removed == 11 for k in range(2, 300))
    assert all(got[1000 + k].n_removed == 0 for k in range(600))
    pairs = ld.overlaps(odd_docs(rows)).count()
    assert pairs <= 2 * 300


def test_every_line_survives_once(corpus, corpus_rows):
    got = run(corpus)
    before = {x.strip() for _, t in corpus_rows for x in (t or "").split("\n")}
    after = {x.strip() for r in got.values() for x in (r.text or "").split("\n")}
    assert {x for x in before if x} <= after
    texts = dict(corpus_rows)
    for d, r in got.items():
        assert r.n_lines == (0 if texts[d] is None else texts[d].count("\n") + 1)
        own, kept = (texts[d] or "").split("\n"), (r.text or "").split("\n")
        it = iter(own)
        assert r.text in (None, "") or all(x in it for x in kept)  # a subsequence
        assert all(s < d for s in r.source_ids)
        if not r.n_removed:
            assert r.text == texts[d]
    for r in got.values():
        earlier = {x.strip() for s in r.source_ids for x in texts[s].split("\n")}
        gone = [x.strip() for x in texts[r.doc_id].split("\n")] if r.n_removed else []
        for x in (r.text or "").split("\n"):
            if x.strip() in gone:
                gone.remove(x.strip())
        assert all(x in earlier for x in gone if x)


def test_odd_rows(odd_docs):
    long = "\n".join(LINES * 300)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (4, long), (5, long), (None, long), (6, "short"), (7, "short")]
    got = ld.line_dedup(odd_docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text is None and by_id[1].n_lines == 0 and by_id[2].text == "" and by_id[3].text == "\n\n"
    assert by_id[4].text == long and by_id[None].text == long and by_id[5].text.strip() == ""
    assert by_id[7].text == "short"
    assert set(odd_docs(rows).columns) <= set(got[0].asDict())
    assert ld.line_dedup(odd_docs([])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30), st.lists(st.integers(0, 9), max_size=30))
def test_alignment(a, b):
    pairs = ld.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    # Lines that are unique in both and in the same order everywhere are all aligned.
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    if once == [x for x in b if x in once] and not (set(a) & set(b)) - set(once):
        assert [a[i] for i, _ in pairs] == once


def test_blocks_need_size():
    assert ld.common_blocks([1, 2, 3, 4], [9, 1, 2, 8, 4], [50] * 5, 60) == [1, 2]
    assert ld.common_blocks([1, 2, 3, 4], [9, 1, 2, 8, 4], [50] * 5, 40) == [1, 2, 4]


LONG = " ".join(f"passage{k}" for k in range(60))


def test_frequent_passages_go_at_every_size(odd_docs):
    """A block of a third of the documents, and a long line in most of them, whatever their number."""
    block = LINES[:2]
    for count in (30, 300, 3000):
        rows = [
            (k, "\n".join([f"Own first line of document {k}.", *([LONG] if k % 4 else []), f"Own middle {k}.", *(block if k % 3 == 0 else []), f"Own end {k}."]))
            for k in range(count)
        ]
        got = run(odd_docs(rows))
        for k, text in rows:
            gone = (2 if k % 3 == 0 and k > 0 else 0) + (1 if k % 4 and k > 1 else 0)
            assert got[k].n_removed == gone, (count, k)
            assert f"Own middle {k}." in got[k].text and f"Own end {k}." in got[k].text


def test_rare_share_of_short_lines_goes_at_every_size(odd_docs):
    notice = "This notice stands in one of a hundred documents, not in all of them."
    for count in (1000, 20000):
        rows = [(k, f"Own text of document {k}." + ("\n" + notice if k % 100 == 5 else "")) for k in range(count)]
        assert sum(r.n_removed for r in run(odd_docs(rows)).values()) == count // 100 - 1


def test_repeated_and_moved_blocks(odd_docs):
    p, a, b = LINES[:3], LINES[10:13], LINES[20:23]
    rows = [
        (1, ["u of its own", *p, "v of its own"]), (2, ["x", *p, "y", *p, "z"]),
        (3, ["r of its own", *a, "s of its own", *a]), (4, ["c", *a, "d"]), (5, [*a, "e", *a, *a]),
        (6, [*b, *LINES[30:33]]), (7, [*LINES[30:33], *b]),
    ]
    got = run(odd_docs([(k, "\n".join(lines)) for k, lines in rows]))
    assert [got[k].n_removed for k in range(1, 8)] == [0, 6, 0, 3, 9, 0, 6]
    assert got[2].text == "x\ny\nz" and got[4].text == "c\nd" and got[5].text == "e" and got[7].text == ""
    assert ld.common_blocks("uPQRv", "xPQRyPQRz", [50] * 9, 100) == [1, 2, 3, 5, 6, 7]
    assert ld.common_blocks("ABCDEF", "DEFABC", [20] * 6, 60) == [0, 1, 2, 3, 4, 5]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20), st.integers(1, 60))
def test_all_common_blocks(a, b, least):
    sizes = [5 + 7 * x for x in b]
    want = set()
    for i in range(len(b)):
        for j in range(i + 1, len(b) + 1):
            if sum(sizes[i:j]) >= least and any(a[k : k + j - i] == b[i:j] for k in range(len(a))):
                want |= set(range(i, j))
    assert ld.common_blocks(a, b, sizes, least) == sorted(want)
    assert ld.aligned_blocks(a, b, sizes, least) == sorted(want)
