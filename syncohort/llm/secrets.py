"""Secret scans through an inverted index of trigrams.

Every rule is a regular expression. From it follows a Boolean query of trigrams that any
match must hold (`trigrams.py`). The index is partitioned by document: each slice of
texts gets posting lists of the trigrams that some rule asks for, a rule's posting lists
are intersected (and united over its clauses), and the rule's pattern runs on the texts
left over. Rules without mandatory trigrams run on every text. Postings live as long as
their slice, so nothing is shuffled and a lost executor costs its own slices only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncohort.llm import trigrams
from syncohort.llm import words as W


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of `pattern` for which `holds` is true.

    A pattern that ignores case must do so for ASCII letters only, `(?ai)`.
    """

    kind: str
    pattern: str
    holds: Callable[[re.Match[str]], bool] = bool

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for match in re.finditer(self.pattern, text):
            if self.holds(match):
                yield match.span()


# Fixed rules: kinds, patterns and least lengths.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 12,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    # A run shorter than 16 holds no run of 16, so the length can be asked for at once.
    SecretRule("hex", r"[0-9a-f]{16,}"),
)

_SAFE = re.compile(r"[A-Za-z0-9+/_.=-]*")

#: Further kinds: issuers' key formats, key blocks, logins in addresses, spoken passwords.
MORE_RULES = (
    SecretRule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY[A-Z ]{0,6}-----"
        r"(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,20}PRIVATE KEY[A-Z ]{0,6}-----)?",
    ),
    SecretRule("github", r"\bgh[opsur]_[A-Za-z0-9]{36,}|\bgithub_pat_[A-Za-z0-9_]{22,}"),
    SecretRule("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    SecretRule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    SecretRule("npm", r"\bnpm_[A-Za-z0-9]{36}"),
    SecretRule("sendgrid", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    SecretRule("azure", r"AccountKey=[A-Za-z0-9+/]{40,}={0,2}"),
    SecretRule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    SecretRule("bearer", r"(?ai)\bbearer\x20+[a-z0-9._~+/=-]{20,}"),
    SecretRule("login", r"://[^\s:/?#@]{1,100}:[^\s:/?#@]{3,100}@"),
    # Passwords that the first rule drops as too short or cuts at another sign.
    SecretRule(
        "password",
        r"""(?ai)\b(?:password|passwd|passphrase|pwd)["']?(?:\x20*[:=]|\x20+is)\x20*["']?([^\s"'<>]{6,})""",
        lambda m: len(_SAFE.match(m[1])[0]) < 12,
    ),
)

RULES = BASE_RULES + MORE_RULES


class TrigramIndex:
    """Posting lists of one slice of texts, for the trigrams that a set of rules asks for."""

    def __init__(self, rules: Sequence[SecretRule]) -> None:
        self.queries = [trigrams.trigram_query(re.compile(r.pattern)) for r in rules]
        self.known = sorted({t for q in self.queries for clause in q for t in clause})
        # One byte per possible trigram: nearly all positions are passed over at once.
        self._asked = np.zeros(1 << 24, bool)
        self._codes = np.array([int.from_bytes(t) for t in self.known], np.uint32)
        self._asked[self._codes] = True

    def postings(self, texts: pa.Array) -> dict[bytes, np.ndarray]:
        """Sorted numbers of the texts that hold each trigram."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        if len(low) < 3:
            return {}
        low = (low + 32 * ((low >= 65) & (low <= 90))).astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(self._asked[codes])
        ends = ends - ends[0]
        row = np.searchsorted(ends, at, "right") - 1
        inside = at + 3 <= ends[row + 1]  # a trigram does not reach into the next text
        number = np.searchsorted(self._codes, codes[at[inside]])
        pairs = np.unique(number.astype(np.int64) * len(texts) + row[inside])
        number, row = np.divmod(pairs, len(texts))
        cuts = np.searchsorted(number, np.arange(len(self.known) + 1))
        return {t: row[a:b] for t, a, b in zip(self.known, cuts, cuts[1:]) if b > a}

    def candidates(self, texts: pa.Array) -> list[np.ndarray | None]:
        """For every rule the texts that can match; None stands for all of them."""
        lists = self.postings(texts)
        none = np.zeros(0, np.int64)
        found: list[np.ndarray | None] = []
        for query in self.queries:
            if query == trigrams.ANY:
                found.append(None)
                continue
            hits = none
            for clause in query:
                shortest_first = sorted((lists.get(t, none) for t in clause), key=len)
                hits = np.union1d(hits, reduce(np.intersect1d, shortest_first))
            found.append(hits)
        return found


_SPANS = pa.list_(
    pa.struct(
        [("start", pa.int64()), ("rule", pa.int32()), ("end", pa.int64()), ("secret", pa.string())]
    )
)


def _scanner(rules: Sequence[SecretRule]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(rules)
        for batch in batches:
            for part in W.slices(batch):
                column = pc.fill_null(part.column("text"), "")
                texts: dict[int, str] = {}
                rows: list[list[dict]] = [[] for _ in range(len(part))]
                for k, (rule, left) in enumerate(zip(rules, index.candidates(column))):
                    for i in range(len(part)) if left is None else left.tolist():
                        if i not in texts:
                            texts[i] = column[i].as_py()
                        rows[i] += (
                            {"start": a, "rule": k, "end": b, "secret": texts[i][a:b]}
                            for a, b in rule.spans(texts[i])
                        )
                for row in rows:
                    row.sort(key=lambda s: (s["start"], s["rule"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(rows, _SPANS)], names=["doc_id", "spans"]
                )

    return scan


def secret_spans(docs: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """(doc_id, spans) for every row of `docs`; spans are (start, kind, end, secret).

    start and end count code points, end exclusive; spans are ordered by start, then by
    the rules' order. Spans of different rules may overlap. Null and empty texts have
    none. Rows that repeat a doc_id or text, or have a null doc_id, are scanned one by
    one; texts of any length are scanned whole. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    found = texts.mapInArrow(
        _scanner(tuple(rules)),
        "doc_id long, spans array<struct<start: long, rule: int, end: long, secret: string>>",
    )
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return found.select(
        "doc_id",
        F.transform(
            "spans",
            lambda s: F.struct(s["start"], kinds[s["rule"]].alias("kind"), s["end"], s["secret"]),
        ).alias("spans"),
    )


def _digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def secrets(docs: DataFrame, rules: Sequence[SecretRule] = MORE_RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans) for every row of `docs`.

    The fixed rules' spans are counted and digested; `rules` add theirs to `spans`. Odd
    rows are treated as by `secret_spans`; without spans the digest is that of an empty
    string.
    """
    names = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    counts = [_count(n).alias(f"n_{n}") for n in names]
    return secret_spans(docs, BASE_RULES + tuple(rules)).select(
        "doc_id",
        *counts,
        F.sha2(_digest(base).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
