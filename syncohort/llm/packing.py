"""Packing tokenised documents into sequences by exact complements, then best fit.

Planning sees only how many pieces there are of each length, at most 4096 numbers
whatever the size of the corpus. Going down from the longest length, the gap it
leaves is filled exactly by one, two or three available lengths, as many times as
the counts allow; every such step uses up a length, so there are few steps. What
has no exact complement is packed best-fit decreasing, again by counts. The plan is
a bounded list of rank ranges per length, and each piece finds its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from syncohort.lineage import cut
from syncohort.llm import words as W

LIMIT = 4096
END_ID = 1
#: Words whose ids a Python worker remembers; beyond it starts afresh.
REMEMBERED = 1 << 19
#: Pieces of one length that are numbered in one group.
NUMBERED = 2000

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x3b\x3d-\x7eÀ-ɏ]+")
_WORD_END = b"\xff"


class WordIds:
    """Token ids of single words, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never joins across it, so a text's ids are
    its words' ids one after the other. Where the merges are ranked by id, words of
    plain Latin letters and ASCII signs go to a faster byte-pair encoder with the
    same merges; everything else goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.encoder = self._encoder(json.load(open(path, encoding="utf-8")))

    @staticmethod
    def _encoder(spec: dict):
        model = spec["model"]
        vocabulary, merges = model["vocab"], model["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        if not pairs or model.get("end_of_word_suffix") != "</w>":
            return None
        first = vocabulary[pairs[0][0] + pairs[0][1]]
        if any(vocabulary[a + b] != first + k for k, (a, b) in enumerate(pairs)):
            return None
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {}
        for token, number in vocabulary.items():
            if token not in special:
                ends = token.endswith("</w>")
                raw = bytes(byte[c] for c in (token[:-4] if ends else token))
                ranks[raw + _WORD_END * ends] = number
        return tiktoken.Encoding(
            "words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}
        )._encode_single_piece

    def _missing(self, words: list[bytes]) -> None:
        other = []
        encode = self.encoder
        for word in words:
            text = word.decode()
            if encode is None or not _PLAIN.fullmatch(text):
                other.append(word)
                continue
            if text.isascii():
                text = text.lower()
                if text.isalpha():
                    ids = encode(text.encode() + _WORD_END)
                    self.known[word] = np.array(ids, "<u4").tobytes()
                    continue
            else:
                text = unicodedata.normalize("NFC", text).lower()
            ids = []
            for piece in _PIECE.findall(text):
                ids += encode(piece.encode() + _WORD_END)
            self.known[word] = np.array(ids, "<u4").tobytes()
        for start in range(0, len(other), 4096):
            part = other[start : start + 4096]
            found = self.tokenizer.encode_batch(
                [w.decode() for w in part], add_special_tokens=False
            )
            for word, one in zip(part, found):
                self.known[word] = np.array(one.ids, "<u4").tobytes()

    def of(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        self._missing([w for w in words if w not in self.known])
        return list(map(self.known.__getitem__, words))


_LOADED: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        W.release()  # what earlier tasks of this worker left
        _LOADED[path] = WordIds(path)
        W.release()  # what was read to build it
    return _LOADED[path]


def _token_ids(texts: pa.Array, ids: WordIds) -> Iterator[np.ndarray]:
    """Token ids of each text."""
    text = W.coded(texts)
    found = ids.of(text.vocabulary)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), "<u4")
    starts = np.cumsum(sizes) - sizes
    counts = sizes[text.codes]
    for start, end in zip(text.bounds, text.bounds[1:]):
        n = counts[start:end]
        jump = starts[text.codes[start:end]] - (np.cumsum(n) - n)
        yield flat[np.repeat(jump, n) + np.arange(n.sum())]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut at `limit` tokens.

    A document is its ids without special tokens, then END_ID; a null text is empty.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(path)
        for batch in batches:
            for part in W.slices(batch):
                rows = []
                each = _token_ids(part.column("text"), ids)
                for doc, own in zip(part.column("doc_id").to_pylist(), each):
                    own = np.append(own, np.uint32(END_ID)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), limit)):
                        cutout = own[start : start + limit]
                        rows.append((doc, k, start, len(cutout), zlib.crc32(cutout)))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tokenise, "doc_id long, piece long, start long, length long, ids_crc32 long"
    )


class Planner:
    """Sequences, as (lengths, times), for `counts` pieces of each length."""

    def __init__(self, counts: dict[int, int], limit: int = LIMIT):
        self.limit = limit
        self.left = np.zeros(limit + 1, np.int64)
        for length, count in counts.items():
            self.left[length] = count
        self.plan: list[tuple[tuple[int, ...], int]] = []

    def _take(self, lengths: tuple[int, ...]) -> bool:
        need = defaultdict(int)
        for length in lengths:
            need[length] += 1
        times = min(int(self.left[k]) // n for k, n in need.items())
        if times:
            self.plan.append((lengths, times))
            for k, n in need.items():
                self.left[k] -= n * times
        return times > 0

    def _pair(self, total: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available lengths, the first as long as possible, that add up to `total`."""
        if total < 2:
            return None
        have = self.left[: total + 1].copy()
        for length in held:
            if length <= total:
                have[length] -= 1
        some = have > 0
        both = some[1:total] & some[total - 1 : 0 : -1]
        if total % 2 == 0 and have[total // 2] < 2:
            both[total // 2 - 1] = False
        at = np.flatnonzero(both)
        return (int(at[-1]) + 1, total - int(at[-1]) - 1) if len(at) else None

    def _complement(self, length: int) -> tuple[int, ...] | None:
        """One, two or three lengths that exactly fill what `length` leaves."""
        gap = self.limit - length
        if gap == 0:
            return ()
        if self.left[gap] > (gap == length):
            return (gap,)
        if pair := self._pair(gap, (length,)):
            return pair
        for a in np.flatnonzero(self.left[: gap - 1])[::-1].tolist():
            if self.left[a] > (a == length) and (pair := self._pair(gap - a, (length, a))):
                return (a, *pair)
        return None

    def _exact(self) -> None:
        for length in range(self.limit, 0, -1):
            while self.left[length]:
                found = self._complement(length)
                if found is None or not self._take((length, *found)):
                    break

    def _best_fit(self) -> None:
        open_bins: dict[int, list[list]] = defaultdict(list)  # gap: [lengths, times]
        gaps: list[int] = []

        def put(lengths: tuple[int, ...], times: int, gap: int) -> None:
            if times:
                if not open_bins[gap]:
                    bisect.insort(gaps, gap)
                open_bins[gap].append([lengths, times])

        for length in range(self.limit, 0, -1):
            count = int(self.left[length])
            while count:
                at = bisect.bisect_left(gaps, length)
                if at < len(gaps):
                    gap = gaps[at]
                    lengths, bins = open_bins[gap].pop()
                    if not open_bins[gap]:
                        gaps.pop(at)
                else:
                    gap, lengths, bins = self.limit, (), -(-count // (self.limit // length))
                each = gap // length
                full = min(bins, count // each)
                put(lengths + (length,) * each, full, gap - each * length)
                count -= full * each
                if full < bins:
                    if count:
                        put(lengths + (length,) * count, 1, gap - count * length)
                        bins, count = bins - 1, 0
                    if lengths:
                        put(lengths, bins - full, gap)
            self.left[length] = 0
        for bins in open_bins.values():
            self.plan.extend((lengths, times) for lengths, times in bins)

    def run(self) -> list[tuple[tuple[int, ...], int]]:
        self._exact()
        self._best_fit()
        return self.plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """(length, [(first rank, past rank, first sequence, offset)]) of a plan."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rank = ranks[length]
            out[length].append((rank, rank + times, sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    return list(out.items())


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every document.

    Only documents longer than `limit` tokens are cut. A null or empty text is the end
    id alone. Every row is packed, also one that repeats a doc_id or has a null one;
    other columns are ignored; an empty table gives an empty table. Between pieces of
    one length, ties are broken by doc_id and piece; which of several equal rows goes
    where is immaterial.
    """
    spark = docs.sparkSession
    cutouts = cut(pieces(docs, path, limit), "pieces")
    counts = {r["length"]: r["count"] for r in cutouts.groupBy("length").count().collect()}
    plan = Planner(counts, limit).run()
    # One row for each of at most `limit` lengths: bounded, so it may be broadcast.
    places = spark.createDataFrame(
        _places(plan),
        "length long, places array<struct<low: long, high: long, sequence: long, offset: long>>",
    )
    parts = max(1, sum(counts.values()) // NUMBERED)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    numbered = cutouts.withColumn("_part", part).withColumn(
        "_rank",
        F.row_number().over(
            Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
        ),
    )
    before = (
        cutouts.groupBy("length", part.alias("_part"))
        .count()
        .withColumn(
            "_before",
            F.sum("count").over(
                Window.partitionBy("length")
                .orderBy("_part")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("count")
    )
    rank = F.coalesce("_before", F.lit(0)) + F.col("_rank") - 1
    placed = (
        numbered.join(before, ["length", "_part"])
        .withColumn("_rank", rank)
        .join(F.broadcast(places), "length")
        .withColumn(
            "_at",
            F.filter("places", lambda p: (p["low"] <= F.col("_rank")) & (F.col("_rank") < p["high"]))[0],
        )
    )
    return placed.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32",
        (F.col("_at.sequence") + F.col("_rank") - F.col("_at.low")).alias("sequence_id"),
        F.col("_at.offset").alias("offset"),
    )
