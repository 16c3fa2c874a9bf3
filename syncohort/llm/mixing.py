"""Mixing sources to target weights by a Pfair schedule of blocks.

A source's texts, in an order fixed by hashes, make a stream of characters that is cut
into blocks. With weight w its i-th block is released at floor(i / w) and due at
ceil((i + 1) / w); serving the released block with the earliest deadline keeps every
source within less than one block of its weight at any time. Weights are exact
rationals, so neither a rounding nor a smallest share adds up over a long schedule; a
few numbers per block are worked out, in pieces that are written as a table, and a
document's place follows from its place in its source. The schedule ends when every
source has been read completely; until then a source that ends earlier starts again, so
no document is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syncohort.lineage import cut, scratch_path

#: Characters of a block at least, and blocks that all characters make at most.
BLOCK_CHARS = 1 << 16
BLOCKS = 1 << 20
#: Slots worked out and written at once.
SLOTS = 1 << 17
#: Default weights are in proportion to a source's characters to this power.
EXPONENT = 0.9
#: Documents of a source that are ordered in one group.
ORDERED = 2000


def shares(weights: Sequence[float]) -> tuple[list[int], int]:
    """Integers in exactly the proportions of `weights`, and their sum."""
    exact = [Fraction(w) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("weights must be above 0")
    common = max((w.denominator for w in exact), default=1)  # powers of two
    parts = [int(w * common) for w in exact]
    return parts, sum(parts)


def schedule(
    weights: Sequence[float], chars: Sequence[int], block_chars: int
) -> Iterator[tuple[int, int, int, int, int]]:
    """(source number, block, release, deadline, slot) of every slot, ascending.

    Ties between deadlines go to the lower number. Slots are filled until each source's
    weight has covered its characters; then come the blocks that are begun by then but
    not served, at most one of a source, all within their deadlines.
    """
    parts, whole = shares(weights)
    # The first slot at which n characters are covered: n / (block_chars * weight).
    end = max((-(-n * whole // (block_chars * p)) for n, p in zip(chars, parts)), default=0)
    waiting: dict[int, list[tuple[int, int, int]]] = {0: []}
    ready = [(-(-whole // p), k, 0, 0) for k, p in enumerate(parts)]
    heapq.heapify(ready)
    for slot in range(end):
        for later in waiting.pop(slot, ()):
            heapq.heappush(ready, later)
        due, k, block, release = heapq.heappop(ready)
        yield k, block, release, due, slot
        block += 1
        release = block * whole // parts[k]
        later = (-(-(block + 1) * whole // parts[k]), k, block, release)
        if release <= slot + 1:
            heapq.heappush(ready, later)
        else:
            waiting.setdefault(release, []).append(later)
    slot = end
    for due, k, block, release in sorted(ready):
        if block * block_chars < chars[k]:
            yield k, block, release, due, slot
            slot += 1


_PLACES = "_k long, block long, release long, deadline long, slot long"


def _written(
    spark: SparkSession, rows: Iterator[tuple[int, ...]], served: list[int], slots: int
) -> DataFrame:
    """`rows` of a schedule as a table; counts each source's blocks in `served`."""
    path = scratch_path(spark, "schedule")
    piece: list[tuple[int, ...]] = []

    def write() -> None:
        spark.createDataFrame(piece, _PLACES).write.mode("append").parquet(path)
        piece.clear()

    for row in rows:
        served[row[0]] += 1
        piece.append(row)
        if len(piece) >= slots:
            write()
    write()
    return spark.read.schema(_PLACES).parquet(path)


def _key(source: Column) -> Column:
    """A source as a string that is never null; a null comes before all others."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    block_chars: int | None = None,
    slots: int = SLOTS,
    exponent: float = EXPONENT,
) -> DataFrame:
    """Rows of `docs` with their place in the mix, repeated where a source starts again.

    Adds copy (0 for the first reading), block (number within the source), release and
    deadline (in slots), slot (where the block is served) and offset (characters before
    the document in its block, on the first reading). A document belongs to the block
    it begins in; ordering by (slot, offset) gives the mix. Every row of `docs` has
    exactly one copy 0. Columns that are not selected from the result do not move.

    `weights` is (source, weight > 0); a source of `docs` it does not name, or names with
    a null, gets the lowest weight named, one it names more than once the highest. Without
    `weights` they are the sources' characters to the power `exponent`. A null source is
    a source of its own; null and empty texts count one character, so they have a place.
    Repeated rows and null doc_ids have places of their own. Columns of `docs` with the
    added names are replaced; an empty table stays empty. Any number of sources. A block
    has `block_chars` characters, by default BLOCK_CHARS or as many more as make one
    reading of everything BLOCKS blocks. `slots` only sets how much of the schedule is
    written at once, the result does not depend on it.
    """
    added = ["copy", "block", "release", "deadline", "slot", "offset"]
    columns = [c for c in docs.columns if c not in added]
    parts = max(1, docs.count() // ORDERED)
    # Names of their own, so that no column clashes; those nobody reads are pruned.
    sized = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(columns)],
        _key(F.col("source")).alias("_key"),
        F.xxhash64(F.lit(17), "doc_id", "text").alias("_hash"),
        F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long").alias("_size"),
    ).withColumn(
        "_part", F.shiftright(F.shiftrightunsigned("_hash", 33) * F.lit(parts).cast("long"), 31)
    )
    sums = cut(sized.groupBy("_key", "_part").agg(F.sum("_size").alias("_sum")), "sums")
    earlier = (
        Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = sums.select(
        "_key", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    totals = sums.groupBy("_key").agg(F.sum("_sum").alias("chars"))
    if weights is None:
        target = totals.withColumn("weight", F.pow("chars", F.lit(exponent)))
    else:
        named = weights.groupBy(_key(F.col("source")).alias("_key")).agg(
            F.max(F.col("weight").cast("double")).alias("weight")
        )
        lowest = F.coalesce(F.min("weight").over(Window.partitionBy()), F.lit(1.0))
        target = totals.join(named, "_key", "left").withColumn("weight", F.coalesce("weight", lowest))
    sources = target.select("_key", "chars", "weight").orderBy("_key").collect()
    chars = [r.chars for r in sources]
    if block_chars is None:
        block_chars = max(BLOCK_CHARS, -(-sum(chars) // BLOCKS))
    spark, served = docs.sparkSession, [0] * len(sources)
    blocks_served = schedule([r.weight for r in sources], chars, block_chars)
    plan = _written(spark, blocks_served, served, slots).withColumnRenamed("block", "_block")
    # Written, as Spark then knows how small it is.
    rounds = cut(
        spark.createDataFrame(
            [(k, r["_key"], -(-r.chars // block_chars), served[k]) for k, r in enumerate(sources)],
            "_number long, _key string, blocks long, served long",
        ),
        "rounds",
    )
    running = F.sum("_size").over(
        Window.partitionBy("_key", "_part")
        .orderBy("_hash")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The other sides of both joins have a row for each part and a row for each block; the
    # first join has the window's keys, so its rows stay where they are.
    placed = (
        sized.withColumn("_place", running - F.col("_size"))
        .join(before.join(rounds, "_key"), ["_key", "_part"])
        .withColumn("_place", F.col("_place") + F.col("_before"))
        .withColumn("_first", F.floor(F.col("_place") / F.lit(block_chars)))
        .withColumn("_copies", F.floor((F.col("served") - 1 - F.col("_first")) / F.col("blocks")))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies"))))
        .withColumn("block", F.col("_first") + F.col("copy") * F.col("blocks"))
        .join(plan, (F.col("_number") == F.col("_k")) & (F.col("block") == F.col("_block")))
    )
    return placed.select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)],
        "copy",
        "block",
        "release",
        "deadline",
        "slot",
        F.pmod("_place", F.lit(block_chars).cast("long")).alias("offset"),
    )
