"""Merkle fingerprints of texts: clauses, paragraphs, sections, root.

A paragraph is a line; its leaves are the clauses in it, cut after `.`, `!`, `?`, `;`,
`:` and `,` and their ideographic forms; a long clause is cut further after words whose
hash is divisible by eight, and inside of words every 32 characters, so that an edit
hardly moves other borders. A paragraph's digest is the
hash of its leaves' digests, a section's that of its paragraphs' (a section ends after a
paragraph whose digest is divisible by four), and the root that of the sections'.
Equal roots mean equal texts; where roots differ, the search goes down into sections whose
digests differ, and only there into paragraphs. All of it is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncohort.lineage import cut

_CLAUSE_END = r"(?<=[.!?;:,。！？；：，、])"
#: After blanks, and every 32 characters of a run without any.
_WORD_END = r"(?<=[\x20\t])|(?<=\G[^\x20\t]{32})"
#: Characters of a leaf that is not cut further, words in a piece of a longer one on average.
_LEAF, _PER_LEAF = 160, 8
_PER_SECTION = 4
#: Digests in a bucket of an index on average, and its bits at most.
_BUCKET, _BITS = 4, 20
_NO_ID = -(2**63)


def tree(text: Column) -> Column:
    """Struct (leaves, sizes, paragraphs, ends, sections, root) of a text; a null is empty.

    `leaves` are all leaf digests in order, `sizes` how many each paragraph has; `ends`
    are the numbers (from 1) of the sections' last paragraphs.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    leaves = F.transform(
        lines, lambda p: F.flatten(F.transform(F.split(p, _CLAUSE_END, -1), _pieces))
    )
    return _with(leaves, _from_leaves)


def _pieces(clause: Column) -> Column:
    """Digests of a clause: one, or of its runs of words if it is long."""
    long = _with(
        F.split(clause, _WORD_END, -1),
        lambda words: _grouped(
            words,
            lambda i: (F.pmod(F.xxhash64(F.element_at(words, i)), F.lit(_PER_LEAF)) == 0)
            | (F.length(F.element_at(words, i)) >= 32),
        )["digests"],
    )
    return F.when(F.length(clause) <= _LEAF, F.array(F.xxhash64(clause))).otherwise(long)


def _grouped(items: Column, last) -> Column:
    """Struct (ends, digests) of the runs of `items` that end where `last(number)` says."""
    numbers = F.sequence(F.lit(1), F.size(items))
    return _with(
        F.filter(numbers, lambda i: (i == F.size(items)) | last(i)),
        lambda ends: F.struct(
            ends.alias("ends"),
            F.transform(
                ends,
                lambda e, k: _with(
                    F.when(k > 0, F.element_at(ends, F.greatest(k, F.lit(1)))).otherwise(0),
                    lambda b: F.xxhash64(F.slice(items, b + 1, e - b)),
                ),
            ).alias("digests"),
        ),
    )


def _with(value: Column, build) -> Column:
    """`build(value)` with `value` worked out once."""
    return F.transform(F.array(value), build)[0]


def _from_leaves(leaves: Column) -> Column:
    return _with(
        F.transform(leaves, lambda p: F.xxhash64(p)),
        lambda paragraphs: _with(
            _grouped(
                paragraphs,
                lambda i: F.pmod(F.element_at(paragraphs, i), F.lit(_PER_SECTION)) == 0,
            ),
            lambda sections: F.struct(
                F.flatten(leaves).alias("leaves"),
                F.transform(leaves, F.size).alias("sizes"),
                paragraphs.alias("paragraphs"),
                sections["ends"].alias("ends"),
                sections["digests"].alias("sections"),
                F.sha2(_hex(sections["digests"]), 256).alias("root"),
            ),
        ),
    )


def _hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lpad(F.hex(d), 16, "0")), "")


def fingerprint(made: Column) -> Column:
    """A tree as text: root, then the digests of sections, paragraphs and leaves."""
    return F.concat_ws(
        ":", made["root"], _hex(made["sections"]), _hex(made["paragraphs"]), _hex(made["leaves"])
    )


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else twice the shared distinct leaves over the leaves of both."""
    left, right = F.array_distinct(a), F.array_distinct(b)
    return 2.0 * F.size(F.array_intersect(left, right)) / (F.size(left) + F.size(right))


def tree_likeness(a: Column, b: Column) -> Column:
    return F.when(a["root"] == b["root"], 1.0).otherwise(likeness(a["leaves"], b["leaves"]))


def _index(digests: Column) -> Column:
    """Struct (bits, entries, starts): the digests in sorted buckets of their first bits.

    Among the sorted digests stands a mark before each bucket, so the places of the marks
    say where a bucket begins: no step looks at more than a bucket.
    """
    wanted = F.ceil(F.log2((F.size(digests) + 1) / F.lit(float(_BUCKET))))
    bits = F.greatest(F.least(wanted, F.lit(_BITS)), F.lit(1)).cast("int")
    return _with(
        bits,
        lambda bits: _with(
            F.array_sort(
                F.concat(
                    F.transform(digests, lambda d: F.struct(d.alias("d"), F.lit(1).alias("kind"))),
                    F.transform(
                        F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), bits) - 1),
                        lambda j: F.struct(
                            F.call_function(
                                "shiftleft",
                                j.cast("long") - F.call_function("shiftleft", F.lit(1), bits - 1),
                                64 - bits,
                            ).alias("d"),
                            F.lit(0).alias("kind"),
                        ),
                    ),
                )
            ),
            lambda entries: F.struct(
                bits.alias("bits"),
                entries.alias("entries"),
                F.filter(
                    F.sequence(F.lit(1), F.size(entries)),
                    lambda k: F.element_at(entries, k)["kind"] == 0,
                ).alias("starts"),
            ),
        ),
    )


def _holds(index: Column, digest: Column) -> Column:
    half = F.call_function("shiftleft", F.lit(1), index["bits"] - 1)
    bucket = F.call_function("shiftright", digest, 64 - index["bits"]).cast("int") + half + 1
    start = F.element_at(index["starts"], bucket)
    end = F.coalesce(
        F.try_element_at(index["starts"], bucket + 1), F.size(index["entries"]) + 1
    )
    return F.exists(
        F.slice(index["entries"], start + 1, end - start - 1), lambda x: x["d"] == digest
    )


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of paragraphs of tree `b` whose digest tree `a` does not have.

    Sections that `a` has are passed over with all their paragraphs.
    """
    numbers = _with(
        _index(a["sections"]),
        lambda known: F.filter(
            F.sequence(F.lit(1), F.size(b["sections"])),
            lambda k: ~_holds(known, F.element_at(b["sections"], k)),
        ),
    )
    below = F.flatten(
        F.transform(
            numbers,
            lambda k: F.sequence(
                F.when(k > 1, F.element_at(b["ends"], F.greatest(k - 1, F.lit(1)))).otherwise(0) + 1,
                F.element_at(b["ends"], k),
            ),
        )
    )
    found = _with(
        _index(a["paragraphs"]),
        lambda known: F.transform(
            F.filter(below, lambda i: ~_holds(known, F.element_at(b["paragraphs"], i))),
            lambda i: i - 1,
        ),
    )
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(found)


def _order(docs: DataFrame) -> DataFrame:
    """(follower, version, reader, need): whose first `need` characters go to whose text.

    Ids are range-partitioned and sorted; the result is written, so partitions keep
    their numbers. Only one row per partition crosses partitions in a single task.
    """
    keys = docs.groupBy("doc_id").agg(
        F.min("version").alias("version"), F.max("n_chars").alias("n")
    )
    placed = cut(
        keys.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .select("doc_id", "version", "n", F.spark_partition_id().alias("part")),
        "order",
    )
    here = F.struct(F.col("doc_id").alias("key"), F.col("n").alias("n"))
    lasts = placed.groupBy("part").agg(F.max(here).alias("last"))
    by_part = Window.orderBy("part")
    before = F.lag("last").over(by_part)
    # The first document follows the last one.
    around = F.last("last").over(
        by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    lasts = lasts.select(F.col("part").alias("_part"), F.coalesce(before, around).alias("edge"))
    inside = F.lag(here).over(Window.partitionBy("part").orderBy("doc_id"))
    return (
        placed.withColumn("inside", inside)
        .join(lasts, F.col("part") == F.col("_part"))
        .select(
            F.col("doc_id").alias("follower"), "version", F.coalesce("inside", "edge").alias("reader")
        )
        .select(
            "follower", "version", F.col("reader.key").alias("reader"),
            F.floor(F.col("reader.n") / 4).cast("int").alias("need"),
        )
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as
    many (or all) of the next document's, by ascending doc_id, after the last the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and changed (numbers of the edited text's paragraphs that the text lacks).

    A null text is empty. A null doc_id comes before all others. Rows that repeat a
    doc_id have the same next document, and where a doc_id has several texts, the one
    with the lowest hash is the next one of its predecessor. The only document is its own
    next. Other columns are ignored; an empty table gives an empty table.
    """
    # One non-null key, in which a null id is the lowest, which no id may be.
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = _order(
        texts.select(
            "doc_id", F.xxhash64("text").alias("version"), F.length("text").cast("long").alias("n_chars")
        )
    )
    # Texts move once: both joins below read the same exchange of (doc_id, text), and
    # only beginnings and digests of the followers move again.
    followers = (
        texts.join(order, F.col("doc_id") == F.col("follower"))
        # Not an equality of two columns, which would become a second join key.
        .where(F.xxhash64("text").bitwiseXOR(F.col("version")) == 0)
        .withColumn("_tree", tree(F.col("text")))
        .select(
            "reader",
            F.substring("text", F.lit(1), F.col("need")).alias("_beginning"),
            F.col("_tree.leaves").alias("_next_leaves"),
            F.col("_tree.root").alias("_next_root"),
        )
        .dropDuplicates(["reader"])
    )
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - tail),
        F.substring(F.col("_beginning"), F.lit(1), tail),
    )
    joined = (
        texts.join(followers, F.col("doc_id") == F.col("reader"))
        .withColumn("_edited", edited)
        .withColumn("_trees", F.transform(F.array("text", "_edited"), tree))
    )
    own, other = F.col("_trees")[0], F.col("_trees")[1]
    near_next = F.when(own["root"] == F.col("_next_root"), 1.0).otherwise(
        likeness(own["leaves"], F.col("_next_leaves"))
    )
    return joined.select(
        F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(other).alias("edited_fingerprint"),
        tree_likeness(own, other).alias("near_edited"),
        near_next.alias("near_next"),
        changed_paragraphs(own, other).alias("changed"),
    )
