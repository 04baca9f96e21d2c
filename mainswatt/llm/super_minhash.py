"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is the set of its shingles. Each element deals the ranks 0, 1, 2, ... to the slots of the signature in
the order of its own random permutation, with a random fraction added; a slot keeps the least. Ranks of one
element are spread over different slots, so slots are correlated and the estimate's variance is lower than with
independent hashes. Rank j is only dealt while some slot of the document is empty: what rank j would bring is larger
than anything dealt before, so a document of many elements stops after a few ranks.

Sets that agree on a band of slots are candidates. Crowded bands (a passage that many share) are split by further
slots, several times over; those that stay crowded hold sets near each other and are joined in a star. Candidate
groups are verified on full sets: first inside blocks of bounded bytes, then between the blocks' leaders, which joins
dense groups at once, and only groups that are still apart are compared block against block. No pair is written
but a spanning forest of those linked; in a task a union-find keeps it, between tasks alternating stars do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import few_files, join_split, materialise
from .common import _BASE, as_bytes, chunks, mix, prefix_hash, signed, span_hash, windows, words
from .components import components
from .near_dup import _marked, least_share, near_leaves, near_sets
from .periodic import SPACE

SLOTS = 128
ROWS = 5
"""Slots of a band: 25 bands; a pair at 0.85 misses all with probability 4e-7."""
BUCKET = 2048
SPLITS = 8
"""Times that a crowded band is split, each by three further slots; a pair at 0.85 is parted in all with probability 5e-4, in all its bands hardly ever."""
BLOCK_BYTES = 16 << 20
_EMPTY = np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets_of(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by row, sorted, and the row of each. Only A-Z change case; fewer words are one shingle."""
    data, offsets = as_bytes(column)
    data = _LOWER[data]
    s, e, row = words(data, offsets, SPACE)
    value, at = windows(span_hash(prefix_hash(data), s, e), row, shingle)
    row = row[at]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
    return value[new], row[new]


def signatures(value: np.ndarray, row: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have elements, and their SuperMinHash signatures: in each slot rank and fraction, 24 bits of the latter."""
    have, doc = np.unique(row, return_inverse=True)
    out = np.full((len(have), slots), _EMPTY, np.uint32)
    flat = out.ravel()
    turn = None  # each element's permutation so far
    with np.errstate(over="ignore"):
        for j in range(slots):
            x = mix(value + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
            pick = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
            if turn is None:
                slot = pick
            else:
                each = np.arange(len(value))
                slot = turn[each, pick].astype(np.int64)
                turn[each, pick] = turn[:, j]
            np.minimum.at(flat, doc * slots + slot, (x >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24))
            open_docs = (out == _EMPTY).any(axis=1)
            if not open_docs.any():
                break
            go = open_docs[doc]
            if turn is None:
                value, doc, pick = value[go], doc[go], pick[go]
                turn = np.repeat(np.arange(slots, dtype=np.uint8)[None], len(value), axis=0)
                turn[np.arange(len(value)), pick] = 0  # place 0 and the pick have changed places
            elif np.count_nonzero(go) < 0.7 * len(go):
                value, doc, turn = value[go], doc[go], turn[go]
    return have, out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each signature."""
    count = signature.shape[1] // rows
    out = np.empty((len(signature), count), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(count):
            h = np.full(len(signature), b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                h = mix(h * np.uint64(_BASE) + signature[:, k].astype(np.uint64))
            out[:, b] = h
    return out


def _set_key(value: np.ndarray, row: np.ndarray, have: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    first = np.searchsorted(row, have)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(value), first) + np.diff(np.r_[first, len(row)]).astype(np.uint64)) if len(have) else np.zeros(0, np.uint64)


def candidates(reps: DataFrame, threshold: float, recall: float, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that hold together all sets of ``reps`` (doc, bands, sketch) that are likely near each other."""
    guess = least_share(threshold, recall)

    def compared(rows: DataFrame) -> DataFrame:
        rows = materialise(rows)
        dealt = rows.join(reps.select("doc", "sketch"), "doc").withColumn("task", F.pmod(F.xxhash64("path"), F.lit(rows.count() // 4096 + 1)))
        return dealt.groupBy("task").applyInArrow(lambda t: near_leaves(t, guess), "a long, b long")

    def shared(rows: DataFrame) -> DataFrame:
        """doc, path, n, least of the rows whose bucket holds n > 1 documents, ``least`` the smallest."""
        sizes = materialise(few_files(rows.groupBy("path").agg(F.count("*").alias("n"), F.min("doc").alias("least")).filter("n > 1")))
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return materialise(few_files(join_split(rows, sizes, "path", sizes.select("path", "n"), total)))

    met = shared(reps.select("doc", F.explode("bands").alias("path")))
    few, many = met.filter(F.col("n") <= bucket).select("doc", "path"), met.filter(F.col("n") > bucket)
    if many.isEmpty():
        return compared(few)
    further = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SPLITS - 1)), lambda t: F.xxhash64("path", t, F.substring("sketch", t * (SLOTS // SPLITS) + 1, F.lit(3)))))
    again = shared(materialise(many.select("doc", "path").join(reps.select("doc", "sketch"), "doc").select("doc", further.alias("path"))))
    stars = again.filter((F.col("n") > bucket) & (F.col("doc") != F.col("least"))).select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct()
    return compared(few.unionByName(again.filter(F.col("n") <= bucket).select("doc", "path"))).unionByName(stars)


def verified(sets: DataFrame, threshold: float, bucket: int = BUCKET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b: a spanning forest of the pairs at ``threshold`` or more, exactly, within the groups of ``sets`` (doc, root, n, held).

    A group is dealt to blocks of about ``bucket`` sets and ``block_bytes`` of hashes at most, its sets by a hash.
    """
    kernel = lambda t: near_sets(t, threshold)
    shape = "a long, b long, links long"
    parts = F.greatest(F.ceil(F.col("m") / bucket), F.ceil(F.col("all") * 8 / block_bytes)).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        by = materialise(rows.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("all")))
        total = by.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        out = join_split(rows, by.select("root", parts.alias("blocks")), "root", by.select("root", F.col("m").alias("n")), total)
        return out.withColumn("block", F.pmod(F.xxhash64("doc", F.lit("block")), F.col("blocks")).cast("int"))

    def crossed(rows: DataFrame) -> DataFrame:
        every = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return every.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def links(rows: DataFrame) -> DataFrame:
        tasks = rows.select("root", "lo", "hi", "block", "doc", "held").groupBy("root", "lo", "hi")
        return materialise(few_files(tasks.applyInArrow(kernel, shape).filter("b is not null").select("a", "b")))

    placed = dealt(sets)
    inside = links(placed.withColumns({"lo": F.col("block"), "hi": F.col("block")}))
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return inside

    def apart(forest: DataFrame) -> DataFrame:
        """doc, root and label of the large groups that ``forest`` leaves in more than one part."""
        of = components(forest)
        rows = large.select("doc", "root").join(of.select(F.col("node").alias("doc"), F.col("root").alias("label")), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        several = rows.groupBy("root").agg((F.min("label") < F.max("label")).alias("more")).filter("more").select("root")
        return materialise(rows.join(several, "root", "left_semi"))

    rest = apart(inside)
    leaders = rest.groupBy("root", "label").agg(F.min("doc").alias("doc")).select("doc", "root")
    between = links(crossed(dealt(sets.join(leaders.select("doc"), "doc", "left_semi"))))
    rest = apart(inside.unionByName(between))
    if rest.isEmpty():
        return inside.unionByName(between)
    open_sets = large.join(rest.select("doc"), "doc", "left_semi")
    return inside.unionByName(between).unionByName(links(crossed(open_sets).filter("lo < hi")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.9999, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept.

    Documents whose sets of ``shingle``-word shingles (A-Z in lower case; words are what blanks and tabs to carriage returns
    separate) have Jaccard similarity ``threshold`` or more are linked; ``component_id`` is the smallest id that
    links reach, ``kept`` whether it is the document's own. Fewer words are one shingle; null, empty and blank texts have none and
    are linked with nothing. Rows that repeat an id are one document with the links of all its texts, each row with
    its own ``n_shingles``; rows without an id are linked with nothing and have a null ``component_id`` and ``kept``.
    Equal sets count as one. Texts of any length are one set. No documents give no rows; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                value, row = sets_of(batch.column("text"), shingle)
                have, signature = signatures(value, row)
                count = np.bincount(row, minlength=batch.num_rows)
                key, bands = np.zeros(batch.num_rows, np.uint64), band_keys(signature)
                key[have] = _set_key(value, row, have)
                sketch = (signature & np.uint32(0xFF)).astype(np.uint8)
                where = np.full(batch.num_rows, -1)
                where[have] = np.arange(len(have))
                length = np.where(where >= 0, bands.shape[1], 0)
                edges = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column("doc"), "n": pa.array(count), "key": pa.array(signed(key), mask=where < 0),
                    "bands": pa.ListArray.from_arrays(edges, pa.array(signed(bands.ravel()))), "sketch": pa.array([sketch[k].tobytes() if k >= 0 else None for k in where.tolist()], pa.binary()),
                })

    signs = materialise(rows.mapInArrow(sign, "doc long, n long, key long, bands array<long>, sketch binary"))
    known = signs.filter("doc is not null and key is not null")
    sets = materialise(known.groupBy("key").agg(F.min("doc").alias("rep")))
    reps = materialise(known.join(sets.select(F.col("rep").alias("doc"), "key"), ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"]).select("doc", "key", "bands", "sketch"))
    # An id with several texts links their sets; as nodes are sets, it is the smallest document of each.
    several = known.groupBy("doc").agg((F.min("key") < F.max("key")).alias("more")).filter("more").select("doc")
    own = known.select("doc", "key").join(several, "doc", "left_semi").distinct().join(sets, "key").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    groups = materialise(components(candidates(reps.select("doc", "bands", "sketch"), threshold, recall, bucket)))
    placed = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("doc"), "root")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                value, row = sets_of(batch.column("text"), shingle)
                edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
                held = [value[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "root": batch.column("root"), "n": pa.array(np.diff(edge).astype(np.int64)), "held": pa.array(held, pa.binary())})

    # Texts outside of groups stay out of the shuffle by a bitmap of bounded size; of equal rows one is made a set.
    chosen = _marked(rows.filter("doc is not null"), placed).join(placed, "doc").dropDuplicates(["doc", "text"])
    full = materialise(chosen.mapInArrow(hold, "doc long, root long, n long, held binary"))
    linked = verified(full, threshold, bucket).unionByName(own)
    classes = components(linked).select(F.col("node").alias("rep"), "root")
    of_set = sets.join(classes, "rep", "left").select("key", F.coalesce("root", "rep").alias("component"))
    out = signs.select("doc", "n", "key").join(of_set, "key", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), component).alias("component_id"), (F.col("doc") == component).alias("kept"))
