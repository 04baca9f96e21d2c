"""Removal of repeated byte strings with two-stage suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document of a smaller id. Equal
strings have the same least k-gram hash (their minimiser), so minimisers deal all strings to buckets without
sending any string twice: consecutive strings of one minimiser travel as one segment of text.

1. Documents are written as units of a few megabytes, compressed, with an id each.
2. Each unit sends its distinct minimisers, 4 bytes each, to the buckets of the hash space; a bucket answers
   each unit which of them other documents hold too. Text that nothing repeats is out of the game here.
3. Each unit sends the segments of the others, equal ones once with their smallest document, to the buckets.
   A bucket sorts the suffixes of its distinct segments in two stages: those smaller than their successors are
   sorted directly, the rest are induced by scanning the first-byte buckets in order. Adjacent common prefixes
   of at least ``length`` bytes chain equal strings together; the least document of a chain answers for all.
4. Units mark the answered strings, and give each document's digest.

Copies collapse in each unit before they are sent and in each bucket before they are sorted, so a document or
passage that a third of the corpus holds costs one segment a unit. The number of buckets grows with the input. A
bucket to which more than ``CROWD`` units send something (the one of a string that stands everywhere) has a level
below it: its units are dealt to parts, each part merges what is equal, the bucket judges the merged parts, and the
parts answer their units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .common import as_bytes, chunks, mix, powers, prefix_hash, span_hash

KGRAM = 20
UNIT = 2 << 20
BUCKET_BYTES = 1 << 20
"""Bytes of corpus text for each bucket."""
CROWD = 1 << 20
"""Units whose entries a bucket takes at once."""
_BLOCK = 1 << 19
_SENT = 1 << 20
"""Bytes of segments in one batch, and at most one entry more."""
_RUN = 200
"""Strings in a segment at most; a longer run of one minimiser (a period) makes several segments."""
SEPARATOR = 0xFF
"""No byte of UTF-8."""


def suffix_order(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``t`` (bytes, ending in the separator) in the order of their first ``depth`` bytes, and 8-byte words.

    Two-stage sorting: suffixes smaller than their successors directly, the others by induction.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    padded = np.r_[t, np.zeros(depth + 16, np.uint8)]
    word = np.zeros(n + depth + 8, np.uint64)
    for j in range(8):
        word |= padded[j : j + len(word)].astype(np.uint64) << np.uint64(56 - 8 * j)
    # A suffix is the smaller if the next unequal byte is the greater.
    change = np.flatnonzero(t[:-1] != t[1:])
    smaller = np.zeros(n, bool)
    if len(change):
        at = np.searchsorted(change, np.arange(n - 1))
        inside = at < len(change)
        c = change[np.minimum(at, len(change) - 1)]
        smaller[:-1] = inside & (t[c] < t[c + 1])
    direct = np.flatnonzero(smaller)
    w = word[direct]
    order = np.argsort(w, kind="stable")
    direct = direct[order]
    new = np.r_[True, w[order][1:] != w[order][:-1]] if len(direct) else np.zeros(0, bool)
    for d in range(8, depth, 8):
        tied = ~new | np.r_[~new[1:], False] if len(new) else new
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(new)[where]
        w = word[direct[where] + d]
        o = np.lexsort((w, group))
        direct[where] = direct[where][o]
        w, g = w[o], group[o]
        new[where] |= np.r_[True, (w[1:] != w[:-1]) | (g[1:] != g[:-1])]
    size = np.bincount(t, minlength=256)
    begin = np.cumsum(size) - size
    held = np.bincount(t[direct], minlength=256)
    split = begin + size - held
    order_all = np.empty(n, np.int64)
    o = np.argsort(t[direct], kind="stable")
    at = np.cumsum(held) - held
    for c in np.flatnonzero(held):
        order_all[split[c] : split[c] + held[c]] = direct[o[at[c] : at[c] + held[c]]]
    front = begin.copy()
    order_all[front[t[-1]]] = n - 1
    front[t[-1]] += 1

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return
        byte = t[before]
        o = np.argsort(byte, kind="stable")
        count = np.bincount(byte, minlength=256)
        at = 0
        for c in np.flatnonzero(count):
            order_all[front[c] : front[c] + count[c]] = before[o[at : at + count[c]]]
            front[c] += count[c]
            at += count[c]

    for c in range(256):
        lo = begin[c]
        while lo < front[c]:
            part = order_all[lo : front[c]]
            lo = front[c]
            induce(part)
        if held[c]:
            induce(order_all[split[c] : split[c] + held[c]])
    return order_all, word


def adjacent_prefixes(order: np.ndarray, word: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in order has its first ``length`` bytes in common with the one before it."""
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        at = np.arange(1, len(order))
        for d in [*range(0, length - 7, 8), length - 8]:
            at = at[word[order[at] + d] == word[order[at - 1] + d]]
        same[at] = True
    return same


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, number of strings and minimiser of each segment."""
    wide = length - KGRAM + 1
    starts, counts, values = [], [], []
    for lo in range(0, len(data) - length + 1, _BLOCK):
        part = data[lo : lo + _BLOCK + length - 1]
        prefix = prefix_hash(part)
        _, down = powers(len(prefix))
        with np.errstate(over="ignore"):
            h = mix((prefix[KGRAM:] - prefix[:-KGRAM]) * down[: len(part) - KGRAM + 1])
        span = 1
        while 2 * span <= wide:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < wide:
            h = np.minimum(h[: len(h) - (wide - span)], h[wide - span :])
        begin = np.arange(lo, lo + len(h))
        ends = offsets[np.searchsorted(offsets, begin, "right")]
        good = begin + length <= ends
        edge = good & ~np.r_[False, good[:-1] & (h[1:] == h[:-1])]
        first = np.flatnonzero(edge)
        if not len(first):
            continue
        stop = np.flatnonzero(good & ~np.r_[good[1:] & (h[1:] == h[:-1]), False]) + 1
        n = stop - first
        if n.max() > _RUN:
            pieces = (n - 1) // _RUN + 1
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, n = np.repeat(first, pieces) + nth * _RUN, np.minimum(np.repeat(n, pieces) - nth * _RUN, _RUN)
        starts.append(first + lo), counts.append(n), values.append(mix(h[first]))  # minima are small; mixed, they spread evenly
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(values)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, end to end."""
    return data[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]


def hashes_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the spans (by start), a block of ``data`` at a time."""
    out = np.empty(len(start), np.uint64)
    edge = np.searchsorted(start, np.arange(0, len(data) + _BLOCK, _BLOCK))
    for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
        if a < b:
            lo = k * _BLOCK
            prefix = prefix_hash(data[lo : int((start[a:b] + size[a:b]).max())])
            out[a:b] = span_hash(prefix, start[a:b] - lo, start[a:b] - lo + size[a:b])
    return out


def sorted_answer(text: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For every string of the segments ``text`` (end to end, sizes ``size``), whether a smaller document holds it."""
    prefix_at, index, inverse, least = _distinct_segments(size, doc, text)
    one = size[index]
    begin = np.cumsum(one + 1) - (one + 1)
    t = np.full(int((one + 1).sum()), SEPARATOR, np.uint8)
    t[np.arange(one.sum()) + np.repeat(np.arange(len(one)), one)] = gather(text, prefix_at[index], one)
    order, word = suffix_order(t, length)
    segment = np.repeat(np.arange(len(one)), one + 1)
    is_start = np.arange(len(t)) + length <= (begin + one)[segment]
    order = order[is_start[order]]
    chain = np.cumsum(~adjacent_prefixes(order, word, length)) - 1
    best = np.full(int(chain[-1]) + 1 if len(chain) else 0, np.iinfo(np.int64).max)
    np.minimum.at(best, chain, least[segment[order]])
    answer = np.empty(len(t), np.int64)
    answer[order] = best[chain]
    strings = size - length + 1
    nth = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    return answer[np.repeat(begin[inverse], strings) + nth] < np.repeat(doc, strings)


def _values_in(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of entries of minimisers: the size of each entry, the distinct values, where each value of each entry is among them, and which two documents hold."""
    vals = [np.frombuffer(v, "<u4") for v in table.column("vals").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(v)).astype(bool) for f, v in zip(table.column("flags").to_pylist(), vals)]
    distinct, inverse, count = np.unique(np.concatenate(vals), return_inverse=True, return_counts=True)
    many = count > 1
    many[inverse[np.concatenate(flags)]] = True
    return [len(v) for v in vals], distinct, inverse, many


def judge_values(table: pa.Table) -> pa.Table:
    """For the entries of one bucket, which of their minimisers two documents hold; entries of none are left out."""
    count, _, inverse, many = _values_in(table)
    return _answers(table, count, many[inverse], always=False)


def merge_values(table: pa.Table) -> pa.Table:
    """The entries of one part as one entry."""
    _, distinct, _, many = _values_in(table)
    return pa.table({"bucket": table.column("bucket")[:1], "unit": table.column("part")[:1], "vals": pa.array([distinct.tobytes()], pa.binary()), "flags": pa.array([np.packbits(many).tobytes()], pa.binary())})


def spread_values(table: pa.Table, judged: pa.Table) -> pa.Table:
    """The bucket's answer to a part, as answers to the part's units."""
    if not judged.num_rows or not table.num_rows:
        return _answers(table.slice(0, 0), [], np.zeros(0, bool), always=False)
    count, distinct, inverse, _ = _values_in(table)
    bits = np.unpackbits(np.frombuffer(judged.column("bits")[0].as_py(), np.uint8), count=len(distinct)).astype(bool)
    return _answers(table, count, bits[inverse], always=False)


def _answers(table: pa.Table, count: list[int], bits: np.ndarray, always: bool) -> pa.Table:
    """unit, bucket and the bits of each entry, where any is set or ``always``."""
    at, kept, out = 0, [], []
    for i, n in enumerate(count):
        if always or bits[at : at + n].any():
            kept.append(i), out.append(np.packbits(bits[at : at + n]).tobytes())
        at += n
    kept = pa.array(kept, pa.int64())
    return pa.table({"unit": table.column("unit").take(kept), "bucket": table.column("bucket").take(kept), "bits": pa.array(out, pa.binary())})


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers of all entries, end to end."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _segments_in(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries of segments: the number of segments of each entry, and the sizes, the documents and the text of all."""
    each = pa.compute.binary_length(table.column("sizes")).to_numpy() // 2
    return each, _joined(table.column("sizes"), "<u2").astype(np.int64), _joined(table.column("docs"), "<i8"), _joined(table.column("text"), np.uint8)


def _strings_of(each: np.ndarray, sizes: np.ndarray, length: int) -> list[int]:
    """The number of strings of each entry; none is without a segment."""
    return np.add.reduceat(sizes - length + 1, np.cumsum(each) - each).tolist()


def _binaries(data: np.ndarray, edge: np.ndarray) -> pa.Array:
    """The parts of ``data`` between the edges (of items)."""
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _segment_entries(bucket: np.ndarray, unit: int, edge: np.ndarray, sizes: np.ndarray, docs: np.ndarray, text: np.ndarray) -> dict:
    """Entries of ``bucket``, each of the segments between two edges. They are built all at once: a unit sends some to every bucket, so there are as many as units times buckets."""
    at = np.r_[0, np.cumsum(sizes)]
    return {"bucket": pa.array(bucket, pa.int32()), "unit": pa.array(np.full(len(bucket), unit)), "sizes": _binaries(sizes.astype("<u2"), edge), "docs": _binaries(docs.astype("<i8"), edge), "text": _binaries(text, at[edge])}


def _distinct_segments(sizes: np.ndarray, doc: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start of each segment, a representative of each distinct one, the number of each segment among them, and their least documents."""
    start = np.cumsum(sizes) - sizes
    _, index, inverse = np.unique(hashes_of(text, start, sizes), return_index=True, return_inverse=True)
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, doc)
    return start, index, inverse, least


def merge_segments(table: pa.Table) -> pa.Table:
    """The entries of one part as one entry: equal segments once, with their least document."""
    _, sizes, doc, text = _segments_in(table)
    start, index, _, least = _distinct_segments(sizes, doc, text)
    return pa.table(_segment_entries(table.column("bucket")[:1].to_numpy(), table.column("part")[0].as_py(), np.array([0, len(index)]), sizes[index], least, gather(text, start[index], sizes[index])))


def spread_segments(table: pa.Table, judged: pa.Table, length: int) -> pa.Table:
    """The bucket's answer to a part, as answers to the part's units: a string goes too where its segment stands in a smaller document of the part."""
    each, sizes, doc, text = _segments_in(table)
    _, index, inverse, least = _distinct_segments(sizes, doc, text)
    strings = sizes - length + 1
    begin = np.cumsum(strings[index]) - strings[index]
    bits = np.unpackbits(np.frombuffer(judged.column("bits")[0].as_py(), np.uint8), count=int(strings[index].sum())).astype(bool)
    nth = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    gone = bits[np.repeat(begin[inverse], strings) + nth] | np.repeat(doc > least[inverse], strings)
    return _answers(table, _strings_of(each, sizes, length), gone, always=True)


class Unit:
    """A unit's documents, its segments and its distinct minimisers."""

    def __init__(self, row: dict, length: int):
        self.ids = np.array([-1 if i is None else i for i in row["ids"]], np.int64)
        self.known = np.array([i is not None for i in row["ids"]], bool)
        size = np.array(row["sizes"], np.int64)
        self.offsets = np.r_[0, np.cumsum(size)]
        raw = pa.decompress(row["data"], decompressed_size=int(size.sum()), codec="zstd", asbytes=True) if size.sum() else b""
        self.data, self.length = np.frombuffer(raw, np.uint8), length
        self.start, self.count, value = segments(self.data, self.offsets, length)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        known = self.known[self.doc]
        self.start, self.count, self.doc, value = self.start[known], self.count[known], self.doc[known], value[known]
        self.values, self.of = np.unique(value, return_inverse=True)

    def buckets(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each distinct minimiser, and where each bucket begins among them."""
        b = (self.values >> np.uint64(64 - bits)).astype(np.int64)
        return b, np.searchsorted(b, np.arange((1 << bits) + 1))

    def shared(self) -> np.ndarray:
        """Distinct minimisers of two documents of this unit."""
        low, high = np.full(len(self.values), np.iinfo(np.int64).max), np.full(len(self.values), np.iinfo(np.int64).min)
        ids = self.ids[self.doc]
        np.minimum.at(low, self.of, ids), np.maximum.at(high, self.of, ids)
        return low < high

    def repeated(self, answers: list[dict], bits: int) -> tuple[np.ndarray, ...]:
        """The distinct repeated segments: bucket, representative, least document; and all repeated ones with their number among them."""
        _, edge = self.buckets(bits)
        mark = np.zeros(len(self.values), bool)
        for a in answers:
            lo, hi = edge[a["bucket"]], edge[a["bucket"] + 1]
            mark[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo).astype(bool)
        mine = np.flatnonzero(mark[self.of])
        bucket = (self.values[self.of[mine]] >> np.uint64(64 - bits)).astype(np.int64)
        size = self.count[mine] + self.length - 1
        key = hashes_of(self.data, self.start[mine], size)
        order = np.lexsort((key, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.ids[self.doc[mine]])
        return bucket[order][new], mine[order][new], least, mine, number


def _units(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in chunks(whole, "text", size):
                data, offsets = as_bytes(batch.column("text"))
                held = pa.compress(np.ascontiguousarray(data), codec="zstd", asbytes=True) if len(data) else b""
                yield pa.RecordBatch.from_pydict({"unit": pa.array([n]), "ids": pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([np.diff(offsets)], pa.list_(pa.int64())), "data": pa.array([held], pa.binary())})
                n += 1

    return narrow.mapInArrow(cut, "unit long, ids array<long>, sizes array<long>, data binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, unit: int = UNIT, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes, if asked for).

    Null and empty texts, and those shorter than ``length`` bytes, lose nothing. Rows with a null id neither
    lose bytes nor cause others to. Rows that repeat an id are one document: neither is smaller. An empty table
    gives no rows; other columns are not read. Ids must be whole numbers. Memory is that of a unit of ``unit`` bytes or a bucket,
    whose equal entries are merged ``crowd`` units at a time; a text longer than a unit is
    a unit of its own, hashed in blocks. ``length`` must be at least 28.
    """
    spark = docs.sparkSession
    if length < KGRAM + 8:
        raise ValueError(f"length must be at least {KGRAM + 8}")
    units = materialise(_units(docs, id_col, text_col, unit))
    total, n_units = units.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.count("*")).first()
    bits = min(24, max(3, int(np.ceil(np.log2(max(1, total / BUCKET_BYTES))))))

    def send_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            u = Unit(row, length)
            b, edge = u.buckets(bits)
            low = ((u.values << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            shared = u.shared()
            used = np.flatnonzero(np.diff(edge))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(used, pa.int32()), "unit": pa.array(np.full(len(used), row["unit"])),
                "vals": pa.array([low[edge[k] : edge[k + 1]].tobytes() for k in used], pa.binary()),
                "flags": pa.array([np.packbits(shared[edge[k] : edge[k + 1]]).tobytes() for k in used], pa.binary()),
            })

    def by_bucket(entries: DataFrame, judge, merge, spread) -> DataFrame:
        """The answers to all entries; a unit sends a bucket one, so none is crowded where units are fewer."""
        answer = "unit long, bucket int, bits binary"
        if n_units <= crowd:
            return entries.groupBy("bucket").applyInArrow(judge, answer)
        entries = materialise(entries)
        crowded = F.broadcast(materialise(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("bucket")))  # of 2^24 buckets
        plain = entries.join(crowded, "bucket", "left_anti").groupBy("bucket").applyInArrow(judge, answer)
        parts = entries.join(crowded, "bucket", "left_semi").withColumn("part", F.pmod(F.xxhash64("unit"), F.lit((n_units - 1) // crowd + 1)))
        merged = parts.groupBy("bucket", "part").applyInArrow(merge, entries.schema)
        judged = materialise(merged.groupBy("bucket").applyInArrow(judge, answer).withColumnRenamed("unit", "part"))
        return plain.unionByName(parts.groupBy("bucket", "part").cogroup(judged.groupBy("bucket", "part")).applyInArrow(spread, answer))

    values = units.mapInArrow(send_values, "bucket int, unit long, vals binary, flags binary")
    judged = by_bucket(values, judge_values, merge_values, spread_values)
    answers = materialise(judged.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers")))

    def send_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            u = Unit(row, length)
            bucket, first, least, _, _ = u.repeated(row["answers"], bits)
            size = u.count[first] + length - 1
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
            batch = (np.cumsum(size) // _SENT)[edge[1:] - 1]  # of each entry
            cut = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1], True]) if len(batch) else np.zeros(1, int)
            for a, b in zip(cut[:-1], cut[1:]):
                lo, hi = edge[a], edge[b]
                pack = gather(u.data, u.start[first[lo:hi]], size[lo:hi])
                yield pa.RecordBatch.from_pydict(_segment_entries(bucket[edge[a:b]], row["unit"], edge[a : b + 1] - lo, size[lo:hi], least[lo:hi], pack))

    def judge_segments(table: pa.Table) -> pa.Table:
        each, sizes, doc, text = _segments_in(table)
        return _answers(table, _strings_of(each, sizes, length), sorted_answer(text, sizes, doc, length), always=True)

    repeated = units.join(answers, "unit").mapInArrow(send_segments, "bucket int, unit long, sizes binary, docs binary, text binary")
    found = by_bucket(repeated, judge_segments, merge_segments, lambda table, judged: spread_segments(table, judged, length))
    marks = materialise(found.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("marks")).join(answers, "unit"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if row["marks"]:
                u = Unit(row, length)
                ids, data, offsets = row["ids"], u.data, u.offsets
                bucket, first, least, mine, number = u.repeated(row["answers"], bits)
                strings = u.count[first]
                flags, lo = [], 0
                for m in row["marks"]:
                    hi = int(np.searchsorted(bucket, m["bucket"], "right"))
                    flags.append(np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=int(strings[lo:hi].sum())).astype(bool))
                    lo = hi
                flags = np.concatenate(flags)
                begin = np.cumsum(strings) - strings
                n = u.count[mine]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                later = np.repeat(u.ids[u.doc[mine]] > least[number], n)
                hit = (np.repeat(u.start[mine], n) + nth)[later | flags[np.repeat(begin[number], n) + nth]]
                cover = np.bincount(hit, minlength=len(data) + 1).astype(np.int32) - np.bincount(hit + length, minlength=len(data) + 1).astype(np.int32)
                keep = np.cumsum(cover)[: len(data)] == 0
            else:
                ids, size = row["ids"], np.array(row["sizes"], np.int64)
                offsets = np.r_[0, np.cumsum(size)]
                raw = pa.decompress(row["data"], decompressed_size=int(size.sum()), codec="zstd", asbytes=True) if size.sum() else b""
                data = np.frombuffer(raw, np.uint8)
                keep = np.ones(len(data), bool)
            removed, spans, sha, kept = [], [], [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                k = keep[a:b]
                rest = data[a:b][k].tobytes() if not k.all() else data[a:b].tobytes()
                removed.append(int(b - a - len(rest)))
                spans.append(int((~k & np.r_[True, k[:-1]]).sum()) if removed[-1] else 0)
                sha.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest)
            out = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return units.join(marks, "unit", "left").mapInArrow(finish, schema).withColumnRenamed("doc_id", id_col)
