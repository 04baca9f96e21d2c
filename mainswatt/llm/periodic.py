"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a maximal stretch of words that repeats with a smallest period q, at least twice. Its squares (stretches
of 2 q words with period q) start at consecutive places, one for each rotation of the repeated unit. The method:

1. Lempel-Ziv blocks. The leftmost square of each kind begins or ends near a block border: for every border and every
   period the common extensions to either side tell the leftmost squares with that period (a leftmost-covering set).
2. Suffix tree, as suffix array with common prefixes. From the square at a place the walk along suffix links, leaf by
   leaf, goes through its rotations as long as the period holds; the ancestor of each leaf at depth 2 q is marked.
   All marks together are the vocabulary of squares. Squares of a unit that is itself a power are left out.
3. The leaves under a mark are all places of that square; consecutive places of one period merge into a run.

All texts of a batch form one string with separators, so a kind of square is marked once and located in every text. Words
that cannot be in a run are cut out first: every word of a run of ``least`` (12) words or more is covered by
stretches of ``least`` / 2 words that occur twice in it, so what repeated stretches do not cover is a border of pieces, again
and again until nothing changes; no run is lost. Steps work on whole arrays, but for the blocks, which follow one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, as_bytes, chunks, mix, prefix_hash, span_hash, windows, words

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LEAST = 12


class Names:
    """Names of all stretches of 2**l letters, for each l up to the longest repeat: equal where the letters are.

    Built by doubling, they sort the suffixes, and give the common extension of any two places.
    """

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.names, size = [rank.astype(np.int32)], 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(n - size, 0)] = rank[size:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.r_[False, key[order[1:]] != key[order[:-1]]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if int(rank[order[-1]]) == n - 1:
                self.order, self.rank = order, rank
                break
            self.names.append(rank.astype(np.int32))
            size *= 2
        common = np.zeros(n, np.int64)
        common[1:] = self.ahead(self.order[:-1], self.order[1:])
        self.common = common  # of each suffix in order with the one before

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and at ``b`` (unequal places, n is the empty one)."""
        a, out = a.astype(np.int64).copy(), np.zeros(len(a), np.int64)
        b = b.astype(np.int64).copy()
        for level in range(len(self.names) - 1, -1, -1):
            name, size = self.names[level], 1 << level
            ok = np.flatnonzero((a + size <= self.n) & (b + size <= self.n))
            ok = ok[name[a[ok]] == name[b[ok]]]
            a[ok] += size
            b[ok] += size
            out[ok] += size
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common suffix of the prefixes that end with the letters ``a`` and ``b`` (-1: empty)."""
        a, out = a.astype(np.int64).copy(), np.zeros(len(a), np.int64)
        b = b.astype(np.int64).copy()
        for level in range(len(self.names) - 1, -1, -1):
            name, size = self.names[level], 1 << level
            ok = np.flatnonzero((a >= size - 1) & (b >= size - 1))
            ok = ok[name[a[ok] - size + 1] == name[b[ok] - size + 1]]
            a[ok] -= size
            b[ok] -= size
            out[ok] += size
        return out

    def under(self, rank: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last suffix, in order, below each leaf's ancestor at ``depth`` (a weighted ancestor by range minima)."""
        least = [self.common]
        while 1 << len(least) <= self.n:
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        lo, hi = rank.astype(np.int64).copy(), rank.astype(np.int64).copy()
        for level in range(len(least) - 1, -1, -1):
            size, row = 1 << level, least[level]
            ok = np.flatnonzero(lo - size >= 0)
            ok = ok[row[lo[ok] - size + 1] >= depth[ok]]
            lo[ok] -= size
            ok = np.flatnonzero(hi + size < self.n)
            ok = ok[row[hi[ok] + 1] >= depth[ok]]
            hi[ok] += size
        return lo, hi


def blocks_of(text: Names) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks and the end: each is the longest stretch that also begins earlier, or one new letter."""
    n, order, common = text.n, text.order.tolist(), text.common.tolist()
    longest = [0] * n
    # Of the suffixes that begin earlier the nearest in order, on either side, is the best: one pass with a stack.
    stack: list[tuple[int, int]] = []
    for i in range(n + 1):
        at, shared = (order[i], common[i]) if i < n else (-1, 0)
        while stack and stack[-1][0] > at:
            place, left = stack.pop()
            if (better := left if left > shared else shared) > longest[place]:
                longest[place] = better
            if left < shared:
                shared = left
        if at >= 0:
            stack.append((at, shared))
    out, at = [0], 0
    while at < n:
        at += longest[at] or 1
        out.append(at)
    return np.array(out, np.int64)


def leftmost_squares(text: Names) -> tuple[np.ndarray, np.ndarray]:
    """start, period of squares that cover, with rotations to the right, the leftmost square of every kind."""
    border = blocks_of(text)
    h, h1 = border[:-1], border[1:]
    h2 = np.r_[border[2:], border[-1]]

    def each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = np.repeat(np.arange(len(count)), count)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count) + 1

    block, k = each(h1 - h)  # centre in the block, over its end
    e, q = h1[block], h1[block] - k
    k1, k2 = text.ahead(e, q), text.behind(e - 1, q - 1)
    start = np.maximum(q - k2, q - k + 1)
    ok = (k1 + k2 >= k) & (k1 > 0)
    found = [(start[ok], k[ok])]
    block, k = each(h2 - h)  # centre in the block, over its start
    b, q = h[block], h[block] + k
    k1, k2 = text.ahead(b, q), text.behind(b - 1, q - 1)
    start = np.maximum(b - k2, b - k + 1)
    ok = (k1 + k2 >= k) & (k1 > 0) & (k2 > 0) & (start + k <= h1[block])
    found.append((start[ok], k[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _primitive(text: Names, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the square's unit is no power: no period of a prime part of it."""
    out = np.ones(len(start), bool)
    rest, prime = period.copy(), 2
    while len(left := np.flatnonzero(rest > 1)):
        while prime * prime <= int(rest[left].max()) and not (rest[left] % prime == 0).any():
            prime += 1
        if prime * prime > int(rest[left].max()):  # what is left is prime
            part = rest[left]
            rest[left] = 1
        else:
            left = left[rest[left] % prime == 0]
            part = np.full(len(left), prime)
            while len(more := left[rest[left] % prime == 0]):
                rest[more] //= prime
        step = period[left] // part
        out[left] &= text.ahead(start[left], start[left] + step) < 2 * period[left] - step
    return out


def runs_in(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of all maximal runs of an integer array that repeat at least twice, by period, then start."""
    none = np.zeros(0, np.int64)
    if len(letters) < 2:
        return none, none, none
    text = Names(letters)
    start, period = leftmost_squares(text)
    pair = np.unique(start * (text.n + 1) + period)
    start, period = pair // (text.n + 1), pair % (text.n + 1)
    ok = _primitive(text, start, period)
    start, period = start[ok], period[ok]
    # Suffix-link walk: rotations at the following leaves while the period holds, each kind once.
    steps = np.minimum(text.ahead(start, start + period) - period + 1, period)
    at = np.repeat(start, steps) + np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
    pair = np.unique(at * (text.n + 1) + np.repeat(period, steps))
    at, period = pair // (text.n + 1), pair % (text.n + 1)
    lo, hi = text.under(text.rank[at], 2 * period)
    mark = np.unique(lo * (text.n + 1) + period, return_index=True)[1]
    lo, hi, period = lo[mark], hi[mark], period[mark]
    # All leaves below the marks, merged where they follow one another.
    many = hi - lo + 1
    place = text.order[np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
    pair = np.sort(np.repeat(period, many) * (text.n + 1) + place)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1] + 1]) if len(pair) else none
    last = np.r_[first[1:], len(pair)] - 1 if len(pair) else none
    start, period = pair[first] % (text.n + 1), pair[first] // (text.n + 1)
    return start, pair[last] - pair[first] + 2 * period, period


def pieces(hashes: np.ndarray, row: np.ndarray, least: int = LEAST) -> np.ndarray:
    """A piece number for each word, -1 for those in no run of ``least`` words or more; a run lies in one piece.

    A piece is a stretch, inside one row, that is covered by stretches of ``least`` / 2 words which occur twice in the piece.
    """
    size = least // 2
    value, at = windows(hashes, row, size, short=False)
    part = row.astype(np.int64)
    while True:
        if not len(at):
            return np.full(len(hashes), -1)
        with np.errstate(over="ignore"):
            key = mix(value ^ mix(part[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        kept = np.count_nonzero(again)
        value, at = value[again], at[again]
        edge = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        held = np.cumsum(edge[:-1]) > 0
        new = held & np.r_[True, ~held[:-1] | (part[1:] != part[:-1])]
        grown = np.where(held, np.cumsum(new) - 1, -1)
        if kept == len(again) and (grown == part).all():
            return part
        part = grown


def runs_of_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first word (of all), length and period of the runs of at least ``least`` words inside one row each."""
    piece = pieces(span_hash(prefix_hash(data), start, end), row, least)
    use = np.flatnonzero(piece >= 0)
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    # Pieces go together up to so many words; a longer one alone. Letters are numbered by their bytes.
    held = data.tobytes()
    cut = np.flatnonzero(np.r_[True, piece[use][1:] != piece[use][:-1], True]) if len(use) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(cut) - 1:
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + TOGETHER, "right")) - 1)
        mine = use[cut[lo] : cut[hi]]
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(held[a:b], len(number)) for a, b in zip(start[mine].tolist(), end[mine].tolist())], np.int64)
        borders = cut[lo:hi] - cut[lo]
        spread = np.arange(len(mine)) + np.searchsorted(borders, np.arange(len(mine)), "right")
        letters = np.empty(len(mine) + len(borders), np.int64)
        letters[borders + np.arange(len(borders))] = len(number) + np.arange(len(borders))
        letters[spread] = ids
        back = np.zeros(len(letters), np.int64)
        back[spread] = mine
        at, length, period = runs_in(letters)
        ok = length >= np.maximum(least, 2 * period)
        found.append((back[at[ok]], length[ok], period[ok]))
        lo = hi
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


TOGETHER = 1 << 16
"""Words of pieces that are searched as one string."""


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, runs (array of start, length, period by start, then period), collapsed.

    Words are what white space (blank, tab to carriage return) separates, numbered from 0; a run is a maximal stretch with a smallest
    period q of at least ``least`` and 2 q words. ``collapsed`` are the words outside of any run's repeats (its words
    after the first q), joined by one blank. Null and empty texts have no words, no runs and an empty ``collapsed``. Texts
    are searched whole. Repeated rows come back each, as do null ids; other columns are not read, whatever their names; no documents give no rows.
    ``least`` is even, 4 or more.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                data, offsets = as_bytes(batch.column("text"))
                s, e, row = words(data, offsets, SPACE)
                at, length, period = runs_of_rows(data, s, e, row, least)
                first = np.searchsorted(row, np.arange(batch.num_rows + 1))
                order = np.lexsort((period, at))
                at, length, period = at[order], length[order], period[order]
                edge = np.zeros(len(s) + 1, np.int32)
                np.add.at(edge, at + period, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                dropped = np.add.reduceat(np.r_[gone, False], first[:-1], dtype=np.int64) * (np.diff(first) > 0)
                held, kept = data.tobytes(), []
                for r, lost in enumerate(dropped.tolist()):
                    split = held[offsets[r] : offsets[r + 1]].split()
                    if lost:
                        split = [w for w, x in zip(split, gone[first[r] : first[r + 1]].tolist()) if not x]
                    kept.append(b" ".join(split))
                mine = row[at] if len(at) else np.zeros(0, np.int64)
                starts = at - first[mine]
                bounds = np.searchsorted(mine, np.arange(batch.num_rows + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (starts, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id"), "n_words": pa.array(np.diff(first).astype(np.int64)),
                    "runs": pa.ListArray.from_arrays(pa.array(bounds), runs), "collapsed": pa.array(kept, pa.binary()).cast(pa.string()),
                })

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text: in texts whose id's crc32 ends in 0, words from some place on are replaced by repeats of those at that place.

    With h the crc32 of the decimal id, g = h div 10 and n words, word i of a + p on becomes word a + (i - a) mod p, where a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8); the text is then its words joined by one blank. Other texts, and those without an id or a word, stay.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    split = F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("on"))
    rows = rows.withColumn("w", F.when(F.col("on"), split)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.try_mod(F.col("g"), F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    made = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return rows.select(F.col("id").alias(id_col), F.when(F.col("on") & (F.col("n") > 0), F.array_join(made, " ")).otherwise(F.col("text")).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period), and digests of the runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    start, period = -F.col("best.start"), -F.col("best.period")
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), start.alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
