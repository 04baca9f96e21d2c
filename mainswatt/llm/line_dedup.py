"""Line dedup by pairwise alignment.

Every line of at least ``min_words`` words is an anchor; a shorter one makes an anchor with as many lines
after it as complete ``min_words``, and where words are long a word is four characters. Grouping anchors by hash
tells the first document that holds each, and how many do; a later document with a shared anchor is linked to that
first holder, so links grow with the lines and never with the square of a group.

Rare lines link first: those that at most ``RARE`` documents hold. Linked documents are aligned with patience diff
(lines unique on both sides, longest increasing subsequence, equal neighbours, recursion between; the exact
longest common subsequence of a range that has no such line), and aligned common blocks of ``min_words`` or more
are deleted from the later document. Common lines (licence lines, menus) mostly go with the blocks that rare lines
align; only where one still stands does it link its document to the line's first holder. So a line that a third of
all documents hold makes no link for a copy that its text's rare lines gave away.

Anchors of which an occurrence still stands are then linked to further earlier holders in rounds: to the
least of each share of the holders, and at last to all that were not tried. Every anchor that some earlier
holder aligns is so deleted. Most lines go with the first holders; one that no holder aligns is compared with
every earlier holder, the one part whose cost is not bounded by the lines.

Lines count as equal where their 64-bit hashes are: among 10^12 different lines some tens of pairs collide.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import join_split, materialise
from .common import _BASE, mix

RARE = 16
"""Documents that hold a rare line, at most."""
SALTS = (16, 64)
"""Shares that the holders of a line still standing are dealt to, by round: the least of each share, then all."""


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of ``b`` the bits that are 0 where the common subsequence with a prefix of ``a`` grows."""
    at: dict[int, int] = {}
    for i, h in enumerate(a):
        at[h] = at.get(h, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for h in b:
        hit = row & at.get(h, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``b`` and each prefix of ``a``."""
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.r_[0, np.cumsum(bits[: len(a)] == 0)]


def lcs(a: list[int], b: list[int], bits: int = 1 << 28) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; ranges of over ``bits`` comparisons are halved (Hirschberg)."""
    if len(a) * len(b) > bits and len(a) > 1 and len(b) > 1:
        half = len(b) // 2
        cut = int(np.argmax(_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]))
        return lcs(a[:cut], b[:half], bits) + [(i + cut, j + half) for i, j in lcs(a[cut:], b[half:], bits)]
    rows = list(_rows(a, b))
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned common blocks (start in a, start in b, lines), in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where: dict[int, int] = {}
        for i in range(a0, a1):
            where[a[i]] = -1 if a[i] in where else i
        once: dict[int, int] = {}
        for j in range(b0, b1):
            if where.get(b[j], -1) >= 0:
                once[b[j]] = -1 if b[j] in once else j
        common = sorted((where[h], j) for h, j in once.items() if j >= 0)
        tails: list[int] = []
        last: list[int] = []
        back = [-1] * len(common)
        for x, (_, j) in enumerate(common):
            at = bisect_left(tails, j)
            back[x] = last[at - 1] if at else -1
            tails[at : at + 1], last[at : at + 1] = [j], [x]
        chain, x = [], last[-1] if last else -1
        while x >= 0:
            chain.append(common[x])
            x = back[x]
        if not chain:
            ours, theirs = set(a[a0:a1]), set(b[b0:b1])
            left = [i for i in range(a0, a1) if a[i] in theirs]
            right = [j for j in range(b0, b1) if b[j] in ours]
            pairs += [(left[i], right[j]) for i, j in lcs([a[i] for i in left], [b[j] for j in right])]
            continue
        pa_, pb = a0, b0
        for i, j in chain[::-1]:
            pairs.append((i, j))
            todo.append((pa_, i, pb, j))
            pa_, pb = i + 1, j + 1
        todo.append((pa_, a1, pb, b1))
    blocks: list[list[int]] = []
    for i, j in sorted(pairs):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def line_hashes(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the hash of each line (trailing white space aside; 0 where blank), and its length in words.

    Lines whose words are long on average (scripts without spaces) have a word for every four characters.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.rtrim(x))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    bare = F.transform("lines", lambda x: F.trim(F.translate(x, "\t\u00a0\u3000", "   ")))
    counted = F.transform(bare, lambda x: F.struct(F.length(x).alias("n"), F.size(F.filter(F.split(x, " "), lambda w: w != "")).alias("words")))
    size = F.transform(counted, lambda z: F.when(z["n"] > 12 * z["words"], F.greatest(z["words"], (z["n"] / 4).cast("int"))).otherwise(z["words"]))
    rows = rows.withColumn("words", size)
    return rows.select("doc_id", F.transform(F.arrays_zip("lines", "words"), lambda z: F.when(z["words"] > 0, F.xxhash64(z["lines"])).otherwise(0)).alias("hashes"), "words")


def anchors_of(rows: DataFrame, min_words: int) -> DataFrame:
    """doc_id, and h and lines of each anchor: a run of lines, blank ones aside, that just reaches ``min_words``."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hashes = (batch.column(c).flatten().to_numpy() for c in ("words", "hashes"))
            count = pc.list_value_length(batch.column("words")).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            full = np.flatnonzero(words > 0)
            row, place, words, hashes = row[full], place[full], words[full], hashes[full].view(np.uint64)
            total = np.r_[0, np.cumsum(words)]
            last = np.searchsorted(total, total[:-1] + min_words) - 1
            ok = np.flatnonzero((last < len(row)) & (row[np.minimum(last, len(row) - 1)] == row))
            last, h = last[ok], hashes[ok].copy()
            with np.errstate(over="ignore"):
                for k in range(1, int((last - ok).max(initial=0)) + 1):
                    more = ok + k <= last
                    h[more] = mix(h[more] * np.uint64(_BASE) + hashes[ok[more] + k])
            size = last - ok + 1
            edge = np.r_[0, np.cumsum(size)]
            held = place[np.repeat(ok - edge[:-1], size) + np.arange(edge[-1])].astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row[ok])), "h": pa.array(h.view(np.int64)), "at": pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(held))})

    return rows.mapInArrow(find, f"doc_id {kind}, h long, at array<int>")


def telling(blocks: list[tuple[int, int, int]], a: list[int], b: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """The blocks that have ``least`` words of ``b``, together with those that only blank lines part from them."""
    out: list[tuple[int, int, int]] = []
    run: list[tuple[int, int, int]] = []
    for x in [*blocks, None]:
        if run and (x is None or any(a[run[-1][0] + run[-1][2] : x[0]]) or any(b[run[-1][1] + run[-1][2] : x[1]])):
            if sum(sum(words[j : j + n]) for _, j, n in run) >= least:
                out += run
            run = []
        run.append(x)
    return out


def pairs_of(met: DataFrame) -> DataFrame:
    """doc_id, first (an earlier document): one row per pair to align."""
    return met.filter("doc_id > first").select("doc_id", "first").distinct()


def removals(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lines to delete (positions from 0), blocks: only documents that lose lines."""
    rows = materialise(line_hashes(docs, min_words, id_col, text_col))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, lines, count = [], [], []
                for i, (a, b, w) in enumerate(zip(*(part.column(c).to_pylist() for c in "abw"))):
                    blocks = telling(patience(a, b), a, b, w, min_words)
                    if blocks:
                        kept.append(i), count.append(len(blocks))
                        lines.append([j for _, s, n in blocks for j in range(s, s + n)])
                if kept:
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(kept)), "gone": pa.array(lines, pa.list_(pa.int32())), "blocks": pa.array(count, pa.int64())})

    def aligned(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs)
        later = rows.select("doc_id", F.col("hashes").alias("b"), F.col("words").alias("w"))
        earlier = rows.select(F.col("doc_id").alias("first"), F.col("hashes").alias("a"))
        count, total = (lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))), pairs.count()
        both = join_split(join_split(pairs, later, "doc_id", count("doc_id"), total), earlier, "first", count("first"), total)
        return materialise(both.select("doc_id", "a", "b", "w").mapInArrow(align, f"doc_id {kind}, gone array<int>, blocks long"))

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.sum("blocks").alias("blocks"))

    runs = materialise(anchors_of(rows, min_words))
    anchors = runs.select("doc_id", "h").distinct()
    lines = materialise(anchors.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final"), F.count("*").alias("df")).filter("first < final").drop("final"))
    counts, total = lines.select("h", F.col("df").alias("n")), lines.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    held = materialise(join_split(anchors, lines, "h", counts, total))

    def undone(found: DataFrame, last: DataFrame) -> DataFrame:
        """The rows (doc_id, h, first, df) of ``last`` of which a line stands."""
        met = runs.join(last, ["doc_id", "h"]).join(merged(found).select("doc_id", "gone"), "doc_id", "left")
        return materialise(met.filter(F.col("gone").isNull() | (F.size(F.array_except("at", "gone")) > 0)).select("doc_id", "h", "first", "df").distinct())

    later = held.filter("doc_id > first").select("doc_id", "h", "first", "df")
    found = aligned(pairs_of(later.filter(F.col("df") <= RARE)))
    found = found.unionByName(aligned(pairs_of(undone(found, later.filter(F.col("df") > RARE)))))
    # A line that two documents hold has no other holder before the later one.
    left = undone(found, later.filter("df > 2"))
    tried = lines.select("h", F.col("first").alias("holder"))
    for salts in SALTS:
        if left.isEmpty():
            break
        rest = join_split(held.select("h", F.col("doc_id").alias("holder")), left.groupBy("h").agg(F.max("doc_id").alias("until")), "h", counts, total).filter("holder < until").drop("until")
        rest = rest.join(tried, ["h", "holder"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("holder"), F.lit(salts)))
        chosen = materialise(rest.groupBy("h", "salt").agg(F.min("holder").alias("first")) if salts < SALTS[-1] else rest.withColumnRenamed("holder", "first"))
        dealt = left.drop("first").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        by = dealt.groupBy("h", "salt").agg(F.count("*").alias("n"))
        found = found.unionByName(aligned(pairs_of(join_split(dealt, chosen, ["h", "salt"], by, salts * left.count()))))
        if salts < SALTS[-1]:
            left, tried = undone(found, left), tried.unionByName(chosen.select("h", F.col("first").alias("holder")))
    return merged(found)


def dedup_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the deleted lines gone from the text, and n_lines, n_removed, n_blocks after the other columns.

    The earlier of two documents is that of the smaller id; n_blocks counts the blocks of all alignments made. Null texts count as empty and stay null; documents
    with a null id stay as they are. Rows that repeat an id are one document (of equal text) to the alignment
    and are each edited alike. Lines of fewer than ``min_words`` words go only inside a block that has as many.
    An empty table gives no rows. Input columns named like an output column are replaced; others may have any names.
    """
    gone = removals(docs, min_words, id_col, text_col).select(F.col("doc_id").alias("__doc"), F.col("gone").alias("__gone"), F.col("blocks").alias("__blocks"))
    kept = docs.drop("n_lines", "n_removed", "n_blocks")
    of = {c: F.col(f"__kept.`{c}`") for c in kept.columns}
    out = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("__kept")).join(gone, of[id_col] == F.col("__doc"), "left")
    lines = F.split(F.coalesce(of[text_col], F.lit("")), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    text = F.when(F.col("__gone").isNull(), of[text_col]).otherwise(left)
    n = F.greatest(F.coalesce(F.size("__gone"), F.lit(0)), F.lit(0)).cast("long")
    return out.select(*[(text if c == text_col else of[c]).alias(c) for c in kept.columns], F.size(lines).cast("long").alias("n_lines"), n.alias("n_removed"), F.coalesce("__blocks", F.lit(0)).cast("long").alias("n_blocks"))
