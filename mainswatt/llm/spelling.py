"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct strings that one deletion, replacement or insertion makes of it,
over the alphabet that the vocabulary uses; those that are words themselves are its neighbours, found by a hash
join on the string alone: a candidate is at distance one as it was made so, and no distance is computed.

A word of L code points has some 2 L A candidates (A letters), so they are made as hashes, a whole-array step per
edit: the hash of an edited word follows from the word's prefix sums. Only candidates that a Bloom filter of the
vocabulary lets through become strings and enter the join. The filter has a fixed size (16 MB), so it can be
broadcast at any scale; where the vocabulary outgrows it, more candidates pass and the join sorts them out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import join_split, materialise
from .common import _BASE, CHUNK, chunks, mix

WORD = "[A-Za-zÀ-ÿ]+"
BITS = 1 << 27
"""Bits of the Bloom filter."""
PROBES = 2
"""Bits a word sets in it, each from 32 bits of its hash."""
POSITIONS = 1 << 13
"""Places of words whose edits are made at once."""


def words_of(docs: DataFrame, damage: int = 0, id_col: str = "doc_id", text_col: str = "text", pattern: str = WORD) -> DataFrame:
    """word, n: the matches of ``pattern`` in the texts, A-Z in lower case, counted by parts of the corpus (a word has several rows).

    With ``damage`` d, a word loses a letter in each document where d divides the crc32 of ``<id>:<word>``; without
    an id it loses none. Null and empty texts have no words; repeated rows count each. Other columns are not read.
    """
    find = re.compile(pattern).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 8 * CHUNK):
                total: Counter[str] = Counter()
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    own = Counter(find((text or "").encode().lower().decode()))  # bytes: only A-Z change
                    if damage and key is not None:
                        start = crc32(f"{key}:".encode())
                        for word in [w for w in own if crc32(w.encode(), start) % damage == 0]:
                            at = crc32(word.encode(), start) % len(word)
                            total[word[:at] + word[at + 1 :]] += own.pop(word)
                    total.update(own)
                yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: distinct words of at least so many code points and occurrences, from counts by parts."""
    long = words.filter(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def alphabet(vocab: DataFrame) -> list[int]:
    """The code points in use, sorted. There are at most as many as the word pattern allows (90)."""
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    return sorted(ord(r.c) for r in letters.collect())


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a column and each row's offset in them."""
    texts = column.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _powers(n: int) -> np.ndarray:
    row = np.full(n, _BASE, np.uint64)
    row[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(row)


_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def _sums(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per place the sum over the word before it, the place's power, and per word its whole sum."""
    size = np.diff(offsets)
    place = np.arange(len(points)) - np.repeat(offsets[:-1], size)
    power = _powers(int(size.max(initial=0)) + 2)
    with np.errstate(over="ignore"):
        run = np.r_[np.uint64(0), np.cumsum(points.astype(np.uint64) * power[place])]
        return run[:-1] - np.repeat(run[offsets[:-1]], size), place, run[offsets[1:]] - run[offsets[:-1]]


def _finish(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bit(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The filter's bit for a hash; ``bits`` is a power of two, of 32 at most."""
    return (h >> np.uint64(32 * probe)) & np.uint64(bits - 1)


def passing(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Indexes of the hashes whose bits are all set in the filter."""
    at = None
    for k in range(PROBES):
        bit = _bit(h if at is None else h[at], k, bits)
        ok = np.flatnonzero((table[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
        at = ok if at is None else at[ok]
    return at


def neighbours(points: np.ndarray, offsets: np.ndarray, letters: np.ndarray, known: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """Word number and string of every distinct edit whose hash ``known`` lets through (hashes to indexes).

    Distinct: of a run of equal letters only the first is deleted, and a letter is not put in after its like.
    """
    before, _, total = _sums(points, offsets)
    size = np.diff(offsets)
    word = np.repeat(np.arange(len(size)), size)
    power = _powers(int(size.max(initial=0)) + 2)
    own, letter = points.astype(np.uint64), letters.astype(np.uint64)
    whole, here, length = total[word], power[np.arange(len(points)) - offsets[:-1][word]], size[word]
    text = points.tobytes().decode("utf-32-le")
    out_word: list[np.ndarray] = []
    out: list[str] = []

    def add(at: np.ndarray, w: np.ndarray, skip: int, put: np.ndarray | None) -> None:
        new = [""] * len(at) if put is None else map(chr, put.tolist())
        out_word.append(w)
        out.extend(text[a:i] + c + text[i + skip : b] for i, c, a, b in zip(at.tolist(), new, offsets[w].tolist(), offsets[w + 1].tolist()))

    def with_letter(rest: np.ndarray, scale: np.ndarray, sizes: np.ndarray, unlike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and letter of the edits let through that put a letter other than ``unlike``."""
        h = _finish(rest[:, None] + letter * scale[:, None], sizes[:, None])
        row, c = np.divmod(known(h.ravel()), len(letter))
        ok = letter[c] != unlike[row]
        return row[ok], letters[c[ok]]

    with np.errstate(over="ignore"):
        last = np.r_[np.uint64(0), own[:-1]]  # the letter before, in the same word
        last[offsets[:-1][size > 0]] = 0
        at = np.flatnonzero(own != last)
        at = at[known(_finish(before[at] + (whole[at] - before[at] - own[at] * here[at]) * _BACK, length[at] - 1))]
        add(at, word[at], 1, None)
        at, put = with_letter(whole - own * here, here, length, own)
        add(at, word[at], 1, put)
        at, put = with_letter(before + (whole - before) * np.uint64(_BASE), here, length + 1, last)
        add(at, word[at], 0, put)
        some = np.flatnonzero(size > 0)  # and after the last letter
        at, put = with_letter(total[some], power[size[some]], size[some] + 1, own[offsets[some + 1] - 1])
        add(offsets[some[at] + 1], some[at], 0, put)
    return np.concatenate(out_word), out


def bloom(vocab: DataFrame, bits: int = BITS) -> np.ndarray:
    """The vocabulary's Bloom filter as bytes, built in pages by aggregation; ``bits`` / 8 bytes at most reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, offsets = _code_points(batch.column("word"))
            h = _finish(_sums(points, offsets)[2], np.diff(offsets))
            yield pa.RecordBatch.from_pydict({"bit": pa.array(np.concatenate([_bit(h, k, bits) for k in range(PROBES)]).astype(np.int64))})

    bit = F.col("bit")
    pages = vocab.select("word").mapInArrow(places, "bit long").groupBy(F.shiftright(bit, 15).alias("page")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("held"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.toLocalIterator():
        out[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(r.held, np.uint8)
    return out


def near_words(vocab: DataFrame, bits: int = BITS) -> DataFrame:
    """word, near, near_n: every ordered pair of words of the vocabulary (word, n) that one edit turns into each other."""
    letters = np.array(alphabet(vocab), np.uint32)
    held = vocab.sparkSession.sparkContext.broadcast(bloom(vocab, bits))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = partial(passing, table=held.value, bits=bits)
        for batch in batches:
            points, offsets = _code_points(batch.column("word"))
            cut = np.flatnonzero(np.diff(offsets // POSITIONS)) + 1  # words of one block of places
            for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, batch.num_rows].tolist()):
                if lo == hi:
                    continue
                own, cand = neighbours(points[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], letters, known)
                yield pa.RecordBatch.from_pydict({"word": batch.column("word").take(pa.array(own + lo)), "near": pa.array(cand, pa.string())})

    # A task gets few words, as each makes hundreds of candidates.
    made = vocab.select("word").repartition(F.col("word")).mapInArrow(edit, "word string, near string")
    return made.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): forms are followed to the last. A chain must not close.

    Each round doubles the steps taken. A form that many words point at has its rows dealt to parts.
    """
    links = materialise(forms.select("word", F.col("form").alias("at")))
    while True:
        counts = links.groupBy("at").agg(F.count("*").alias("n"))
        further = materialise(counts.join(links.select(F.col("word").alias("at"), F.col("at").alias("next")), "at"))
        total = further.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not total:
            return links.select("word", F.col("at").alias("root"))
        moved = join_split(links, further.select("at", "next"), "at", further.select("at", "n"), total).select("word", F.col("next").alias("at"))
        links = materialise(moved.unionByName(links.join(further.select("at"), "at", "left_anti").select("word", "at")))


def variants(vocab: DataFrame, ratio: int = 2, bits: int = BITS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``vocab`` (word, n; each word once, none null).

    Words are near if one inserted, deleted or replaced code point turns one into the other. ``form`` is the near word
    of largest n (of equal ones the smallest in code-point order) if its n is at least ``ratio`` (over 1) times the word's,
    else null; ``root`` follows forms to the last, and is the word itself where it has none. ``n_near`` counts near
    words. An empty vocabulary gives no rows; further columns are not read, whatever their names.
    """
    vocab = materialise(vocab.select("word", F.col("n").cast("long").alias("n")))
    pairs = near_words(vocab, bits)
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("top"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    every = vocab.join(found, "word", "left")
    has = F.col("top") >= ratio * F.col("n")
    every = materialise(every.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("top")).alias("form_n")))
    ends = roots(every.filter("form is not null"))
    return every.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
