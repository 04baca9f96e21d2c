"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of binary lengths: as many of ``size`` tokens as fit, then one
for each set bit of the rest, longest first. A piece is a whole sequence, so no sequence crosses documents,
none needs padding (each length is a power of two), and sequences of equal length form one bucket. The
bucket is the upper part of ``sequence_id``; a batch is drawn from one bucket.

Tokenising is the whole cost. White space separates tokens in the given vocabulary, so a text is the
concatenation of its space-separated parts; each worker keeps the ids of parts it has met, as bytes, asks
for a chunk's different parts once, and gathers the ids of its texts. No shuffle: pieces are numbered by
partition and row.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 2
MEMO = 500_000
"""Words and parts that a worker process remembers; once it has met so many, it adds no more."""
MEMO_PART = 64
"""Characters of the longest word worth remembering."""
RUN = 2048
"""Words that the tokenizer gets at once."""
CHUNK = 4 << 20
"""Bytes of text cut at once; a longer text is cut alone."""


class Ids:
    """Token ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.memo, self.known = Tokenizer.from_file(path), memo, {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @staticmethod
    def core(part: str) -> tuple[str, str]:
        """A part as (word, closing mark), folded where folding cannot change its ids.

        The vocabulary is lower case and sets letters and digits apart from other signs. ASCII is folded
        unless it could spell a special token, and a last point or comma is cut from a letter or digit.
        """
        if part.isascii() and "<" not in part:
            part = part.lower()
        if len(part) > 1 and part[-1] in ".," and part[-2].isascii() and part[-2].isalnum():
            return part[:-1], part[-1]
        return part, ""

    def coded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words the tokenizer has not been asked for.

        Words of ASCII letters go to it many at a time, spaced: each is one pre-token, and only a pre-token's last
        id stands for an ending. Others, and a run whose endings are not one a word, go one by one.
        """
        plain, rest, out = [], [], {}
        for w in words:
            (plain if w.isascii() and w.isalpha() else rest).append(w)
        for at in range(0, len(plain), RUN):
            run = plain[at : at + RUN]
            ids = np.array(self.tokenizer.encode(" ".join(run), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) != len(run) or ends[-1] != len(ids):
                rest += run
                continue
            held, ends = ids.tobytes(), (4 * ends).tolist()
            out.update(zip(run, (held[s:e] for s, e in zip([0, *ends], ends))))
        for at in range(0, len(rest), RUN):
            run = rest[at : at + RUN]
            out.update(zip(run, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False))))
        return out

    def parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each space-separated part."""
        known = self.known
        held = list(map(known.get, parts))
        new = [k for k, h in enumerate(held) if h is None]
        if new:
            cores = [self.core(parts[k]) for k in new]
            coded = self.coded([w for w in {w for pair in cores for w in pair} if w not in known])
            for k, (w, m) in zip(new, cores):
                i = coded[w] if w in coded else known[w]
                held[k] = i + (coded[m] if m in coded else known[m]) if m else i
            for made in (coded, {parts[k]: held[k] for k in new}):
                if len(known) + len(made) <= self.memo:
                    known.update((w, i) for w, i in made.items() if len(w) <= MEMO_PART)
        return held

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column (null: none), and each row's offset in them.

        Special tokens spelled out in a text are found as the tokenizer finds them.
        """
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " "), " ")
        word = pc.list_flatten(cut).dictionary_encode()
        held = self.parts(word.dictionary.to_pylist())
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        flat, code = np.frombuffer(b"".join(held), "<u4"), word.indices.to_numpy(zero_copy_only=False)
        each, start = size[code], np.cumsum(size) - size
        ends = np.r_[0, np.cumsum(each)]
        at = np.repeat(start[code] - ends[:-1], each)
        at += np.arange(len(at))
        rows = np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]
        return flat[at], ends[rows]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, at = self.encode(pa.array(texts, pa.string()))
        return [ids[s:e].tobytes() for s, e in zip(at[:-1], at[1:])]


_met: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """This worker process's tokenizer, with what it remembers from earlier tasks."""
    if path not in _met:
        _met[path] = Ids(path)
    return _met[path]


def binary_lengths(n: int, size: int) -> list[int]:
    """``n`` as a sum of ``size`` and smaller powers of two, longest first."""
    out, rest = [size] * (n // size), n % size
    return out + [1 << b for b in range(size.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` if asked for).

    Null and empty texts are one piece of the end id alone. Repeated rows are packed each on its own; a null id
    stays null. An empty table gives no rows; other columns are neither read nor returned. A text of any length
    is cut whole: memory is that of one text's ids.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")
    kind = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import chunks

        ids, end = ids_of(tokenizer_path), END_ID.to_bytes(4, "little")
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                row, start, length, crc, total, values = [], [], [], [], [], []
                coded, bounds = ids.encode(batch.column("text"))
                for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    held = coded[low:high].tobytes() + end
                    at, n = 0, len(held) // 4
                    for k in binary_lengths(n, size):
                        piece = held[4 * at : 4 * (at + k)]
                        row.append(i), start.append(at), length.append(k), crc.append(zlib.crc32(piece)), total.append(n)
                        if with_ids:
                            values.append(np.frombuffer(piece, "<i4"))
                        at += k
                out = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64()))}
                out |= {k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total))}
                out["bucket"] = pa.array([k.bit_length() - 1 for k in length], pa.int32())
                if with_ids:
                    out["ids"] = pa.array(values, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    pieces = narrow.mapInArrow(cut, schema)
    # monotonically_increasing_id stays below 2**58 for up to 2**25 partitions; the bucket fills the bits above.
    number = F.col("bucket").cast("long") * F.lit(1 << 58) + F.monotonically_increasing_id()
    out = pieces.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long")).drop("bucket")
    return out.withColumnRenamed("doc_id", id_col)
