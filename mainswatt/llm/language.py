"""Language identification by interpolated Kneser-Ney character models.

For each language an order-``n`` character model is learnt from a bounded sample of labelled rows (at most
about ``sample`` documents a language, chosen by hash of id). Each observed n-gram's probability is
interpolated once, at training: discounted counts at the highest order, continuation counts below, so
scoring is a look-up of the longest known n-gram and the back-off weights of longer known contexts. The
tables of all languages share sorted 64-bit hash arrays; a directory of the top bits leads to the few
entries that a look-up compares. A text takes the language of least cross-entropy per character.

Text is lower-cased, everything but letters becomes one space, and every character of the whole text
counts. A text without letters is ``und``. ``rejected`` marks texts that no language explains: their
cross-entropy lies beyond the language's limit, which is fitted to a stated rate of false rejects on documents
that the models were not trained on.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import CHUNK, chunks, lower, mix

ORDER = 4
UND = "und"
REJECT_RATE = 1e-4
"""Share of texts in a known language that calibration allows to be rejected."""
MOST_CHARS = 1 << 16
"""Characters of a sampled text that count for learning."""
_K = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter or a mark."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with a space before each row and one between words, the row of each, and letters per row."""
    column = lower(column)
    size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(column.to_pylist())
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(size)), size)
    alpha = letters()[code]
    count = np.bincount(row[alpha], minlength=len(size)) if len(code) else np.zeros(len(size), np.int64)
    keep = alpha.copy()
    if len(code):
        keep[1:] |= alpha[:-1] & (row[1:] == row[:-1])  # one space after each word
    return np.where(alpha[keep], code[keep], 32).astype(np.uint64), row[keep], count


class Grams:
    """Hashes of the characters that end at each position and of those before them, by order; before a row stand spaces."""

    def __init__(self, code: np.ndarray, row: np.ndarray, order: int):
        self.code, self.back = code, [code]
        with np.errstate(over="ignore"):
            for k in range(1, order):
                c = np.full(len(code), 32, np.uint64)
                if k < len(code):
                    same = row[k:] == row[:-k]
                    c[k:][same] = code[:-k][same]
                self.back.append(mix(c + np.uint64(k << 32)))

    def _folded(self, n: int, at: np.ndarray | slice) -> np.ndarray:
        out = np.full(len(self.code[at]), n, np.uint64)
        for k in range(n - 1, 0, -1):
            out = out * _K + self.back[k][at]
        return out

    def keys(self, n: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the ``n`` characters that end at the positions ``at``."""
        with np.errstate(over="ignore"):
            return mix(self._folded(n, at) * _K + self.code[at])

    def contexts(self, n: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the ``n - 1`` characters before them."""
        with np.errstate(over="ignore"):
            return mix(self._folded(n, at))


def keys(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` characters that end at each position."""
    return Grams(code, row, n).keys(n)


def contexts(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n - 1`` characters before each position, as used by :func:`keys` of order ``n``."""
    return Grams(code, row, n).contexts(n)


def _by_row(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` (a matrix) over equal, ascending ``row``."""
    out = np.zeros((rows, values.shape[1]))
    if len(row):
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[start]] = np.add.reduceat(values, start, axis=0, dtype=np.float64)
    return out


class Table:
    """A sorted hash array with a directory of the top bits, and a matrix of values by entry and language."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values = hashes, np.vstack([values, np.zeros((1, values.shape[1]), np.float32)])
        self.bits = max(1, min(22, int(len(hashes)).bit_length() + 1))
        top = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(top, np.arange(1 << self.bits)).astype(np.int32)
        self.depth = int(np.bincount(top).max()) if len(hashes) else 0
        self.padded = np.r_[hashes, np.zeros(self.depth + 1, np.uint64)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1 (the row of zeros)."""
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        for k in range(self.depth):
            there = self.padded[at + k] if k == 0 else self.padded[at[todo] + k]
            mine = h if k == 0 else h[todo]
            hit = there == mine
            out[todo[hit]] = at[todo[hit]] + k
            todo = todo[~hit & (there < mine) & (there != 0)]
            if not len(todo):
                break
        return out


class Models:
    """All languages' models. ``limits`` and ``scale`` calibrate rejection and score."""

    def __init__(self, langs: list[str], alphabet: int, grams: dict[int, Table], weights: dict[int, Table], floor: float):
        self.langs, self.alphabet, self.grams, self.weights, self.floor = langs, alphabet, grams, weights, floor
        self.limits, self.scale = np.full(len(langs), np.inf), 1.0

    @classmethod
    def train(cls, texts: dict[str, list[str]], order: int = ORDER) -> Models:
        langs = sorted(texts)
        seen: list[dict[int, tuple]] = []
        alphabet = set()
        for lang in langs:
            code, row, _ = normalised(pa.array(texts[lang], pa.string()))
            alphabet |= set(np.unique(code).tolist())
            where = {}
            for n in range(1, order + 1):  # an order at a time: a position takes many bytes
                grams_of = Grams(code, row, n)
                k, at, raw = np.unique(grams_of.keys(n), return_index=True, return_counts=True)
                low = Grams(code, row, n - 1).keys(n - 1, at) if n > 1 else np.zeros(len(k), np.uint64)
                where[n] = k, grams_of.contexts(n, at), low
            counts = {order: raw.astype(float)}
            for n in range(order - 1, 0, -1):
                counts[n] = np.bincount(np.searchsorted(where[n][0], where[n + 1][2]), minlength=len(where[n][0])).astype(float)
            seen.append({n: (*where[n], counts[n]) for n in where})
        size = max(1, len(alphabet))
        grams, weights, below = {}, {}, None
        for n in range(1, order + 1):
            hashes = np.unique(np.concatenate([s[n][0] for s in seen])) if seen else np.zeros(0, np.uint64)
            ctx = np.unique(np.concatenate([s[n][1] for s in seen])) if seen else np.zeros(0, np.uint64)
            low_of, ctx_of = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
            weight, prob = np.ones((len(ctx), len(langs))), np.zeros((len(hashes), len(langs)))
            for j, s in enumerate(seen):
                k, c, low, count = s[n]
                at, there = np.searchsorted(hashes, k), np.searchsorted(ctx, c)
                low_of[at], ctx_of[at] = low, c
                ones, twos = (count == 1).sum(), (count == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(there, count, len(ctx))
                kinds = np.bincount(there, minlength=len(ctx))
                held = total > 0
                weight[held, j] = d * kinds[held] / total[held]
                prob[at, j] = np.maximum(count - d, 0) / total[there]
            back = below[np.searchsorted(grams[n - 1].hashes, low_of)] if n > 1 else np.full((len(hashes), len(langs)), 1 / size)
            prob += weight[np.searchsorted(ctx, ctx_of)] * back
            below = prob
            grams[n] = Table(hashes, np.log(np.maximum(prob, 1e-12)).astype(np.float32))
            weights[n] = Table(ctx, np.log(np.maximum(weight, 1e-12)).astype(np.float32))
        return cls(langs, size, grams, weights, float(np.log(1 / size)))

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each row under each language, and letters per row."""
        code, row, count = normalised(column)
        total = np.zeros((len(count), len(self.langs)))
        order = max(self.grams)
        grams, todo = Grams(code, row, order), np.arange(len(code))
        for n in range(order, 0, -1):
            at = self.grams[n].find(grams.keys(n, todo))
            hit = at >= 0
            total += _by_row(row[todo[hit]], self.grams[n].values[at[hit]], len(count))
            todo = todo[~hit]
            if not len(todo):
                break
            total += _by_row(row[todo], self.weights[n].values[self.weights[n].find(grams.contexts(n, todo))], len(count))
        if len(todo):
            total += np.bincount(row[todo], minlength=len(count))[:, None] * self.floor
        size = np.bincount(row, minlength=len(count))
        return -total / np.maximum(size, 1)[:, None], count

    def calibrate(self, texts: dict[str, list[str]], reject_rate: float = REJECT_RATE) -> None:
        """Fit the limits of rejection and the score's scale on texts that the models have not seen.

        A text's entropy over its language's median is a gap. Gaps beyond their 90 per cent quantile fall off about
        exponentially; the limit is where that tail, over all languages, leaves ``reject_rate`` of true texts, and a
        quarter over the median at least, since few texts tell little of a tail.
        """
        gaps, margins, median = [], [], {}
        for j, lang in enumerate(self.langs):
            e, count = self.entropies(pa.array(texts.get(lang, []), pa.string()))
            e = e[count > 0]
            if len(e):
                median[j] = float(np.median(e[:, j]))
                gaps += (e[:, j] - median[j]).tolist()
            if len(e) and len(self.langs) > 1:
                margins += (np.sort(e, axis=1)[:, 1] - e.min(axis=1)).tolist()
        if gaps:
            edge = float(np.quantile(gaps, 0.9))
            beyond = [g - edge for g in gaps if g > edge]
            tail = edge + float(np.mean(beyond or [0.0])) * np.log(0.1 / reject_rate)
            for j, m in median.items():
                self.limits[j] = m + max(tail, 0.25 * m)
        self.scale = 3.0 / max(float(np.median(margins)), 1e-3) if margins else 1.0

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, entropy and rejection of each row."""
        e, count = self.entropies(column)
        if not self.langs:
            return [UND] * len(count), np.zeros(len(count)), np.zeros(len(count)), np.ones(len(count), bool)
        best = e.argmin(axis=1)
        least = e[np.arange(len(e)), best]
        soft = np.exp(-(e - least[:, None]) * self.scale)
        score = 1 / soft.sum(axis=1)
        none = count == 0
        names = [UND if z else self.langs[b] for b, z in zip(best.tolist(), none.tolist())]
        room = 4 / np.sqrt(np.maximum(count, 1))  # a short text's mean scatters more: about three deviations of one letter's
        return names, np.where(none, 0.0, score), least, none | (least > self.limits[best] + room)


def fit(labelled: DataFrame, sample: int = 400, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, bytes_most: int = 64 << 20, langs_most: int = 1024) -> Models:
    """Learn the models from about ``sample`` documents a language, and calibrate on a fifth of them.

    The bounds of the sample: rows whose id hash falls under ``sample / rows of the language``, at most
    ``2 * sample`` rows a language (least hashes first), ``MOST_CHARS`` characters of each and ``bytes_most``
    characters in all, of the ``langs_most`` languages with most rows. Rows without language or text don't count;
    no rows make models without languages.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs_most).collect()}
    if not counts:
        return Models.train({}, order)
    chance = F.try_element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.filter(draw < chance).withColumn("draw", draw)
    picked = picked.withColumn("text", F.substring("text", 1, MOST_CHARS)).orderBy("draw", "id", "text").limit(2 * sample * len(counts))

    def learn(rows: list[dict]) -> Models:
        texts: dict[str, list] = {k: [] for k in counts}
        held = 0
        for r in sorted(rows, key=lambda r: (r["draw"], r["id"] or "", r["text"])):
            held += len(r["text"])
            if held <= bytes_most and len(texts[r["lang"]]) < 2 * sample:
                texts[r["lang"]].append((r["draw"], r["text"]))
        for k in texts:
            texts[k] = [t for _, t in sorted(texts[k])]
        few = {k: max(1, len(v) // 5) if len(v) > 1 else 0 for k, v in texts.items()}
        models = Models.train({k: v[few[k] :] for k, v in texts.items()}, order)
        models.calibrate({k: v[: few[k]] or v for k, v in texts.items()})
        return models

    # The sample is bounded, but its n-grams take more than a driver may have to spare: a task learns them.
    packed = picked.groupBy().applyInArrow(lambda t: pa.table({"models": pa.array([pickle.dumps(learn(t.select(["lang", "text", "id", "draw"]).to_pylist()))], pa.binary())}), "models binary").first()
    return pickle.loads(packed["models"]) if packed else learn([])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the query never learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: id, lang_pred, score, entropy, rejected; with ``keep``, a struct ``kept`` of those columns too.

    Null texts and texts without a letter are ``und``, score 0, rejected. Repeated rows are each predicted;
    an empty table gives no rows. Other columns are not read, and kept ones may have any names. Every character
    of a text counts, however long it is.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *([F.struct(*[F.col(f"`{c}`") for c in keep if c != text_col], F.lit(1).alias("__one")).alias("__kept")] if keep else []))
    found = [StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("entropy", DoubleType()), ("rejected", BooleanType()))]
    schema = StructType([narrow.schema["__id"], *found, *([narrow.schema["__kept"], narrow.schema["__text"]] if keep else [])])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__text", CHUNK // 2):
                lang, score, entropy, bad = held.value.predict(batch.column("__text"))
                out = {"__id": batch.column("__id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "entropy": pa.array(entropy), "rejected": pa.array(bad)}
                yield pa.RecordBatch.from_pydict(out | ({c: batch.column(c) for c in ("__kept", "__text")} if keep else {}))

    out = narrow.mapInArrow(predict, schema)
    if keep:
        inner = [F.col("__text").alias(c) if c == text_col else F.col(f"__kept.`{c}`").alias(c) for c in keep]
        return out.select(F.col("__id").alias(id_col), "lang_pred", "score", "entropy", "rejected", F.struct(*inner).alias("kept"))
    return out.withColumnRenamed("__id", id_col)
