"""Benchmark decontamination by template canonicalisation.

Text becomes a sequence of template tokens: runs of digits (with inner points and commas) become a number
placeholder, a unit right after a number becomes a unit placeholder, runs of capitalised words inside a
sentence become one name placeholder (capitals of ASCII and Latin-1), all else is the lower-cased word. Windows of ``window`` template
tokens are hashed on both sides and hash-joined; where a window of a document equals one of an item, the
values in its slots are paired, and the window stands only if each value of the item meets one value of the
document, and each of the document one of the item, throughout the window; every window is judged on its own. A question with other numbers or names is thus found, a chance template is not.
The windows that stand are then judged together: of the meanings that they give to a value, the one that most windows
give is taken, and the windows that agree with all meanings taken are the consistent ones. So an item copied but for one
number is still found whole, and a question whose values change midway is told from one that keeps them.
An item's first word, which opens a sentence there but not where a document quotes it after other words, is
read both ways. Windows that hold too few plain words, and items too short, are found by their raw words.

The item windows are broadcast in blocks of at most ``block_bytes`` of benchmark text, one after the other, so driver
and broadcast have a fixed bound and a large benchmark costs more passes over the documents. Matching is local to a
document: nothing is shuffled, and a passage that a third of all documents hold makes no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .common import as_bytes, chunks, mix, powers, prefix_hash, span_hash

_NOUNS = "inch inches foot feet hertz mph kmh percent".split()
_PLURALS = "day week month year hour minute second gram kilogram ton pound ounce litre liter millilitre milliliter metre meter kilometre kilometer centimetre centimeter mile yard dollar euro cent degree watt volt".split()
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs hz khz mhz ghz w kw v a usd eur gbp kb mb gb tb".split() + _NOUNS + _PLURALS + [x + "s" for x in _PLURALS]
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
_LETTER, _DIGIT = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63, 124]] = True
SHORTEST = 6
"""An item of fewer template tokens than this cannot be told from chance by its template, only by its raw words."""


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(span_hash(prefix_hash(data), ends - [len(u) for u in UNITS], ends))


def template(data: np.ndarray, offsets: np.ndarray, inside: bool = False) -> dict[str, np.ndarray]:
    """Template tokens of each row: hash, kind, row, the bytes they stand for (start, end) and the first of their raw tokens (lo).

    The start of a row opens a sentence, unless the rows are read as if from ``inside`` one.
    Raw tokens are the lower-cased words and numbers; ``raw`` holds their hashes and ``raw_row`` their rows.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if not n:
        return {"hash": np.zeros(0, np.uint64), "kind": np.zeros(0, np.uint8), "row": empty, "start": empty, "end": empty, "lo": empty, "raw": np.zeros(0, np.uint64), "raw_row": empty}
    big = (data >= 65) & (data <= 90)
    big[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    small = data + (big * np.uint8(32))
    kind = _KIND[data]
    if n > 2:
        inner = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1
        kind[inner[(kind[inner - 1] == _DIGIT) & (kind[inner + 1] == _DIGIT)]] = _DIGIT
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    row = np.searchsorted(offsets, start, "right") - 1
    hashes = span_hash(prefix_hash(small), start, end)
    kinds = np.where(kind[start] == _DIGIT, NUMBER, WORD).astype(np.uint8)
    raw, raw_row, group = hashes, row, empty
    if len(start):
        stops = np.r_[0, np.cumsum(_STOP[data])]
        same = np.r_[False, row[1:] == row[:-1]]
        opens = ~same | np.r_[True, stops[start[1:]] > stops[end[:-1]]]
        capital = big[start] | ((data[start] == 0xC3) & np.r_[big[1:], False][start])
        second = np.minimum(start + 1 + (data[start] == 0xC3), n - 1)
        name = (kinds == WORD) & capital & ~(opens & same if inside else opens) & (end - start > 1) & ~big[second]
        after = np.r_[False, kinds[:-1] == NUMBER] & same & ~opens
        units = _unit_hashes()
        at = np.minimum(np.searchsorted(units, hashes), len(units) - 1)
        kinds[after & (kinds == WORD) & (units[at] == hashes)] = UNIT
        kinds[name & (kinds == WORD)] = NAME
        first = ~((kinds == NAME) & np.r_[False, kinds[:-1] == NAME] & ~opens)
        group = np.flatnonzero(first)
        end = end[np.r_[group[1:], len(first)] - 1]
        start, row, kinds, hashes = start[group], row[group], kinds[group], hashes[group]
        hashes = np.where(kinds == WORD, hashes, mix(kinds.astype(np.uint64)))
    return {"hash": hashes, "kind": kinds, "row": row, "start": start, "end": end, "lo": group, "raw": raw, "raw_row": raw_row}


def template_windows(t: dict[str, np.ndarray], size: int, literal: float) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of each window of ``size`` tokens in one row, of which enough are plain words."""
    n = len(t["hash"])
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(t["hash"] * up[:n], out=total[1:])
        plain = np.r_[0, np.cumsum(t["kind"] == WORD)]
        at = np.flatnonzero((t["row"][: n - size + 1] == t["row"][size - 1 :]) & (plain[size:] - plain[: n - size + 1] >= literal * size))
        return mix((total[at + size] - total[at]) * down[at] + np.uint64(size)), at


def raw_windows(t: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first raw token of each window of ``size`` raw tokens in one row."""
    return template_windows({"hash": t["raw"], "kind": np.zeros(len(t["raw"]), np.uint8), "row": t["raw_row"]}, size, 0)


def _value(data: np.ndarray, t: dict[str, np.ndarray], i: int) -> tuple[int, bytes]:
    """Kind and lower-cased bytes of a slot."""
    return int(t["kind"][i]), bytes(data[t["start"][i] : t["end"][i]]).lower()


def consistent_windows(runs: list[list[tuple[int, set]]]) -> set[int]:
    """The windows that agree on what each value of the item means in the document.

    A run has the windows of one alignment, each with its pairs (value of the item, value of the document). Long runs
    go first; in a run the pair that most windows hold is taken first (ties: the smaller), if neither value is taken.
    """
    means: dict[tuple, tuple] = {}
    taken: set[tuple] = set()
    out: set[int] = set()
    for run in sorted(runs, key=len, reverse=True):
        held = Counter(x for _, pairs in run for x in pairs)
        for (theirs, ours), _ in sorted(held.items(), key=lambda x: (-x[1], x[0])):
            if theirs not in means and ours not in taken:
                means[theirs] = ours
                taken.add(ours)
        out |= {window for window, pairs in run if all(means.get(theirs) == ours for theirs, ours in pairs)}
    return out


def item_index(items: list[tuple], window: int, literal: float) -> dict:
    """The items' windows, sorted by hash, with their slots' values, for a broadcast; ``raw`` has those found by raw words."""
    data, offsets = as_bytes(pa.array([x[1] or "" for x in items], pa.string()))
    t = template(data, offsets)
    count = np.bincount(t["row"], minlength=len(items))
    size_of = np.minimum(count, window)
    ends = np.r_[t["lo"], len(t["raw"])]
    begin = np.searchsorted(t["row"], np.arange(len(items)))
    found, plain = [], []
    for size in sorted({int(s) for s in size_of if s}):
        h, at = template_windows(t, size, literal)
        keep = (size_of[t["row"][at]] == size) & (size >= SHORTEST)
        found.append((h[keep], at[keep], np.full(int(keep.sum()), size)))
        every = template_windows(t, size, 0)[1]
        every = every[size_of[t["row"][every]] == size]
        # The first word reads otherwise after other text, so its window is also found by raw words.
        other = np.union1d(np.setdiff1d(every, at[keep]), every[every == begin[t["row"][every]]])
        length = ends[other + size] - ends[other]
        length = np.where(count[t["row"][other]] > window, np.minimum(length, window), length)
        plain += zip(other.tolist(), length.tolist(), [size] * len(other))
    values = {int(i): _value(data, t, i) for i in np.flatnonzero(t["kind"] != WORD)}
    # First windows of items whose first word is a name where a sentence goes on before it; their tokens follow the others.
    u, n = template(data, offsets, inside=True), len(t["hash"])
    first = np.flatnonzero(np.r_[True, u["row"][1:] != u["row"][:-1]]) if len(u["row"]) else np.zeros(0, np.int64)
    first = first[u["kind"][first] == NAME]
    short = np.minimum(np.bincount(u["row"], minlength=len(items)), window)[u["row"][first]]
    for size in sorted({int(s) for s in short if s >= SHORTEST}):
        h, at = template_windows(u, size, literal)
        keep = np.isin(at, first[short == size])
        found.append((h[keep], at[keep] + n, np.full(int(keep.sum()), size)))
        values |= {int(i) + n: _value(data, u, i) for f in at[keep] for i in range(f, f + size) if u["kind"][i] != WORD}
    rows = np.r_[t["row"], u["row"]]
    ordinal = np.r_[np.arange(n) - begin[t["row"]], np.zeros(len(u["row"]), np.int64)]

    def table(found: list[tuple], spans: list | None = None) -> dict:
        h, at, size = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        return {"hash": h[order], "at": at[order], "item": rows[at[order]], "ordinal": ordinal[at[order]], "span": (size if spans is None else np.concatenate(spans) if spans else size)[order], "sizes": sorted({int(s) for s in size})}

    raw, spans = [], []
    for length in sorted({n for _, n, _ in plain}):
        at, span = np.array([(i, size) for i, n, size in plain if n == length]).T
        h, every = raw_windows(t, length)
        raw.append((h[np.searchsorted(every, t["lo"][at])], at, np.full(len(at), length)))
        spans.append(span)
    return table(found) | {"raw": table(raw, spans), "values": values, "total": np.maximum(count - size_of + 1, 1), "ids": [x[0] for x in items]}


def _hits(table: dict, size: int, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first token, place in the table) of each window that the table holds."""
    lo = np.searchsorted(table["hash"], h, "left")
    hit = np.flatnonzero(table["hash"][np.minimum(lo, len(table["hash"]) - 1)] == h)
    for i, k in zip(at[hit].tolist(), lo[hit].tolist()):
        value = table["hash"][k]
        while k < len(table["hash"]) and table["hash"][k] == value:
            yield i, k
            k += 1


def matches(batch: pa.RecordBatch, index: dict, literal: float) -> list[tuple[int, int, int, int, int, float, int, float]]:
    """(row, item, windows, slots, changed slots, coverage, consistent windows, their coverage) for each row and item of which a window stands."""
    data, offsets = as_bytes(batch.column("text"))
    t = template(data, offsets)
    pairs: dict[tuple[int, int, int], list[tuple[int, int, int, int, bool]]] = {}
    for size in index["sizes"]:
        for i, k in _hits(index, size, *template_windows(t, size, literal)):
            there = int(index["at"][k])
            pairs.setdefault((int(t["row"][i]), int(index["item"][k]), i - there), []).append((i, there, int(index["ordinal"][k]), size, False))
    raw = index["raw"]
    for size in raw["sizes"]:
        for i, k in _hits(raw, size, *raw_windows(t, size)):
            i, there = int(np.searchsorted(t["lo"], i, "right")) - 1, int(raw["at"][k])
            pairs.setdefault((int(t["row"][i]), int(raw["item"][k]), i - there), []).append((i, there, int(raw["ordinal"][k]), int(raw["span"][k]), True))
    best: dict[tuple[int, int], list] = {}
    for (row, item, _), hits in pairs.items():
        slots: dict[int, bool] = {}
        stands: list[tuple[int, set]] = []
        for i, there, ordinal, size, same in hits:
            means: dict[tuple, tuple] = {}
            stems: dict[tuple, tuple] = {}
            mine: dict[int, bool] = {}
            good = True
            for k in range(size):
                theirs = index["values"].get(there + k)
                if theirs is None:
                    continue
                ours = theirs if same else _value(data, t, i + k)
                good &= means.setdefault(theirs, ours) == ours and stems.setdefault(ours, theirs) == theirs
                mine[there + k] = ours != theirs
            if good:
                stands.append((ordinal, set(means.items())))
                slots |= mine
        if stands:
            x = best.setdefault((row, item), [[], 0, 0])
            x[0].append(stands)
            x[1], x[2] = max(x[1], len(slots)), max(x[2], sum(slots.values()))
    out = []
    for (row, item), (runs, slots, changed) in best.items():
        every = {window for run in runs for window, _ in run}
        agree, total = consistent_windows(runs), int(index["total"][item])
        out.append((row, item, len(every), slots, changed, min(1.0, len(every) / total), len(agree), min(1.0, len(agree) / total)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, literal: float = 0.6, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that share a template window: n_windows, n_slots, n_changed, coverage, n_consistent, consistent_coverage.

    n_windows and coverage count windows that stand each on its own, n_consistent and consistent_coverage those that agree on
    one meaning of each value (at least one does); where the two differ, the document changes a value's meaning on its way.
    Null and empty texts match nothing; items of under ``window`` template tokens have one window. Items of
    under six template tokens (down to one word), and windows of which less than ``literal`` are plain words,
    match verbatim only (case and punctuation aside). Repeated document rows are matched each on its own, repeated
    rows of the benchmark are one item; null ids stay null. An empty table on either side gives no rows; extra columns are not read. A very long text is one chunk.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = int(total // block_bytes) + 1
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_windows long, n_slots long, n_changed long, coverage double, n_consistent long, consistent_coverage double"
    out = None
    for b in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        index = item_index([(r.i, r.t) for r in mine.collect()], window, literal)  # at most about block_bytes of text
        held = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for whole in batches:
                for batch in chunks(whole, "text") if index["sizes"] or index["raw"]["sizes"] else ():
                    if rows := matches(batch, index, literal):
                        row, item, *rest = zip(*rows)
                        out = {"doc_id": batch.column("doc_id").take(pa.array(row))}
                        out["item_id"] = pa.array([index["ids"][i] for i in item], target[1])
                        out |= {k: pa.array(v, pa.float64() if k.endswith("coverage") else pa.int64()) for k, v in zip(("n_windows", "n_slots", "n_changed", "coverage", "n_consistent", "consistent_coverage"), rest)}
                        yield pa.RecordBatch.from_pydict(out)

        from pyspark.sql.pandas.types import to_arrow_type

        target = (None, to_arrow_type(benchmark.schema[item_col].dataType))
        part = narrow.mapInArrow(find, schema)
        if blocks > 1:  # so that one block's index at a time is held
            part = materialise(part)
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})
