"""Shared by the operators: byte-level views of Arrow text columns.

Text columns are never turned into Python strings where bytes will do: a chunk of documents is one
``uint8`` array with offsets, and words, shingles and windows are found with whole-array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
"""Bytes of text handled at once; a longer document makes a chunk of its own."""

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``limit`` bytes of text each, or of one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and each row's offset in them (null counts as empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first ``n`` powers and their inverses, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the bytes, with a leading 0; feed it to :func:`span_hash`."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)``; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a run without white space (``space`` by byte) inside one row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | cut[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def windows(hashes: np.ndarray, row: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of ``size`` words inside one row.

    With ``short``, a row of 1 to ``size - 1`` words has one window, of all its words.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        m = n - size + 1
        if m > 0:
            at = np.flatnonzero(row[:m] == row[size - 1 :])
            value = hashes[at].copy()
            for k in range(1, size):
                value = value * np.uint64(_BASE) + hashes[at + k]
            value = mix(value)
        else:
            at, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if short:
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            count = np.diff(np.r_[first, n])
            few = count < size
            extra = []
            for f, c in zip(first[few].tolist(), count[few].tolist()):
                v = 0x5851F42D4C957F2D + c
                for h in hashes[f : f + c].tolist():
                    v = (v * _BASE + h) & _MASK
                extra.append(v)
            if extra:
                value = np.r_[value, mix(np.array(extra, np.uint64))]
                at = np.r_[at, first[few]]
                order = np.argsort(at, kind="stable")
                at, value = at[order], value[order]
    return value, at


def lower(column: pa.Array) -> pa.Array:
    """Lower case, null as empty."""
    return pc.utf8_lower(pc.fill_null(column, ""))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
