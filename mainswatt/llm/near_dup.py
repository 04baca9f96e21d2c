"""Near-duplicate join on word shingles by chosen paths.

Documents are sets of shingles of ``shingle`` words, drawn as ``TOKENS`` min-hash tokens, so that two sets
share each token with their Jaccard similarity as probability. A run splits all sets by a recursion: each node
chooses one of the tokens, and with probability 1 / threshold - 1 a second one, by the hash of its path; a set
goes on to the child of each value it has there, so a pair at the threshold is expected to stay together in one
child of a node. A node of ``bucket`` sets or fewer is a leaf, compared by brute force on sketches; one of more sets
at depth ``DEEPEST``, as many texts near each other make it, is compared block against block.

Runs are repeated until the target recall. How many that takes follows from the depth at which sets come to
rest (:func:`runs_for`): most rest at once and leave after a few runs; those in crowded nodes, as a passage that
a third of all documents quote makes them, go on for as many as their deepest leaf asks for. Equal texts (word
by word) count as one set throughout.

Leaves give candidate links (estimated similarity well under the threshold), links give candidate groups.
Within a group every pair is compared exactly, so links are counted exactly; groups of many sets are compared
block against block, no pair being written. Verified links give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import few_files, materialise
from .common import _BASE, as_bytes, chunks, lower, mix, prefix_hash, signed, span_hash, windows, words
from .components import components

TOKENS = SKETCH = 128
"""Tokens that paths choose from (whole, as among many sets short ones are equal by chance), and bytes of the sketch that leaves compare: each token's last."""
BUCKET = 2048
DEEPEST = 8
"""Levels of splitting; sets that are still many in a node then are mostly near each other."""


def sets_of(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes (repeats included), the row of each, and a hash of each row's words."""
    data, offsets = as_bytes(lower(column))
    s, e, row = words(data, offsets)
    h = span_hash(prefix_hash(data), s, e)
    value, at = windows(h, row, shingle)
    key = np.zeros(len(column), np.uint64)
    if len(h):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        with np.errstate(over="ignore"):
            key[row[first]] = mix(np.add.reduceat(mix(h + place.astype(np.uint64) * np.uint64(_BASE)), first))
    return value, row[at], key


def tokens_of(value: np.ndarray, row: np.ndarray, count: int = TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their min-hash tokens."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    out = np.empty((len(first), count), np.uint32)
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    if len(first):
        with np.errstate(over="ignore"):
            for k in range(count):
                out[:, k] = np.minimum.reduceat(((value ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))) >> np.uint64(32), first)
    return row[first], out


def root_of(run: np.ndarray) -> np.ndarray:
    """The path of a run's root."""
    return mix(run.astype(np.uint64) + np.uint64(1))


def children_of(path: np.ndarray, tokens: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and path of each child that the sets (their node, their tokens) go to."""
    chosen = mix(path ^ np.uint64(0x5851F42D4C957F2D))
    first = (chosen % np.uint64(TOKENS)).astype(np.int64)
    step = 1 + ((chosen >> np.uint64(16)) % np.uint64(TOKENS - 1)).astype(np.int64)
    more = np.flatnonzero((chosen >> np.uint64(40)).astype(np.float64) < second * 2.0**24)
    row = np.r_[np.arange(len(path)), more]
    at = np.r_[first, (first[more] + step[more]) % TOKENS]
    with np.errstate(over="ignore"):
        return row, mix(path[row] * np.uint64(_BASE) + (at.astype(np.uint64) << np.uint64(32)) + tokens[row, at].astype(np.uint64))


def survival(share: np.ndarray, depth: int, second: float) -> np.ndarray:
    """Probability that two sets with this share of equal tokens are together in a node of ``depth`` in one run.

    The root counts with one chosen token: all pairs have the same root, so its second one is no chance of their own.
    """
    out = np.ones_like(share)
    for _ in range(depth - 1):
        out = (1 - second) * share * out + second * (1 - (1 - share * out) ** 2)
    return share * out


def runs_for(depth: int, threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met at ``depth`` or before; a tenth of the loss is left to :func:`least_share`.

    Runs draw from the same tokens, so the chance is taken over the number of tokens that the pair shares.
    """
    k = np.arange(TOKENS + 1)  # of those that the pair may share
    weight = np.array([math.comb(TOKENS, int(i)) * threshold**i * (1 - threshold) ** (TOKENS - i) for i in k])
    miss = 1 - survival(k / TOKENS, depth, 1 / threshold - 1)
    runs = 1
    while (weight * miss**runs).sum() > 0.9 * (1 - recall):
        runs += 1
    return runs


def least_share(threshold: float, recall: float) -> float:
    """The greatest share of equal sketch bytes that a pair at the threshold falls short of by a tenth of the loss at most."""
    below, k = 0.0, 0
    while (below := below + math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)) <= (1 - recall) / 10:
        k += 1
    return k / SKETCH


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node of its component) of a symmetric boolean matrix, roots left out."""
    out, seen = [], np.zeros(len(near), bool)
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root] = True
        edge = near[root] & ~seen
        while edge.any():
            seen |= edge
            out += [(int(x), root) for x in np.flatnonzero(edge)]
            edge = near[edge].any(axis=0) & ~seen
    return out


def _square(half: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """A symmetric matrix over ``n`` nodes from a block of it."""
    out = np.zeros((n, n), bool)
    out[np.ix_(left, right)] = half
    return out | out.T


def _blocks(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Deal the rows of each key to blocks, and each block to every pair of blocks (lo, hi) that it is part of.

    A key of m rows makes blocks of 4 sqrt(m) rows, 128 to 2048; rows are replicated by the number of blocks.
    """
    k = F.ceil(F.col(size) / F.greatest(F.lit(128), F.least(F.lit(2048), F.floor(4 * F.sqrt(F.col(size))))))
    dealt = rows.withColumn("blocks", k.cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(key), "doc"), F.col("blocks")).cast("int"))
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")


def _marked(rows: DataFrame, ids: DataFrame, bits: int = 1 << 27) -> DataFrame:
    """``rows`` whose doc may be one of ``ids``: all that are, and others by chance as ``ids`` nears ``bits``.

    The bitmap is broadcast in pages; it has ``bits`` bits (16 MB) at most, however many ids there are.
    """
    return _bit(rows, ids, bits, "inner").filter("bit = 1").select(rows.columns)


def _bit(rows: DataFrame, ids: DataFrame, bits: int, how: str) -> DataFrame:
    """``rows`` with the ``bit`` that ``ids`` set at the place of their doc."""
    place = F.pmod(F.xxhash64("doc"), F.lit(bits))
    page, at = F.shiftright(place, 15), place.bitwiseAND(F.lit(32767))
    pages = ids.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(at).alias("held"))
    byte = F.conv(F.hex(F.col("held").substr((F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(pages), page == F.col("page"), how).withColumn("bit", F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", bits: int = 1 << 24) -> DataFrame:
    """``docs`` less those whose id is one of ``ids`` (doc, distinct; read twice, as are ``docs``). Null ids stay.

    A broadcast bitmap of ``bits`` bits (2 MB) tells most of those that stay; only the others meet the ids in a shuffle.
    """
    told = _told(docs, ids, id_col, bits)
    # No anti join: Spark would move it below the bitmap's join, where all rows are shuffled.
    maybe = told.filter("bit = 1").join(ids.select("doc", F.lit(True).alias("__gone")), "doc", "left").filter("__gone is null")
    return told.filter("bit is null or bit = 0").select("__row.*").union(maybe.select("__row.*"))


def only(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", bits: int = 1 << 24) -> DataFrame:
    """The other rows of :func:`without`, by an inner join, as Spark would move a semi join too."""
    return _told(docs, ids, id_col, bits).filter("bit = 1").join(ids, "doc").select("__row.*")


def _told(docs: DataFrame, ids: DataFrame, id_col: str, bits: int) -> DataFrame:
    """The rows as ``__row``, their id as ``doc``, and its ``bit``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").cast(ids.schema["doc"].dataType).alias("doc"))
    return _bit(rows, ids, bits, "left")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second block of a task (the same ones where the blocks are one)."""
    block, lo, hi = (table.column(c).to_numpy() for c in ("block", "lo", "hi"))
    return np.flatnonzero(block == lo), np.flatnonzero(block == hi)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def near_sketches(table: pa.Table, least: float) -> pa.Table:
    """A spanning forest of the pairs of one block task whose share of equal sketch bytes is at least ``least``."""
    doc = table.column("doc").to_numpy()
    order = np.argsort(doc, kind="stable")
    table, doc = table.take(pa.array(order)), doc[order]
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    left, right = _sides(table)
    half = np.zeros((len(left), len(right)), bool)
    other = np.ascontiguousarray(sketch[right])
    for at, i in enumerate(left):
        half[at] = (other == sketch[i]).sum(axis=1) >= least * SKETCH
    pairs = _forest(_square(half, left, right, len(doc)))
    return pa.table({"a": pa.array([doc[r] for _, r in pairs], pa.int64()), "b": pa.array([doc[x] for x, _ in pairs], pa.int64())})


def near_leaves(table: pa.Table, least: float) -> pa.Table:
    """Spanning forests of the near pairs of many leaves at once: every two sets of a leaf are compared."""
    doc, path = table.column("doc").to_numpy(), table.column("path").to_numpy()
    order = np.lexsort((doc, path))
    doc, path = doc[order], path[order]
    sketch = np.frombuffer(b"".join(table.column("sketch").take(pa.array(order)).to_pylist()), np.uint8).reshape(-1, SKETCH)
    start = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    size = np.diff(np.r_[start, len(path)])
    two = start[size == 2]
    near = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= least * SKETCH]
    a, b = [doc[near]], [doc[near + 1]]
    for lo, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        mine = sketch[lo : lo + n]
        close = np.array([(mine == x).sum(axis=1) >= least * SKETCH for x in mine])
        if int(close.sum()) > n:
            pairs = np.array(_forest(close))
            a.append(doc[lo + pairs[:, 1]]), b.append(doc[lo + pairs[:, 0]])
    return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def candidate_links(reps: DataFrame, n: int, threshold: float, recall: float, bucket: int) -> DataFrame:
    """a, b: links that join all pairs of ``reps`` (doc, tokens, sketch; ``n`` rows) that are likely near, by chosen paths.

    All runs of a depth go level by level at the same time. Sets that came to rest deeper than their runs allow
    for go on with further runs, from the root, until none is left.
    """
    second, guess = 1 / threshold - 1, least_share(threshold, recall)
    # Few sets are split or run again, so the others' tokens stay out of the shuffle; as for filters, a bitmap of 2 MB tells them.
    of = lambda ids: _marked(reps.select("doc", "tokens"), ids.select("doc"), 1 << 24)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lo, hi = (batch.column(c).to_numpy() for c in ("lo", "hi"))
                row = np.repeat(np.arange(batch.num_rows), hi - lo)
                run = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
                child, path = children_of(root_of(run), _tokens(batch.column("tokens"))[row], second)
                taken = pa.array(row[child])
                yield pa.RecordBatch.from_pydict({"doc": batch.column("doc").take(taken), "path": pa.array(signed(path))})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16384):
                batch = whole.slice(at, 16384)
                child, path = children_of(batch.column("path").to_numpy().view(np.uint64), _tokens(batch.column("tokens")), second)
                taken = pa.array(child)
                yield pa.RecordBatch.from_pydict({"doc": batch.column("doc").take(taken), "path": pa.array(signed(path))})

    def leaf_links(leaves: DataFrame, rows: int) -> DataFrame:
        dealt = leaves.withColumn("task", F.pmod(F.xxhash64("path"), F.lit(rows // 4096 + 1)))
        return dealt.groupBy("task").applyInArrow(lambda t: near_leaves(t, guess), "a long, b long")

    if n <= bucket:
        return leaf_links(reps.select("doc", F.lit(0).cast("long").alias("path"), "sketch"), n)
    shape = "doc long, path long"
    runs = [0, runs_for(1, threshold, recall)]  # by depth
    wanted = reps.select("doc", "tokens", F.lit(0).alias("lo"), F.lit(runs[1]).alias("hi"))
    nodes, crowds, rest = [], [], None  # rest: doc and the depth that its runs allow for
    while True:
        rows, level, opened = wanted.mapInArrow(first, shape), 1, []
        while True:
            rows = materialise(few_files(rows) if nodes else rows)
            sizes = materialise(few_files(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")))
            nodes.append((rows, sizes))
            if level > 1:
                opened.append(rows.select("doc", F.lit(level).alias("depth")))
            big = sizes.filter(F.col("n") > bucket)
            total = big.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if not total:
                break
            # Nodes of more than a bucket are one in so many of all rows at most, so their table is broadcast; crowded ones need no split then.
            going = rows.select("doc", "path").join(F.broadcast(big.select("path", F.col("n").alias("size"))), "path")
            if level == DEEPEST:
                crowds.append(going)
                break
            level += 1
            rows = going.join(of(going), "doc").select("doc", "path", "tokens").mapInArrow(split, shape)
        if not opened:
            break
        runs += [runs_for(d, threshold, recall) for d in range(len(runs), level + 1)]
        allowed = lambda depth: F.element_at(F.array(*map(F.lit, runs[1:])), depth)
        deep = reduce(DataFrame.unionByName, opened).groupBy("doc").agg(F.max("depth").alias("depth"))
        grown = deep.withColumn("before", F.lit(1)) if rest is None else deep.join(rest.withColumnRenamed("depth", "before"), "doc", "left").withColumn("before", F.coalesce("before", F.lit(1))).filter(F.col("depth") > F.col("before"))
        grown = materialise(grown.select("doc", "depth", allowed(F.col("before")).alias("lo"), allowed(F.col("depth")).alias("hi")))
        if grown.isEmpty():
            break
        rest = grown.select("doc", "depth") if rest is None else rest.unionByName(grown.select("doc", "depth")).groupBy("doc").agg(F.max("depth").alias("depth"))
        wanted = of(grown).join(grown.select("doc", "lo", "hi"), "doc").select("doc", "tokens", "lo", "hi")
    met = reduce(DataFrame.unionByName, [r.select("doc", "path").join(s.filter(F.col("n") <= bucket).select("path"), "path") for r, s in nodes])
    met = materialise(few_files(met))
    out = leaf_links(met.join(reps.select("doc", "sketch"), "doc"), met.count())
    if crowds:
        tasks = _blocks(reduce(DataFrame.unionByName, crowds).join(reps.select("doc", "sketch"), "doc"), "bucket", "size").select("path", "lo", "hi", "block", "doc", "sketch")
        out = out.unionByName(tasks.groupBy("path", "lo", "hi").applyInArrow(lambda t: near_sketches(t, guess), "a long, b long"))
    return out


def shared_counts(value: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections between the sets ``left`` and ``right``; shingles in many sets by matrix product."""
    _, column, df = np.unique(value, return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(n, -1), np.full(n, -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    many = df > max(8, n // 16)
    number = np.cumsum(many) - 1
    use = many[column]
    r, c = row[use], number[column[use]]
    for lo in range(0, int(many.sum()), 4096):
        x = np.zeros((n, min(4096, int(many.sum()) - lo)), np.float32)
        here = (c >= lo) & (c < lo + 4096)
        x[r[here], c[here] - lo] = 1
        out += x[left] @ x[right].T
    use = (df > 1)[column] & ~use
    order = np.argsort(column[use], kind="stable")
    r, c = row[use][order], column[use][order]
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True]) if len(c) else np.zeros(1, np.int64)
    size = np.diff(start)
    for k in np.unique(size):
        group = r[start[:-1][size == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(k):
                a, b = place_l[group[:, i]], place_r[group[:, j]]
                ok = (a >= 0) & (b >= 0)
                np.add.at(out, (a[ok], b[ok]), 1)
    return out


def near_sets(table: pa.Table, threshold: float) -> pa.Table:
    """Link counts (a, links) and a spanning forest (a, b) of the exact links of one group task."""
    doc = table.column("doc").to_numpy()
    order = np.argsort(doc, kind="stable")
    table, doc = table.take(pa.array(order)), doc[order]
    held = [np.frombuffer(x, np.uint64) for x in table.column("held").to_pylist()]
    size = np.array([len(x) for x in held])
    row = np.repeat(np.arange(len(doc)), size)
    left, right = _sides(table)
    same = shared_counts(np.concatenate(held), row, left, right, len(doc)).astype(np.int64)
    union = size[left][:, None] + size[right][None] - same
    linked = same >= threshold * union - 1e-9
    one = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    if one:
        linked &= left[:, None] != right[None]
    links = np.zeros(len(doc), np.int64)
    links[left] += linked.sum(axis=1)
    if not one:
        links[right] += linked.sum(axis=0)
    pairs = _forest(_square(linked, left, right, len(doc)))
    some = np.flatnonzero(links)
    return pa.table({
        "a": pa.array(np.r_[doc[some], [doc[r] for _, r in pairs]].astype(np.int64)),
        "b": pa.array([None] * len(some) + [int(doc[x]) for x, _ in pairs], pa.int64()),
        "links": pa.array(np.r_[links[some], np.zeros(len(pairs), np.int64)].astype(np.int64)),
    })


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.9999, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, n_links, copy_of, n_copies.

    ``copy_of`` is the least document of equal words (lower-cased), ``n_copies`` how many documents have them;
    ``n_links`` counts the other such texts of similarity ``threshold`` or more; ``class_id`` is the least
    document of the class that links and copies join. Texts of fewer than ``shingle`` words are one shingle.
    Null, empty and blank texts have no shingles: each is a class of its own. Rows with a null id come back with
    a null class. Repeated rows of one id are one document. An empty table gives no rows; other columns are not
    read, whatever their names. Texts of any length are one set, of all their shingles. Ids are whole numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                value, row, key = sets_of(batch.column("text"), shingle)
                have, tokens = tokens_of(value, row)
                sketch = (tokens[:, :SKETCH] & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column("doc").take(pa.array(have)), "key": pa.array(signed(key[have])),
                    "tokens": pa.array([x.tobytes() for x in tokens], pa.binary()), "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()),
                })

    signs = materialise(rows.mapInArrow(sign, "doc long, key long, tokens binary, sketch binary"))
    texts = materialise(signs.groupBy("key").agg(F.min("doc").alias("rep"), F.countDistinct("doc").alias("n_copies")))
    reps = materialise(signs.join(texts.select(F.col("rep").alias("doc"), "key"), ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"]).select("doc", "tokens", "sketch"))
    edges = candidate_links(reps, reps.count(), threshold, recall, bucket)
    groups = materialise(components(edges))
    rooted = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = rooted.groupBy("root").agg(F.count("*").alias("size"))
    placed = rooted.join(sizes, "root").select(F.col("node").alias("doc"), "root", "size")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                value, row, _ = sets_of(batch.column("text"), shingle)
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
                value, row = value[new], row[new]
                edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
                held = [value[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "root": batch.column("root"), "size": batch.column("size"), "held": pa.array(held, pa.binary())})

    # Ids meet a bitmap of bounded size first, so texts outside of groups stay out of the shuffle; then the ids
    # themselves. Rows of one id are made one before the sets are built, where the join has them side by side.
    chosen = _marked(rows, placed).join(placed, "doc").dropDuplicates(["doc"])
    wanted = chosen.mapInArrow(hold, "doc long, root long, size long, held binary")
    exact = _blocks(wanted, "group", "size").groupBy("root", "lo", "hi").applyInArrow(lambda t: near_sets(t, threshold), "a long, b long, links long")
    exact = materialise(few_files(exact))
    classes = components(exact.filter("b is not null").select("a", "b"))
    counted = exact.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    texts = texts.join(counted, "rep", "left").join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left")
    of_doc = signs.select("doc", "key").distinct().join(texts, "key")
    of_doc = of_doc.select(F.col("doc").alias("__doc"), F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("rep").alias("copy_of"), "n_copies")
    ids = docs.select(F.col(id_col).cast("long").alias(id_col))
    out = ids.join(of_doc, F.col(id_col) == F.col("__doc"), "left")
    return out.select(id_col, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_of", id_col).alias("copy_of"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
