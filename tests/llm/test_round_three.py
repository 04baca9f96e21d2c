"""Spelling variants, SuperMinHash near duplicates and periodic runs against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mainswatt.llm import periodic, queries, spelling, super_minhash

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, word string, n long")


# --- spelling variants ---------------------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(vocab):
    best = {}
    for w, n in vocab.items():
        others = [(-vocab[v], v) for v in vocab if near(w, v)]
        top = min(others, default=None)
        best[w] = (top[1] if top and -top[0] >= 2 * n else None, len(others))
    out = {}
    for w, n in vocab.items():
        root = w
        while best[root][0]:
            root = best[root][0]
        form = best[w][0]
        out[w] = (form, root, n, best[w][1], vocab[form] if form else None)
    return out


@pytest.mark.parametrize("bits", [spelling.BITS, 1 << 15])  # a filter that holds little lets more through, no less
def test_variants_equal_all_pairs(spark, bits):
    letters = np.array(list("abcéÿ"))
    words = {"".join(RNG.choice(letters, RNG.integers(1, 7))) for _ in range(400)} | {"aaaa", "aaaaa", "aaa", "ab" * 5000, "ab" * 5000 + "c"}
    vocab = {w: int(2 ** RNG.integers(0, 12)) for w in sorted(words)}
    vocab |= {"ccc": 64, "cccc": 32, "ccccc": 16, "cccccc": 8, "ccccccc": 4}  # a chain of forms
    table = spark.createDataFrame(list(vocab.items()), "word string, n long").withColumns({"form": F.lit("x"), "root": F.lit(1)})  # clashing names
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table, bits=bits).collect()}
    assert got == variants_by_hand(vocab)


def test_every_edit_is_made_once():
    for word in ["aab", "b", "abab", "ééa"]:
        points, offsets = spelling._code_points(pa.array([word]))
        letters = [ord(c) for c in "abé"]
        own, made = spelling.neighbours(points, offsets, np.array(letters, np.uint32), lambda h: np.arange(len(h)))
        edits = {word[:i] + word[i + 1 :] for i in range(len(word))}
        edits |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abé"} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abé"}
        assert sorted(made) == sorted(edits - {word}) and not own.any()


def test_words_are_counted_and_damaged(spark, nothing):
    rows = [(i, " ".join(RNG.choice(["Straße", "ÀÖÜ", "hello", "HELLO", "a1b2", "naïve×word"], 60))) for i in range(40)] + [(1, "hello hello"), (None, "hello Zebra"), (50, None), (51, ""), (52, "x" * 70000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    want = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if i is not None and h % 3 == 0 else w] += 1
    counted = spelling.words_of(docs, damage=3)
    got = {r.word: r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    assert got == dict(want)
    least = {r.word: r.n for r in spelling.vocabulary(counted, 5, 3).collect()}
    assert least == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert spelling.variants(spelling.vocabulary(spelling.words_of(nothing, 97))).count() == 0


# --- SuperMinHash --------------------------------------------------------------------------------------------------


def set_of(text, k=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return ({tuple(words)} if words else set()) if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components_by_hand(rows, percent=85):
    sets = [set_of(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else None, find(i) == i if i is not None else None) for (i, _), s in zip(rows, sets))


def edited(words, rate, rng):
    return " ".join(w if rng.random() > rate else f"x{rng.integers(10**6)}" for w in words)


def corpus(seed, dense, loose):
    rng = np.random.default_rng(seed)
    pool = [f"w{k}" for k in range(400)]
    base = list(rng.choice(pool, 120))
    rows = [edited(base, 0.02, rng) for _ in range(dense)]  # a group of near copies, some of them too far
    passage = list(rng.choice(pool, 60))
    rows += [" ".join(passage + list(rng.choice(pool, int(rng.integers(2, 30))))) for _ in range(loose)]  # a passage that many share
    rows += [" ".join(rng.choice(pool, int(rng.integers(1, 90)))) for _ in range(40)]
    rows += [rows[0], rows[1].upper(), None, "", " \t\n", "one two", "One  two", "one", "É é", "é É", " ".join(rng.choice(pool, 30000))]
    out = [(int(k), t) for k, t in zip(rng.permutation(len(rows)), rows)]
    return out + [(out[3][0], out[3][1]), (out[4][0], "words of its own here"), (10**6, "words of its own here"), (None, out[5][1]), (None, None)]


@pytest.mark.parametrize("bucket, dense, loose", [(2048, 60, 60), (8, 60, 60), (4, 90, 10)])
def test_components_equal_all_pairs(spark, bucket, dense, loose):
    rows = corpus(bucket + dense, dense, loose)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "n_shingles": F.lit(7.5)})
    got = super_minhash.near_duplicates(docs, threshold=0.85, shingle=3, recall=0.99999, bucket=bucket).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in got) == components_by_hand(rows)


def test_small_blocks_give_the_same_forest(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 10**6, 200)).astype(np.uint64)]
    for _ in range(60):
        keep = sets[rng.integers(len(sets))].copy()
        keep[rng.integers(0, len(keep), int(rng.integers(0, 16)))] = rng.integers(10**6, 10**7, 1)
        sets.append(np.unique(keep))
    frame = spark.createDataFrame([(k, 0, len(s), bytearray(s.tobytes())) for k, s in enumerate(sets)], "doc long, root long, n long, held binary")
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    for bucket, size in ((2048, 16 << 20), (5, 16 << 20), (2048, 4000)):
        label = list(range(len(sets)))
        for r in super_minhash.verified(frame, 0.85, bucket, size).collect():
            old, new = max(label[r.a], label[r.b]), min(label[r.a], label[r.b])
            label = [new if p == old else p for p in label]
        assert label == parent


def test_signatures_estimate_with_low_variance():
    rng = np.random.default_rng(5)
    errors = []
    for trial in range(60):
        n = 40
        pool = rng.integers(0, 2**63, 3 * n).astype(np.uint64)
        a, b = pool[: 2 * n], pool[n : 3 * n]  # a third in common
        value = np.r_[np.sort(a), np.sort(b)]
        have, s = super_minhash.signatures(value, np.r_[np.zeros(2 * n, int), np.ones(2 * n, int)])
        assert have.tolist() == [0, 1] and (s != super_minhash._EMPTY).all()
        errors.append((s[0] == s[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02
    assert np.var(errors) < (1 / 3 * 2 / 3) / super_minhash.SLOTS  # below that of independent hashes


def test_early_stopping_changes_nothing():
    rng = np.random.default_rng(6)
    value = rng.integers(0, 2**63, 3000).astype(np.uint64)
    row = np.sort(rng.integers(0, 9, 3000))
    row[:2] = [0, 1]
    row.sort()
    have, s = super_minhash.signatures(value, row)
    for k, r in enumerate(have):  # one document at a time, an element at a time, without stopping
        want = np.full(super_minhash.SLOTS, super_minhash._EMPTY, np.uint64)
        for v in value[row == r][:40] if (row == r).sum() > 40 else value[row == r]:
            turn = list(range(super_minhash.SLOTS))
            for j in range(super_minhash.SLOTS):
                with np.errstate(over="ignore"):
                    x = int(super_minhash.mix(np.array([v + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15)]))[0])
                pick = j + (((x & 0xFFFFFFFF) * (super_minhash.SLOTS - j)) >> 32)
                turn[j], turn[pick] = turn[pick], turn[j]
                want[turn[j]] = min(int(want[turn[j]]), (x >> 40) | j << 24)
        sub = value[row == r][:40]
        assert super_minhash.signatures(sub, np.zeros(len(sub), int))[1][0].tolist() == want.tolist()


def test_nothing_has_no_components(spark, nothing):
    assert super_minhash.near_duplicates(nothing).count() == 0


# --- periodic runs -------------------------------------------------------------------------------------------------


def runs_by_hand(x, least=2):
    out = set()
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i + q >= 2 * q and j > i:
                out.add((i, j - i + q, q))
            i = max(j, i + 1) if j == i else j + 1
    small = {(s, n, q) for s, n, q in out if not any(t <= s and s + n <= t + m and p < q and q % p == 0 for t, m, p in out)}
    return sorted((s, n, q) for s, n, q in small if n >= max(least, 2 * q))


def test_runs_of_letters_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rng.integers(0, 50))
        x = rng.integers(0, int(rng.integers(1, 5)), n)
        if n > 3 and rng.random() < 0.5:
            p, s = int(rng.integers(1, n // 2 + 1)), int(rng.integers(0, n))
            x[s:] = [x[s + (i - s) % p] for i in range(s, n)]
        got = sorted(zip(*(a.tolist() for a in periodic.runs_in(x))))
        assert got == runs_by_hand(x.tolist())


def test_fibonacci_words_have_overlapping_runs():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert sorted(zip(*(x.tolist() for x in periodic.runs_in(np.array(b))))) == runs_by_hand(b)


def periodic_rows():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in rng.integers(0, 40, int(rng.integers(0, 200)))]
        for _ in range(int(rng.integers(0, 4))):
            unit = [f"u{k}" for k in rng.integers(0, 3, int(rng.integers(1, 9)))]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = (unit * 12)[: int(rng.integers(2, 40))]
        rows.append((i, str(rng.choice([" ", "\n", "\t \x0b"])).join(words)))
    line = "the same long line of a few words here\n"
    return rows + [(100, None), (101, ""), (102, " \n "), (103, "a " * 5000), (104, line * 3 + "x " + line), (105, "ab\x1cab " * 12), (106, line + "y " + line + "z"), (3, rows[3][1]), (None, "b c " * 9), (107, "é ü " * 7)]


def test_runs_of_texts(spark, nothing):
    rows = periodic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "collapsed": F.lit("x")})
    got = periodic.periodic_runs(docs).collect()
    want = []
    for i, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        runs = runs_by_hand(words, 12)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[3])
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=key) == sorted(want, key=key)
    assert periodic.periodic_runs(nothing).count() == 0


def test_long_pieces_are_searched_alone(spark, monkeypatch):
    texts = [f"{'p q r s t ' * 40}{k} {'m n ' * 30}" for k in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    table = pa.array(texts)
    data, offsets = periodic.as_bytes(table)
    whole = periodic.runs_of_rows(data, *periodic.words(data, offsets, periodic.SPACE))
    monkeypatch.setattr(periodic, "TOGETHER", 50)
    parts = periodic.runs_of_rows(data, *periodic.words(data, offsets, periodic.SPACE))
    assert sorted(zip(*map(list, whole))) == sorted(zip(*map(list, parts))) and len(whole[0]) == 40
    assert periodic.periodic_runs(docs).filter("size(runs) = 2").count() == 20


def test_tails_and_digests(spark):
    rows = periodic_rows() + [(k, " ".join(f"v{j}" for j in range(k % 37))) for k in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.collapsed_sha256, r.runs_sha256, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periodic.digests(periodic.periodic_runs(periodic.repeat_tails(docs))).collect()}
    want = set()
    for i, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        n = len(words)
        if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = runs_by_hand(words, 12)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.add((i, digest(" ".join(w for k, w in enumerate(words) if k not in gone)), digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), len(runs), s, m, q, 1000 * m // q if runs else None))
    assert got == want and any(x[3] for x in want)


def test_new_queries_are_registered():
    assert {"op11_spelling_variants", "op12_superminhash", "op13_periodic_runs"} <= set(queries.queries()) & set(queries.oracle_sql())


def test_entries_of_a_unit_go_in_few_batches():
    from mainswatt.llm import suffixes

    sizes, docs = np.array([50, 60, 51, 70]), np.array([7, 2**40, 3, 9])
    text = np.arange(sizes.sum()).astype(np.uint8)
    table = pa.table(suffixes._segment_entries(np.array([4, 9]), 5, np.array([0, 1, 4]), sizes, docs, text))
    assert table.select(["bucket", "unit"]).to_pylist() == [{"bucket": 4, "unit": 5}, {"bucket": 9, "unit": 5}]
    assert table.column("text").to_pylist() == [text[:50].tobytes(), text[50:].tobytes()]
    each, s, d, t = suffixes._segments_in(table)
    assert each.tolist() == [1, 3] and s.tolist() == sizes.tolist() and d.tolist() == docs.tolist() and t.tolist() == text.tolist()
    assert suffixes._strings_of(each, s, 50) == [1, 11 + 2 + 21]
