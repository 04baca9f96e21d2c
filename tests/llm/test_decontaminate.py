"""Decontamination against brute force, and consistency over all windows of an item."""

import random

import pytest

from mainswatt.llm import decontaminate

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 7))) for _ in range(60)]
NAMES = ["Alba", "Bruno", "Carla", "Dario", "Elena"]
WORD, NUMBER, UNIT, NAME = range(4)


def sentence(n, rng):
    """Words with a number, a number and its unit, or a name between them; it opens with a word."""
    out = [(WORD, rng.choice(WORDS))]
    while len(out) < n:
        draw = rng.random()
        if draw < 0.12:
            out.append((NUMBER, str(rng.randint(2, 9))))
        elif draw < 0.2:
            out += [(NUMBER, str(rng.randint(2, 9))), (UNIT, rng.choice(["kg", "km", "hours"]))]
        elif draw < 0.3:
            out.append((NAME, rng.choice(NAMES)))
        out.append((WORD, rng.choice(WORDS)))
    return out


def renamed(tokens, rng, from_=0):
    """Other values from a place on, each value of a kind always by the same other one."""
    pools = {NUMBER: [str(x) for x in range(20, 60)], UNIT: ["cm", "days", "lb"], NAME: ["Fabio", "Gina", "Hugo", "Iris", "Jona"]}
    for pool in pools.values():
        rng.shuffle(pool)
    new = {}
    out = list(tokens[:from_])
    for kind, value in tokens[from_:]:
        if kind != WORD:
            if (kind, value) not in new:
                new[kind, value] = pools[kind][len([k for k in new if k[0] == kind])]
            value = new[kind, value]
        out.append((kind, value))
    return out


def text(tokens):
    return " ".join(v for _, v in tokens)


def by_hand(doc, item, window=13, literal=0.6):
    """Windows of ``item`` that stand somewhere in ``doc``."""
    size = min(len(item), window)
    found = set()
    for o in range(len(item) - size + 1):
        mine = item[o : o + size]
        plain = sum(k == WORD for k, _ in mine) >= literal * size
        for d in range(len(doc) - size + 1):
            theirs = doc[d : d + size]
            if (not plain or o == 0) and [v.lower() for _, v in mine] == [v.lower() for _, v in theirs]:
                found.add(o)
            if plain and all(a[0] == b[0] and (a[0] != WORD or a[1] == b[1]) for a, b in zip(mine, theirs)):
                slots = {(a, b) for a, b in zip(mine, theirs) if a[0] != WORD}
                if len({a for a, _ in slots}) == len({b for _, b in slots}) == len(slots):
                    found.add(o)
    return found, len(item) - size + 1


def test_windows_equal_brute_force(spark):
    rng = random.Random(3)
    items = {i: sentence(rng.randint(9, 30), rng) for i in range(24)}
    items[24] = items[3]
    docs = {}
    for d in range(72):
        item = items[d % 24]
        middle = [item, renamed(item, rng), renamed(item, rng, len(item) // 2), item[: len(item) // 2] + [(WORD, "inserted")] + item[len(item) // 2 :]][rng.randint(0, 3)]
        docs[d] = sentence(rng.randint(5, 40), rng) + middle + sentence(rng.randint(5, 40), rng)[:1] + sentence(rng.randint(2, 20), rng)
    table = spark.createDataFrame([(d, text(t)) for d, t in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, text(t)) for i, t in items.items()], "item_id long, text string")
    want = {}
    for d, doc in docs.items():
        for i, item in items.items():
            found, total = by_hand(doc, item)
            if found:
                want[d, i] = (len(found), len(found) / total)
    got = decontaminate.contaminated(table, bench).collect()
    assert len(want) > 50 and {(r.doc_id, r.item_id): (r.n_windows, r.coverage) for r in got} == want
    assert all(1 <= r.n_consistent <= r.n_windows for r in got)
    # Small blocks, each table repeated: one row a document row and item, the same figures.
    again = decontaminate.contaminated(table.unionAll(table), bench.unionAll(bench), block_bytes=500).collect()
    assert sorted(map(str, again)) == sorted(map(str, got * 2))


@pytest.mark.parametrize(("values", "share"), [("5 5", 1.0), ("9 9", 1.0), ("9 8", 0.6), ("5 8", 0.6)])
def test_consistency_goes_over_all_windows(spark, values, share):
    """An item of 45 words with one number at two places, too far apart for one window."""
    rng = random.Random(1)
    parts = [" ".join(rng.choice(WORDS) for _ in range(15)) for _ in range(3)]
    item = f"{parts[0]} 5 {parts[1]} 5 {parts[2]}"
    a, b = values.split()
    docs = spark.createDataFrame([(1, f"{parts[0]} {a} {parts[1]} {b} {parts[2]}")], "doc_id long, text string")
    (r,) = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert r.coverage == 1 and (r.n_consistent == r.n_windows) == (share == 1) and abs(r.consistent_coverage - share) < 0.07


def test_consistent_windows_by_hand():
    one, two, three = ((1, b"1"), (1, b"7")), ((1, b"1"), (1, b"8")), ((1, b"2"), (1, b"7"))
    assert decontaminate.consistent_windows([[(0, set()), (1, {one}), (2, {one}), (3, {two}), (4, {three})]]) == {0, 1, 2}
    assert decontaminate.consistent_windows([[(3, {two})], [(0, {one}), (1, {one})]]) == {0, 1}
    assert decontaminate.consistent_windows([[(0, {one}), (1, {two})]]) == {0}
    assert decontaminate.consistent_windows([]) == set()
