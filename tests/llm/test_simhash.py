"""SimHash groups against brute force, with nulls, empty and long texts, ties and repeated rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from cropgrid.llm import simhash
from cropgrid.llm.textbytes import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "é", "st", "or", "Ing", "x,"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """{doc_id: smallest doc_id reachable} by comparing all fingerprints."""
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = [(i, fingerprint(t)) for i, t in rows if i is not None]
    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


BASE, LONG = prose(1, 600), prose(3, 9000)
TEXTS = [
    (0, None), (1, ""), (2, "  \n\t "), (3, "one two"), (4, "One  TWO"), (5, "one two three"), (6, BASE), (7, BASE),
    *((10 + k, edited(BASE, k, 1 + k % 4)) for k in range(60)), (80, LONG), (81, edited(LONG, 4, 12)), (82, "word " * 400), (83, "a b " * 300),
    (84, BASE), (84, "another text\nof one id"), (85, "another text\nof one id"), (-5, "another text of one id"), (None, BASE), (None, None), (90, "é" * 400),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, print string, component_id int").repartition(5)


def test_groups(docs):
    of = components(TEXTS)
    expected = [(i, f"{fingerprint(t):016x}", of.get(i)) for i, t in TEXTS]
    assert len({x for _, x, _ in expected}) > len(set(of.values())) + 5  # links between different fingerprints join groups
    found = simhash.groups(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(tuple(r) for r in found.collect()) == Counter(expected)
    assert simhash.groups(docs.limit(0)).count() == 0


def test_every_link_once(docs):
    prints = sorted({fingerprint(t) for i, t in TEXTS if i is not None})
    signed = [x - (x >> 63 << 64) for x in prints]
    expected = Counter((min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2)
    assert expected and Counter(tuple(r) for r in simhash.links(docs).collect()) == expected


def test_long_texts_are_counted_in_chunks(monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in TEXTS], pa.string())})
    monkeypatch.setattr(simhash, "CHUNK", 37)
    _, data, offsets = next(slices(iter([batch]), "text"))
    assert simhash.fingerprints(data, offsets).tolist() == [fingerprint(t) for _, t in TEXTS]


def test_points_meet(spark):
    r = np.random.default_rng(4)
    seeds = r.integers(-2**63, 2**63 - 1, 50)
    flips = [int(s) ^ (1 << int(b)) ^ (1 << int(c)) for s in seeds for b, c in r.integers(0, 63, (20, 2))]
    values = sorted({*map(int, seeds), *flips})
    expected = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if ((a ^ b) % 2**64).bit_count() <= 2}
    frame = spark.createDataFrame([(v,) for v in values], "print long").repartition(3)
    assert {tuple(x) for x in simhash.met(frame, True).collect()} == expected
    stars = {tuple(x) for x in simhash.met(frame, False).collect()}
    assert stars <= expected
