"""Trie of conversations against brute force, in slices of any size, and the radix tree against a dictionary."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from cropgrid.llm import trie
from cropgrid.llm.radix import Tree, common


def expected(turns):
    name = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, name(role or "", text or ""), role or "", text or ""))
    whole = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(x[3:] for x in sorted(own.get(c - c % 100, []))[:h] + sorted(rows)[h:])
    members, ends = {}, {}
    for c, path in whole.items():
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, found in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(found) - 1) * len(p[-1][1]) if p else 0
    for p, found in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        yield (min(found), len(p), min(members[p[:-1]]) if p else None, len(found), kids[p], leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest())


def conversations():
    r = random.Random(8)
    pool = [("user", f"hello {k}") for k in range(4)] + [("assistant", "é🙂" * 5), (None, None), ("", ""), ("user", "x" * 40)]
    turns = []
    for c in [*range(0, 40), *range(100, 230), 300, 350, 401, 777]:
        n = 1 if c in (777, 401) else r.randint(1, 7)
        for t in range(n):
            turns.append((c, t, *(pool[0] if t == 0 and c % 3 else r.choice(pool))))
    turns += [(100 + k, 9, "user", "tail") for k in range(30)]
    turns += [(500 + k, t, "user", f"copy {t}") for k in range(60) for t in range(6)]  # one large group of copies
    turns += [(600, t, "user", f"long {t % 3}") for t in range(300)] + [(601, t, "user", f"long {t % 3}") for t in range(305)]
    turns += [(2, None, "user", "null turn"), (2, None, "user", "null turn"), (3, 1, "a", "tie"), (3, 1, "b", "tie"), (None, 0, "user", "no id"), (12345678901, 5, "user", "alone")]
    return turns


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*t, "clash", 2) for t in conversations()], "conv_id long, turn long, role string, text string, node string, depth int").repartition(5)


@pytest.mark.parametrize("slice_bytes", [trie.SLICE, 3000, 1])
def test_nodes(frame, slice_bytes):
    found = trie.nodes(frame, slice_bytes)
    assert found.columns == trie.RESULT
    assert Counter(tuple(x) for x in found.collect()) == Counter(expected(conversations()))


def test_few_rows(spark):
    for rows in ([], [(5, 0, "user", "x")], [(401, 0, "user", "x")], [(None, None, None, None)], [(0, None, None, None), (0, None, None, None)]):
        found = trie.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert Counter(tuple(x) for x in found.collect()) == Counter(expected(rows))


def test_radix_layouts():
    r = random.Random(3)
    keys = {bytes([a]) + bytes(r.randrange(256) for _ in range(r.randint(0, 5))) for a in range(256) for _ in range(6)} | {b"", b"\0", b"\0\0\0"}
    keys |= {b"long" * 40 + bytes([k]) * 3 for k in range(20)}
    tree, shuffled = Tree(), sorted(keys)
    r.shuffle(shuffled)
    for k in shuffled:
        tree.insert(k, k)
    seen, found, places = [(tree.root, b"")], [], set()
    while seen:
        node, key = seen.pop()
        key += node.prefix
        places.add(node.places)
        if node.ends is not None:
            assert node.ends == key
            found.append(key)
        seen.extend((kid, key + bytes([b])) for b, kid in reversed(list(node.branches())))
    assert found == sorted(keys) and places == {4, 16, 48, 256}


def test_common_beginning():
    r = random.Random(1)
    for _ in range(300):
        a, b = (bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert common(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
