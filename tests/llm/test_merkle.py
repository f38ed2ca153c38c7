"""Merkle manifest against brute force: trees of several tiers, nulls, ties and repeated rows."""

import hashlib
import zlib
from collections import Counter

import pytest
from cropgrid.llm import merkle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + 16])))
        at //= 16
    return out


def expected(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row, leaf(row)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: climbed([h for _, h in own]) for s, own in by.items()}
    upper = climbed([trees[s][-1][0] for s in sources])
    for place, s in enumerate(sources):
        for at, (row, own) in enumerate(by[s]):
            steps = path(trees[s], at) + path(upper, place)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            node = leaf((*row[:4], row[4].translate(LOW))) if tampered else own
            for before, after in steps:
                node = digest(before, node, after)
            yield row[0], own, trees[s][-1][0], upper[-1][0], digest(*[a + b for a, b in steps]), node, node == upper[-1][0]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
STRANGE = [
    (3, "one", "en", 4, "Text"), (3, "one", "en", 4, "Text"), (3, "one", "en", 4, "text"), (None, "one", None, None, None), (None, "one", "en", 0, ""),
    (7, None, "en", 2, "nul"), (8, "", "en", 2, "empty source"), (9, "ünï", "é", 5, "🙂 Ä"), (0, "solo", "en", 1, "A"), (-4, "one", "en", 1, "B" * 70_000),
]


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", leaf string, position int").repartition(7)
    found = merkle.checked(frame)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in found.collect()) == Counter(expected(rows))


def test_strange_rows(spark):
    check(spark, STRANGE)
    check(spark, STRANGE[:1])
    assert merkle.checked(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [16, 17, 257, 4097])
def test_sizes(spark, n):
    check(spark, [(i * 3, "hot", "en", i, f"Text {i}") for i in range(n)] + STRANGE)


def test_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    check(spark, [(i, "hot" if i % 3 else f"s{i % 700}", "en", i, f"Text {i}") for i in range(900)] + STRANGE)


def test_proofs_hold(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"lower {i}") for i in range(120)]
    assert all(r.verified for r in merkle.checked(spark.createDataFrame(rows, SCHEMA)).collect())
