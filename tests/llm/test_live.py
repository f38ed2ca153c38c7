"""A credential under a few of many sources is masked; one that most sources copy is an example and stays."""

import random
import re
import time

from cropgrid.llm import secrets_scan, stages
from pyspark.sql import functions as F


def test_few_owners_are_live(spark):
    real, example = "AKIA0REALREALREAL0", "AKIA0EXAMPLEEXAMPLE"
    rows = [(i, f"doc {i} has {example} in it" + (f" and {real}" if i in (3, 7) else ""), "en", f"s{i}", 1) for i in range(12)]
    rows += [(20 + i, "plain", "en", f"s{i}", 5) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for r in secrets_scan.scan(docs).where("size(verdicts) > 0").collect():
        for v in r.verdicts:
            value = r._doc.text[v.start:v.end]
            assert (v.owners, v.live) == ((2, True) if value == real else (12, False))
    masked = {r.doc_id: r.text for r in stages.secret_masking(spark, docs, "").collect()}
    assert len(masked) == len(rows) and not any(real in t for t in masked.values())
    assert masked[3] == f"doc 3 has {example} in it and [SECRET]"
    # too few owners to call anything widely copied
    one = docs.where("source = 's3'")
    assert all(v.live for r in secrets_scan.scan(one).collect() for v in r.verdicts)


def by_hand(text, spans):
    """`text` with the unions of (start, end) masked, span by span."""
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + secrets_scan.MASK
        at = max(at, end)
    return out + text[at:]


def test_masks_by_hand(spark):
    random.seed(4)
    rows = []
    for i in range(60):
        text = "".join(random.choice("abc \n\u00e9\U0001f600") for _ in range(random.choice([1, 5, 255, 256, 257, 513, 3000])))
        spans = sorted((a, min(len(text), a + random.randint(1, random.choice([3, 600])))) for a in random.choices(range(len(text)), k=random.choice([0, 1, 2, 3, 9, 70])))
        rows.append((i, text, [(a, b, random.random() < 0.8) for a, b in spans]))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,end:int,live:boolean>>")
    found = {r.i: r.m for r in df.select("i", secrets_scan.masked("text", "spans").alias("m")).collect()}
    assert found == {i: by_hand(text, [(a, b) for a, b, live in spans if live]) for i, text, spans in rows}


def test_long_texts(spark):
    """20,000 values in one text: places as a plain search finds them, in a time that does not grow with their square."""
    text = " \U0001f600 ".join(f"{i:016x}" for i in range(20000))
    docs = spark.createDataFrame([(1, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int")
    start = time.time()
    spans = secrets_scan.found(docs).first().spans
    assert [(s.start, s.end) for s in spans if s.kind == "hex"] == [m.span() for m in re.finditer("[0-9a-f]{16,}", text)]
    assert stages.secret_masking(spark, docs, "").first().text == by_hand(text, [(s.start, s.end) for s in spans])
    assert time.time() - start < 60


def test_common_values_and_strange_rows(spark):
    """A value that most rows hold (met by broadcast) and rare ones (met by shuffle), repeated rows, clashing names, no rows."""
    kinds = "doc_id long, text string, lang string, source string, _row long, spans string, verdicts string, owner string"
    rows = [(i, "key AKIA0HOTHOTHOTHOT0 " * 3, "en", "s", 1, "x", "y", "z") for i in range(700)]
    rows += [(i, f"hex {i:032x}", None, None, None, None, None, None) for i in range(700, 1400)] + [(None, None, None, None, None, None, None, None)] * 2 + [(5, "", "en", "s", 1, "", "", "")]
    docs = spark.createDataFrame(rows, kinds)
    found = secrets_scan.scan(docs)
    assert found.select("_doc.*").columns == docs.columns
    uses = {(r.n, r.uses): r["count"] for r in found.select(F.size("verdicts").alias("n"), F.get("verdicts", F.lit(0)).uses.alias("uses")).groupBy("n", "uses").count().collect()}
    assert uses == {(3, 2100): 700, (1, 1): 700, (0, None): 3}
    assert sorted(map(tuple, found.select("_doc.*").collect()), key=str) == sorted(rows, key=str)
    assert secrets_scan.scan(docs.limit(0), keep=("doc_id",)).count() == 0
