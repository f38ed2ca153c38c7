"""Quality rules: an ordered decision list, learned from labelled statistics and run as Spark conditions.

Rejecting rules are grown one after the other (sequential covering): conditions `statistic >= bound` or
`statistic < bound` are added while they raise FOIL's gain on two thirds of the labelled rows, then cut
back on the rest, and the rows that a rule covers leave the training set. The result is a list of
conjunctions that `verdict` turns into one ordered CASE expression.

Defined cases: a null or empty text has no words and fails the base rule (fewer than ten words). Ties in
the gain go to the statistic named first and to the lower bound. Repeated rows each get their own verdict.
Texts of one `lang` (all of them, if there is no such column) have their own marks of toxicity, so that a smaller
language is judged by its own toxic texts. A null `lang` counts as one language. For the fit, a row's marks are counted with
those of the other half of the rows, so that a bound on them is judged as on unseen texts. Without labels, or with labels
of one kind only, the list is empty and the base rule decides alone. Labels without an id, or both of whose marks are null, are ignored; several labels of one id count as the worst.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropgrid.llm import textbytes as tb
from cropgrid.session import kept_table

#: The fit uses this many labelled documents at most, those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: A word is a mark if so large a share of one language's toxic texts has it, LEAST of them at least, and so few other texts of
#: any language do. Each language gives MARKS marks at most.
MARK_SHARE, MARK_LEAST, MARK_PURITY, MARKS = 0.1, 3, 0.98, 256
CONDITIONS, RULES, PRECISION = 4, 32, 0.9

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_bangs", "n_digits", "n_lines", "n_marks"]
RATIOS = ["symbol_share", "repeat_share", "dup_line_share", "upper_share", "bang_share", "digit_share", "word_length"]
FEATURES = ["n_marks", *RATIOS, "n_words"]

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters, lower-cased, and the texts they are in."""
    low = tb.LOWER[data]
    starts, ends, text = tb.runs(LETTER[low], offsets)
    return tb.Rolling(low).of(starts, ends), text


def count(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> list[np.ndarray]:
    """COUNTS and EXTRA of each text."""
    n = len(offsets) - 1
    starts, ends, text = tb.words(data, offsets)
    rolling = tb.Rolling(data)
    keys, at = tb.grams(rolling.of(starts, ends), text, 5)
    twice, _ = tb.repeated(tb.mix(keys + tb.mix(text[at].astype(np.uint64))))
    in_repeat = tb.covered(at[twice], 5, len(starts))
    line_starts, line_ends, line_text = tb.runs(data != 0x0A, offsets)
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~tb.SPACE[data], out=held[1:])
    full = held[line_ends] > held[line_starts]
    line_keys = rolling.of(line_starts[full], line_ends[full])
    _, again = tb.repeated(tb.mix(line_keys + tb.mix(line_text[full].astype(np.uint64))))
    marked, mark_text = plain_words(data, offsets)
    points = ~tb.SPACE[data] & ((data & 0xC0) != 0x80)
    return [
        np.bincount(text, minlength=n), tb.per_text(points, offsets), tb.per_text(SYMBOL[data], offsets),
        np.bincount(line_text[full][again], minlength=n), np.bincount(text[in_repeat], minlength=n),
        tb.per_text((data >= 0x41) & (data <= 0x5A), offsets), tb.per_text(data == 0x21, offsets),
        tb.per_text((data >= 0x30) & (data <= 0x39), offsets), np.bincount(line_text[full], minlength=n),
        np.bincount(mark_text[np.isin(marked, marks)], minlength=n),
    ]


def statistics(docs: DataFrame, marks: list[int] | None = None, text: str = "text") -> DataFrame:
    """Every row of `docs`, whole, as the struct `doc`, with its COUNTS, EXTRA and RATIOS."""
    known = np.array(sorted(m & 0xFFFFFFFFFFFFFFFF for m in marks or []), np.uint64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text"):
            found = count(data, offsets, known)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc"), *(pa.array(x.astype(np.int64)) for x in found)], ["doc", *COUNTS, *EXTRA])

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = packed.schema["doc"].dataType.simpleString()
    found = packed.mapInArrow(counted, f"doc {kind}, " + ", ".join(f"{c} long" for c in COUNTS + EXTRA))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return found.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "upper_share": share("n_upper", "word_chars"),
        "bang_share": share("n_bangs", "n_words"), "digit_share": share("n_digits", "word_chars"),
        "word_length": share("word_chars", "n_words"),
    })


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """`rows` labelled texts at most, chosen by hash: doc_id, text, kind, bad, toxic. The bound makes the broadcast safe."""
    marks = (labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id")
             .agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"),
                  F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
             .select("doc_id", (F.col("toxic") > 0).alias("toxic"),
                     ((F.col("quality") < 1) | (F.col("toxic") > 0)).alias("bad"))
             .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows))
    kind = F.xxhash64("lang") if "lang" in docs.columns else F.lit(0).cast("long")
    return docs.select("doc_id", "text", kind.alias("kind")).join(F.broadcast(marks), "doc_id")


def toxic_marks(sample: DataFrame) -> list[int]:
    """Hashes of the words that a good share of one language's toxic sample texts have and next to no other text."""
    def per_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text"):
            keys, text = plain_words(data, offsets)
            toxic, kind = np.array(rows.column("toxic").to_pylist(), bool), rows.column("kind").to_numpy()
            _, first = np.unique(tb.mix(keys + tb.mix(text.astype(np.uint64))), return_index=True)
            key, of = keys[first], text[first]
            _, at, where = np.unique(tb.mix(key + tb.mix(kind[of].view(np.uint64))), return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind[of[at]]), pa.array(key[at].view(np.int64)),
                 pa.array(np.bincount(where, weights=toxic[of], minlength=len(at)).astype(np.int64)),
                 pa.array(np.bincount(where, minlength=len(at)).astype(np.int64))], ["kind", "word", "bad", "both"])

    total = sample.where("toxic").groupBy("kind").agg(F.count("*").alias("total"))
    seen = sample.mapInArrow(per_slice, "kind long, word long, bad long, both long").groupBy("kind", "word").agg(
        F.sum("bad").alias("bad"), F.sum("both").alias("both"))
    often = (seen.join(F.broadcast(total), "kind")  # as many rows as languages of the sample
             .where(F.col("bad") >= F.greatest(F.lit(float(MARK_LEAST)), MARK_SHARE * F.col("total"))).select("kind", "word", "bad"))
    everywhere = seen.groupBy("word").agg(F.sum("bad").alias("all_bad"), F.sum("both").alias("all_both"))
    found = often.join(everywhere, "word").where(F.col("all_bad") >= MARK_PURITY * F.col("all_both"))
    most = Window.partitionBy("kind").orderBy(F.desc("bad"), "word")
    return sorted({r.word for r in found.withColumn("place", F.row_number().over(most)).where(F.col("place") <= MARKS).collect()})


def grow(values: np.ndarray, bad: np.ndarray) -> list[tuple[int, bool, float]]:
    """Conditions (statistic, at least?, bound), added while FOIL's gain is positive and good rows are covered."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best = (1e-9, None)
        for f in range(values.shape[1]):
            column, hit = values[inside, f], bad[inside]
            order = np.argsort(column, kind="stable")
            ranked, hits = column[order], np.cumsum(hit[order])
            cut = np.flatnonzero(ranked[1:] > ranked[:-1])
            below_p, below = hits[cut], cut + 1
            for least, p, every in ((False, below_p, below), (True, p0 - below_p, len(hit) - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / every) - np.log2(p0 / (p0 + n0))), -1.0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    k = int(gain.argmax())
                    best = (gain[k], (f, least, float((ranked[cut[k]] + ranked[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covers(values, [best[1]])
    return rule


def covers(values: np.ndarray, rule: list[tuple[int, bool, float]]) -> np.ndarray:
    inside = np.ones(len(values), bool)
    for f, least, bound in rule:
        inside &= values[:, f] >= bound if least else values[:, f] < bound
    return inside


def learn(values: np.ndarray, bad: np.ndarray, held: np.ndarray) -> list[list[tuple[int, bool, float]]]:
    """Rejecting rules in order. `held` rows prune and judge; the others grow."""
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < RULES and bad[left & ~held].any() and (~bad[left & ~held]).any():
        rule = grow(values[left & ~held], bad[left & ~held])
        test, truth = values[left & held], bad[left & held]

        def worth(n: int, rule=rule, test=test, truth=truth) -> float:
            got = truth[covers(test, rule[:n])]
            return (2 * got.sum() - len(got)) / len(got) if len(got) else -1.0

        if rule:
            rule = rule[:max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))]
        got = truth[covers(test, rule)]
        if not rule or len(got) < 2 or got.mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~covers(values, rule)
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[int], list[list[tuple[int, bool, float]]]]:
    """The marks and the rules. Only FIT_ROWS rows of a few numbers each reach the driver."""
    sample = kept_table(labelled(docs, labels).withColumn("half", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2))), "labelled")
    marks = toxic_marks(sample)
    halves = [sample.where(F.col("half") == h) for h in (0, 1)]
    counted = statistics(halves[0], toxic_marks(halves[1])).unionAll(statistics(halves[1], toxic_marks(halves[0])))
    rows = counted.select(
        F.col("doc.bad").alias("bad"), (F.pmod(F.xxhash64(F.col("doc.doc_id").cast("string"), F.lit("held")), F.lit(3)) == 0).alias("held"),
        *FEATURES).orderBy(*FEATURES, "bad", "held").toPandas()
    if not len(rows):
        return marks, []
    return marks, learn(rows[FEATURES].to_numpy(float), rows["bad"].to_numpy(bool), rows["held"].to_numpy(bool))


def verdict(rules: list[list[tuple[int, bool, float]]]) -> Column:
    """The first rule that covers a row, by number, or null: one CASE with a branch for each rule."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        test = F.lit(True)
        for f, least, bound in rules[i]:
            test &= (F.col(FEATURES[f]) >= bound) if least else (F.col(FEATURES[f]) < bound)
        out = F.when(test, F.lit(i + 1)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of `docs` as `doc`, its statistics, base_failed, rule (number or null) and kept."""
    marks, rules = fit(docs, labels)
    return (statistics(docs, marks)
            .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
            .withColumn("rule", verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))
