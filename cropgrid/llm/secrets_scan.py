"""Secret scans: credentials by pattern, told apart by how many owners use the same value.

Everything is DataFrame and SQL functions. A text is cut at the matches of a pattern; running sums of the lengths of pieces and
matches, by doubling steps, give each match its place in code points, so the time follows the text's length and (but for a
logarithm) its matches. The texts are searched once, into a table in the shared folder. The values found are
then counted over the whole corpus: by documents, distinct repositories and distinct owners. Values that at least two owners and
EXAMPLE_SHARE of all owners of the corpus (or EXAMPLE_OWNERS of them) share are widely copied examples; all others look live and are
masked, so a credential that turns up under a few owners does not stay. Repositories are told apart within an owner: a value never
has fewer documents or repositories than owners.

Defined cases: a null or empty text has no spans. Repeated rows count as documents of their own; a null owner
or repository counts as one owner of its own. Spans of different kinds may overlap, all stay. In a tie of
start, kinds stand in the order of KINDS. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropgrid.session import kept_table

#: Kind, pattern (Java), group that holds the value, least code points of the value.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("bearer", r"(?:gh[oprsu]|xox[abp]|glpat|sk|rk)[_-][A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 16),
]
BASE = ("assign", "access", "hex")
#: Values of so large a share of the corpus's owners are copied examples, or of so many owners where there are very many.
EXAMPLE_SHARE, EXAMPLE_OWNERS = 0.5, 100
#: A value with more than one of so many uses is joined by broadcast: no more than that many values can have as much.
HOT_VALUES = 1000
MASK = "[SECRET]"
#: Code points of the pieces that a text is cut into before spans are masked.
PIECE = 256


def let(name: str, value: str, body: str) -> str:
    """SQL of `body` with `name` for `value`, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, combine: str) -> str:
    """SQL of the running total of an array under an associative `combine` of `a` and `b`: steps of 1, 2, 4, ... places."""
    steps = f"transform(sequence(0, cast(ceil(log2(greatest(size({values}), 1))) as int)), e -> cast(pow(2, e) as int))"
    return f"aggregate({steps}, {values}, (run, step) -> transform(run, (b, i) -> CASE WHEN i < step THEN b ELSE {let('a', 'run[i - step]', combine)} END))"


def spans_of(text: str, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Matches in one column as an array of (start, rank, end, kind, value), in order. Patterns have no zero-width match."""
    regex = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pieces = f"arrays_zip(split({text}, {regex}, -1), regexp_extract_all({text}, {regex}, 0), regexp_extract_all({text}, {regex}, {group}))"
    ends = let("lengths", "transform(z, x -> length(x.`0`) + coalesce(length(x.`1`), 0))", running("lengths", "a + b"))
    placed = let("z", pieces, let("ends", ends, f"""transform(z, (x, i) -> named_struct(
        'start', ends[i] - length(x.`1`), 'rank', {rank}, 'end', ends[i], 'kind', '{kind}', 'value', x.`2`))"""))
    return F.expr(f"""
        CASE WHEN {text} RLIKE {regex} THEN filter({placed}, s -> length(s.value) >= {least})
        ELSE cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string>>) END""")


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `spans`, in order of start and kind."""
    held = docs.withColumn("_whole", F.coalesce(F.col(text).cast("string"), F.lit("")))
    kinds = [spans_of("_whole", *kind, rank) for rank, kind in enumerate(KINDS)]
    return held.withColumn("spans", F.array_sort(F.concat(*kinds))).drop("_whole")


def ownership(spans: DataFrame) -> DataFrame:
    """Of each value hash: documents, repositories and owners. `spans`: value_hash, owner, repository.

    Rows of one owner and repository are summed before they travel, so a value that a third of all rows
    hold costs one row for each task and repository.
    """
    by_repository = spans.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return by_owner.groupBy("value_hash").agg(
        F.sum("n").alias("uses"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def example_owners(total: str) -> Column:
    """How many owners make a value a copied example when the corpus has `total`."""
    return F.greatest(F.lit(2), F.least(F.ceil(EXAMPLE_SHARE * F.col(total)), F.lit(EXAMPLE_OWNERS)))


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), text: str = "text",
         keep: tuple[str, ...] | None = None) -> DataFrame:
    """`_doc`, a struct of the columns `keep` (all if none are named), and `verdicts`: the spans of each row in order, each with
    uses, repositories, owners and live (not widely copied).

    The texts are searched once; rows, their spans and the columns to keep go to a table in the shared folder, in which each row has
    a number of its own, so that repeated rows stay apart. Values and row numbers are shuffled, and the kept columns of rows with
    spans travel once; rows without spans stay where they are. Uses of a very common value meet its counts by broadcast.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    marked = found(docs.select(kept.alias("_doc"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate((text, owner, *repository))]), "_0")
    rows = kept_table(marked.select(
        F.monotonically_increasing_id().alias("_row"), "_doc", "spans", F.col("_1").cast("string").alias("owner"),
        F.to_json(F.struct(*[f"_{i + 2}" for i in range(len(repository))]), {"ignoreNullFields": "false"}).alias("repository")), "secret_spans")
    each = rows.select("_row", "owner", "repository", F.explode("spans").alias("s")).withColumn("value_hash", F.sha2("s.value", 256))
    whole = rows.select("owner").distinct().agg(F.count("*").alias("total")).select(example_owners("total").alias("many"))
    known = kept_table(ownership(each.select("value_hash", "owner", "repository")).crossJoin(F.broadcast(whole)), "secret_values")  # one row
    all_uses = known.agg(F.sum("uses").alias("all_uses"))
    common = known.crossJoin(F.broadcast(all_uses)).where(F.col("uses") * HOT_VALUES > F.col("all_uses")).drop("all_uses")  # one row; HOT_VALUES at most
    uses = each.select("_row", "value_hash", "s.start", "s.rank", "s.end", "s.kind")
    judged = (uses.join(F.broadcast(common), "value_hash")
              .unionByName(uses.join(F.broadcast(common.select("value_hash")), "value_hash", "left_anti").join(known, "value_hash"))
              .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
                  "start", "rank", "end", "kind", "uses", "repositories", "owners",
                  (F.col("owners") < F.col("many")).alias("live")))).alias("verdicts")))
    joined = rows.where("size(spans) > 0").select("_row", "_doc").join(judged, "_row").select("_doc", "verdicts")
    without = rows.where("size(spans) = 0").select("_doc", F.array().cast(judged.schema["verdicts"].dataType).alias("verdicts"))
    return joined.unionAll(without)


def masked(text: str, spans: str) -> Column:
    """The text with each live span, or union of overlapping ones, replaced by MASK. `spans` are in order.

    The farthest end before each span tells which ones begin a union. The text between unions is read from pieces of PIECE code
    points, so a span costs no pass over the text before it."""
    def cut(a: str, b: str) -> str:
        first = f"greatest({a} - c * {PIECE}, 0)"
        return f"""CASE WHEN {b} <= {a} THEN '' ELSE array_join(transform(
            sequence(cast({a} div {PIECE} as int), cast(({b} - 1) div {PIECE} as int)),
            c -> substring(pieces[c], {first} + 1, least({b} - c * {PIECE}, {PIECE}) - {first})), '') END"""

    gaps = "filter(transform(live, (s, i) -> named_struct('from', CASE WHEN i = 0 THEN 0 ELSE reach[i - 1] END, 'to', s.start)), g -> g.to >= g.from)"
    out = f"""concat(array_join(transform({gaps}, g -> concat({cut('g.from', 'g.to')}, '{MASK}')), ''),
        {let('last', 'element_at(reach, -1)', let('size', f'length({text})', cut('last', 'size')))})"""
    reach = let("ends", "transform(live, s -> s.end)", running("ends", "greatest(a, b)"))
    whole = let("live", f"filter({spans}, s -> s.live)", let("reach", reach, let("pieces", f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)", out)))
    return F.expr(f"CASE WHEN exists({spans}, s -> s.live) THEN {whole} ELSE {text} END")


def listed(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    of = spans if kinds is None else f"filter({spans}, s -> s.kind in ({', '.join(repr(k) for k in kinds)}))"
    return F.expr(f"array_join(transform({of}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
