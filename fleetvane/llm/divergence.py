r"""Operator 11: which terms set a source apart within its language, and how far sources lie from one another.

Terms are counted in tasks, with a table of bounded size, before anything is shuffled. A group's share of a term is
p = 1 + floor(10^9 (count + 5) / (N + 5 V)); a term that doesn't occur in it has the group's baseline share, count 0.

Pairs are sparse: with b and c the baselines of groups g and s of a language, the sum over all V kept terms of |p - q| is
    V |b - c|  +  A(g, s) + A(s, g)  +  the sum over terms that both have of |p - q| - |p - c| - |b - q| + |b - c|,
    A(g, s) = the sum over terms of g of |p - c| - |b - c|,
so terms that neither has are never rows, and A comes from how often g has each share.

Ranks are by radix selection: histograms of the values' upper bits, then of the lower bits in the bucket that holds a
group's k-th value, give its threshold; what ties there is refined by bytes of UTF-8 in the same way, until few enough are
left in a bucket to be sorted. So no task ever sorts a group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.llm.common import raw_texts_of, slices, written

LEAST_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Runs of letters and of characters beyond ASCII; in UTF-8 the latter are bytes from 0x80 on.
_terms = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
#: Different (lang, source, term) that a task counts, and the bytes of such terms, before it sends them on.
MOST_COUNTED, MOST_COUNTED_BYTES = 200_000, 16 << 20
#: Bits of a histogram's digit, UTF-8 bytes that a turn compares, and rows of a group's bucket up to which they are sorted.
DIGIT, BYTES, FEW = 16, 2, 4096
#: Groups up to which their table (under 200 bytes each) is broadcast; beyond, it is joined by shuffle.
MOST_BROADCAST_GROUPS = 20_000
COUNTS = "lang string, source string, term string, n long, docs long"
LONG = "decimal(38,0)"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in how many documents. docs has lang and source without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[str, str], list[Counter]] = {}
        held = size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (occurrences, docs) in counted.items():
                keys = list(occurrences)
                for i in range(0, len(keys), 16_384):
                    part = keys[i : i + 16_384]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([occurrences[k] for k in part], pa.int64()), pa.array([docs[k] for k in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            counted.clear()

        for whole in batches:
            for batch in slices(whole, 256):
                langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for lang, source, text in zip(langs, sources, raw_texts_of(batch, "text"), strict=True):
                    found = Counter(_terms(text.lower()))  # bytes: only A-Z change
                    if not found:
                        continue
                    if (lang, source) not in counted:
                        counted[lang, source] = [Counter(), Counter()]
                    occurrences, docs = counted[lang, source]
                    before = len(occurrences)
                    occurrences.update(found)
                    docs.update(found.keys())
                    held += len(occurrences) - before
                    size += sum(map(len, found)) if len(occurrences) > before else 0
                if held > MOST_COUNTED or size > MOST_COUNTED_BYTES:
                    yield from sent()
                    held = size = 0
        yield from sent()

    parts = docs.select("lang", "source", "text").mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, n: Column, v: Column) -> Column:
    """p, exact: a quotient of whole decimals."""
    scaled = (F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")).cast(LONG)
    return (F.lit(1) + F.call_function("div", scaled, (n + SMOOTH * v).cast("decimal(20,0)"))).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """df, a written table of groups, to be broadcast if it is small enough by count."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST_GROUPS else df


def shares(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Written: (lang, source, v, base) of every group, base null where no term is kept, and (lang, source, term, p, q) of every kept term that occurs in it."""
    counts = written(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("groups")).where(F.col("docs") >= least_docs)
    kept = written(kept.drop("docs"), "kept")  # a list holds the sources of a language at most
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
    totals = kept.select("lang", F.explode("groups").alias("g")).groupBy("lang", F.col("g.source").alias("source")).agg(F.sum("g.n").alias("n"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1)).select("lang", "source").join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "all_n", "n"])
    groups = written(groups.withColumn("base", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v")))), "groups")
    rows = kept.select("lang", "term", "total", F.explode("groups").alias("g")).select("lang", F.col("g.source").alias("source"), "term", "total", F.col("g.n").alias("count"))
    rows = rows.join(_small(groups.withColumnRenamed("n", "size")), ["lang", "source"])
    rows = rows.select("lang", "source", "term", _share(F.col("count"), F.col("size"), F.col("v")).alias("p"), _share(F.col("total"), F.col("all_n"), F.col("v")).alias("q"))
    return groups.select("lang", "source", "v", "base"), written(rows, "shares")


def pair_divergence(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two different sources of a language."""
    one = groups.select("lang", "source", "v", "base")
    other = _small(groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base")))
    pairs = written(one.join(other, "lang").where("source <> item"), "pairs")
    far = F.abs(F.col("base") - F.col("other_base"))
    by_share = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = by_share.join(_small(pairs), ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("other_base")) - far)).alias("alone"))
    x, y = rows.select("lang", "term", "source", "p"), rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"))
    bases = _small(pairs.where("source < item").select("lang", "source", "item", "base", "other_base"))
    both = x.join(y, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item", "p", "r").agg(F.count("*").alias("times")).join(bases, ["lang", "source", "item"])
    p, r, b, c = F.col("p"), F.col("r"), F.col("base"), F.col("other_base")
    both = written(both.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (F.abs(p - r) - F.abs(p - c) - F.abs(b - r) + F.abs(b - c))).alias("both")), "both")
    both = both.union(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both"))
    alone = written(alone, "alone")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    keys = ["lang", "source", "item"]
    none = lambda c: F.coalesce(c, F.lit(0))
    value = none(F.col("v") * far) + none(F.col("alone")) + none(F.col("back")) + none(F.col("both"))
    return pairs.join(alone, keys, "left").join(back, keys, "left").join(both, keys, "left").select(*keys, value.cast("long").alias("value"))


def _digit(rows: DataFrame, group: list[str], digit: Column, descending: bool) -> DataFrame:
    """For each group of rows, with its need: the digit at which the need-th row lies (in that order), how many rows come before that digit, and how many have it."""
    counts = rows.withColumn("digit", digit).groupBy(*group, "digit").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    order = F.col("digit").desc() if descending else F.col("digit").asc()
    so_far = F.sum("n").over(Window.partitionBy(*group).orderBy(order))
    # All of a group that is smaller than its need is taken: its last digit is the edge then.
    last = F.max("so_far").over(Window.partitionBy(*group))
    found = counts.withColumn("so_far", so_far).withColumn("all", last)
    return found.where("so_far >= least(need, all) and so_far - n < least(need, all)").select(*group, F.col("digit").alias("edge"), (F.col("so_far") - F.col("n")).alias("before"), F.col("n").alias("at_edge"))


def radix_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, few: int = FEW) -> DataFrame:
    """The rows of each group that are among its k first by value descending, then item by UTF-8 bytes, and among equals of both any.

    value is a long from 0 to 2**48 - 1, item a string. group columns have no nulls.
    """
    taken = None
    left = rows.withColumn("need", F.lit(k).cast("long"))

    def turn(left: DataFrame, digit: Column, descending: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows beyond the edge, which are in; rows at it, with what is still needed of them; the edges."""
        edges = written(_digit(left, group, digit, descending), "edges")
        joined = left.withColumn("digit", digit).join(_small(edges), group)
        sure = joined.where(F.col("digit") > F.col("edge") if descending else F.col("digit") < F.col("edge"))
        at = joined.where("digit = edge").withColumn("need", F.col("need") - F.col("before"))
        return sure.select(*rows.columns), written(at.select(*rows.columns, "need"), "ties"), edges

    for low in (2 * DIGIT, DIGIT, 0):
        sure, left, edges = turn(left, F.shiftrightunsigned(F.col(value), low).bitwiseAND((1 << DIGIT) - 1), True)
        taken = sure if taken is None else taken.union(sure)
    at = 0
    while edges.where(F.col("at_edge") > few).take(1):
        # Past its last byte an item's digit is 0 with its length; more bytes sort after it.
        part = F.substring(F.col(item).cast("binary"), at + 1, BYTES)
        digit = F.when(F.length(part) == 0, 0).otherwise(F.conv(F.rpad(F.hex(part), 2 * BYTES, "0"), 16, 10).cast("long") * (BYTES + 1) + F.length(part))
        ended = F.length(F.col(item).cast("binary")) <= at
        if not left.where(~ended).take(1):
            break  # equal items only: any of them
        sure, left, edges = turn(left, digit, False)
        taken, at = taken.union(sure), at + BYTES
    place = F.row_number().over(Window.partitionBy(*group).orderBy(item))
    return taken.union(left.withColumn("place", place).where("place <= need").select(*rows.columns))


def source_divergence(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS, few: int = FEW) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' ranks the other sources of the language by their distance, part 'term' the kept terms that the source has more of than its language.

    Null text, lang and source are ''. Every row is a document, repeated ones too. A group without terms has its pairs all
    the same; a language with one source has none, one without kept terms only pairs of value 0. An empty table gives no
    rows. Other columns of docs play no part.
    """
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups, rows = shares(filled, least_docs)
    keys = ["lang", "source"]
    terms = written(rows.where("p > q").select(*keys, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "gains")
    parts = (("pair", pair_divergence(groups, rows)), ("term", radix_top(terms, keys, "value", "item", top, few)))
    rank = F.row_number().over(Window.partitionBy("part", *keys).orderBy(F.col("value").desc(), "item"))
    both = [df.select(*keys, F.lit(part).alias("part"), "item", "value") for part, df in parts]
    return both[0].union(both[1]).withColumn("rank", rank)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 5) AS BIGINT) // CAST(gn.n + 5 * v.v AS BIGINT) AS p, 1 + CAST(1000000000 * (k.total + 5) AS BIGINT) // CAST(v.n + 5 * v.v AS BIGINT) AS q
  FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT CAST(sum(abs(x.p - y.p)) AS BIGINT) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
