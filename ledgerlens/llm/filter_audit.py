"""How five text filters interact: a histogram of failure masks, and every order of the filters read from it.

A document's failures are a five-bit mask of native expressions: A to D depend
on its own text, E on the smallest doc_id that has the same text, which a
grouping by text (by its SHA-256, so that no text is shuffled) supplies. All a
report of any order needs is how many documents of a part have each mask: 32
cells. The 120 orders are then enumerated over the cells, not the documents.

Defined results: null text counts as empty; null lang is the part ''. A null
doc_id has no smaller one, is no smaller one, and has no label. Rows that repeat
a doc_id with one text are as small as each other: none fails E by the other.
A doc_id is good (toxic) if any of its rows in labels says quality (toxic) is 1.
Columns other than those named are ignored. No documents, no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, dropped, written

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
#: Fewest words, smallest share of distinct words, largest share of capitals (per cent), characters that fail.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
_BLANKS = "\t\n\x0b\x0c\r"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The failures A to D of a text as bits 1, 2, 4, 8."""
    words = F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.length(text).cast("long")
    capitals = chars - F.length(F.translate(text, UPPER, ""))
    failed = {
        "A": n < MIN_WORDS,
        "B": 100 * distinct.cast("long") < MIN_DISTINCT * n.cast("long"),
        "C": 100 * capitals > MAX_CAPITALS * chars,
        "D": text.rlike(SYMBOLS),
    }
    return sum((F.when(what, bit(k)).otherwise(0) for k, what in failed.items()), F.lit(0))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of one text, part, mask (A to D) and labels: n of them, and `first`, the smallest doc_id with its rows.

    Grouping by doc_id first makes the second grouping's partial sums small however
    often a text is copied, and counts repeated rows. Rows without an id go past the join.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    keys = ["digest", "part", "mask", "good", "toxic"]
    none = F.lit(0)
    with_id = (
        rows.where("doc_id IS NOT NULL")
        .join(known, "doc_id", "left")
        .withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
        .groupBy("doc_id", *keys)
        .agg(F.count("*").alias("n"))
        .groupBy(keys)
        .agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    )
    kind = with_id.schema["first"].dataType
    without = rows.where("doc_id IS NULL").withColumns({"good": none, "toxic": none}).groupBy(keys).agg(F.count("*").alias("n")).withColumn("first", F.lit(None).cast(kind))
    return with_id.unionByName(without)


def histogram(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (0 to 31) and, long: n documents, good and toxic ones among them."""
    rows = written(judged(documents, labels), "audit-rows")
    smallest = rows.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"), F.sum("n").alias("copies")).where("copies > 1").select("digest", "smallest")
    left = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    failing = F.when(F.col("first").isNotNull() & F.col("smallest").isNotNull(), F.col("n") - left).otherwise(0)
    cells = (
        rows.join(smallest, "digest", "left")
        .withColumn("failing", failing)
        .select("part", "good", "toxic", F.inline(F.array(F.struct("mask", (F.col("n") - F.col("failing")).alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), F.col("failing").alias("n")))))
        .where("n > 0")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    )
    out = written(cells, "audit-cells")
    dropped(rows)
    return out


def orders(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the part's cells alone."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    own = sum((F.when(letter == k, bit(k)).otherwise(0) for k in FILTERS), F.lit(0))
    before = sum((F.when(F.contains(earlier, F.lit(k)), bit(k)).otherwise(0) for k in FILTERS), F.lit(0))

    def total(column: str, where) -> Column:
        count = lambda a, c: a + F.when(where(c["mask"]), c[column]).otherwise(F.lit(0))
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: count(a, c).cast("long"))

    fails, passed = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("before")) == 0
    here = lambda m: fails(m) & passed(m)
    # A filter is the first of a mask's j failing ones in 120 / j of the 120 orders.
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: F.when(fails(c["mask"]), a + (c["n"] * len(ORDERS) / F.bit_count(c["mask"])).cast("long")).otherwise(a))
    return steps.withColumns({"own": own, "before": before}).select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(F.col("own") + F.col("before")) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part's 600 rows: 120 orders of five steps."""
    return orders(histogram(documents, labels))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
first AS (SELECT text, min(doc_id) AS smallest FROM d GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > smallest THEN 'E' ELSE '' END AS fails
  FROM w JOIN first ON first.text = w.text LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS x, left(filter_order, CAST(s - 1 AS INTEGER)) AS earlier FROM orders, range(1, 6) AS r(s)),
m AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails = x AS alone, contains(fails, x) AS failing,
    len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND fails <> '' AS gone
  FROM g, steps),
r AS (
  SELECT part, filter_order, step, x,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM m GROUP BY ALL)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""
