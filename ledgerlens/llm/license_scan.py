"""License scans by diagonal voting, in DataFrame operations alone.

Every word bigram of every text is hashed and joined to the bigrams of the
license templates. A hit votes for the diagonal (its place in the text less its
place in the template); neighbouring diagonals, which small insertions and
deletions leave, are merged, and the words under the best diagonal are held
against the template's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import native_words


@dataclass(frozen=True)
class Template:
    """Words (lower case, blank-separated) that stand for a label.

    An exact template (share 1.0) counts wherever its words stand
    consecutively; any other where `share` of its bigrams do, with up to `gap`
    words put in or left out between two of them.
    """

    label: str
    words: str
    share: float = 0.75
    gap: int = 2
    base: bool = False


# The phrases and labels of the contract.
BASE = (
    Template("cc-by", "cc by", 1.0, 0, True),
    Template("gpl", "general public license", 1.0, 0, True),
    Template("reserved", "all rights reserved", 1.0, 0, True),
)
#: Notices of well-known public licenses; their words are the licenses' own.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
)
_END = "\0"


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, text: str = "text") -> DataFrame:
    """One row a document: `__rid`, its columns but the text, `scan_words`, and
    `spans`, an array of (label, base, start, votes, score) by start.

    Columns named as one of these are replaced. Null texts are empty: no words, no spans. Texts of fewer words than a
    template can't hold it. Repeated rows each get their own row. The
    templates, a parameter, are all that is broadcast.
    """
    spark, keep = docs.sparkSession, [c for c in docs.columns if c not in (text, "__rid", "scan_words", "spans")]
    split = [(i, t, t.words.split()) for i, t in enumerate(templates)]
    names = "tid int, label string, base boolean, need double, gap int, n int, wanted array<string>"
    about = F.broadcast(
        spark.createDataFrame([(i, t.label, t.base, t.share, t.gap, len(w), w) for i, t, w in split], names)
    )
    places = [(i, p, len(w), 2 * t.gap, w[p], w[p + 1]) for i, t, w in split for p in range(len(w) - 1)]
    places = spark.createDataFrame(
        [*places, (-1, 0, 0, 0, _END, None)], "tid int, at int, len int, pad int, a string, b string"
    ).select("tid", "at", "len", "pad", F.xxhash64("a", "b").alias("gram"))

    own = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("__own")
    texts = docs.select(F.monotonically_increasing_id().alias("__rid"), own, native_words(F.col(f"`{text}`")).alias("ws"))
    grams = texts.select(
        "__rid", "__own", "ws", F.posexplode(F.concat("ws", F.array(F.lit(_END)))).alias("p", "w")
    ).withColumn("gram", F.xxhash64("w", F.get("ws", F.col("p") + 1)))
    first = F.greatest(F.col("p") - F.col("at") - F.col("pad"), F.lit(0))
    last = F.col("p") - F.col("at") + F.col("len") + F.col("pad")
    hits = grams.join(F.broadcast(places), "gram").select(
        "__rid",
        F.when(F.col("tid") < 0, F.col("__own")).alias("__own"),
        "tid",
        (F.col("p") - F.col("at")).alias("diagonal"),
        F.when(F.col("tid") >= 0, F.slice("ws", first + 1, F.greatest(last - first, F.lit(0)))).alias("under"),
    )

    # From here on there are a row a document (tid -1) and the few hits, dealt by row id once.
    voted = (
        hits.repartition(F.col("__rid"))
        .groupBy("__rid", "tid", "diagonal")
        .agg(F.count("*").alias("votes"), F.first("under").alias("under"), F.first("__own").alias("__own"))
        .join(about, "tid", "left")
        .where((F.col("tid") < 0) | (F.col("votes") * 4 >= F.col("n") - 1))
    )
    order = Window.partitionBy("__rid", "tid").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    islands = voted.withColumn("new", F.when(step <= F.col("gap"), 0).otherwise(1)).withColumn(
        "island", F.sum("new").over(order)
    )
    best = F.struct("votes", -F.col("diagonal"))
    merged = islands.groupBy("__rid", "tid", "island").agg(
        F.max_by("diagonal", best).alias("start"),
        F.max_by("under", best).alias("under"),
        F.sum("votes").alias("votes"),
        *[F.first(c).alias(c) for c in ("label", "base", "need", "wanted", "__own")],
    )

    def bigrams(words):
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))

    wanted = F.array_distinct(bigrams(F.col("wanted")))
    score = F.size(F.array_intersect(wanted, bigrams(F.col("under")))) / F.size(wanted)
    holds = F.when(F.col("need") >= 1, F.col("under") == F.col("wanted")).otherwise(score >= F.col("need"))
    span = F.struct(F.greatest("start", F.lit(0)).cast("long").alias("start"), "label", "base", "votes", score.alias("score"))
    return (
        merged.groupBy("__rid")
        .agg(
            F.first("__own", ignorenulls=True).alias("__own"),
            F.max(F.when(F.col("tid") < 0, F.col("start"))).cast("long").alias("scan_words"),
            F.array_sort(F.collect_list(F.when((F.col("tid") >= 0) & holds, span))).alias("spans"),
        )
        .select("__rid", *[F.col(f"__own.c{i}").alias(c) for i, c in enumerate(keep)], "scan_words", "spans")
    )


def op3_license_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(scan(docs))


def digest(found: DataFrame) -> DataFrame:
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        F.col("scan_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"),
        join(spans).alias("labels"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
