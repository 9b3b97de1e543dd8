"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source the rows lie in key ranges (the leading bits of
the key); totals of the ranges are added up to distributed prefix sums of word counts, the range that
holds the cut is cut into ranges again, and the source's budget is cut exactly: first whole epochs,
then all rows below the cut key, then the leading words of the row at the cut. What decides about a
row is one small row per source. The mix itself is range-sorted by source, epoch and key.

Defined cases: a null text has size 0 and takes nothing. A null source is a source, last in order.
Rows of one key (repeated rows) at the cut share what is left evenly, in whole words. Sources
without words get the target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemart.llm.common import SPACE, free_name, written

#: Weights by a source's place in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix has so many times the words of all sources, and no source more than MOST times its own.
SHARE = 1.5
MOST = 2
#: Bits of the key that cut a range into smaller ones, and the rows of a range that needs no cutting.
LEVEL_BITS = 6
RANGE_ROWS = 64
SEED = 20


def word_count(text: Column) -> Column:
    """Number of words; what is no word is cut away and each word is cut down to one character."""
    short = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+"), F.lit("a"))
    return F.length(F.regexp_replace(short, F.lit(f"[{SPACE}]+"), F.lit(""))).cast("bigint")


def random_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def _places(sources: DataFrame) -> DataFrame:
    """`place` of each source in code point order, null last; one row per source."""
    order = (F.col("source").isNull(), F.col("source"))
    ranged = written(
        sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-places")
    before = (ranged.groupBy("part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return (ranged.withColumn("within", within).join(before.select("part", "before"), "part")
            .withColumn("place", F.col("within") + F.col("before")).drop("part", "within", "before"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """(source, source_size, n_rows) with `target`: shares by weight, stopped at `most` times the
    source's size, the excess reshared among the others until none is above."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = written(
        _places(sources).withColumn("weight", cycle[(F.col("place") % len(weights)).cast("int")])
        .withColumn("cap", F.col("source_size") * most).drop("place"), "mix-sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, above = 0.0, -1
    while True:
        # words for each unit of weight among those that are not stopped
        stopped = F.col("weight") * level > F.col("cap")
        row = placed.agg(F.coalesce(F.sum(F.when(stopped, F.col("cap"))), F.lit(0)),
                         F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0)),
                         F.count_if(stopped)).first()
        if row[2] == above or not row[1]:
            break
        above, level = row[2], max(level, (total * share - row[0]) / row[1])
    return placed.withColumn("target", F.least(F.col("cap").cast("double"),
                                               F.col("weight") * level)).drop("weight", "cap")


def cuts(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: `epochs` whole ones, then the keys before cut_key, then `cut_words` of each row at
    the cut. `sized` has source, size, key.

    The keys are cut into ranges by their leading bits, the ranges' words are added up in order, and
    the one range of each source that holds its cut is cut again, until it has few rows. A window
    never has more than 2^LEVEL_BITS rows of a source, however large the source, but for the rows of
    the last range, which are few or have one key."""
    goals = (goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
                F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
             .withColumn("rest", F.floor("target").cast("bigint")
                         - F.col("epochs") * F.col("source_size"))
             .withColumnRenamed("source", "of"))
    rows = (sized.join(goals.select("of", F.col("rest").alias("left")),
                       F.col("source").eqNullSafe(F.col("of"))).select("of", "left", "key", "size"))
    for shift in range(64 - LEVEL_BITS, -1, -LEVEL_BITS):
        ranged = rows.withColumn("range", key_range(F.col("key"), shift))
        here = written(
            _before(ranged.groupBy("of", "left", "range").agg(
                F.sum("size").alias("words"), F.count("*").alias("n")), "range")
            .select(F.col("of").alias("at"), F.col("range").alias("cut_range"),
                    (F.col("left") - F.col("before")).alias("more"), "n"), "mix-ranges")
        rows = (ranged.join(here.drop("n"), F.col("of").eqNullSafe(F.col("at"))
                            & (F.col("range") == F.col("cut_range")))
                .select("of", F.col("more").alias("left"), "key", "size"))
        if (here.agg(F.max("n")).first()[0] or 0) <= RANGE_ROWS:
            break
        rows = written(rows, "mix-range")
    keys = _before(rows.groupBy("of", "left", "key").agg(
        F.sum("size").alias("words"), F.count("*").alias("n")), "key").select(
            F.col("of").alias("at"), F.col("key").alias("cut_key"),
            F.floor((F.col("left") - F.col("before")) / F.col("n")).alias("cut_words"))
    return (goals.join(keys, F.col("of").eqNullSafe(F.col("at")), "left")
            .drop("at", "rest", "n_rows"))


def _before(sums: DataFrame, order: str) -> DataFrame:
    """Of each source the row that holds the word after `left`, with the words `before` it."""
    total = F.sum("words").over(Window.partitionBy("of").orderBy(order))
    return (sums.withColumn("before", total - F.col("words"))
            .filter((F.col("before") <= F.col("left"))
                    & (F.col("left") < F.col("before") + F.col("words"))))


def key_range(key: Column, shift: int) -> Column:
    """The leading bits of a key as a number; ranges are in the order of the keys."""
    return F.shiftright(key, shift)


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
         most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, key) of all rows, and the cut of each source; both are stored."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                random_key(F.col("doc_id"), F.col("text"), seed).alias("key")),
                    "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                          F.count("*").alias("n_rows"))
    goals = targets(sources, weights, share, most)
    return sized, written(cuts(sized, goals), "mix-cuts")


def taken(size: Column, key: Column) -> Column:
    """Words that the mix takes from a row joined to its source's cut."""
    cut = F.col("cut_key")
    part = (F.when(cut.isNull(), F.lit(0)).when(key < cut, size)
            .when(key == cut, F.least(size, F.col("cut_words"))).otherwise(F.lit(0)))
    return F.col("epochs") * size + part


def mix_sizes(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, words taken."""
    sized, cut = plan(docs, **how)
    return (sized.join(cut, F.col("source").eqNullSafe(F.col("of")))
            .select("doc_id", "size", "source_size", "target",
                    taken(F.col("size"), F.col("key")).cast("bigint").alias("taken")))


def mix_documents(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The mix itself with the columns of `docs`: a row for each epoch that takes the document,
    the row at the cut with its leading words only. Rows are sorted over all partitions by source
    (null last), epoch and key, so those of one source are in random order, in each epoch the same."""
    _, cut = plan(docs, seed=seed, **how)
    names = {name: free_name(docs.columns, f"mix_{name}") for name in ("size", "key", "take", "n")}
    cut = cut.select("of", "epochs", "cut_key", "cut_words")
    inner = docs.select(F.struct(*docs.columns).alias("doc"))
    size, key = names["size"], names["key"]
    rows = (inner.withColumn(size, word_count(F.col("doc.text")))
            .withColumn(key, random_key(F.col("doc.doc_id"), F.col("doc.text"), seed))
            .join(cut, F.col("doc.source").eqNullSafe(F.col("of")))
            .withColumn(names["take"], taken(F.col(size), F.col(key)))
            .filter(F.col(names["take"]) > 0)
            .withColumn(names["n"], F.explode(F.sequence(
                F.lit(1), F.ceil(F.col(names["take"]) / F.col(size))))))
    left = F.col(names["take"]) - (F.col(names["n"]) - 1) * F.col(size)
    pieces = F.regexp_extract_all(F.col("doc.text"), F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    text = F.when(left < F.col(size), F.array_join(
        F.slice(pieces, F.lit(1), left.cast("int")), "")).otherwise(F.col("doc.text"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(left < F.col(size), F.length(text)).otherwise(
            F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    order = (F.col("doc.source").isNull(), F.col("doc.source"), F.col(names["n"]), F.col(key))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select(*[made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])

