"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of `width` consecutive words, and a window is a set of shingles.
Shingles are counted over the whole corpus and each window's are ordered by rarity. A document that
contains the window contains its rarest shingle, so Spark joins the corpus with that prefix alone. A
candidate must have room for the window before and after the shingle (length and positional bounds),
and then the words of the item-sized window of the document are compared as text.

The corpus is passed over twice, once for the counts and once for the candidates, whatever the size of
the benchmark, and no text of either side comes to the driver. What does is a bitmap of FILTER_BITS
bits: a place of a document whose shingle is not in it can't be in the join and is left out of the
shuffle. A benchmark that fills the bitmap makes the shuffles larger and changes no result.

Shingles are 64-bit hashes; equal hashes of different shingles only add candidates. Rows of one
doc_id whose texts share a 64-bit hash count as one row, repeated.

Defined cases: a null text has no words and no hits. An item without words has no window. A null
item_id counts as the item with the empty id. Repeated items count once. Without items nothing is
hit; an empty document table gives an empty result. Repeated documents come out as often as they come
in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemart.llm.common import byte_batches, free_name, lowered_bytes, signed, written

WIDTH = 10
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 5
#: Windows of the benchmark in one Arrow batch.
BLOCK_WORDS = 200_000
#: Places of the bitmap of known shingles: 4 MB.
FILTER_BITS = 25
#: Bytes of texts in one Arrow batch.
TEXT_BYTES = 1 << 20

#: Words are runs of ASCII digits and letters and of everything beyond ASCII.
_TABLE = lowered_bytes(b"0123456789abcdefghijklmnopqrstuvwxyz")
_FACTOR = 0x9E3779B97F4A7C15
#: Bytes hashed at a time; a word longer than LONG is hashed by itself.
PIECE, LONG = 1 << 20, 1 << 16
_BITMAP_BITS = 15


def _powers(factor: int) -> np.ndarray:
    """1, f, f², ... modulo 2^64, for a piece and the word that may stick out of it."""
    out = np.full(PIECE + LONG, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of a batch of texts: their bytes, where each begins and ends, the text each is of, and
    the first word of each text (one more than there are texts)."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        texts = column.cast(pa.large_binary()).fill_null(b"")
        _, places, held = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = held[offsets[0]:offsets[-1]].to_pybytes().translate(_TABLE) if held else b""
        offsets = offsets - offsets[0]
        inside = np.frombuffer(data, np.uint8) != 32
        before, after = np.roll(inside, 1), np.roll(inside, -1)
        if len(data):
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        first = np.searchsorted(starts, offsets)
        return cls(data, starts, ends, np.repeat(np.arange(len(texts)), np.diff(first)), first)

    def hashes(self, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """A hash of each word, the same wherever the word stands."""
        data, out = np.frombuffer(self.data, np.uint8), np.zeros(len(self.starts), np.uint64)
        low = 0
        while low < len(self.starts):
            begin = self.starts[low]
            high = np.searchsorted(self.starts, begin + PIECE)
            piece = data[begin:min(self.ends[high - 1], begin + PIECE + LONG)]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * powers[:len(piece)], out=sums[1:])
            at = self.starts[low:high] - begin
            out[low:high] = (sums[np.minimum(self.ends[low:high] - begin, len(piece))]
                             - sums[at]) * inverse[at]
            low = high
        for i in np.flatnonzero(self.ends - self.starts > LONG).tolist():
            word = hashlib.blake2b(self.data[self.starts[i]:self.ends[i]], digest_size=8).digest()
            out[i] = int.from_bytes(word, "little")
        return out

    def runs(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The runs of `size` words that lie in one text: the place of each, and its hash."""
        n = max(0, len(hashes) - size + 1)
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = (out ^ hashes[k:k + n]) * np.uint64(_FACTOR)
            out ^= out >> np.uint64(29)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1:])
        return at, out[at]

    def between(self, low: int, high: int) -> bytes:
        """The words from `low` until before `high`, a space between."""
        return b" ".join(self.data[self.starts[low]:self.ends[high - 1]].split())


class Hashing:
    """Word hashes; the powers are made once per worker call."""

    def __init__(self):
        self.powers, self.inverse = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))

    def __call__(self, words: Words) -> np.ndarray:
        return words.hashes(self.powers, self.inverse)


@dataclass
class Known:
    """The shingles of the benchmark that matter: their sizes, and a bitmap of their hashes."""

    sizes: Sequence[int]
    bits: np.ndarray

    @classmethod
    def of(cls, shingles: DataFrame) -> Known:
        """From rows with `size` and `hash`; the driver gets FILTER_BITS bits at most."""
        place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
        part = F.shiftright(place, _BITMAP_BITS)
        rows = (shingles.groupBy(part.alias("part"))
                .agg(F.bitmap_construct_agg(place.bitwiseAND((1 << _BITMAP_BITS) - 1)).alias("bits"),
                     F.collect_set("size").alias("sizes")).collect())
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        length = 1 << (_BITMAP_BITS - 3)
        for row in rows:
            bits[row["part"] * length:(row["part"] + 1) * length] = np.frombuffer(
                bytes(row["bits"]), np.uint8)
        return cls(sorted({size for row in rows for size in row["sizes"]}), bits)

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - FILTER_BITS)
        bit = np.left_shift(1, (place & np.uint64(7)).astype(np.uint8), dtype=np.uint8)
        return self.bits[place >> np.uint64(3)] & bit != 0


def windows(benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE,
            most_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per item and window: item, the window's words as text, `n` of them, the size and the
    hashes of its shingles in order."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing()
        for batch in batches:
            if not batch.num_rows:
                continue
            words, names = Words.of(batch.column(1)), batch.column(0).to_pylist()
            hashes = hashing(words)
            shingles = {}
            for size in range(1, shingle + 1):
                at, values = words.runs(hashes, size)
                shingles[size] = np.zeros(len(hashes), np.uint64)
                shingles[size][at] = values
            rows = []
            for i, name in enumerate(names):
                low, high = int(words.first[i]), int(words.first[i + 1])
                n = min(width, high - low)
                size = min(n, shingle)
                for at in range(low, high - n + 1) if n else ():
                    rows.append({"item": name, "words": words.between(at, at + n), "n": n,
                                 "size": size,
                                 "hashes": signed(shingles[size][at:at + n - size + 1]).tolist()})
                    if len(rows) >= most_words:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int32()),
                        ("size", pa.int32()), ("hashes", pa.list_(pa.int64()))])
    byte_batches(benchmark.sparkSession, TEXT_BYTES)
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    return (benchmark.select(name.alias("item"), "text").distinct()
            .mapInArrow(cut, "item string, words binary, n int, size int, hashes array<long>")
            .withColumn("words", F.col("words").cast("string")))


def shingle_counts(docs: DataFrame, known: Known) -> DataFrame:
    """(hash, n): how often the corpus has each shingle the bitmap holds."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing()
        for batch in batches:
            words = Words.of(batch.column(0))
            hashes = hashing(words)
            for size in known.sizes:
                values = words.runs(hashes, size)[1]
                values, n = np.unique(values[known.hold(values)], return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": pa.array(signed(values)),
                                                  "n": pa.array(n.astype(np.int64))})

    byte_batches(docs.sparkSession, TEXT_BYTES)
    return (docs.select("text").mapInArrow(count, "hash long, n long")
            .groupBy("hash").agg(F.sum("n").alias("n")))


def prefixes(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest shingle, the first of equals: words, n, size, hash, offset."""
    shingles = distinct.select("words", "n", "size", F.posexplode("hashes").alias("offset", "hash"))
    rank = F.struct(F.coalesce(F.col("total"), F.lit(0)).alias("total"), "offset", "hash")
    return (shingles.join(counts.withColumnRenamed("n", "total"), "hash", "left")
            .groupBy("words", "n", "size").agg(F.min(rank).alias("best"))
            .select("words", "n", "size", "best.offset", "best.hash"))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def places(docs: DataFrame, known: Known, width: int) -> DataFrame:
    """A row per document with `n_words`, and a row per place whose shingle the bitmap holds: `hash`,
    `place`, and the words around it as text, of which `first` is the first."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing()
        for batch in batches:
            words = Words.of(batch.column(2))
            hashes = hashing(words)
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(),
                                                          pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(words.first)), *none], names)
            for size in known.sizes:
                at, values = words.runs(hashes, size)
                some = known.hold(values)
                at, values = at[some], values[some]
                # a long text with many places goes out in parts
                for low in range(0, len(at), 1 << 13):
                    place, value = at[low:low + (1 << 13)], values[low:low + (1 << 13)]
                    text = words.text[place]
                    begin = words.first[text]
                    left = np.maximum(begin, place - (width - 1))
                    right = np.minimum(words.first[text + 1], place + width)
                    around = [words.between(a, z) for a, z in zip(left.tolist(), right.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)),
                         pa.nulls(len(place), pa.int64()), pa.array(signed(value)),
                         pa.array(place - begin), pa.array(left - begin),
                         pa.array(around, pa.binary())], names)

    names = ["doc_id", "key", "n_words", "hash", "place", "first", "around"]
    byte_batches(docs.sparkSession, TEXT_BYTES)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           *(T.StructField(name, T.LongType()) for name in names[1:-1]),
                           T.StructField("around", T.BinaryType())])
    return docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(find, schema)


def hits(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """The join: (doc_id, key, start, words, n) for each window that stands in a document."""
    start = F.col("place") - F.col("offset")
    begin = (start - F.col("first")).cast("int")
    here = F.split(F.col("around").cast("string"), " ")
    # bounds first; the comparison is exact
    room = (begin >= 0) & (begin + F.col("n") <= F.size(here))
    same = F.array_join(F.slice(here, F.greatest(begin, F.lit(0)) + 1, F.col("n")), " "
                        ) == F.col("words")
    return (found.filter(F.col("hash").isNotNull()).drop("n_words")
            .join(prefix, "hash").filter(room & same)
            .select("doc_id", "key", start.alias("start"), "words", "n").distinct())


def search(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE,
           most_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All windows of all documents: the documents (doc_id, key, n_words), the hits, and which items
    have which window; stored."""
    owned = written(windows(benchmark, width, shingle, most_words), "windows")
    distinct = owned.select("words", "n", "size", "hashes").distinct()
    every = Known.of(distinct.select("size", F.explode("hashes").alias("hash")))
    prefix = written(prefixes(distinct, shingle_counts(docs, every)), "prefixes")
    found = written(places(docs, Known.of(prefix), width), "places")
    return (found.filter(F.col("n_words").isNotNull()).select("doc_id", "key", "n_words"),
            written(hits(found, prefix), "hits"), owned.select("item", "words"))


def ranges(hit: DataFrame) -> DataFrame:
    """Hit words as disjoint ranges: doc_id, key, start, end (exclusive)."""
    by_start = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    return (hit.select("doc_id", "key", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
            .withColumn("apart", apart).withColumn("number", F.sum("apart").over(by_start))
            .groupBy("doc_id", "key", "number")
            .agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("number"))


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, the hit `ranges` of words in order, the items
    found, sorted as text, and contaminated."""
    rows, hit, owned = search(docs.select("doc_id", "text"), benchmark, **how)
    spans = ranges(hit).groupBy("doc_id", "key").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    items = (hit.select("doc_id", "key", "words").distinct().join(owned, "words")
             .select("doc_id", "key", "item").distinct().groupBy("doc_id", "key")
             .agg(F.sort_array(F.collect_list("item")).alias("items")))
    named = spans.join(items.withColumnsRenamed({"doc_id": "of", "key": "of_key"}),
                       F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
                       ).select("of", "of_key", "n_hit", "ranges", "items")
    return (rows.join(named, F.col("doc_id").eqNullSafe(F.col("of"))
                      & (F.col("key") == F.col("of_key")), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce("ranges", F.array().cast("array<struct<start:bigint,end:bigint>>")
                               ).alias("ranges"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.col("n_hit").isNotNull().alias("contaminated")))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no window of a benchmark item, with their columns."""
    _, hit, _ = search(docs.select("doc_id", "text"), benchmark, **how)
    of, key = free_name(docs.columns, "hit_id"), free_name(docs.columns, "hit_key")
    gone = written(hit.select(F.col("doc_id").alias(of), F.col("key").alias(key)).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(of))
                     & (text_key(F.col("text")) == F.col(key)), "left_anti")
