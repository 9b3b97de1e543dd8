"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within `most` bits agree in at least two of most + 2 blocks of their bits. So each
distinct fingerprint goes, once per two blocks, to the group of their values; at four bits that is 15
groups of about 21 bits each, so groups stay small up to billions of fingerprints. Within a task groups
are sorted by Gray rank, which puts fingerprints with shared leading bits side by side. The index
factors the bits that all members of a run share into the node above it (a mask and a pattern). A
search adds up the differences that each level newly fixes, and drops whole groups once they exceed
the limit. It also drops groups already known to be in the searcher's own component, so a dense
group of near copies costs no pair for each two members, and only links of a spanning forest leave
the task.

A group of more than CHUNK fingerprints is cut into chunks; every pair of chunks meets in some task.

Defined cases: a null or empty text, and one without words, has the fingerprint zero, which links
like any other. Rows of one doc_id are rows of their own. A group with only null doc_ids has a null
component_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemart.llm.common import as_bytes, free_name, lowered_bytes, small_batches, written
from tidemart.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
#: Blocks that a group agrees in. More make smaller groups, and more of them.
AGREE = 2
#: Fingerprints of a group that meet in one task at once; larger groups are cut.
CHUNK = 32_768
#: Small groups share an index of about so many.
BATCH = 256
#: Children of an index node.
FANOUT = 16
#: (searcher, node) pairs held at once.
FRONTIER = 1 << 20

_LOWER = lowered_bytes()


# --- fingerprints ------------------------------------------------------------------------------

def fingerprint_of(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())),
        np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """The 64-bit fingerprint as a signed long."""
    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(t, width) for t in as_bytes(column)), np.uint64,
                            len(column))
        return pa.array(found.view(np.int64))

    return of(text)


# --- index -------------------------------------------------------------------------------------

def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of (mask, pattern) over fingerprints in Gray order; level 0 holds the leaves."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask, pattern = np.full(len(codes), full), codes
        self.levels = [(mask, pattern)]
        while len(mask) > FANOUT:
            starts = np.arange(0, len(mask), FANOUT)
            shared = np.bitwise_and.reduceat(mask, starts)
            ones = np.bitwise_and.reduceat(pattern, starts)
            any_one = np.bitwise_or.reduceat(pattern, starts)
            mask = shared & ~(ones ^ any_one)
            pattern = ones & mask
            self.levels.append((mask, pattern))
        # bits that a level fixes and the level above doesn't
        self.fixed = [m & ~np.repeat(up[0], FANOUT)[:len(m)]
                      for (m, _), up in zip(self.levels, self.levels[1:])] + [mask]

    def spread(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level, the label that all members of a node share, or -1."""
        out = [labels]
        while len(out) < len(self.levels):
            starts = np.arange(0, len(out[-1]), FANOUT)
            low = np.minimum.reduceat(out[-1], starts)
            out.append(np.where(low == np.maximum.reduceat(out[-1], starts), low, -1))
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, labels: list[np.ndarray], most: int,
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) within `most` bits, without those whose labels are equal already."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        step = max(1, FRONTIER // max(n, 1))
        waiting = []
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            waiting.append((top, np.repeat(q, n), np.tile(np.arange(n), len(q)),
                            np.zeros(len(q) * n, np.uint8)))
        waiting.reverse()
        while waiting:
            level, q, node, far = waiting.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                waiting.append((level, q[half:], node[half:], far[half:]))
                waiting.append((level, q[:half], node[:half], far[:half]))
                continue
            pattern = self.levels[level][1]
            far = far + np.bitwise_count((queries[q] ^ pattern[node]) & self.fixed[level][node])
            keep = (far <= most) & (labels[level][node] != own[q])
            q, node, far = q[keep], node[keep], far[keep]
            if not level:
                yield q, node
            elif len(q):
                below = len(self.levels[level - 1][0])
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = child < below
                waiting.append((level - 1, np.repeat(q, FANOUT)[inside], child[inside],
                                np.repeat(far, FANOUT)[inside]))


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b; a label is the smallest place of its component."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def links(codes: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the distinct codes under `most` differing bits: (member,
    first member)."""
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    index, labels = GrayIndex(codes), np.arange(len(codes))
    at, step = 0, 64
    while at < len(codes):
        own = labels[at:at + step]
        for q, leaf in index.search(codes[at:at + step], own, index.spread(labels), most):
            labels = _merge(labels, q + at, leaf)
        at += step
        step = min(4096, 2 * step)
    tied = np.flatnonzero(labels != np.arange(len(codes)))
    return codes[tied], codes[labels[tied]]


# --- distributed search ------------------------------------------------------------------------

def near_links(codes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links (a, b) of a spanning forest of the distinct fingerprints `code`: any two within
    `most` bits are connected by them, and no others."""
    blocks = most + AGREE
    edge = [64 * i // blocks for i in range(blocks + 1)]

    def bits(block: int) -> Column:
        width = edge[block + 1] - edge[block]
        return F.shiftrightunsigned(F.col("code"), edge[block]).bitwiseAND(F.lit((1 << width) - 1))

    def together(chosen: tuple[int, ...]) -> Column:
        value = bits(chosen[0])
        for block in chosen[1:]:
            value = F.shiftleft(value, edge[block + 1] - edge[block]).bitwiseOR(bits(block))
        return value

    value = [together(chosen) for chosen in combinations(range(blocks), AGREE)]
    placed = codes.select("code", F.posexplode(F.array(*value)).alias("block", "value"))
    large = (placed.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK)
             .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")))
    cut = placed.join(large.drop("n"), ["block", "value"], "left")
    chunk = F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")
    # a chunk goes to every pair it is part of
    pairs = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.least(chunk, other) * F.col("chunks") + F.greatest(chunk, other)))
    dealt = cut.select("code", "block", "value", F.explode(pairs).alias("pair"))
    key = ["block", "value", "pair"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, last = [], 0, None

        def done(parts):
            found = np.unique(np.concatenate(parts).view(np.uint64))
            a, b = links(found, most)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for frame in frames:
            if frame.empty:
                continue
            code = frame["code"].to_numpy()
            group = frame[key].to_numpy()
            begins = np.append(last is None or (group[0] != last).any(),
                               (group[1:] != group[:-1]).any(axis=1))
            last, at = group[-1], 0
            # one that is alone in its group has no partner there
            meets = ~(begins & np.append(begins[1:], False))
            code, begins = code[meets], begins[meets]
            # whole groups only; small ones share an index
            for begin in np.flatnonzero(begins).tolist():
                if n + begin - at >= BATCH:
                    yield done([*held, code[at:begin]])
                    held, n, at = [], 0, begin
            held.append(code[at:])
            n += len(code) - at
        if held:
            yield done(held)

    return (dealt.repartition(*key).sortWithinPartitions(*key)
            .mapInPandas(search, "a long, b long"))


def grouped(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(code, component_id, first) of each distinct fingerprint of (doc_id, code): the smallest
    doc_id of its component, and whose row stands for the component."""
    codes = prints.groupBy("code").agg(F.min("doc_id").alias("doc_id"))
    found = components(near_links(codes.select("code"), most))
    joined = (codes.join(found, codes["code"] == found["node"], "left")
              .withColumn("root", F.coalesce("root", "code")))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "code")
    least = joined.groupBy("root").agg(F.min(rank).alias("least"))
    return joined.join(least, "root").select(
        "code", F.col("least.doc_id").alias("component_id"), F.col("least.code").alias("first"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """One row per document: doc_id, its fingerprint in hexadecimal, its component."""
    small_batches(docs.sparkSession)
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), width).alias("code")),
                     "simhash")
    found = written(grouped(prints, most), "simhash-groups")
    return prints.join(found, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """The documents without their near-duplicates: of each component the row with the smallest
    doc_id stays. Of rows with one doc_id and fingerprint it is the one with the least hash of its
    columns, maps left out."""
    small_batches(docs.sparkSession)
    code = free_name(docs.columns, "simhash_code")
    stamped = written(docs.withColumn(code, fingerprint(F.col("text"), width)), "simhash-documents")
    found = grouped(stamped.select("doc_id", F.col(code).alias("code")), most)
    first = found.filter(F.col("code") == F.col("first")).select("code", "component_id").alias("f")
    kept = stamped.alias("d").join(
        first, (F.col(f"d.{code}") == F.col("f.code"))
        & F.col("d.doc_id").eqNullSafe(F.col("f.component_id")), "left_semi")
    place = free_name([*docs.columns, code], "simhash_place")
    hashed = [field.name for field in docs.schema.fields if "map<" not in field.dataType.simpleString()]
    again = Window.partitionBy(code, "doc_id").orderBy(F.xxhash64(*hashed), *(
        F.col(name) for name in ("text",) if name in hashed))
    return kept.withColumn(place, F.row_number().over(again)).filter(
        F.col(place) == 1).select(*docs.columns)
