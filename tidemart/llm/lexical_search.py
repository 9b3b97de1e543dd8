"""Ranked lexical search over an inverted index with geometric blocks.

The queries are a stated set; it is taken in blocks of at most BLOCK_TERMS different terms, and every
block meets all documents. Of each document the index keeps its vector over those terms (forward
index) and, per chunk of CHUNK_DOCS documents, a posting list of each term. A posting list longer
than a block is clustered by the similarity of its documents (nearest of evenly chosen members, by
projected vectors) and cut into blocks. A block stores the coordinatewise maximum of its documents'
vectors, rounded up to steps, over the terms that share a query with the list's term and don't weigh
more than it. A document's score comes from its heaviest term of the query and lighter ones, so a
query's product with the summary in the list of that term is never below the score.

Searching a chunk, a block is opened only if that bound reaches the query's threshold: the tenth best
score known so far. It starts from the best blocks of all chunks, scored when the index is built, so
the threshold is the corpus's and not the chunk's. Documents of opened blocks get their exact score
from the forward index. A document that belongs to the result is found in the list of its heaviest
term, so nothing is lost; blocks whose bound equals the threshold are opened, for ties.

Terms, counts, weights and scores are integers as stated at `weights` and `impacts`.

Defined cases: a null or empty text has no terms and is no document of the corpus; a query without
terms has no results. Repeated documents and repeated queries count and are ranked each. Equal scores
come by ascending doc_id, a null id last. Without documents or queries the result is empty. Other
columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemart.llm.common import as_bytes, byte_batches, lowered_bytes, written

TOP = 10
#: Different terms of the queries that are searched together.
BLOCK_TERMS = 8192
#: Documents of a chunk, and those of a block of a posting list at most.
CHUNK_DOCS, BLOCK_DOCS = 4096, 64
#: Impacts lie below SCALE; summaries hold them in steps, rounded up.
SCALE, STEP = 1_000_000, 3922
#: Dimensions of the vectors that documents are clustered by.
SKETCH = 32

#: Terms are runs of ASCII digits and letters and of everything beyond ASCII.
_TABLE = lowered_bytes(b"0123456789abcdefghijklmnopqrstuvwxyz")

VECTORS = "doc_id long, n long, terms array<int>, times array<int>"
#: One row a chunk; arrays as little-endian binary.
INDEX = ("doc_ids array<long>, rows binary, terms binary, impacts binary, block_terms binary, "
         "block_rows binary, blocks binary, summary_rows binary, summary_terms binary, "
         "summaries binary, seeds array<struct<query: int, score: long>>")


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df],
                    np.int64)


def impacts(times: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """1000000000 tf div (1000 tf + 8 m) with m = 10 + 90 n N div L, per entry."""
    m = 10 + 90 * n.astype(np.int64) * n_docs // n_terms
    times = times.astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * m)


class Queries:
    """A block of queries: their terms as numbers of the block's vocabulary."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.names, self.vocabulary, self.terms = [name for name, _ in items], {}, []
        for _, own in items:
            self.terms.append(np.array(sorted({
                self.vocabulary.setdefault(t, len(self.vocabulary)) for t in own}), np.int64))
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        """Sets the weights; a term without weight adds to no score and is left out."""
        self.weights = weights(n_docs, np.array([df.get(t, 0) for t in range(len(self.vocabulary))]))

    def useful(self) -> list[np.ndarray]:
        return [own[self.weights[own] > 0] for own in self.terms]

    def neighbours(self) -> list[np.ndarray]:
        """Of each term, itself and the lighter terms that share a query with it; of equal weights
        the lower number is the heavier."""
        found: list[set[int]] = [set() for _ in self.vocabulary]
        for own in self.useful():
            lighter = own[np.lexsort((own, -self.weights[own]))].tolist()
            for at, t in enumerate(lighter):
                found[t].update(lighter[at:])
        return [np.array(sorted(s), np.int64) for s in found]


def query_blocks(queries: DataFrame, most_terms: int = BLOCK_TERMS) -> Iterator[Queries]:
    """The queries in blocks; the driver holds one block and one query more."""
    held: list[tuple[object, list[bytes]]] = []
    known: set[bytes] = set()
    for name, text in queries.select("item_id", "text").toLocalIterator():
        own = sorted(set(terms_of(text.encode()))) if text else []
        if held and len(known.union(own)) > most_terms:
            yield Queries(held)
            held, known = [], set()
        if own:
            held.append((name, own))
            known.update(own)
    if held:
        yield Queries(held)


def vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """Of each document with terms: how many, and those of the queries with their occurrences."""
    vocabulary = queries.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            kept, n, terms, times = [], [], [], []
            for k, text in enumerate(as_bytes(batch.column(1))):
                own = terms_of(text)
                if not own:
                    continue
                found = np.array([t for t in map(get, own) if t is not None], np.int32)
                term, often = np.unique(found, return_counts=True)
                kept.append(k)
                n.append(len(own))
                terms.append(term)
                times.append(often.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()).take(pa.array(kept, pa.int32())),
                 pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        count, VECTORS)


def _cuts(lengths) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


class Chunk:
    """Forward index, blocks and summaries of some documents."""

    #: the arrays as stored: names and types
    STORED = {"rows": "<i8", "terms": "<u4", "impacts": "<i4", "block_terms": "<u4",
              "block_rows": "<i8", "blocks": "<u4", "summary_rows": "<i8", "summary_terms": "<u4",
              "summaries": "u1"}

    def __init__(self, doc_ids: list[int | None], **arrays: np.ndarray):
        self.doc_ids = doc_ids
        for name in self.STORED:
            setattr(self, name, arrays[name])
        #: first block of each term, for terms up to the highest one
        top = int(self.block_terms[-1]) + 2 if len(self.block_terms) else 1
        self.first = np.searchsorted(self.block_terms, np.arange(top))
        self.opened = self.met = 0

    @classmethod
    def build(cls, doc_ids, n, terms: list[np.ndarray], times: list[np.ndarray], n_docs: int,
              n_terms: int, weight: np.ndarray, neighbours: list[np.ndarray]) -> Chunk:
        sizes = np.array([len(t) for t in terms], np.int64)
        rows, term = _cuts(sizes), np.concatenate(terms).astype(np.int64)
        place = np.repeat(np.arange(len(sizes)), sizes)
        value = impacts(np.concatenate(times), np.asarray(n, np.int64)[place], n_docs, n_terms)
        dense = np.zeros((len(sizes), len(weight)), np.uint8)
        dense[place, term] = -(-value // STEP)
        # documents by direction: projected vectors of weighted impacts
        axes = np.random.default_rng(7).standard_normal((len(weight), SKETCH)).astype(np.float32)
        sketch = np.zeros((len(sizes), SKETCH), np.float32)
        for at in range(0, len(sizes), 256):
            part = slice(rows[at], rows[min(at + 256, len(sizes))])
            share = (value[part] * weight[term[part]] / SCALE).astype(np.float32)
            sketch[at:at + 256] = np.add.reduceat(axes[term[part]] * share[:, None],
                                                  rows[at:at + 256][:len(sizes) - at] - rows[at])
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)

        order = np.argsort(term, kind="stable")
        lists, starts = place[order], np.searchsorted(term[order], np.arange(len(weight) + 1))
        block_terms, block_sizes, blocks = [], [], []
        summary_sizes, summary_terms, summaries = [], [], []
        for t in np.flatnonzero((np.diff(starts) > 0) & (weight > 0)).tolist():
            own = lists[starts[t]:starts[t + 1]]
            own, first = cls._clustered(own, sketch)
            near = neighbours[t]
            most = np.maximum.reduceat(dense[own[:, None], near], first, axis=0)
            which, column = np.nonzero(most)
            block_terms.append(np.full(len(first), t))
            block_sizes.append(np.diff(np.append(first, len(own))))
            blocks.append(own)
            summary_sizes.append(np.bincount(which, minlength=len(first)))
            summary_terms.append(near[column])
            summaries.append(most[which, column])

        def joined(parts, kind):
            return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)

        return cls(list(doc_ids), rows=rows, terms=term.astype(np.uint32),
                   impacts=value.astype(np.int32), block_terms=joined(block_terms, np.uint32),
                   block_rows=_cuts(joined(block_sizes, np.int64)), blocks=joined(blocks, np.uint32),
                   summary_rows=_cuts(joined(summary_sizes, np.int64)),
                   summary_terms=joined(summary_terms, np.uint32),
                   summaries=joined(summaries, np.uint8))

    @staticmethod
    def _clustered(own: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A posting list ordered by cluster, and where its blocks start."""
        if len(own) <= BLOCK_DOCS:
            return own, np.zeros(1, np.int64)
        middles = own[np.linspace(0, len(own) - 1, -(-len(own) // BLOCK_DOCS)).astype(np.int64)]
        nearest = np.argmax(sketch[own] @ sketch[middles].T, axis=1)
        order = np.argsort(nearest, kind="stable")
        own, nearest = own[order], nearest[order]
        within = np.arange(len(own)) - np.searchsorted(nearest, nearest)
        return own, np.flatnonzero(within % BLOCK_DOCS == 0)

    def bounds(self, terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of a query's terms and the bounds of their documents' scores; `weight` is the
        query's, zero for other terms."""
        blocks, found = [], []
        for t in terms.tolist():
            if t + 1 >= len(self.first):
                continue
            low, high = self.first[t], self.first[t + 1]
            if low == high:
                continue
            cut = self.summary_rows[low:high + 1]
            part = slice(cut[0], cut[-1])
            product = weight[self.summary_terms[part]] * self.summaries[part]
            blocks.append(np.arange(low, high))
            found.append(np.add.reduceat(product, cut[:-1] - cut[0]) * STEP)
        none = np.zeros(0, np.int64)
        return (np.concatenate(blocks), np.concatenate(found)) if blocks else (none, none)

    def scores(self, places: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents from the forward index."""
        low, size = self.rows[places], self.rows[places + 1] - self.rows[places]
        start = _cuts(size)
        entry = np.arange(start[-1]) + np.repeat(low - start[:-1], size)
        return np.add.reduceat(weight[self.terms[entry]] * self.impacts[entry], start[:-1])

    def documents(self, blocks: np.ndarray) -> np.ndarray:
        parts = [self.blocks[self.block_rows[b]:self.block_rows[b + 1]] for b in blocks.tolist()]
        return np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, weight: np.ndarray, least: int
               ) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents of all blocks whose bound reaches `least`."""
        blocks, bound = self.bounds(terms, weight)
        chosen = blocks[bound >= max(least, 1)]
        self.met += len(blocks)
        self.opened += len(chosen)
        places = self.documents(chosen)
        return places, self.scores(places, weight) if len(places) else places

    def best(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The highest scores in the block with the highest bound."""
        blocks, bound = self.bounds(terms, weight)
        if not len(blocks):
            return bound
        found = self.scores(self.documents(blocks[[np.argmax(bound)]]), weight)
        return np.sort(found)[::-1][:TOP]

    def row(self, seeds: list[tuple[int, int]]) -> pa.RecordBatch:
        seed = pa.struct([("query", pa.int32()), ("score", pa.int64())])
        columns = {"doc_ids": pa.array([self.doc_ids], pa.list_(pa.int64()))}
        for name, kind in self.STORED.items():
            columns[name] = pa.array([getattr(self, name).astype(kind).tobytes()], pa.large_binary()
                                     ).cast(pa.binary())
        columns["seeds"] = pa.array([[{"query": q, "score": s} for q, s in seeds]], pa.list_(seed))
        return pa.RecordBatch.from_pydict(columns)

    @classmethod
    def read(cls, batch: pa.RecordBatch, at: int) -> Chunk:
        return cls(batch["doc_ids"][at].as_py(), **{
            name: np.frombuffer(batch[name][at].as_py(), kind).astype(
                np.uint8 if kind == "u1" else np.int64) for name, kind in cls.STORED.items()})


def _weight_of(queries: Queries, terms: np.ndarray) -> np.ndarray:
    own = np.zeros(len(queries.weights), np.int64)
    own[terms] = queries.weights[terms]
    return own


def index(rows: DataFrame, queries: Queries, n_docs: int, n_terms: int) -> DataFrame:
    """One row per chunk of documents: forward index, blocks, summaries, and for each query the
    scores of the most promising block."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        neighbours, useful = queries.neighbours(), queries.useful()

        def chunk(doc_ids, n, terms, times) -> pa.RecordBatch:
            made = Chunk.build(doc_ids, n, terms, times, n_docs, n_terms, queries.weights, neighbours)
            return made.row([(q, int(score)) for q, own in enumerate(useful)
                             for score in made.best(own, _weight_of(queries, own))])

        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            lists = [[np.asarray(v.values.to_numpy()) for v in batch.column(k)] for k in (2, 3)]
            for column, values in zip(held, (batch.column(0).to_pylist(),
                                             batch.column(1).to_pylist(), *lists)):
                column.extend(values)
            while len(held[0]) >= CHUNK_DOCS:
                yield chunk(*(column[:CHUNK_DOCS] for column in held))
                held = tuple(column[CHUNK_DOCS:] for column in held)
        if held[0]:
            yield chunk(*held)

    # documents without a term of the queries have no score
    return rows.filter(F.size("terms") > 0).mapInArrow(build, INDEX)


def search(chunks: DataFrame, queries: Queries, least: dict[int, int]) -> DataFrame:
    """The best documents of each query in each task's chunks: query, doc_id, score."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        useful = queries.useful()
        best: list[list[tuple[int, float, int | None]]] = [[] for _ in useful]
        for batch in batches:
            for at in range(batch.num_rows):
                chunk = Chunk.read(batch, at)
                for q, own in enumerate(useful):
                    if not len(own):
                        continue
                    floor = max(least.get(q, 1), -best[q][-1][0] if len(best[q]) == TOP else 1)
                    places, scores = chunk.search(own, _weight_of(queries, own), floor)
                    some = scores >= floor
                    names = [chunk.doc_ids[p] for p in places[some].tolist()]
                    best[q] = sorted(best[q] + [
                        (-s, math.inf if d is None else d, d)
                        for s, d in zip(scores[some].tolist(), names)], key=lambda r: r[:2])[:TOP]
        rows = [(q, d, -s) for q, own in enumerate(best) for s, _, d in own]
        yield pa.RecordBatch.from_pydict({
            "query": pa.array([r[0] for r in rows], pa.int32()),
            "doc_id": pa.array([r[1] for r in rows], pa.int64()),
            "score": pa.array([r[2] for r in rows], pa.int64())})

    return chunks.drop("seeds").mapInArrow(find, "query int, doc_id long, score long")


def _ranked(docs: DataFrame, queries: Queries) -> DataFrame:
    spark = docs.sparkSession
    rows = written(vectors(docs, queries), "vectors")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most as many rows as the block has terms
    queries.weigh(n_docs, dict(rows.select(F.explode("terms").alias("term"))
                               .groupBy("term").count().collect()))
    chunks = written(index(rows, queries, n_docs, max(n_terms, 1)), "search-index")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"))
    seeds = (chunks.select(F.inline("seeds")).withColumn("rank", F.row_number().over(ranked))
             .filter(f"rank <= {TOP}").groupBy("query")
             .agg(F.count("*").alias("n"), F.min("score").alias("least")))
    least = {q: s for q, n, s in seeds.collect() if n == TOP}
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = (search(chunks, queries, least).filter("score > 0")
             .withColumn("rank", F.row_number().over(ranked)).filter(f"rank <= {TOP}"))
    names = spark.createDataFrame(list(enumerate(queries.names)), "query int, item_id long")
    return found.join(names, "query").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """The highest-scoring documents of each query: item_id, rank, doc_id, score."""
    byte_batches(docs.sparkSession)
    queries = queries.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    out = None
    for block in query_blocks(queries, most_terms):
        part = _ranked(docs.select("doc_id", "text"), block)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame(
        [], "item_id long, rank int, doc_id long, score long")
