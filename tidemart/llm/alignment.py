"""Alignment of two tokenizers' tokens by the bytes they cover.

Each text is encoded by a byte-level vocabulary (A, with a space before the text) and by a piece
vocabulary (B, which adds that space). A batch of texts is one list array a side; flattened, with its
parent indices and segmented sums of token lengths, it gives every token's end within its document.
A hash join of both sides on (document, end) finds where both end: these offsets cut the tokens into
groups. Links are the pairs of occurrences whose bytes overlap; a batch has them grouped by document
and pair of ids, and grouped again into the number of documents of each pair.

A task numbers the pairs it meets and stores, per document, numbers and occurrences, compressed; and
per chunk of documents each pair once with its number of documents. Spark adds up the chunks' counts,
finds the highest count of each A id (one row an id, so its size is that of the vocabulary), and takes
the counts back to the chunks that hold the pair, where the documents' sums are formed. Links never
travel one by one. A chunk ends at CHUNK_PAIRS distinct pairs, so a task's memory is bounded by a
batch and a chunk's pairs.

Defined cases: a text that is null or empty, or that a side doesn't give back byte by byte (a lower
one eighth block, which B reads as a space), has no tokens: zeros and an empty digest. Strings of
special tokens are plain text. Repeated rows are documents each; null ids are kept. Other columns play
no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tidemart.llm.common import byte_batches
from tidemart.llm.token_files import Encoder
from tidemart.session import work_dir

#: Distinct pairs of a chunk, about; it ends with the batch that reaches them.
CHUNK_PAIRS = 1_000_000
#: Text of a batch, about; a batch's arrays take some hundred times that.
BATCH_BYTES = 1 << 20
#: Segments of text a worker remembers; beyond that it starts anew.
_KNOWN = 500_000
_SPACE = "▁"
# spaces and what follows them: no piece has a space after something else
_SEGMENT = re.compile(r" +[^ ]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

DOCUMENT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "links binary")
PAIR = "pair long, number int, n long"
STORED = f"kind string, chunk long, {DOCUMENT}, {PAIR}"
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
          "count_sum long, groups_sha256 string")


class Pieces:
    """Encodes whole texts with a sentencepiece model, each recurring segment once.

    A piece has spaces at its start only (checked), so texts can be cut where a space follows
    something else; the model adds the space of each segment itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(_SPACE in piece.lstrip(_SPACE) for piece in self.pieces)
        self.type = np.dtype("<u2" if len(self.pieces) <= 65_536 else "<u4")
        self.known: dict[str, bytes] = {}

    def token_bytes(self) -> list[bytes]:
        found = [_BYTE.fullmatch(p) if self.model.is_byte(i) else None
                 for i, p in enumerate(self.pieces)]
        return [bytes([int(m.group(1), 16)]) if m else p.replace(_SPACE, " ").encode()
                for m, p in zip(found, self.pieces)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.type).tobytes()
                for ids in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._ids(texts)
        # a lone space at the end is no segment that the model would give back
        cut = [None if t.endswith(" ") or _SPACE in t else _SEGMENT.findall(" " + t)
               for t in texts]
        if len(self.known) > _KNOWN:
            self.known.clear()
        new = list(set(chain.from_iterable(own for own in cut if own)).difference(self.known))
        self.known.update(zip(new, self._ids([segment[1:] for segment in new])))
        get = self.known.__getitem__
        whole = iter(self._ids([t for t, own in zip(texts, cut) if own is None]))
        return [next(whole) if own is None else b"".join(map(get, own)) for own in cut]


class Side:
    """A vocabulary as Arrow arrays: bytes and lengths of its tokens, and their ids as text."""

    def __init__(self, encoder, token_bytes: list[bytes], first: str):
        self.encoder, self.first, self.size = encoder, first, len(token_bytes)
        self.bytes = pa.array(token_bytes, pa.binary())
        self.lengths = pc.cast(pc.binary_length(self.bytes), pa.int64())
        #: each id as the first of its side in a group, and as a later one
        self.shown = [f"{mark}{i}" for mark in (first, ",") for i in range(self.size)]

    def ids(self, raw: list[bytes]) -> pa.ListArray:
        size = self.encoder.type.itemsize
        offsets = np.concatenate(([0], np.cumsum([len(r) // size for r in raw]))).astype(np.int32)
        values = np.frombuffer(b"".join(raw), self.encoder.type).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    def spelled(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes that the tokens of each list cover."""
        taken = self.bytes.take(pc.list_flatten(ids))
        if not len(taken):
            return [b""] * len(ids)
        data = taken.buffers()[2].to_pybytes()
        places = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)
        cuts = places[ids.offsets.to_numpy()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class Aligner:
    """Both sides of an alignment, built once per worker."""

    def __init__(self, bytes_path: str, pieces_path: str):
        a, b = Encoder(bytes_path, plain_specials=True), Pieces(pieces_path)
        entries = {i: e for e, i in a.model.get_vocab().items()}
        raw = {letter: n for n, letter in a.letters.items()}
        spelled = [bytes(raw[c] for c in entries[i]) if i in entries and all(
            c in raw for c in entries[i]) else entries.get(i, "").encode()
            for i in range(max(entries) + 1)]
        self.a, self.b = Side(a, spelled, ";"), Side(b, b.token_bytes(), "|")
        self.shown = pa.array(self.a.shown + self.b.shown)

    def tokens(self, texts: list[str]) -> tuple[list[int], pa.ListArray, pa.ListArray]:
        """Places of texts that both sides give back whole, and their ids."""
        places = [k for k, t in enumerate(texts) if t]
        own = [texts[k] for k in places]
        a = self.a.ids(self.a.encoder.encode(own, spaced=True))
        b = self.b.ids(self.b.encoder.encode(own))
        wanted = [b" " + t.encode() for t in own]
        same = [k for k, (x, y, z) in enumerate(zip(self.a.spelled(a), self.b.spelled(b), wanted))
                if x == z == y]
        if len(same) < len(places):
            keep = pa.array(same, pa.int32())
            a, b = a.take(keep), b.take(keep)
        return [places[k] for k in same], a, b


@lru_cache(maxsize=1)
def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    return Aligner(bytes_path, pieces_path)


def token_ends(side: Side, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Flat ids, ends counted over the whole batch, and the table (doc, end, place) whose ends
    count from the start of their document."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    running = pc.cumulative_sum(side.lengths.take(ids))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(lists.offsets[:-1])
    end = pc.subtract(running, before.take(doc))
    return (ids.to_numpy(), running.to_numpy(), pa.table(
        {"doc": doc, "end": end, "place": pa.array(np.arange(len(ids), dtype=np.int64))}))


class Batch:
    """The alignment of a batch of texts."""

    def __init__(self, both: Aligner, a: pa.ListArray, b: pa.ListArray):
        self.both, self.n = both, len(a)
        self.ids_a, ends_a, table_a = token_ends(both.a, a)
        self.ids_b, ends_b, table_b = token_ends(both.b, b)
        doc_a, doc_b = table_a["doc"].to_numpy(), table_b["doc"].to_numpy()
        met = table_a.join(table_b.rename_columns(["doc", "end", "other"]), ["doc", "end"],
                           join_type="inner", use_threads=False)
        #: whether a group ends at a token
        self.last_a = np.zeros(len(self.ids_a), np.int64)
        self.last_b = np.zeros(len(self.ids_b), np.int64)
        self.last_a[met["place"].to_numpy()] = 1
        self.last_b[met["other"].to_numpy()] = 1
        self.n_a = np.bincount(doc_a, minlength=self.n)
        self.n_b = np.bincount(doc_b, minlength=self.n)
        self.n_groups = np.bincount(doc_a, self.last_a, self.n).astype(np.int64)
        # every end of a token of either side ends one overlap
        alone = np.flatnonzero(self.last_a == 0)
        first = np.concatenate((np.searchsorted(ends_a, ends_b), alone))
        second = np.concatenate((np.arange(len(ends_b)), np.searchsorted(ends_b, ends_a[alone])))
        doc = doc_a[first]
        self.n_links = np.bincount(doc, minlength=self.n)
        pair = self.ids_a[first].astype(np.int64) * both.b.size + self.ids_b[second]
        links = pa.table({"doc": doc, "pair": pair}).group_by(
            ["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        #: document, pair and occurrences; and the number of documents of each pair
        self.links = links.rename_columns(["doc", "pair", "times"])
        counts = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
        self.counts = counts.rename_columns(["pair", "n"])

    def digests(self) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` of each document."""
        n_a, n_b = len(self.ids_a), len(self.ids_b)
        group_a = np.cumsum(self.last_a) - self.last_a
        group_b = np.cumsum(self.last_b) - self.last_b
        # tokens of a group lie side by side, those of A first
        a_before = np.searchsorted(group_a, np.arange(group_b[-1] + 2) if n_b else [0])
        b_before = np.searchsorted(group_b, np.arange(group_a[-1] + 2) if n_a else [0])
        first_a = np.concatenate(([1], self.last_a[:-1])) if n_a else self.last_a
        first_b = np.concatenate(([1], self.last_b[:-1])) if n_b else self.last_b
        which = np.empty(n_a + n_b, np.int64)
        which[np.arange(n_a) + b_before[group_a]] = self.ids_a + (1 - first_a) * self.both.a.size
        which[np.arange(n_b) + a_before[group_b + 1]] = (
            2 * self.both.a.size + self.ids_b + (1 - first_b) * self.both.b.size)
        shown = self.both.shown.take(pa.array(which))
        data = memoryview(shown.buffers()[2]) if len(shown) else b""
        places = np.frombuffer(shown.buffers()[1], np.int32, len(shown) + 1)
        cuts = places[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        # without the mark before the first group
        return [hashlib.sha256(data[a + 1:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]


class Chunk:
    """Pairs that a task has met, numbered as they come, with their numbers of documents."""

    def __init__(self):
        self.name = uuid.uuid4().int >> 65
        self.pairs = np.zeros(0, np.int64)  # sorted
        self.numbers = np.zeros(0, np.int64)  # of the sorted pairs
        self.n = np.zeros(0, np.int64)  # by number

    def add(self, batch: Batch) -> list[bytes]:
        """The links of each document as compressed differences of pair numbers, and occurrences."""
        own, n = batch.counts["pair"].to_numpy(), batch.counts["n"].to_numpy()
        at = np.searchsorted(self.pairs, own)
        new = own[(at >= len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != own)
                  ] if len(self.pairs) else own
        if len(new):
            order = np.argsort(np.concatenate((self.pairs, new)), kind="stable")
            numbers = np.concatenate((self.numbers, len(self.n) + np.arange(len(new))))
            self.pairs = np.concatenate((self.pairs, new))[order]
            self.numbers = numbers[order]
            self.n = np.concatenate((self.n, np.zeros(len(new), np.int64)))
        self.n[self.numbers[np.searchsorted(self.pairs, own)]] += n
        number = self.numbers[np.searchsorted(self.pairs, batch.links["pair"].to_numpy())]
        doc, times = batch.links["doc"].to_numpy(), batch.links["times"].to_numpy()
        order = np.argsort(doc.astype(np.int64) * len(self.n) + number)
        doc, number, times = doc[order], number[order].astype("<u4"), times[order].astype("<u4")
        cuts = np.searchsorted(doc, np.arange(batch.n + 1))
        pack = zstandard.ZstdCompressor(level=1).compress
        return [pack(np.concatenate((np.diff(number[a:b], prepend=np.uint32(0)), times[a:b])).tobytes())
                for a, b in zip(cuts, cuts[1:])]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.pairs), 65_536):
            part = slice(at, at + 65_536)
            numbers = self.numbers[part]
            yield _stored(len(numbers), kind=["pair"] * len(numbers),
                          chunk=[self.name] * len(numbers), pair=self.pairs[part],
                          number=numbers.astype(np.int32), n=self.n[numbers])


_FIELDS = pa.schema([
    ("kind", pa.string()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
    ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("links", pa.binary()), ("pair", pa.int64()),
    ("number", pa.int32()), ("n", pa.int64())])


def _stored(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
         for f in _FIELDS], schema=_FIELDS)


def store(docs: DataFrame, bytes_path: str, pieces_path: str, folder: str) -> None:
    """Aligns all documents and writes them, and the pairs of each chunk, below the folder."""
    byte_batches(docs.sparkSession, BATCH_BYTES)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunk = aligner(bytes_path, pieces_path), Chunk()
        for rows in batches:
            size = rows.num_rows
            texts = rows.column(1).to_pylist()
            places, a, b = both.tokens(texts)
            values = {name: np.zeros(size, np.int64)
                      for name in ("n_a", "n_b", "n_groups", "n_links")}
            digests, links = [""] * size, [b""] * size
            if places:
                batch = Batch(both, a, b)
                for name, column in values.items():
                    column[places] = getattr(batch, name)
                for place, digest, packed in zip(places, batch.digests(), chunk.add(batch)):
                    digests[place], links[place] = digest, packed
            yield _stored(size, kind=["doc"] * size, chunk=[chunk.name] * size,
                          doc_id=rows.column(0).cast(pa.int64()), groups_sha256=digests,
                          links=links, **values)
            if len(chunk.n) >= CHUNK_PAIRS:
                yield from chunk.rows()
                chunk = Chunk()
        yield from chunk.rows()

    (docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(align, STORED)
     .write.partitionBy("kind").parquet(folder))


def pair_counts(spark, folder: str, n_b: int) -> DataFrame:
    """Per chunk and pair: its number in the chunk, the count over all documents, and whether that
    is the highest of its A id."""
    rows = spark.read.schema(STORED).parquet(folder).filter("kind = 'pair'")
    # a chunk has a pair once, so what meets here is at most a row a chunk
    counted = rows.select("chunk", "number", "pair", F.sum("n").over(Window.partitionBy("pair"))
                          .alias("n"), F.expr(f"pair div {n_b}").alias("a"))
    highest = counted.groupBy("a").agg(F.max("n").alias("most"))
    # one row for each id of A at most
    return (counted.join(F.broadcast(highest), "a")
            .select("chunk", "number", "pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _sums(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Counts of a chunk's pairs added up for its documents."""
    number = pairs["number"].to_numpy()
    n, best = np.zeros(len(number) + 1, np.int64), np.zeros(len(number) + 1, np.int64)
    n[number] = pairs["n"].to_numpy()
    best[number] = pairs["best"].to_numpy()
    unpack = zstandard.ZstdDecompressor().decompress
    n_best, count_sum = [], []
    for packed in docs["links"].to_pylist():
        halves = np.frombuffer(unpack(packed), "<u4").reshape(2, -1) if packed else None
        if halves is None:
            n_best.append(0)
            count_sum.append(0)
            continue
        at, times = np.cumsum(halves[0], dtype=np.int64), halves[1].astype(np.int64)
        n_best.append(int((best[at] * times).sum()))
        count_sum.append(int((n[at] * times).sum()))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*(docs[c] for c in columns), pa.array(n_best, pa.int64()),
                     pa.array(count_sum, pa.int64()), docs["groups_sha256"]],
                    [*columns, "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Per document: tokens of either side, groups, links, and what the links' corpus-wide counts
    add up to."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "alignment")
    store(docs, bytes_path, pieces_path, folder)
    n_b = aligner(bytes_path, pieces_path).b.size
    rows = spark.read.schema(STORED).parquet(folder).filter("kind = 'doc'").select(
        "chunk", *(part.split()[0] for part in DOCUMENT.split(", ")))
    counts = pair_counts(spark, folder, n_b).select("chunk", "number", "n", "best")
    return rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_sums, RESULT)
