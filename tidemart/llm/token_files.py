"""Token ids in binary files with one shared zstandard dictionary.

A shard file holds documents in ascending doc_id order, each compressed by itself, so that one
short document is read without its neighbours:

    magic | dictionary SHA-256 (32 bytes) | id width (1 byte) | frames ... | index | footer

The index has three little-endian 64-bit columns: doc_id, offset of the frame, number of ids. The
footer is the offset of the index, the number of documents and the magic. A frame is the document's
ids as little-endian unsigned integers of the given width, compressed with the dictionary, which
lies beside the shards under its hash. Each task writes its own shard under a name of its attempt;
only files named in the manifest count, so a repeated or lost attempt leaves nothing that is read.

Defined cases: a null text is empty and has only the end id. A null doc_id comes first and is kept
as null by a flag in the manifest (their number per shard). Rows of one doc_id lie side by side,
ordered by a hash of the text. An empty table has no shards and gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window, functions as F

from tidemart.llm.common import opened, small_batches, written
from tidemart.session import work_dir

MAGIC = b"TMTOKEN1"
FOOTER = "<qq8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
END_ID = 0
#: The dictionary is trained on whole documents of at most so many characters, about so many.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 65_536
#: Samples that training takes at least.
_LEAST = 16
#: Text bytes of a shard, about; there are as many shards as shuffle partitions at least.
SHARD_BYTES = 128 << 20
LEVEL = 3
MANIFEST = "shard long, file string, n_docs long, n_nulls long, n_tokens long, n_bytes long"

#: A space with white space on both sides: where cutting before it would change the pieces.
_TIED = re.compile(r"\s (?:\s|\Z)")
# Fixed value: how a byte-level tokenizer cuts a text into pieces.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                        r"|\s+(?!\S)|\s+")
#: Marks that form one piece after a word.
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Words a worker remembers; beyond that it starts anew.
_KNOWN = 500_000
#: Words that go to the model at once.
_TOGETHER = 256


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Encodes whole texts with the tokenizers library.

    Texts mostly consist of single-spaced words, and a byte-level vocabulary never joins a word to
    the space after it. So a text can be cut before single spaces, each word that recurs is encoded
    once, and words of letters go to the library's model many at a time. Where that doesn't hold (a
    space between other white space, an added token in the text, another kind of vocabulary) texts
    are encoded in one go. With `plain_specials` the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain_specials
        #: strings that become one id wherever they stand
        self.added = [token.content for token in self.model.get_added_tokens_decoder().values()
                      if not (plain_specials and token.special)]
        vocabulary = self.model.get_vocab()
        self.type = np.dtype("<u2" if len(vocabulary) <= 65_536 else "<u4")
        self.letters = _byte_letters()
        space = self.letters[32]
        bytes_of = {letter: b for b, letter in self.letters.items()}
        # entries with a space inside, all of whose words are letters, would join words
        inside = [entry for entry in vocabulary if space in entry.lstrip(space)]
        joins = any(any(word.isalpha() for word in bytes(
            bytes_of.get(c, 32) for c in entry).decode(errors="replace").split(" "))
            for entry in inside)
        #: bytes that such entries have before a space; a piece that ends so is encoded by itself
        self.joining = {bytes_of[a] for entry in inside for a, b in zip(entry, entry[1:])
                        if b == space and a in bytes_of}
        splitter = self.model.pre_tokenizer
        self.by_word = (isinstance(self.model.model, models.BPE) and not joins
                        and isinstance(splitter, pre_tokenizers.ByteLevel)
                        and not splitter.add_prefix_space and self.model.normalizer is None)
        newline = self.letters[10]
        #: all bytes of entries that hold a newline; pieces without them stay apart between newlines
        self.beside = {bytes_of[c] for entry in vocabulary if newline in entry for c in entry}
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for entry, number in vocabulary.items():
            self.lengths[number] = len(entry)
        self.bpe = self.model.model
        self.known: dict[str, bytes] = {}  # ids of a space and the word
        self.pieces: dict[str, bytes] = {}  # ids of other pieces

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(one.ids, self.type).tobytes() for one in found]

    def _ids(self, piece: str) -> np.ndarray:
        """The model's ids of a piece, or of several words of letters with a space before each."""
        shown = piece.encode().decode("latin-1").translate(self.letters)
        return np.array([token.id for token in self.bpe.tokenize(shown)], self.type)

    def _together(self, words: list[str], into: dict[str, bytes], mark: str = " ") -> None:
        """Ids of each word, which the vocabulary doesn't join to the mark before the next one. A
        space belongs to the word that follows it; another mark is an id of its own."""
        own, size = int(mark != " "), self.type.itemsize
        for at in range(0, len(words), _TOGETHER):
            part = words[at:at + _TOGETHER]
            ids = self._ids(mark + mark.join(part))
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in part), np.int64, len(part)))
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            raw, low = ids.tobytes(), own * size
            for word, high in zip(part, (cuts * size).tolist()):
                into[word] = raw[low:high]
                low = high + own * size

    def _learn(self, words: list[str]) -> None:
        # a word of letters, perhaps with marks after it, is cut without a pattern
        cores = [word.rstrip(_MARKS) for word in words]
        plain = list(map(str.isalpha, cores))
        known, pieces = self.known, self.pieces
        mixed = {word: _PIECES.findall(" " + word) for word, p in zip(words, plain) if not p}
        spaced = {piece[1:] for own in mixed.values() for piece in own
                  if piece[0] == " " and len(piece) > 1}
        letters = {core for core, p in zip(cores, plain) if p}
        letters.update(filter(str.isalpha, spaced))
        self._together([word for word in letters if word not in known], known)
        others: dict[str, bytes] = {}
        self._together([piece for piece in spaced if not piece.isalpha()
                        and piece.encode()[-1] not in self.joining], others)
        bare = {piece for own in mixed.values() for piece in own
                if piece[0] != " " and piece not in pieces}
        self._together([piece for piece in bare
                        if self.beside.isdisjoint(piece.encode())], pieces, "\n")
        for word, core, p in zip(words, cores, plain):
            if p and len(core) < len(word):
                tail = word[len(core):]
                if tail not in pieces:
                    pieces[tail] = self._ids(tail).tobytes()
                known[word] = known[core] + pieces[tail]
        for word, own in mixed.items():
            found = []
            for piece in own:
                rest = piece[1:] if piece[0] == " " else ""
                got = (others.get(rest) or known.get(rest)) if rest else pieces.get(piece)
                if got is None:
                    got = pieces[piece] = self._ids(piece).tobytes()
                found.append(got)
            known[word] = b"".join(found)

    def encode(self, texts: list[str], spaced: bool = False) -> list[bytes]:
        """Ids of each text, with a space before it if `spaced`, as bytes of the integer type."""
        if not self.by_word:
            return self._whole([" " + t for t in texts] if spaced else texts)
        cut = [None if t.startswith(" ") or _TIED.search(t) or any(a in t for a in self.added)
               else t.split(" ") for t in texts]
        if spaced:
            # a text that starts with white space is tied to the space before it
            cut = [None if own is None or own[0][:1].isspace() or not own[0] else own
                   for own in cut]
            firsts = []
        else:
            # the first word of a text has no space before it
            firsts = [None if own is None else own.pop(0) for own in cut]
        if len(self.known) + len(self.pieces) > _KNOWN:
            self.known.clear()
            self.pieces.clear()
        known = self.known
        here = set(chain.from_iterable(own for own in cut if own))
        self._learn(list(here.difference(known)))
        get = known.__getitem__
        if spaced:
            whole = iter(self._whole([" " + t for t, own in zip(texts, cut) if own is None]))
            return [next(whole) if own is None else b"".join(map(get, own)) for own in cut]
        whole = iter(self._whole([t if own is None else first
                                  for t, first, own in zip(texts, firsts, cut)]))
        return [next(whole) if own is None else next(whole) + b"".join(map(get, own))
                for own in cut]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process; it outlives the task."""
    return Encoder(path)


def _sample(docs: DataFrame) -> tuple[list[str], int, int]:
    """Hash-chosen whole texts for the dictionary, and the table's rows and bytes, in one pass."""
    n = docs.count()  # from the files' footers
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    watch = Observation()
    short = (docs.observe(watch, F.sum(F.octet_length("text")).alias("bytes"))
             .filter(F.length("text") <= SAMPLE_CHARS))
    share = SAMPLE_ROWS / max(n, 1)
    picked = short.filter(key < max(1, share * 1_000_003)).orderBy(key, "text")
    texts = [row[0] for row in picked.select("text").limit(2 * SAMPLE_ROWS).collect()]
    size = watch.get["bytes"] or 0
    if len(texts) < _LEAST and n:  # few rows, or many copies of few
        texts = [row[0] for row in short.orderBy(key, "text").select("text")
                 .limit(SAMPLE_ROWS).collect()]
    return texts, n, size


def train_dictionary(texts: list[str], tokenizer: str) -> bytes:
    """A zstandard dictionary of serialized ids. Samples too few or too like each other to train on
    are the dictionary's content as they are; without any sample it is empty."""
    own = encoder(tokenizer)
    end = np.asarray([END_ID], own.type).tobytes()
    samples = [ids + end for ids in own.encode(texts)]
    try:
        if len(samples) >= _LEAST:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    content = b"".join(samples)[-DICTIONARY_BYTES:]
    return content * (8 // len(content) + 1) if content else b""


def _compressor(dictionary: bytes):
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held)


def _decompressor(dictionary: bytes):
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=held)


def write(docs: DataFrame, tokenizer: str, folder: str, shards: int | None = None) -> DataFrame:
    """Writes all documents and returns the stored manifest, one row per shard."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    texts, _, size = _sample(docs)
    dictionary = train_dictionary(texts, tokenizer)
    digest = hashlib.sha256(dictionary).digest()
    files, base = opened(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/{digest.hex()}.dictionary") as out:
        out.write(dictionary)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        own, packer, out = None, _compressor(dictionary), None
        ids, starts, sizes, nulls = [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                own, number = encoder(tokenizer), TaskContext.get().partitionId()
                name = f"shard-{number:06d}-{uuid.uuid4().hex[:12]}.tok"
                store, place = opened(folder)
                out = store.open_output_stream(f"{place}/{name}")
                out.write(MAGIC + digest + bytes([own.type.itemsize]))
                at = len(MAGIC) + 33
            end = np.asarray([END_ID], own.type).tobytes()
            for doc_id, raw in zip(batch.column(0).to_pylist(),
                                   own.encode(batch.column(1).to_pylist())):
                frame = packer.compress(raw + end)
                nulls += doc_id is None
                ids.append(doc_id or 0)
                starts.append(at)
                sizes.append(len(raw) // own.type.itemsize + 1)
                out.write(frame)
                at += len(frame)
        if out is None:
            return
        for column in (ids, starts, sizes):
            out.write(np.asarray(column, "<i8").tobytes())
        out.write(struct.pack(FOOTER, at, len(ids), MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict({
            "shard": [number], "file": [name], "n_docs": [len(ids)], "n_nulls": [nulls],
            "n_tokens": [sum(sizes)], "n_bytes": [at + 24 * len(ids) + FOOTER_BYTES]})

    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    key = F.xxhash64("text")
    ordered = (docs.repartitionByRange(n, F.col("doc_id"), key)
               .sortWithinPartitions("doc_id", key))
    return written(ordered.mapInArrow(shard, MANIFEST), "token-manifest")


class Shard:
    """Random access to one shard file; needs memory for its index and one document."""

    def __init__(self, folder: str, name: str):
        files, base = opened(folder)
        self.file = files.open_input_file(f"{base}/{name}")
        head = self.file.read(len(MAGIC) + 33)
        self.file.seek(self.file.size() - FOOTER_BYTES)
        index, n, magic = struct.unpack(FOOTER, self.file.read(FOOTER_BYTES))
        if head[:len(MAGIC)] != MAGIC or magic != MAGIC:
            raise ValueError(f"{name} is no token shard")
        digest = head[len(MAGIC):-1]
        self.type = np.dtype(f"<u{head[-1]}")
        with files.open_input_stream(f"{base}/{digest.hex()}.dictionary") as stream:
            dictionary = stream.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {name} has changed")
        self.dictionary = dictionary
        self.unpack = _decompressor(dictionary).decompress
        self.file.seek(index)
        columns = np.frombuffer(self.file.read(24 * n), "<i8").reshape(3, n)
        self.doc_ids, self.starts, self.sizes = columns
        self.ends = np.append(self.starts[1:], index)

    def ids(self, at: int) -> np.ndarray:
        """The ids of the document at a place of the index, with the end id."""
        start = int(self.starts[at])
        self.file.seek(start)
        got = np.frombuffer(self.unpack(self.file.read(int(self.ends[at]) - start)), self.type)
        if len(got) != self.sizes[at]:
            raise ValueError("a frame and the index differ")
        return got

    def find(self, doc_id: int, nulls: int = 0) -> np.ndarray | None:
        """Ids of the first document of that id."""
        at = nulls + int(np.searchsorted(self.doc_ids[nulls:], doc_id))
        return self.ids(at) if at < len(self.doc_ids) and self.doc_ids[at] == doc_id else None


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of all its ids as little-endian 32-bit integers), shard."""
    # one row per shard file, so one window over them is small
    placed = manifest.withColumn("before", F.sum("n_tokens").over(Window.orderBy("shard"))
                                 - F.col("n_tokens"))

    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                shard, before = Shard(folder, row.file), row.before
                starts = before + np.cumsum(shard.sizes) - shard.sizes
                for at in range(0, row.n_docs, 10_000):
                    part = range(at, min(at + 10_000, row.n_docs))
                    sums = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in part]
                    ids = pd.array(shard.doc_ids[part.start:part.stop], dtype="Int64")
                    ids[:max(0, row.n_nulls - at)] = pd.NA
                    yield pd.DataFrame({
                        "doc_id": ids, "start": starts[part.start:part.stop],
                        "n_tokens": shard.sizes[part.start:part.stop], "ids_crc32": sums,
                        "shard": row.shard})

    n = max(1, manifest.count())
    # a range for each shard: hashes would give some tasks several and some none
    return placed.repartitionByRange(n, "shard").mapInPandas(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes the documents' ids and reads the files back: one row per document."""
    folder = folder or work_dir(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, folder), folder)
