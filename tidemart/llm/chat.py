"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole:

    <|im_start|>role\\n text <|im_end|>\\n        for each turn

and encoded once, with offsets. The spans of assistant texts and the token spans are both sorted, so
the tokens of a turn are found by binary search; a token counts for the loss if it overlaps a span,
and the characters under the mask are the overlaps. The two turn marks are added to the tokenizer as
special tokens (nothing is trained), so encoding never crosses a turn.

Control strings inside texts and roles are escaped reversibly: `<`, any number of backslashes, `|`
gets one backslash more. In roles backslashes and line breaks are escaped too.

Turns are cut into parts of PART_TURNS turn numbers, each a row, so no task holds an endless
conversation; as turn marks separate encodings, parts put together equal the whole.

Defined cases: null texts and roles are empty. Turns are ordered by number (null first), then role,
then text; repeated rows are all kept. A null conv_id is a conversation. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemart.llm.common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
PART_TURNS = 64

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
FORMATTED = ("conv_id long, part long, n_turns long, formatted string, ids array<int>, "
             "loss_mask array<boolean>, loss_starts array<int>, loss_ends array<int>")
#: What `digests` reads of it.
DIGESTED = ("conv_id", "formatted", "loss_starts", "loss_ends", "part")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of the texts to learn from."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"
        if role == LEARNT_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(pieces), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        turns.append((unescape_role(formatted[at + len(START):line]),
                      unescape(formatted[line + 1:end])))
        at = end + len(END) + 1
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]],
         ) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens overlap a span, and the characters under them, span by span."""
    chosen, under = np.zeros(len(offsets), bool), []
    if not len(offsets):
        return chosen, under
    # tokens of one character share its offsets, so both columns ascend
    starts, ends = offsets[:, 0], offsets[:, 1]
    for low, high in spans:
        first = int(np.searchsorted(ends, low, "right"))
        last = int(np.searchsorted(starts, high, "left"))
        if first < last and low < high:
            chosen[first:last] = True
            at = max(low, int(starts[first]))
            if (starts[first + 1:last] > np.maximum(ends[first:last - 1], at)).any():
                raise ValueError("offsets leave a gap in a learnt text")
            under.append((at, min(high, max(at, int(ends[last - 1])))))
    return chosen, under


def load(path: str):
    """The tokenizer with the two turn marks; offsets keep leading spaces."""
    from tokenizers import AddedToken, Tokenizer, processors

    model = Tokenizer.from_file(path)
    model.post_processor = processors.ByteLevel(trim_offsets=False)
    model.add_special_tokens([AddedToken(START, normalized=False),
                              AddedToken(END, normalized=False)])
    return model


def _lists(values: list[Sequence], kind: pa.DataType) -> pa.ListArray:
    """One list a row, from arrays that lie end to end."""
    edges = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate([np.asarray(v) for v in values]) if values else np.array([])
    return pa.ListArray.from_arrays(edges, pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def format_conversations(conversations: DataFrame, tokenizer: str,
                         columns: Sequence[str] | None = None) -> DataFrame:
    """One row per conversation and part: the formatted text, its ids, the loss mask over ids and
    the character spans under it. With `columns`, only these leave the tasks; every part is encoded
    and masked in any case."""
    kept = [field for field in FORMATTED.split(", ")
            if columns is None or field.split()[0] in columns]
    small_batches(conversations.sparkSession)
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-(1 << 62))).cast("bigint")
    grouped = (conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"),
                                    part.alias("part"), turn.alias("t"))
               .groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load(tokenizer)
            turns = batch.column(2)
            edges, said = turns.offsets.to_pylist(), turns.values
            pairs = list(zip(said.field("role").to_pylist(), said.field("text").to_pylist()))
            texts = [render(pairs[a:b]) for a, b in zip(edges, edges[1:])]
            # added tokens match only where the template wrote them: texts are escaped
            encoded = model.encode_batch([t for t, _ in texts], add_special_tokens=False)
            masked = [mask(np.fromiter(chain.from_iterable(one.offsets), np.int64,
                                       2 * len(one)).reshape(-1, 2), spans)
                      for one, (_, spans) in zip(encoded, texts)]
            made = {
                "conv_id": lambda: batch.column(0), "part": lambda: batch.column(1),
                "n_turns": lambda: pa.array(np.diff(edges), pa.int64()),
                "formatted": lambda: pa.array([t for t, _ in texts], pa.string()),
                "ids": lambda: _lists([one.ids for one in encoded], pa.int32()),
                "loss_mask": lambda: _lists([chosen for chosen, _ in masked], pa.bool_()),
                "loss_starts": lambda: _lists([[a for a, _ in under] for _, under in masked],
                                              pa.int32()),
                "loss_ends": lambda: _lists([[b for _, b in under] for _, under in masked],
                                            pa.int32())}
            yield pa.RecordBatch.from_pydict(
                {name: made[name]() for name in (field.split()[0] for field in kept)})

    return grouped.mapInArrow(encode, ", ".join(kept))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted parts: turns, digests of all turns and of the
    learnt texts. Parts of a conversation stream by in order; only running digests are held."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        conv, turns, loss, counts = none, None, None, None

        def row():
            return {"conv_id": conv, "n_turns": counts[0], "turns_sha256": turns.hexdigest(),
                    "loss_chars": counts[1], "loss_sha256": loss.hexdigest(),
                    "formatted_chars": counts[2]}

        for frame in frames:
            out = []
            for conv_id, text, starts, ends in zip(*frame):
                if conv is none or conv_id != conv:
                    if conv is not none:
                        out.append(row())
                    conv, turns, loss, counts = (conv_id, hashlib.sha256(), hashlib.sha256(),
                                                 [0, 0, 0])
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                for a, b in zip(starts, ends):
                    learnt = unescape(text[a:b])
                    loss.update(learnt.encode())
                    counts[1] += len(learnt)
                counts[2] += len(text)
            yield out
        if conv is not none:
            yield [row()]

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()),
                        ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in read([c.to_pylist() for c in b.columns] for b in batches):
            yield pa.RecordBatch.from_pylist(rows, schema)

    return (formatted.select(*DIGESTED)
            .repartition("conv_id").sortWithinPartitions("conv_id", "part").drop("part")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))
