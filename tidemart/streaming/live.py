"""Rules whose other side changes while they run: a dictionary joined as it is now, and counts as a
changelog with retractions.

Both keep little state, per code and share or per bucket of keys, and take a key's rows as frames.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemart.streaming import buckets

# The rules travel to the workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shares that the rows of one dictionary code are dealt over.
SALTS = 8
# plain names: those with an underscore in front do not reach a stateful processor
_CODE, _SALT, _NAME, _FACT = "code_key", "share", "new_name", "fact_text"
#: A change of the dictionary; the highest version of a code is the newest.
ENTRY = T.StructType([T.StructField("dic_code", T.StringType()),
                      T.StructField("dic_name", T.StringType()),
                      T.StructField("version", T.LongType())])
_TEXT = T.StructType([T.StructField("text", T.StringType())])


class Names(StatefulProcessor):
    """Gives each fact of a code the code's name. Facts of a code that has none yet wait."""

    def __init__(self, name: str):
        self.name = name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("name", _TEXT)
        self.waiting = handle.getListState("waiting", _TEXT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.known.update((initialState[_NAME].iloc[-1],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        held = self.known.get()
        name, unnamed = held[0] if held else None, []
        # names of this micro-batch hold for its facts, whatever their order
        frames = [(frame, frame[frame[_FACT].isna()]) for frame in rows]
        fresh = [names for _, names in frames if len(names)]
        if fresh:
            newest = pd.concat(fresh).sort_values("name_version", kind="stable").iloc[-1]
            name = newest[_NAME]
            self.known.update((name,))
            if self.waiting.exists():
                yield self._named([text for text, in self.waiting.get()], name)
                self.waiting.clear()
        for frame, _ in frames:
            facts = frame[_FACT].dropna().tolist()
            if facts and name is not None:
                yield self._named(facts, name)
            else:
                unnamed += facts
        if unnamed:
            self.waiting.appendList([(text,) for text in unnamed])

    def _named(self, facts: list[str], name: str) -> pd.DataFrame:
        return pd.DataFrame({_FACT: facts, self.name: name})

    def close(self) -> None:
        pass


def named_live(facts: DataFrame, changes: DataFrame, stored: DataFrame, code: str, name: str,
               salts: int = SALTS) -> DataFrame:
    """Facts with the name of their code, as the dictionary is when they come.

    `stored` is the dictionary as it stands when the query first starts (dic_code, dic_name), `changes`
    a stream of later entries with a `version` that orders them. Facts of an unknown code wait for
    its entry instead of getting lost; a null code never has one, and such facts are left out as by an
    inner join. Facts are dealt over `salts` shares of their code and entries go to each, so no
    task holds a whole code.
    """
    fields = facts.schema
    spread = F.explode(F.array(*(F.lit(k) for k in range(salts))))
    text = F.to_json(F.struct(*fields.names), {"ignoreNullFields": "false"})
    dealt = facts.filter(F.col(code).isNotNull()).select(
        F.col(code).alias(_CODE), F.pmod(F.xxhash64(text), F.lit(salts)).cast("int").alias(_SALT),
        F.lit(None).cast("string").alias(_NAME), F.lit(None).cast("bigint").alias("name_version"),
        text.alias(_FACT))
    entries = changes.filter("dic_code IS NOT NULL").select(
        F.col("dic_code").alias(_CODE), spread.alias(_SALT), F.col("dic_name").alias(_NAME),
        F.col("version").cast("bigint").alias("name_version"), F.lit(None).cast("string").alias(_FACT))
    known = stored.select(F.col("dic_code").alias(_CODE), spread.alias(_SALT),
                          F.col("dic_name").alias(_NAME))
    rows = dealt.unionByName(entries).groupBy(_CODE, _SALT).transformWithStateInPandas(
        Names(name), T.StructType([T.StructField(_FACT, T.StringType()),
                                   T.StructField(name, T.StringType())]),
        "Append", "None", known.groupBy(_CODE, _SALT))
    return rows.select(F.from_json(_FACT, fields).alias("fact"), name).select("fact.*", name)


# --- counts as a changelog ---------------------------------------------------------------------

#: Kinds of changelog rows: a new group, the row before and after a change, a group that is gone.
NEW, BEFORE, AFTER, GONE = "+I", "-U", "+U", "-D"


def changelog(rows: DataFrame, key: str, sign: str) -> DataFrame:
    """Live counts per key as a changelog: `kind`, key and `row_count`. `sign` is 1 for a row that
    comes and -1 for one that goes. A change of a group gives the row it replaces and the row it
    leaves; a group whose count falls to zero is gone. Rows of a null key are a group too. Every Arrow
    batch is summed per key ahead of the shuffle, so a hot key costs a row a batch; counts are kept per
    bucket of keys."""
    kind = rows.schema[key].dataType
    summed = T.StructType([T.StructField(key, kind), T.StructField("amount", T.LongType())])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]).group_by(key).aggregate([("amount", "sum")])
                yield from table.select([key, "amount_sum"]).rename_columns(
                    [key, "amount"]).combine_chunks().to_batches()

    parts = rows.select(key, F.col(sign).cast("bigint").alias("amount")).mapInArrow(combine, summed)
    counted = buckets.applied(
        buckets.packed(parts, [key], [], amount=F.col("amount")).drop(buckets.ROW),
        buckets.Count((NEW, BEFORE, AFTER, GONE)),
        f"{buckets.KEY} string, row_count long, kind string")
    return buckets.unpacked(counted, T.StructType([T.StructField(key, kind)]), "row_count", "kind",
                            text=buckets.KEY)


def net(changes: DataFrame, key: str) -> DataFrame:
    """What a changelog adds up to: the groups that are there, with their counts."""
    amount = F.when(F.col("kind").isin(NEW, AFTER), F.col("row_count")).otherwise(-F.col("row_count"))
    return (changes.groupBy(key).agg(F.sum(amount).alias("row_count")).filter("row_count <> 0"))
