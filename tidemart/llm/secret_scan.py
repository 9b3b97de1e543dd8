"""Secret scans with built-in functions only.

Three patterns find plain secrets (assignments, access keys, long hexadecimal runs). Then candidate
strings of each character class (hexadecimal, base64) are walked once: a window of WINDOW characters
slides over the candidate, the counts of its characters change by the one that enters and the one
that leaves, and so does the sum of c * log2(c) that gives the window's Shannon entropy. Windows at
or above the class's limit are merged to spans. Candidates that are nothing but words or digits give
no span. Out of the spans are cut the patterns' matches, and the words that mark a sample with WINDOW
characters on either side; what is left of a span stays where it is as long as a window. So neither a
match nor a sample word takes more of a long candidate with it than its own surroundings.

Sums are kept in millionths as integers, so results don't depend on the order of additions.

Defined cases: a null text is empty; no secret gives zero counts and empty lists. Kinds may overlap;
each kind's own matches do not. Repeated rows are scanned each by itself. An empty table gives an
empty result. Starts and ends count code points, the end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemart.llm.common import let

# The three patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
ASSIGN_VALUE, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

WINDOW = 20
#: Symbols of each class and the least entropy, in bits a character, of a window to report.
CLASSES = {"entropy_hex": ("0123456789abcdefABCDEF", "0-9a-fA-F", 3.2),
           "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
                              "A-Za-z0-9+/_=-", 3.9)}
#: Words that mark a sample.
SAMPLES = "(?i:example|sample|placeholder|changeme|dummy|abcdefgh|12345678|qwerty)"
#: Candidates that look random and are known not to be secrets.
ALLOWED = (
    "^[a-z]+(?:[-_/=+][a-z]+)*$",
    "^[A-Z]?[a-z]+(?:[-_/=+]+[A-Z]?[a-z]+)*$",
    "^[A-Z]+(?:[-_/=+][A-Z]+)*$",
    "^[0-9]+$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")

_UNIT = 1_000_000
#: Millionths of c * log2(c).
SUMS = [0, *[round(_UNIT * c * math.log2(c)) for c in range(1, WINDOW + 2)]]
SPAN = "struct<start: int, kind: int, end: int>"


def most_sum(least_entropy: float) -> int:
    """The largest sum of a window at or above an entropy: H = log2(W) - sum / W."""
    return math.floor(_UNIT * WINDOW * (math.log2(WINDOW) - least_entropy))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _found(text: Column, pattern: str, kind: str) -> Column:
    """(start, value) of the matches of a pattern; a text without any is looked at once."""
    def walk(gaps: Column) -> Column:
        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["gap"])
            return F.struct(
                (start + F.length(pair["match"])).alias("at"),
                F.concat(state["rows"], F.array(F.struct(
                    start.alias("start"), pair["match"].alias("value")))).alias("rows"))

        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"),
                             F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
        zero = F.struct(F.lit(0).alias("at"), _none(kind).alias("rows"))
        return F.aggregate(pairs, zero, step, lambda state: state["rows"])

    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), walk)).otherwise(_none(kind))


def _spans(found: Column, number: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind"),
        (m["start"] + F.length(m["value"])).alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns; a match too short is dropped after it was found."""
    match = "struct<start: int, value: string>"
    assign = F.filter(_found(text, ASSIGN, match), lambda m: F.length(
        F.regexp_extract(m["value"], ASSIGN, 1)) >= ASSIGN_VALUE)
    # a shorter run is dropped either way, so these are found with their length at once
    access = _found(text, f"{ACCESS[:-1]}{{{ACCESS_CHARS - len('AKIA')},}}", match)
    long_hex = _found(text, f"{HEX[:-1]}{{{HEX_CHARS},}}", match)
    return F.concat(*[_spans(m, k) for k, m in enumerate((assign, access, long_hex))])


def _hot(symbols: Column, limit: int, kind: int, first: Column) -> Column:
    """Merged spans of the windows whose entropy reaches a limit. `symbols` are places in the class
    from 1 on; the counts of a window change by one symbol in and one out."""
    sums = F.array(*[F.lit(s) for s in SUMS])

    def step(state: Column, i: Column) -> Column:
        enters = symbols[i]
        leaves = F.when(i >= WINDOW, symbols[i - WINDOW]).otherwise(F.lit(0))
        more, less = state["counts"][enters], state["counts"][leaves]
        counts = F.transform(state["counts"], lambda n, k: n + (k == enters).cast("int")
                             - ((k == leaves) & (leaves > 0)).cast("int"))
        total = F.when(enters == leaves, state["sum"]).otherwise(
            state["sum"] + sums[more + 1] - sums[more]
            + F.when(leaves > 0, sums[less - 1] - sums[less]).otherwise(0))
        return F.struct(counts.alias("counts"), total.alias("sum"), i.alias("i"),
                        state["start"].alias("open"), state["end"].alias("end"),
                        state["spans"].alias("spans"))

    def mark(state: Column) -> Column:
        hot = (state["i"] >= WINDOW - 1) & (state["sum"] <= limit)
        begins = state["i"] - (WINDOW - 1)
        apart = hot & (state["end"] < begins)
        closed = F.when(apart & (state["end"] >= 0), F.concat(state["spans"], F.array(F.struct(
            state["open"].alias("start"), state["end"].alias("end")))))
        return F.struct(
            state["counts"].alias("counts"), state["sum"].alias("sum"),
            F.when(apart, begins).otherwise(state["open"]).alias("start"),
            F.when(hot, state["i"] + 1).otherwise(state["end"]).alias("end"),
            F.coalesce(closed, state["spans"]).alias("spans"))

    zero = F.struct(F.array_repeat(F.lit(0), 1 + max(len(c[0]) for c in CLASSES.values())).alias(
        "counts"), F.lit(0).alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
        _none("struct<start: int, end: int>").alias("spans"))
    ended = F.aggregate(
        F.sequence(F.lit(0), F.size(symbols) - 1), zero,
        lambda state, i: let(step(state, i), mark),
        lambda s: F.when(s["end"] >= 0, F.concat(s["spans"], F.array(F.struct(
            s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["spans"]))
    return F.transform(ended, lambda s: F.struct(
        (first + s["start"]).alias("start"), F.lit(kind).alias("kind"),
        (first + s["end"]).alias("end")))


def entropy_spans(text: Column, name: str) -> Column:
    """Spans of one character class."""
    symbols, written, least = CLASSES[name]
    found = _found(text, f"[{written}]{{{WINDOW},}}", "struct<start: int, value: string>")
    kept = F.filter(found, lambda m: ~_any_like(m["value"]))
    placed = F.transform(kept, lambda m: F.struct(
        m["start"].alias("start"), F.transform(F.split(m["value"], ""), lambda c: F.instr(
            F.lit(symbols), c)).alias("symbols")))
    return F.flatten(F.transform(placed, lambda m: _hot(
        m["symbols"], most_sum(least), KINDS.index(name), m["start"])))


def _any_like(value: Column) -> Column:
    found = value.rlike(ALLOWED[0])
    for pattern in ALLOWED[1:]:
        found = found | value.rlike(pattern)
    return found


def _around_samples(text: Column, more: Column) -> Column:
    """Places of sample words with their surroundings, in texts that have something to cut."""
    found = _found(text, SAMPLES, "struct<start: int, value: string>")
    wide = F.transform(found, lambda m: F.struct(
        (m["start"] - WINDOW).alias("start"), F.lit(-1).alias("kind"),
        (m["start"] + F.length(m["value"]) + WINDOW).alias("end")))
    return F.when(F.size(more) > 0, wide).otherwise(_none(SPAN))


def _left_of(span: Column, cuts: Column) -> Column:
    """The parts of a span outside the cuts, which come by start, as long as a window at least."""
    zero = F.struct(span["start"].alias("at"), _none("struct<start: int, end: int>").alias("parts"))

    def part(start: Column, end: Column) -> Column:
        return F.when(end - start >= WINDOW, F.array(F.struct(
            start.alias("start"), end.alias("end")))).otherwise(_none("struct<start: int, end: int>"))

    def step(state: Column, cut: Column) -> Column:
        return F.struct(F.greatest(state["at"], cut["end"]).alias("at"), F.concat(
            state["parts"], part(state["at"], F.least(cut["start"], span["end"]))).alias("parts"))

    parts = F.aggregate(cuts, zero, step, lambda s: F.concat(
        s["parts"], part(s["at"], span["end"])))
    return F.transform(parts, lambda p: F.struct(
        p["start"].alias("start"), span["kind"].alias("kind"), p["end"].alias("end")))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id with `base` (the patterns' spans) and `spans` (all), ordered by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), base_spans(text).alias("base"),
                       F.concat(*[entropy_spans(text, k) for k in CLASSES]).alias("more"))
    cuts = F.sort_array(F.concat("base", _around_samples(F.col("text"), F.col("more"))))

    def apart(cuts: Column) -> Column:
        return F.flatten(F.transform("more", lambda m: _left_of(m, F.filter(
            cuts, lambda c: (c["start"] < m["end"]) & (m["start"] < c["end"])))))

    return rows.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat(
        "base", F.when(F.size("more") > 0, let(cuts, apart)).otherwise(_none(SPAN)))).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"], s["end"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the patterns, their digest, and all spans as text."""
    return spans(docs).select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
