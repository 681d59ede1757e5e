"""Line dedup over windows of three lines, and substring dedup over hashed units.

Line dedup: every three consecutive lines with a word make a window. Windows found more than once, anywhere, are kept
where they come first (by doc_id, then row, then place) and removed elsewhere: the lines that later occurrences cover
are merged and go. Texts with fewer than three such lines have no window and stay as they are.

Substring dedup: texts are cut into units, lines or paragraphs of any length. A unit is normalised (lower case, words
joined by blanks) and digested to 128 bits; digests are grouped over the whole table, the occurrence that ranks first
stays, ranked likewise, and the others go. A passage set inside a unit has no unit of its own, so the segments of units
that stay are digested, too, and a run of them, one after another, goes if each of them occurred before as a segment and
they have RUN_WORDS words together. What such runs leave of a unit counts as a unit for the rest of its text. A segment is a sentence; sentences of fewer than SHORT words that follow one another make one
segment of SHORT words or what is left of them. Spans of what was removed are places in the original text; units without
a word stay.

Null texts count as empty, stay null, and lose nothing. A null doc_id ranks before all others. Rows that repeat are
documents of their own: the first keeps its lines. All that is gathered for one document is bounded by its own text; a
window or unit that very many documents share is broadcast to their rows, so these never meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RID, SPACES, join_counted, keep, let, numbered

WINDOW = 3
#: Words of a run of repeated segments that goes from a line or paragraph which stays.
RUN_WORDS = 25
#: Words of a sentence that is a segment by itself.
SHORT = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _with_words(lines: Column) -> Column:
    """Line and place of each line that has a word."""
    placed = F.transform(lines, lambda x, i: F.struct(F.btrim(x, F.lit(SPACES)).alias("line"), i.alias("at")))
    return F.filter(placed, lambda x: x["line"] != "")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """RID and places (of lines, from 0) that later occurrences of windows cover: one row per document that has any;
    docs has RID, doc_id and text."""
    rows = docs.select(RID, F.col("doc_id").cast("long").alias("doc_id"), _with_words(_lines(F.col("text"))).alias("l"))

    def digest(l: Column, i: Column) -> Column:  # noqa: E741
        parts = [F.element_at(l, i + k)["line"] for k in range(window)]
        at = F.array(*[F.element_at(l, i + k)["at"] for k in range(window)])
        return F.struct(F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit("second"), *parts).alias("g"), at.alias("at"))

    found = rows.filter(F.size("l") >= window).select(
        RID,
        "doc_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - (window - 1)), lambda i: digest(F.col("l"), i))).alias("w"),
    ).select(RID, "doc_id", "w.h", "w.g", "w.at")
    found = keep(found)
    place = F.struct(F.col("doc_id"), F.col(RID), F.col("at")[0])
    first = keep(found.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    later = join_counted(found, first, ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy(RID).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))


def _deduped(docs: DataFrame, window: int, written: bool = False) -> DataFrame:
    """row (all columns of docs), text (what stays), lines (how many there were) and gone (places of those that went).
    The caller's columns stand inside the struct, so none of their names can clash with these."""
    rows = numbered(docs, F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row"))
    rows = keep(rows) if written else rows
    text = F.col("row")["text"]
    joined = rows.join(repeated_windows(rows.select(RID, F.col("row")["doc_id"].alias("doc_id"), text.alias("text")), window), RID, "left")

    # Places that stay come from a set difference, so the work follows the lines, however many of them go.
    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), text).otherwise(let(_lines(text), left)).alias("text"),
        F.size(_lines(text)).cast("long").alias("lines"),
        F.array_sort(F.coalesce(F.col("gone"), F.array().cast("array<int>"))).alias("gone"),
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def dedup_lines(docs: DataFrame, window: int = WINDOW, length: str | None = None, written: bool = False) -> DataFrame:
    """All columns of docs, under any names, text without the removed lines; length: a column that holds the characters
    of the text, and follows it where it changes; written: rows are numbered once, in a table of their own."""
    done = _deduped(docs, window, written)
    size = F.when(F.size("gone") > 0, F.length("text").cast("long"))
    return done.select(
        *[
            (F.col("text") if c == "text" else F.coalesce(size, F.col("row")[c]) if c == length else F.col("row")[c]).alias(c)
            for c in docs.columns
        ]
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places of lines, comma-joined) and the text that stays."""
    return _deduped(docs.select("doc_id", "text"), WINDOW).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.col("lines").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("removed"),
        "text",
    )


#: DuckDB, for the rows of line_report(documents).
LINES_SQL = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, rid, i - 1 AS pos, trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, rid, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), n AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos) AS k FROM l WHERE line <> ''),
w AS (
  SELECT doc_id, rid, pos, lead(pos, 1) OVER o AS pos2, lead(pos, 2) OVER o AS pos3,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win
  FROM n WINDOW o AS (PARTITION BY rid ORDER BY pos)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, rid, pos) AS occurrence FROM w WHERE win IS NOT NULL
), g AS (
  SELECT DISTINCT rid, unnest([pos, pos2, pos3]) AS pos FROM r WHERE occurrence > 1
), gone AS (SELECT rid, list(pos ORDER BY pos) AS gone FROM g GROUP BY rid)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       coalesce(array_to_string(gone, ','), '') AS removed,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(gone, i - 1)], chr(10)) END AS text
FROM d LEFT JOIN gone USING (rid)
"""

# Substring dedup

#: What ends a unit by kind; a unit keeps the characters that end it, so the units of a text make up the text.
CUTS = {"paragraph": re.compile(r"\n(?:[^\S\n]*\n)+"), "line": re.compile(r"\n")}
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
#: Place of a row that says of a document only that it repeats something of its own.
OWN = -1


def _lower(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _norm(text: str) -> str:
    return " ".join(text.split())


def _digest(norm: str, segment: bool = False) -> bytes:
    """Units and segments are told apart: a line of one word is no copy of a sentence of one word inside a line."""
    return xxhash.xxh3_128_digest(norm.encode("utf-8", "surrogatepass"), int(segment))


def segments(sizes: list[int]) -> list[tuple[int, int]]:
    """The first sentence of each segment and the one after its last, from the words of the sentences."""
    out, since, words = [], 0, 0
    for k, n in enumerate(sizes):
        if n >= SHORT and since < k:
            out.append((since, k))
            since, words = k, 0
        words += n
        if words >= SHORT:
            out.append((since, k + 1))
            since, words = k + 1, 0
    return [*out, (since, len(sizes))] if since < len(sizes) else out


def digests(text: str, kind: str, inner: bool) -> list[bytes]:
    """The digests of a text in order, each as often as it occurs: of each unit with a word, followed by those of its
    segments where these are wanted."""
    out = []
    for unit in CUTS[kind].split(_lower(text)):
        norm = _norm(unit)
        if norm:
            out.append(_digest(norm))
            if inner:
                inside = _SENTENCE.split(norm)
                if len(inside) == 1:
                    out.append(_digest(norm, True))
                else:
                    out.extend(_digest(" ".join(inside[a:b]), True) for a, b in segments([x.count(" ") + 1 for x in inside]))
    return out


def _pieces(pattern: re.Pattern, text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of text[a:b], each with what ends it."""
    ends = [m.end() for m in pattern.finditer(text, a, b)]
    if not ends or ends[-1] < b:
        ends.append(b)
    return list(zip([a, *ends], ends))


def removed(text: str, gone: set[bytes], kind: str, runs: int | None) -> tuple[int, int, list[tuple[int, int]]]:
    """How many units with a word a text has, how many units and segments go, and the spans of these in order; gone:
    digests that occur first in another text. What repeats within the text goes but for its first occurrence."""
    low, seen, units, n, spans = _lower(text), set(gone), 0, 0, []
    for a, b in _pieces(CUTS[kind], text, 0, len(text)):
        norm = _norm(low[a:b])
        if not norm:
            continue
        units += 1
        x = _digest(norm)
        if x in seen:
            n += 1
            spans.append((a, b))
            continue
        seen.add(x)
        if runs is None:
            continue
        end = a + len(text[a:b].rstrip())  # what ends the unit is part of no segment
        start = end - len(text[a:end].lstrip())
        found = _pieces(_SENTENCE, low, start, end)
        places = [(found[i][0], found[j - 1][1]) for i, j in segments([len(low[p:q].split()) for p, q in found])]
        run: list[tuple[int, int]] = []
        words, cut = 0, []
        for p, q in [*places, (end, end)]:
            norm = _norm(low[p:q])
            if norm and (y := _digest(norm, True)) in seen:
                run.append((p, q))
                words += norm.count(" ") + 1
                continue
            if run and words >= runs:
                n += len(run)
                cut.append((run[0][0], run[-1][1]))
            run, words = [], 0
            if norm:
                seen.add(y)
        if cut:
            # What is left of a unit counts as a unit from here on, and goes if it is one that occurred before.
            edges = [start, *(x for span in cut for x in span), end]
            left = _norm("".join(low[p:q] for p, q in zip(edges[::2], edges[1::2])))
            x = _digest(left)
            spans += [(a, b)] if not left or x in seen else cut
            seen.add(x)
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and merged[-1][1] == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return units, n, merged


def repeated_units(docs: DataFrame, kind: str, inner: bool) -> DataFrame:
    """RID and gone, the numbers (among the distinct digests of the text) of what occurs first in another row, and OWN
    where a text repeats something of its own: one row per document that has any. docs has RID, doc_id and text."""
    pair = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again, found = [], []
            for t in batch.column(2):
                every = digests(t.as_py() or "", kind, inner)
                order = dict.fromkeys(every)
                again.append(len(order) < len(every))
                found.append([{"h": int.from_bytes(x[:8], "little", signed=True), "g": int.from_bytes(x[8:], "little", signed=True)} for x in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(again), pa.array(found, pair)], names=[RID, "doc_id", "again", "d"])

    rows = docs.select(RID, F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = keep(rows.mapInArrow(run, f"{RID} long, doc_id long, again boolean, d array<struct<h:long,g:long>>"))
    found = texts.select(RID, "doc_id", F.posexplode("d").alias("at", "x")).select(RID, "doc_id", "at", "x.h", "x.g")
    first = found.groupBy("h", "g").agg(F.min(F.struct("doc_id", RID)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = keep(first.select("h", "g", F.col(f"first.{RID}").alias("owner"), "n"))
    later = join_counted(found.select(RID, "at", "h", "g"), first, ["h", "g"]).filter(F.col(RID) != F.col("owner"))
    own = texts.filter("again").select(RID, F.lit(OWN).alias("at"))
    return later.select(RID, "at").unionByName(own).groupBy(RID).agg(F.collect_list("at").alias("gone"))


def dedup_units(docs: DataFrame, kind: str = "line", runs: int | None = RUN_WORDS) -> DataFrame:
    """doc_id, text (what stays), n_units (lines or paragraphs with a word), n_removed (these and segments that went),
    and spans: start and end in the original text, in characters, of each removed run. runs: words of a run of repeated
    segments that goes; None takes whole units only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, gone_n, spans = [], [], [], []
            for t, gone in zip(batch.column(1), batch.column(2), strict=True):
                text, gone = t.as_py(), gone.as_py()
                if not text or gone is None:
                    texts.append(text)
                    n.append(sum(bool(x.strip()) for x in CUTS[kind].split(text or "")))
                    gone_n.append(0)
                    spans.append([])
                    continue
                order = list(dict.fromkeys(digests(text, kind, runs is not None)))
                units, out, cut = removed(text, {order[k] for k in gone if k != OWN}, kind, runs)
                ends = [0, *(x for span in cut for x in span), len(text)]
                texts.append("".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
                n.append(units)
                gone_n.append(out)
                spans.append([{"start": a, "end": b} for a, b in cut])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(spans, span)],
                names=["doc_id", "text", "n_units", "n_removed", "spans"],
            )

    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.join(repeated_units(rows, kind, runs is not None), RID, "left").select("doc_id", "text", "gone").mapInArrow(
        run, "doc_id long, text string, n_units long, n_removed long, spans array<struct<start:int,end:int>>"
    )
