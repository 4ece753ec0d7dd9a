"""Filter interaction audit: what each filter removes at each step of every order in which the filters may run.

A document's *mask* holds the filters that it fails. Every mask stands for one wide integer, whose 64-bit fields hold
the document's outcome at each step of each order (kept, removed here, failing but removed earlier), and which filter
alone it fails. The integers of a part's documents are summed; no field can carry into the next, as none
grows beyond the number of documents. Unpacked once, the sum is the whole audit of the part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialise, runs, working_on

WORD = "[^\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
#: Outcomes of a document at a step, in the order of their fields.
KEPT, REMOVED, REDUNDANT = range(3)
FIELD_BYTES = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


@lru_cache(maxsize=8)
def orders(names: str) -> tuple[str, ...]:
    return tuple("".join(p) for p in permutations(names))


@lru_cache(maxsize=8)
def wide_masks(names: str) -> tuple[int, ...]:
    """The wide integer of every mask: three fields for each step of each order, then one for each filter."""
    steps = len(orders(names)) * len(names)
    out = []
    for mask in range(1 << len(names)):
        fields = np.zeros(3 * steps + len(names), "<u8")
        for k, order in enumerate(orders(names)):
            earlier = 0
            for s, name in enumerate(order):
                bit = 1 << names.index(name)
                at = 3 * (k * len(names) + s)
                if mask & bit:
                    fields[at + (REDUNDANT if mask & earlier else REMOVED)] = 1
                elif not mask & earlier:
                    fields[at + KEPT] = 1
                earlier |= bit
        if mask and not mask & (mask - 1):
            fields[3 * steps + mask.bit_length() - 1] = 1
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return tuple(out)


def unpacked(total: int, names: str) -> tuple[np.ndarray, np.ndarray]:
    """((steps of all orders, outcomes), documents that fail one filter alone) of a sum of wide integers."""
    steps = len(orders(names)) * len(names)
    fields = np.frombuffer(total.to_bytes(FIELD_BYTES * (3 * steps + len(names)), "little"), "<u8").astype(np.int64)
    return fields[: 3 * steps].reshape(steps, 3), fields[3 * steps :]


def audited(part: str, counts: list[tuple[int, bool, bool, int]], names: str) -> pa.RecordBatch:
    """All rows of a part, from (mask, good, toxic, documents)."""
    if sum(c[3] for c in counts) >= 1 << (8 * FIELD_BYTES - 1):
        raise OverflowError("more documents than a field holds")
    wide = wide_masks(names)
    every, good, toxic = (sum(n * wide[mask] for mask, *flags, n in counts if kind is None or flags[kind]) for kind in (None, 0, 1))
    steps, unique = unpacked(every, names)
    size = len(names)
    which = np.array([names.index(f) for order in orders(names) for f in order])
    shapley = np.bincount(which, steps[:, REMOVED], size).astype(np.int64) if steps[:, REMOVED].sum() < 1 << 53 else np.array([steps[which == f, REMOVED].sum() for f in range(size)])
    columns = [steps[:, KEPT], steps[:, REMOVED], steps[:, REDUNDANT], unique[which], unpacked(good, names)[0][:, REMOVED], unpacked(toxic, names)[0][:, REMOVED], shapley[which]]
    named = [pa.array([part] * len(which)), pa.array([o for o in orders(names) for _ in range(size)]), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders(names))))]
    return pa.RecordBatch.from_arrays([*named, *map(pa.array, columns)], ["part", "filter_order", "step", *COUNTS])


def audit(flags: DataFrame, names: str = FILTERS) -> DataFrame:
    """``RESULT`` from ``flags`` (part, mask, good, toxic; a row per document): a row per part, order and step, zeros included.

    Documents of equal part, mask and labels are counted before anything is shuffled, so that a part of any size is at
    most ``4 * 2 ** len(names)`` rows when its wide integers are summed. Empty table: an empty result.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        for (part,), rows in runs(batches, ("part",)):
            yield audited(part, list(zip(rows["mask"], rows["good"], rows["toxic"], rows["n"])), names)

    counts = flags.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    return counts.repartition("part").sortWithinPartitions("part").mapInArrow(parts, RESULT)


def fails(text: Column) -> list[Column]:
    """What a text fails by itself: few words, repeated words, capitals, signs."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document; the last filter is failed by texts that a smaller doc_id has too."""
    text = F.coalesce("text", F.lit(""))
    own = F.lit(0)
    for k, failed in enumerate(fails(text)):
        own = own + F.when(failed, F.lit(1 << k)).otherwise(F.lit(0))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), own.alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    base = materialise(base, "audit-masks")
    first = base.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without a doc_id match nothing; the salt deals them out.
    salt = F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(F.lit(0))
    rows = base.join(first, ["digest", "doc_id"], "left").withColumn("salt", salt).join(marked.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left")
    again = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(16)).otherwise(F.lit(0))
    return rows.select("part", (F.col("own") + again).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``RESULT``: the five filters over whole texts, for every source, order and step.

    Nulls: a null text is empty, a null source is the part ''; a row with a null doc_id has no smaller one, is no
    smaller one and has no labels. Repeated rows count each; rows of one doc_id and text are not copies of each other.
    Of several labels of a doc_id any that says 1 counts. Long texts are read whole. Empty table: an empty result.
    Other columns are not read, so their names cannot clash.
    """
    return audit(document_flags(docs, labels))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
              regexp_matches(text, '[#$%&*|]'), coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false)] AS x
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, x, good, toxic, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, o, step.i AS step, x[o[step.i]] AS failing, len(list_filter(o[1:step.i - 1], lambda y: x[y])) > 0 AS gone, len(list_filter(x, lambda y: y)) = 1 AS alone, good, toxic, n FROM m, o, k step),
r AS (SELECT part, o, step, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
             coalesce(sum(n) FILTER (failing AND alone), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND failing AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic = 1), 0) AS toxic_lost
      FROM s GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda y: substr('ABCDE', y, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM r
"""
