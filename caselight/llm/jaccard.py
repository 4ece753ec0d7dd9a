"""N-gram Jaccard join: documents whose word-shingle sets are alike, and the groups that such links make.

A prefix-tree join over all documents, distributed:

1. *Document frequencies.* How many of its shingles a document shares with others is counted exactly (``winnow``). Most
   documents share too few to link with anything; no pair is ever made of them.
2. *Global order.* The shingles of the others are ordered from rare to frequent. Two sets that link have a shingle in
   common among the first ``n - ceil(t n) + 1`` of each, their prefixes.
3. *Shards.* Documents that meet in a prefix shingle go to the shard of the smallest of them. So every link lies whole
   in a shard.
4. *Trees.* A shard stores its ordered sets in a trie and walks it with all of them at once: overlaps of common
   beginnings are counted once, subtrees are left by remaining-length bounds (``trie``). Sets that links have joined
   already are not compared again, so a large group of near copies costs little more than a comparison each.
5. *Large shards* are dealt in blocks. What stays in different groups after that is compared across the blocks, the
   sets outside the shard's largest group against all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import components
from .shared import broadcast_if_small, discard, free_name, materialise, runs, working_on
from .shingles import U
from .trie import Likeness, join
from .winnow import describe, described_sets, slices

__all__ = ["Likeness", "jaccard_groups", "keep_first"]

#: Sets and bytes of a block of a shard.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: An order number is the binary logarithm of a shingle's document frequency, then the upper bits of its hash.
ORDER = "shiftleft(cast(floor(log2(df)) as bigint), 57) | shiftrightunsigned(h, 7)"
SET_ROW = "node long, n long, elements binary, weight long, prefix array<long>"


def _needed(like: Likeness) -> str:
    return f"((n * {like.num} + {like.den} - 1) div {like.den})"


def ordered_sets(docs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """(node, n, elements, weight, prefix) of the classes (node, digest, id, n) that can link with another: the order
    numbers of the shingles that other classes have as well, ascending, and those of them in the prefix."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        for batch in batches:
            for some in slices(batch):
                elements, bounds, digests = described_sets(some, like.words)
                sets = [elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["id", "digest", "elements"])

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, elements in zip(batch.column("node").to_pylist(), batch.column("elements").to_pylist()):
                h = np.frombuffer(elements, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node, np.int64)), pa.array(h)], ["node", "h"])

    def to_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], [], [], []]
            for node, n, numbers in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("numbers")):
                order = np.unique(numbers.values.to_numpy())
                prefix = like.spare(n) + 1 - (n - len(order))  # shingles that no other set has come first
                if prefix > 0:
                    for column, value in zip(columns, (node, n, order.tobytes(), order.nbytes, order[:prefix])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())))], ["node", "n", "elements", "weight", "prefix"])

    texts = docs.join(broadcast_if_small(classes.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = texts.mapInArrow(to_sets, "id long, digest binary, elements binary").join(classes.drop("n"), ["id", "digest"])
    sets = materialise(sets.select("node", "elements"), "sets")
    rows = sets.mapInArrow(to_rows, "node long, h long")
    frequencies = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    numbers = rows.join(frequencies, "h").select("node", F.expr(ORDER).alias("number")).groupBy("node").agg(F.collect_list("number").alias("numbers"))
    ordered = materialise(numbers.join(classes.select("node", "n"), "node").mapInArrow(to_order, SET_ROW), "ordered")
    discard(sets)
    return ordered


def joined(units: DataFrame, ordered: DataFrame, like: Likeness) -> DataFrame:
    """Links (u, v) between the sets of each unit: rows (hub, low, high, node, label, leaf, probe)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        for _, rows in runs(batches, ("hub", "low", "high")):
            sets = [np.frombuffer(x, U) for x in rows["elements"]]
            label = np.array(rows["label"], np.int64)
            links = [] if (label == label[0]).all() else join(sets, np.array(rows["n"], np.int64), like, label, np.array(rows["leaf"], bool), np.array(rows["probe"], bool))
            pairs = [(rows["node"][a], rows["node"][b]) for a, b in links]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    grouped = units.join(ordered.select("node", "n", "elements"), "node").repartition("hub", "low", "high").sortWithinPartitions("hub", "low", "high")
    return grouped.mapInArrow(meet, "u long, v long")


def _blocks(rows: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(weight / F.lit(BLOCK_BYTES))).cast("int")


def _spread(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def links(ordered: DataFrame, like: Likeness) -> DataFrame:
    """Links (u, v) between ordered sets, enough of them to join all that links join."""
    keys = ordered.select("node", "weight", F.explode("prefix").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("rows")).where("rows > 1").select("key", "hub")
    members = materialise(keys.join(hubs, "key").groupBy("hub", "node").agg(F.first("weight").alias("weight")), "members")
    shards = members.groupBy("hub").agg(_blocks(F.count("*"), F.sum("weight")).alias("blocks"))
    dealt = members.join(shards, "hub")
    own = dealt.where("node <> hub").withColumn("low", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = own.select("hub", "low", "node").union(dealt.where("node = hub").select("hub", _spread("blocks").alias("low"), "node"))
    units = units.select("hub", "low", F.col("low").alias("high"), "node", F.col("node").alias("label"), F.lit(True).alias("leaf"), F.lit(True).alias("probe"))
    found = materialise(joined(units, ordered, like), "links")

    large = dealt.where("blocks > 1").select("hub", "node", "weight")
    if not large.isEmpty():
        more = materialise(joined(_across(large, components(found)), ordered, like), "more-links")
        found = found.union(more)
    return found


def _across(members: DataFrame, named: DataFrame) -> DataFrame:
    """Units of shards (hub, node, weight) in several blocks and several groups (node, component): the rows outside a
    shard's largest group against those in it, and against each other. Each two blocks meet once."""
    members = members.join(named, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    main = members.groupBy("hub", "label").agg(F.count("*").alias("rows")).groupBy("hub").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    members = materialise(members.join(main, "hub").select("hub", "node", "label", "weight", (F.col("label") != F.col("main")).alias("odd")), "large-shards")
    blocks = members.groupBy("hub").agg(*(_blocks(F.sum(side.cast("int")), F.sum(F.when(side, F.col("weight")).otherwise(0))).alias(name) for name, side in (("odds", F.col("odd")), ("mains", ~F.col("odd")))))
    members = members.join(blocks, "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("odd"), F.col("odds")).otherwise(F.col("mains"))).cast("int"))
    odd, rest = members.where("odd"), members.where("NOT odd")
    picked = ["hub", "low", "high", "node", "label", "leaf", "probe"]
    no, yes = F.lit(False), F.lit(True)
    apart = odd.withColumn("other", _spread("odds"))
    apart = apart.select("hub", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "label", yes.alias("leaf"), yes.alias("probe"))
    walking = odd.withColumn("low", _spread("mains")).select("hub", "low", (-1 - F.col("own")).alias("high"), "node", "label", no.alias("leaf"), yes.alias("probe"))
    standing = rest.withColumn("other", _spread("odds")).select("hub", F.col("own").alias("low"), (-1 - F.col("other")).alias("high"), "node", "label", yes.alias("leaf"), no.alias("probe"))
    return apart.union(walking.select(*picked)).union(standing.select(*picked))


def text_groups(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, n_shingles, digest, first) of every row: ``first`` is the struct (doc_id, digest) of the row with the
    smallest doc_id in the row's group of linked texts; null where the text links with no other row's."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = describe(docs, like.words)
    known = described.where("doc_id IS NOT NULL AND n_shingles > 0").withColumnRenamed("n_shingles", "n")
    classes = known.where(f"lone <= n - {_needed(like)}").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    ordered = ordered_sets(docs, classes, like)
    named = components(links(ordered, like))
    groups = classes.join(named, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("group"))
    firsts = groups.groupBy("group").agg(F.min(F.struct(F.col("id").alias("doc_id"), "digest")).alias("first"))
    firsts = materialise(groups.join(firsts, "group").select("digest", "first"), "groups")
    discard(ordered)
    discard(classes)
    return described.join(firsts, "digest", "left").select("doc_id", "n_shingles", "digest", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def jaccard_groups(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs``.

    Nulls: a null text has no shingles; a row without doc_id links with nothing and its component is null. Empty
    texts are in a component of their own. Rows that repeat a doc_id are one document: what links with any of them is
    in its component. Ties cannot occur: a component is named by its smallest doc_id. Empty table: an empty result.
    Texts are used whole, of any length. Other columns are not read, whatever their names.
    """
    rows = text_groups(docs, like).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
    known = rows.where("doc_id IS NOT NULL")
    repeated = known.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).where("low <> high")
    if repeated.isEmpty():
        return rows
    named = components(known.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))).select(F.col("node").alias("doc_id"), "component")
    return rows.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def keep_first(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The rows of ``docs`` without those that a row of a smaller doc_id stands for: of each group of linked texts one
    row stays.

    Nulls: rows without doc_id, without text or with an empty text all stay. Ties: of rows with equal doc_id and linked
    texts one stays, which of them is not defined if only other columns differ. A row that repeats a doc_id with a text
    of its own stays. Empty table: an empty result. Texts are used whole. Columns keep their names, order and values.
    """
    rows = materialise(text_groups(docs, like), "text-groups")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    stays = F.col("first").isNull() | ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.digest") == F.col("digest")))
    gone = materialise(known.where(~stays).select("doc_id").distinct(), "gone")
    repeated = materialise(known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    key = free_name("document", docs.columns)
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    kept = keyed.join(broadcast_if_small(gone.withColumnRenamed("doc_id", key)), key, "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    plain = keyed.join(gone.union(repeated).distinct().withColumnRenamed("doc_id", key), key, "left_anti").select(*docs.columns)

    mark = free_name("digest", [*docs.columns, key])

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                yield some.append_column(mark, pa.array(described_sets(some, like.words)[2], pa.binary()))

    several = keyed.join(repeated.withColumnRenamed("doc_id", key), key, "left_semi")
    several = several.mapInArrow(with_digest, StructType([*several.schema.fields, StructField(mark, BinaryType())]))
    empty = several.where(F.col(mark).isNull()).select(*docs.columns)
    firsts = known.where(stays).select(F.col("doc_id").alias(key), F.col("digest").alias(mark)).distinct()
    one = several.join(firsts, [key, mark], "left_semi").dropDuplicates([key, mark]).select(*docs.columns)
    return plain.union(one).union(empty)
