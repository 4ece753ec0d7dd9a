"""Similar cases: feature vectors, pair similarity, nearest reference cases and the reference repository."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.folders import kept

#: Weights of features in percent and the spans that differences are held against.
WEIGHTS = {"trust_score": (40, 100), "ocr_confidence": (10, 100), "metadata_score": (15, 100), "revision_count": (5, None), "salary_consistency": (10, "same"), "identity_similarity": (10, 1), "employer_consistency": (10, 1)}
BONUSES = {"pdf_producer": 5, "editing_software": 5, "context": 10}
#: Texts for which "None" says that there is none, so that it matches nothing.
TOOLS = ("pdf_producer", "editing_software")
SUSPICIOUS = "canva|photoshop|illustrator|inkscape|gimp|acrobat"
VECTOR = "trust_score decimal(9,1), ocr_confidence decimal(9,1), metadata_score decimal(9,1), pdf_producer string, revision_count int, salary_consistency boolean, context string"
#: Built-in reference cases.
BUILT_IN = [
    ("ref-g1", False, 98, 95, 100, "None", 1, True, "Loan Approval"), ("ref-g2", False, 92, 90, 100, "iText", 1, True, "KYC / Onboarding"), ("ref-g3", False, 88, 85, 80, "Quartz", 1, True, "Tenant Screening"),
    ("ref-f1", True, 20, 70, 20, "Canva", 3, False, "Loan Approval"), ("ref-f2", True, 35, 80, 40, "Canva", 2, False, "Mortgage Underwriting"), ("ref-f3", True, 45, 60, 60, "iText", 2, True, "Tenant Screening"),
]


def built_in(spark: SparkSession) -> DataFrame:
    from decimal import Decimal

    rows = [(i, f, *map(Decimal, n), p, r, s, c) for i, f, *n, p, r, s, c in BUILT_IN]
    return spark.createDataFrame(rows, "ref_id string, is_fraud boolean, " + VECTOR)


def likeness(feature: str, a: Column, b: Column) -> Column:
    """1 less the difference over its span; equal flags 1; a missing value counts as alike."""
    span = WEIGHTS[feature][1]
    if span == "same":
        part = F.when(a == b, 1).when(a != b, 0)
    else:
        width = F.greatest(F.lit(1), a, b) if span is None else F.lit(span)
        part = 1 - F.abs(a - b) / width
    return F.coalesce(part.cast("decimal(18,9)"), F.lit(1).cast("decimal(18,9)"))


def similarity(a: str, b: str, columns: list[str]) -> Column:
    """Similarity in percent of two vectors in one row, by prefixed columns; features that neither has count as alike."""
    total = F.lit(0).cast("decimal(18,9)")
    for name, (weight, _) in WEIGHTS.items():
        part = likeness(name, F.col(f"{a}{name}"), F.col(f"{b}{name}")) if name in columns else F.lit(1).cast("decimal(18,9)")
        total = total + part * weight
    for name, bonus in BONUSES.items():
        if name in columns:
            x, y = F.col(f"{a}{name}"), F.col(f"{b}{name}")
            same = (x == y) & (x != "None") if name in TOOLS else x == y
            total = total + F.when(same, bonus).otherwise(0)
    return F.bround(F.least(F.lit(100), total).cast("decimal(18,6)"), 1).cast("decimal(9,1)")


def differences(a: str, b: str, columns: list[str]) -> Column:
    """Names of features that differ by over 0.15 of their span, or as flags."""
    return F.array_compact(F.array(*[F.when(likeness(n, F.col(a + n), F.col(b + n)) < 0.85, F.lit(n)) for n in WEIGHTS if n in columns]))


def difference_texts(a: str, b: str, columns: list[str]) -> Column:
    """What ``differences`` finds, as texts in the order of features: by how much numbers differ, and both flags."""
    texts = []
    for name in [n for n in WEIGHTS if n in columns]:
        x, y, shown = F.col(a + name), F.col(b + name), name.replace("_", " ").title()
        flag = lambda c: F.when(c, "True").otherwise("False")
        if WEIGHTS[name][1] == "same":
            text = F.concat(F.lit(f"{shown} discrepancy: case has "), flag(x), F.lit(", target reference has "), flag(y), F.lit("."))
        else:
            text = F.concat(F.lit(f"{shown} varies by "), F.abs(x - y).cast("decimal(9,1)").cast("string"), F.lit(" points."))
        texts.append(F.when(likeness(name, x, y) < 0.85, text))
    return F.array_compact(F.array(*texts))


def prefixed(vectors: DataFrame, prefix: str) -> DataFrame:
    return vectors.select(*[F.col(c).alias(prefix + c) for c in vectors.columns])


def matches(cases: DataFrame, references: DataFrame, least: float = 60.0) -> DataFrame:
    """(case_id, ref_id, is_fraud, similarity) of each case with every reference of another id that is like enough.

    References are a bounded library (built-in and approved cases): they are broadcast, as their row limit is checked
    by ``library``. Cases against cases go through ``neighbours``.
    """
    columns = [c for c in references.columns if c not in ("ref_id", "is_fraud")]
    joined = prefixed(cases, "a_").join(F.broadcast(prefixed(references, "b_")), F.col("a_case_id").cast("string") != F.col("b_ref_id"))
    scored = joined.select(F.col("a_case_id").alias("case_id"), F.col("b_ref_id").alias("ref_id"), F.col("b_is_fraud").alias("is_fraud"), similarity("a_", "b_", columns).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


LIBRARY_ROWS = 10_000


def library(*parts: DataFrame) -> DataFrame:
    """The union of reference sets; a library of over ``LIBRARY_ROWS`` rows is refused here and belongs to ``neighbours``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if out.limit(LIBRARY_ROWS + 1).count() > LIBRARY_ROWS:
        raise ValueError(f"more than {LIBRARY_ROWS} references: use neighbours()")
    return out


def top_matches(found: DataFrame, k: int = 2) -> DataFrame:
    """The k best of each case and label; of equals the smaller reference id."""
    rank = F.row_number().over(Window.partitionBy("case_id", "is_fraud").orderBy(F.col("similarity").desc(), "ref_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Vectors of either side that meet in one cell, and in one step inside it.
CELL, STEP = 50_000, 512
#: A case is at most once a completed case and once an entry of the repository, so this many candidates can be itself.
OWN = 2
#: Bands of scores and buckets of texts that make the leaves of the index. With one each for missing values, and the
#: flag, there are at most 6,075 leaves (twice as many of references, by label), however many cases there are.
BUCKETS, FLAG, BANDS = {"context": 8, "pdf_producer": 4}, "salary_consistency", {"trust_score": 8, "metadata_score": 4}
#: Regions that leaves of cases are put together in, at least and at most; a large one is split into cells.
REGIONS = 16, 128
#: Most partitions that cells are dealt over.
PARTITIONS = 20_000
#: References that every task of a search may know, the first of each leaf.
HEAD = 65_536


def plain_features(vectors: DataFrame, others: list[str]) -> tuple[list[str], DataFrame]:
    """The feature columns that are there, and ``others`` beside them as numbers (nan is missing) and texts."""
    numbers, texts = ([c for c in group if c in vectors.columns] for group in (WEIGHTS, BONUSES))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    return numbers + texts, vectors.select(*others, *map(number, numbers), *[F.col(c).cast("string").alias(c) for c in texts])


def arrays(a: pa.Table, b: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Features of two tables: numbers (nan is missing) and codes of texts (-1 never matches); features that only one has are left out."""
    x, y = {}, {}
    for name in [n for n in (*WEIGHTS, *BONUSES) if n in a.column_names and n in b.column_names]:
        if name in WEIGHTS:
            x[name], y[name] = (np.array(t[name].to_pylist(), np.float64) for t in (a, b))
        else:
            codes: dict = {None: -1} | ({"None": -1} if name in TOOLS else {})
            x[name], y[name] = (np.array([codes.setdefault(v, len(codes)) for v in t[name].to_pylist()], np.int64) for t in (a, b))
    return x, y


def tenths(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """``similarity`` of each row of x with each of y, in tenths of a percent, by the same decimals."""
    total = np.zeros((len(next(iter(x.values()))), len(next(iter(y.values())))), np.int64)
    for name, (weight, span) in WEIGHTS.items():
        if name not in x:
            total += weight * 10**9
            continue
        p, q = x[name][:, None], y[name][None]
        part = (p == q).astype(float) if span == "same" else 1 - np.abs(p - q) / (np.maximum(1, np.maximum(p, q)) if span is None else span)
        total += weight * np.rint(np.where(np.isnan(p) | np.isnan(q), 1, part) * 1e9).astype(np.int64)
    for name, bonus in BONUSES.items():
        if name in x:
            total += np.where((x[name][:, None] == y[name][None]) & (x[name][:, None] >= 0), bonus * 10**9, 0)
    millionths = (np.minimum(total, 100 * 10**9) + 500) // 1000
    whole, rest = np.divmod(millionths, 100_000)
    return whole + ((rest > 50_000) | ((rest == 50_000) & (whole % 2 == 1)))


def bound(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> float:
    """What no pair of rows of x and y exceeds, in tenths: by the gaps between ranges, and all bonuses that some pair may get."""
    total = 100.0 + sum(w for n, w in BONUSES.items() if n in x and np.intersect1d(x[n][x[n] >= 0], y[n]).size)
    for name, (weight, span) in WEIGHTS.items():
        if name in x and not np.isnan(x[name]).any() | np.isnan(y[name]).any():
            ranges = x[name].min(), x[name].max(), y[name].min(), y[name].max()
            total -= weight * float(least_and_most(span, *ranges)[0])
    return min(1000.0, 10 * total + 1)


def least_and_most(span: float | str | None, a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most by which values of two ranges can differ, as a share of the span."""
    gaps = np.maximum(0, np.maximum(a_low - b_high, b_low - a_high)), np.maximum(a_high - b_low, b_high - a_low)
    if span == "same":
        return tuple((g > 0).astype(float) for g in gaps)
    if span is not None:
        return gaps[0] / span, gaps[1] / span
    # Held against the larger value: a gap is the least between the ends that face each other.
    between = np.where(a_low > b_high, a_low, b_low)
    apart = [np.abs(p - q) / np.maximum(1, np.maximum(p, q)) for p, q in ((a_low, b_high), (a_high, b_low))]
    return gaps[0] / np.maximum(1, between), np.maximum(*apart)


def leaf(columns: list[str]) -> Column:
    """The number of a vector's leaf, of at most 6,075, by buckets of texts, the flag and bands of scores."""
    code = F.lit(0)
    parts = [(F.pmod(F.xxhash64(c), F.lit(n)), n, c) for c, n in BUCKETS.items()] + [(F.col(FLAG), 2, FLAG)]
    parts += [(F.least(F.greatest(F.floor(F.col(c) * n / 100), F.lit(0)), F.lit(n - 1)), n, c) for c, n in BANDS.items()]
    for part, n, name in parts:
        if name in columns:
            known = F.col(name).isNotNull() & ((F.col(name) != "None") if name in TOOLS else F.lit(True))
            code = code * (n + 1) + F.when(known, part).otherwise(n)
    return code.cast("int")


def leaves(vectors: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """Summaries of leaves in their order: rows, and of each feature the smallest and largest value and how many rows have one."""
    value = {c: F.when(F.col(c) != "None", F.col(c)) if c in TOOLS else F.col(c) for c in names}
    found = vectors.groupBy("leaf").agg(F.count("*").alias("n"), *[f(value[c]).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max, F.count)])
    rows = sorted(found.collect(), key=lambda r: r["leaf"])  # as few as there are leaves
    out = {c: np.array([r[c] for r in rows], np.int64) for c in ["leaf", "n", *[f"count_{c}" for c in names]]}
    return out | {f"{e}_{c}": np.array([r[f"{e}_{c}"] for r in rows], object if c in BONUSES else np.float64) for c in names for e in ("min", "max")}


def ranked(a: dict[str, np.ndarray], b: dict[str, np.ndarray], names: list[str]) -> None:
    """Put places in the order of all texts in place of texts; -1 where a leaf has none."""
    for c in [c for c in names if c in BONUSES]:
        columns = [(side, f"{e}_{c}") for side in (a, b) for e in ("min", "max")]
        place = {v: k for k, v in enumerate(sorted({v for side, key in columns for v in side[key] if v is not None}))}
        for side, key in columns:
            side[key] = np.array([place.get(v, -1) for v in side[key]], np.int64)


def between(a: dict[str, np.ndarray], b: dict[str, np.ndarray], names: list[str], at: slice) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) in tenths: no pair of vectors of leaf a[at] and leaf b is less alike than low or more than high."""
    low = np.full((len(a["n"][at]), len(b["n"])), 100.0)
    high = low.copy()
    for c in names:
        ends = a[f"min_{c}"][at, None], a[f"max_{c}"][at, None], b[f"min_{c}"][None], b[f"max_{c}"][None]
        if c in BONUSES:
            some = (ends[0] >= 0) & (ends[2] >= 0)
            high += BONUSES[c] * (some & (ends[0] <= ends[3]) & (ends[2] <= ends[1]))
            whole = (a[f"count_{c}"] == a["n"])[at, None] & (b[f"count_{c}"] == b["n"])[None]
            low += BONUSES[c] * (some & whole & (ends[0] == ends[1]) & (ends[2] == ends[3]) & (ends[0] == ends[2]))
            continue
        weight, span = WEIGHTS[c]
        few, many = least_and_most(span, *ends)
        missing = (a[f"count_{c}"] < a["n"])[at, None] | (b[f"count_{c}"] < b["n"])[None]
        high -= weight * np.where(missing, 0, few)
        low -= weight * np.nan_to_num(many)
    # A tenth on either side for rounding; what reaches 100 is 100.
    return np.where(low > 100.01, 1000, np.minimum(1000, 10 * low - 1)), np.minimum(1000, 10 * high + 1)


class Near(NamedTuple):
    """Summaries of the leaves of two sides, as many as leaves, for the bounds of those that meet in a task."""

    a: dict[str, np.ndarray]
    b: dict[str, np.ndarray]
    names: list[str]

    def of(self, leaves_of_a: np.ndarray, leaves_of_b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places of its rows, what no row of b exceeds with them) of each leaf of a."""
        order, at = np.argsort(leaves_of_a, kind="stable"), np.searchsorted(self.b["leaf"], leaves_of_b)
        for rows in np.split(order, np.flatnonzero(np.diff(leaves_of_a[order])) + 1):
            one = int(leaves_of_a[rows[0]])
            place = int(np.searchsorted(self.a["leaf"], one))
            yield one, rows, between(self.a, self.b, self.names, slice(place, place + 1))[1][0, at]


class Cells:
    """Which leaves of two sides meet, and in which cells their rows do.

    Leaves of a, in order, are put together in regions; a leaf of b goes to the regions that hold a leaf it may match,
    and no other row is copied. Regions of over ``cell`` rows of a side are split, so that no cell holds more of either.
    """

    def __init__(self, near: Near, meets: np.ndarray, cell: int):
        a, b, _ = self.near = near
        total = int(a["n"].sum())
        number = min(REGIONS[1], max(REGIONS[0], -(-total // cell)))
        region = (np.cumsum(a["n"]) - a["n"]) * number // max(1, total)
        needs = np.zeros((number, len(b["n"])), bool)
        np.logical_or.at(needs, region, meets)
        split = lambda n: np.maximum(1, -(-n // cell))
        self.rows = split(np.bincount(region.astype(np.int64), a["n"], number).astype(np.int64))
        self.columns = split(needs @ b["n"])
        self.number = int(min(PARTITIONS, (self.rows * self.columns).sum()))
        self.compared, self.all = int(a["n"] @ (meets @ b["n"])), total * int(b["n"].sum())
        entry = lambda r: (int(r), int(self.rows[r]), int(self.columns[r]))
        self.a_routes = [(int(c), [entry(r)]) for c, r in zip(a["leaf"], region)]
        self.b_routes = [(int(c), [entry(r) for r in np.flatnonzero(needs[:, k])]) for k, c in enumerate(b["leaf"])]

    @classmethod
    def of_leaves(cls, numbers: np.ndarray, a_rows: np.ndarray, b_rows: np.ndarray, cell: int) -> Cells:
        """Cells of rows that already have the one leaf in which they meet as ``leaf``; b's rows are copied only where a's of a leaf are split."""
        self = cls.__new__(cls)
        self.rows, self.columns = (np.maximum(1, -(-n // cell)) for n in (a_rows, b_rows))
        self.number = int(min(PARTITIONS, max(1, (self.rows * self.columns).sum())))
        self.compared = self.all = int(a_rows @ b_rows)
        self.a_routes = self.b_routes = [(int(c), [(k, int(r), int(n))]) for k, (c, r, n) in enumerate(zip(numbers, self.rows, self.columns))]
        return self

    def meet(self, a: DataFrame, b: DataFrame, a_key: str, b_key: str, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``work`` of the rows of a and of b of each cell; both have ``leaf``. No row of a meets one of b twice."""
        spark, kind = a.sparkSession, "leaf int, route array<struct<region: int, rows: int, columns: int>>"
        # Routes have a row per leaf and at most REGIONS[1] entries each, so that they are always small.
        one, two = (F.broadcast(spark.createDataFrame(r, kind)) for r in (self.a_routes, self.b_routes))
        spread = lambda d, r: d.join(r, "leaf").withColumn("_to", F.explode("route")).drop("route")
        own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cells = ["_region", "_row", "_column"]
        left = spread(a, one).withColumns({"_region": F.col("_to.region"), "_row": own(a_key, "_to.rows")}).withColumn("_column", every("_to.columns")).drop("_to")
        right = spread(b, two).withColumns({"_region": F.col("_to.region"), "_column": own(b_key, "_to.columns")}).withColumn("_row", every("_to.rows")).drop("_to")
        # Other names on the right, as both sides may be one table.
        right = right.select(*cells, *[F.col(c).alias("b_" + c) for c in right.columns if c not in cells])
        grouped = [d.repartition(self.number, *cells).groupBy(*cells) for d in (left, right)]

        def both(x: pa.Table, y: pa.Table) -> pa.Table:
            return work(x, y.rename_columns([c.removeprefix("b_") for c in y.column_names])) if x.num_rows and y.num_rows else pa.table({})

        return grouped[0].cogroup(grouped[1]).applyInArrow(both, schema)

    def pairs(self, rows: DataFrame, key: str, work: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``work`` of the rows of each cell as a and as b, where both sides are the same table. What it yields goes on at once,
        so that a task holds the rows of a cell and never all of its pairs."""
        spark, kind = rows.sparkSession, "leaf int, route array<struct<region: int, rows: int, columns: int>>"
        one, two = (F.broadcast(spark.createDataFrame(r, kind)) for r in (self.a_routes, [(c // 2, r) for c, r in self.b_routes]))
        start = np.cumsum(self.rows * self.columns) - self.rows * self.columns
        first = F.element_at(F.array(*(F.lit(int(n)) for n in start)), F.col("_to.region") + 1)
        sides = []
        for side, routes in enumerate((one, two)):
            own, many = ("rows", "columns") if side == 0 else ("columns", "rows")
            sent = rows.join(routes, "leaf").withColumn("_to", F.explode("route")).drop("route")
            sent = sent.withColumns({"_own": F.pmod(F.xxhash64(key), F.col(f"_to.{own}")), "_each": F.explode(F.sequence(F.lit(0), F.col(f"_to.{many}") - 1))})
            place = F.col("_own") * F.col("_to.columns") + F.col("_each") if side == 0 else F.col("_each") * F.col("_to.columns") + F.col("_own")
            sides.append(sent.select((first + place).cast("long").alias("_cell"), F.lit(side).alias("_side"), *rows.columns))
        dealt = sides[0].union(sides[1]).repartition(self.number, "_cell").sortWithinPartitions("_cell", "_side")

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, now = [], None
            for batch in batches:
                cell = batch.column("_cell").to_numpy()
                for part in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
                    if not len(part):
                        continue
                    if cell[part[0]] != now and held:
                        yield from both(held)
                        held = []
                    now = cell[part[0]]
                    held.append(batch.slice(part[0], len(part)))
            if held:
                yield from both(held)

        def both(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = pa.Table.from_batches(held)
            a = int(pa.compute.sum(pa.compute.equal(cell["_side"], 0)).as_py())
            if 0 < a < cell.num_rows:
                yield from work(cell.slice(0, a), cell.slice(a))

        return dealt.mapInArrow(cells, schema)


def cells_between(a: DataFrame, b: DataFrame, names: list[str], floors: Callable[[np.ndarray, dict], np.ndarray], cell: int, within: str | None = None) -> tuple[Cells, dict[int, list[int]]]:
    """The cells of two sides with ``leaf``, that of b doubled and one more for rows of the second label.

    ``floors`` of (low, leaves of b) gives for each leaf of a, by label, the likeness from which on pairs are wanted; it
    is returned by leaf. ``within``: a text among ``names`` that has to be the same.
    """
    p, q = leaves(a, names), leaves(b, names)
    ranked(p, q, names)
    meets, wanted = np.zeros((len(p["n"]), len(q["n"])), bool), {}
    for k in range(0, len(p["n"]), 256):
        at = slice(k, k + 256)
        low, high = between(p, q, names, at)
        least = floors(low, q)
        meets[at] = high >= least[:, q["leaf"] % 2]
        if within:
            low_a, high_a, low_b, high_b = p[f"min_{within}"][at, None], p[f"max_{within}"][at, None], q[f"min_{within}"][None], q[f"max_{within}"][None]
            meets[at] &= (low_a >= 0) & (low_b >= 0) & (low_a <= high_b) & (low_b <= high_a)
        wanted |= {int(c): [int(v) for v in f] for c, f in zip(p["leaf"][at], least)}
    return Cells(Near(p, q, names), meets, cell), wanted


def steps(x: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Places of rows in steps of rows that are alike."""
    order = np.lexsort([x[n] for n in ("trust_score", "pdf_producer", "context") if n in x])
    return [order[k : k + STEP] for k in range(0, len(order), STEP)]


def picked(x: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {n: v[at] for n, v in x.items()}


def sides(cases: DataFrame, references: DataFrame, k: int) -> tuple[list[str], list[str], DataFrame, DataFrame]:
    """Feature columns of references and of cases, cases with their vectors, and references that can be among the best."""
    names, known = plain_features(references, ["ref_id", "source", "is_fraud"])
    own, asked = plain_features(cases, ["case_id"])
    asked = asked.withColumn("vector", F.to_json(F.struct(*own))).withColumn("leaf", leaf(own))
    known = known.where("ref_id IS NOT NULL").withColumns({"ref_id": F.col("ref_id").cast("string"), "source": F.col("source").cast("int"), "is_fraud": F.coalesce("is_fraud", F.lit(False))})
    first = F.row_number().over(Window.partitionBy("is_fraud", *names).orderBy("source", "ref_id"))
    known = known.withColumn("_n", first).where(F.col("_n") <= k + OWN).drop("_n").withColumn("leaf", leaf(names) * 2 + F.col("is_fraud").cast("int"))
    return names, own, asked, known


def searched(asked: DataFrame, known: DataFrame, names: list[str], k: int, least: float) -> tuple[Cells, dict[int, list[int]]]:
    """The cells in which leaves of cases and references meet.

    Where leaves of at least as many references as are wanted are all so much alike a leaf of cases, others whose bound
    is less cannot be among the best of any of its cases, and do not meet it.
    """

    def floors(low: np.ndarray, theirs: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full((len(low), 2), round(least * 10), np.int64)
        for label in (0, 1):
            mine = np.flatnonzero(theirs["leaf"] % 2 == label)
            if theirs["n"][mine].sum() >= k + OWN:
                order = mine[np.argsort(-low[:, mine], 1, kind="stable")]
                last = np.argmax(np.cumsum(theirs["n"][order], 1) >= k + OWN, 1)
                out[:, label] = np.maximum(out[:, label], np.floor(low[np.arange(len(low)), order[np.arange(len(low)), last]]))
        return out

    return cells_between(asked.drop("case_id").dropDuplicates(["vector"]), known, names, floors, CELL)


def search(cases: DataFrame, references: DataFrame, k: int, least: float) -> tuple[DataFrame, DataFrame, Cells, dict[int, list[int]]]:
    """Cases with their vectors, references that can be among the best, and the cells in which their leaves meet."""
    names, own, asked, known = sides(cases, references, k)
    return asked, known, *searched(asked, known, [n for n in own if n in names], k, least)


def key_of(score: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One number for a score and a place in order that is larger for what is better."""
    return (score << 32) + ((1 << 32) - 1 - place)


def merged(best: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The largest numbers of each row of both, as many as in ``best``, the least of them last."""
    some = best.shape[1]
    return -np.partition(-np.concatenate([best, more], 1), some - 1, 1)[:, :some]


def best_of(a: pa.Table, b: pa.Table, near: Near, wanted: dict[int, list[int]], some: int, number: bool = False) -> pa.Table:
    """The best rows of b, by label, of each row of a. Rows of b come by their bounds and in order, until all of a's step
    have as many that are better than any that can follow; of equals the first are better. ``number``: rows of a by their
    place there, and places of b in order."""
    b = b.sort_by([("source", "ascending"), ("ref_id", "ascending")])
    x, y = arrays(a, b)
    theirs, out = b["leaf"].to_numpy(), []
    for one, mine, high in near.of(a["leaf"].to_numpy(), theirs):
        high = np.floor(high).astype(np.int64)
        for label, floor in enumerate(wanted[one]):
            same = np.flatnonzero((theirs % 2 == label) & (high >= floor))
            same = same[np.argsort(-high[same], kind="stable")]
            for rows in [mine[at] for at in steps(picked(x, mine))]:
                p = picked(x, rows)
                # The score, and below it the place in order; a smaller place is better.
                best = np.full((len(rows), some), (floor << 32) - 1, np.int64)
                for at in np.split(same, range(STEP, len(same), STEP)) if len(same) else []:
                    live = np.flatnonzero(best[:, -1] < key_of(high[at[0]], at[0]))
                    if not len(live):
                        break
                    q = picked(y, at)
                    if bound(picked(p, live), q) >= best[live, -1].min() >> 32:
                        best[live] = merged(best[live], key_of(tenths(picked(p, live), q), at[None]))
                i, j = np.nonzero(best >= floor << 32)
                out.append((rows[i], best[i, j]))
    rows, found = (np.concatenate(v) for v in zip(*out))
    place = (1 << 32) - 1 - (found & ((1 << 32) - 1))
    at = b.take(pa.array(place))
    own = {"row": pa.array(rows), "place": pa.array(place)} if number else {"vector": a["vector"].take(pa.array(rows))}
    return pa.table(own | {"ref_id": at["ref_id"], "source": at["source"], "is_fraud": at["is_fraud"], "tenths": pa.array(found >> 32)})


def head_of(known: DataFrame, names: list[str], rows: int, enough: int) -> tuple[pa.Table, dict[int, tuple], DataFrame]:
    """(head, next, rest): the first references of each leaf in order, about ``HEAD`` in all, by leaf the key of the first that
    is not among them, and those references. Rows have ``leaf``; keys are source, id and all features."""
    key = ["source", "ref_id", "features"]
    ordered = known.withColumn("features", F.to_json(F.struct(*names)))
    number = ordered.select("leaf").distinct().count()
    each = max(enough, HEAD // max(1, number))
    place = F.row_number().over(Window.partitionBy("leaf").orderBy(*key))
    first = ordered.withColumn("_n", place).where(F.col("_n") <= each + 1).toArrow().sort_by([(c, "ascending") for c in key])
    after = first.filter(pa.compute.equal(first["_n"], each + 1)).select(["leaf", *key]).to_pylist()
    after = {r["leaf"]: tuple(r[c] for c in key) for r in after}
    # Equal keys stay together, so that none is in both or in neither.
    keep = [r["leaf"] not in after or tuple(r[c] for c in key) < after[r["leaf"]] for r in first.select(["leaf", *key]).to_pylist()]
    limits = known.sparkSession.createDataFrame([(k, *v) for k, v in after.items()], "leaf int, _source int, _ref_id string, _features string")
    rest = ordered.join(F.broadcast(limits), "leaf").where(F.struct(*key) >= F.struct("_source", "_ref_id", "_features")).drop("_source", "_ref_id", "_features", "features")
    return first.filter(pa.array(keep, pa.bool_())).drop_columns(["_n", "features"]), after, rest


def points(a: pa.Table, names: list[str], texts: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """Rows of a as leaves of one row each, with places of texts among ``texts``, in the form of ``spread``."""
    out = {"n": np.ones(a.num_rows, np.int64)}
    for c in names:
        values = a[c].to_pylist()
        if c in BONUSES:
            none = {None} | ({"None"} if c in TOOLS else set())
            seen = {v: 2 * (k := bisect_left(texts[c], v)) + (k < len(texts[c]) and texts[c][k] == v) for v in set(values) - none}
            value = np.array([seen.get(v, -1) for v in values], np.int64)
            known = value >= 0
        else:
            value = np.array(values, np.float64)
            known = ~np.isnan(value)
        out |= {f"min_{c}": value, f"max_{c}": value, f"count_{c}": known.astype(np.int64)}
    return out


def spread(b: dict[str, np.ndarray], names: list[str]) -> tuple[dict[str, np.ndarray], dict[str, list[str]]]:
    """Summaries with places of texts, one apart from each other, and the texts."""
    out, texts = dict(b), {}
    for c in [c for c in names if c in BONUSES]:
        texts[c] = sorted({v for e in ("min", "max") for v in b[f"{e}_{c}"] if v is not None})
        place = {v: 2 * k + 1 for k, v in enumerate(texts[c])}
        out |= {f"{e}_{c}": np.array([place.get(v, -1) for v in b[f"{e}_{c}"]], np.int64) for e in ("min", "max")}
    return out, texts


def rest_of(a: pa.Table, b: pa.Table, some: int) -> pa.Table:
    """The best rows of b, which is of one leaf, of each row of a that are at least as good as its ``floor``."""
    b = b.sort_by([("source", "ascending"), ("ref_id", "ascending")])
    (x, y), floors, out = arrays(a, b), a["floor"].to_numpy().astype(np.int64), []
    blocks = [(at.min(), np.sort(at)) for at in steps(y)]
    for rows in steps(x):
        p, best = picked(x, rows), np.repeat((floors[rows] << 32)[:, None] - 1, some, 1)
        tops = [int(bound(p, picked(y, at))) for _, at in blocks]
        for k in sorted(range(len(blocks)), key=lambda k: (-tops[k], blocks[k][0])):
            first, at = blocks[k]
            live = np.flatnonzero(best[:, -1] < key_of(tops[k], first))
            if len(live):
                best[live] = merged(best[live], key_of(tenths(picked(p, live), picked(y, at)), at[None]))
        i, j = np.nonzero(best >= floors[rows, None] << 32)
        out.append((rows[i], best[i, j]))
    rows, found = (np.concatenate(v) for v in zip(*out))
    at = b.take(pa.array((1 << 32) - 1 - (found & ((1 << 32) - 1))))
    return pa.table({"vector": a["vector"].take(pa.array(rows)), "ref_id": at["ref_id"], "source": at["source"], "is_fraud": at["is_fraud"], "tenths": pa.array(found >> 32)})


FOUND = "vector string, ref_id string, source int, is_fraud boolean, tenths long"


def found_by_head(asked: DataFrame, known: DataFrame, names: list[str], own: list[str], k: int, least: float) -> DataFrame:
    """The best references of each vector, where there are more than ``HEAD``: first among the head, which every task knows,
    then in the leaves that can hold a better one. A vector goes to those leaves only, and no reference is copied."""
    spark, some, floor = asked.sparkSession, k + OWN, round(least * 10)
    vectors = kept(asked.drop("case_id").dropDuplicates(["vector"]), "vectors")
    both = [n for n in own if n in names]
    ours = leaves(vectors, both)
    head, after, rest = head_of(known, names, int(ours["n"].sum()), some)
    all_leaves = leaves(known, both)
    ranked(ours, all_leaves, both)
    near, wanted = Near(ours, all_leaves, both), {int(c): [floor, floor] for c in ours["leaf"]}
    rest = kept(rest, "references")
    left, texts = spread(leaves(rest, both), both)
    order = [(r["source"], r["ref_id"]) for r in head.select(["source", "ref_id"]).to_pylist()]
    # The place that the first of a leaf's rest would have in the head.
    starts = np.array([bisect_left(order, after[int(c)][:2]) for c in left["leaf"]], np.int64)
    shared = spark.sparkContext.broadcast((head, near, wanted, left, texts, starts))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, near, wanted, left, texts, starts = shared.value
        for batch in batches:
            a = pa.Table.from_batches([batch])
            found = best_of(a, head, near, wanted, some, number=True)
            row, score, label = found["row"].to_numpy(), found["tenths"].to_numpy(), found["is_fraud"].to_numpy(zero_copy_only=False).astype(np.int64)
            best, nth = np.full((a.num_rows, 2, some), (floor << 32) - 1, np.int64), np.zeros((a.num_rows, 2), np.int64)
            for i, f, v in zip(row, label, key_of(score, found["place"].to_numpy())):
                best[i, f, nth[i, f]] = v
                nth[i, f] += 1
            worst = best.min(2)
            to, floors = [[] for _ in range(a.num_rows)], [[] for _ in range(a.num_rows)]
            point = points(a, both, texts)
            for at in range(0, a.num_rows, 256):
                high = np.floor(between(point, left, both, slice(at, at + 256))[1]).astype(np.int64)
                i, j = np.nonzero(key_of(high, starts[None]) >= worst[at : at + 256][:, left["leaf"] % 2])
                for one, leaf in zip(i + at, j):
                    to[one].append(int(left["leaf"][leaf]))
                    floors[one].append(int(worst[one, left["leaf"][leaf] % 2] + 1 >> 32))
            hits = [[] for _ in range(a.num_rows)]
            for one, hit in zip(row, found.select(["ref_id", "source", "is_fraud", "tenths"]).to_pylist()):
                hits[one].append(hit)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(hits, HITS), pa.array([[{"leaf": x, "floor": f} for x, f in zip(*both)] for both in zip(to, floors)], TO)], [*columns, "hits", "to"])

    columns = [c for c in vectors.columns if c != "leaf"]
    schema = ", ".join(f"{n} {t}" for n, t in vectors.select(*columns).dtypes) + ", hits array<struct<ref_id: string, source: int, is_fraud: boolean, tenths: long>>, to array<struct<leaf: int, floor: int>>"
    number = min(PARTITIONS, max(2 * spark.sparkContext.defaultParallelism, -(-int(ours["n"].sum()) // 8192)))
    dealt = vectors.repartition(number, "leaf", F.pmod(F.xxhash64("vector"), F.lit(8))).sortWithinPartitions("leaf")
    first = kept(dealt.mapInArrow(asks, schema), "first-found")
    hits = first.select("vector", F.inline("hits"))
    if not len(left["leaf"]):
        return hits
    again = first.select("*", F.inline("to")).drop("hits", "to")
    many = {r["leaf"]: r["n"] for r in again.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # as few as there are leaves
    cells = Cells.of_leaves(left["leaf"], np.array([many.get(int(c), 0) for c in left["leaf"]], np.int64), left["n"], CELL)
    return hits.union(cells.meet(again, rest, "vector", "ref_id", lambda a, b: rest_of(a, b, some), FOUND))


HITS = pa.list_(pa.struct([("ref_id", pa.string()), ("source", pa.int32()), ("is_fraud", pa.bool_()), ("tenths", pa.int64())]))
TO = pa.list_(pa.struct([("leaf", pa.int32()), ("floor", pa.int32())]))


def nearest(cases: DataFrame, references: DataFrame, k: int = 2, least: float = 60.0) -> DataFrame:
    """(case_id, ref_id, is_fraud, similarity, rank): the k best references of each case and label, exactly.

    References (ref_id, source, is_fraud and features) may be as many as the cases; one of the case's own id is left
    out. Of equals the smaller source and then id comes first. Equal vectors meet once. Up to ``HEAD`` references meet by
    leaves (``search``), more by a head of each leaf first (``found_by_head``).
    """
    names, own, asked, known = sides(cases, references, k)
    some = k + OWN
    known = kept(known, "known")
    if known.count() > HEAD:
        found = found_by_head(asked, known, names, own, k, least)
    else:
        cells, wanted = searched(asked, known, [n for n in own if n in names], k, least)
        near = cells.near
        work = lambda a, b: best_of(a, b, near, wanted, some)
        found = cells.meet(asked.drop("case_id").dropDuplicates(["vector"]), known, "vector", "ref_id", work, FOUND)
    order = [F.col("tenths").desc(), "source", "ref_id"]
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("vector", "is_fraud").orderBy(*order))).where(F.col("rank") <= some)
    # The few best of a vector are one row, so that no row is sent on for each of them and each case.
    best = best.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("is_fraud", "rank", "ref_id", "tenths"))).alias("found"))
    each = asked.select("case_id", "vector").join(best, "vector")
    others = F.filter("found", lambda f: F.col("case_id").cast("string") != f["ref_id"])
    first = lambda label: F.slice(F.filter("others", lambda f: f["is_fraud"] == label), 1, k)
    ranked = each.withColumn("others", others).select("case_id", F.explode(F.array(*(first(F.lit(f)) for f in (False, True)))).alias("some")).select("case_id", F.posexplode("some").alias("at", "f"))
    return ranked.select("case_id", "f.ref_id", "f.is_fraud", (F.col("f.tenths").cast("decimal(9,0)") / 10).cast("decimal(9,1)").alias("similarity"), (F.col("at") + 1).alias("rank"))


def candidates(spark: SparkSession, cases: DataFrame, completed: DataFrame, repository: DataFrame) -> DataFrame:
    """All references of a search: the built-in ones, completed cases (fraud if trust is under 70) and the trusted repository.

    ``completed`` holds ids; both it and ``repository`` have features by ``case_id``.
    """
    past = cases.join(completed.select("case_id").distinct(), "case_id", "left_semi")
    past = past.withColumn("is_fraud", F.coalesce(F.col("trust_score") < 70, F.lit(False)))
    parts = [built_in(spark).withColumn("source", F.lit(0))]
    for n, part in enumerate((past, repository.withColumn("is_fraud", F.lit(False))), 1):
        parts.append(part.withColumn("source", F.lit(n)).withColumn("ref_id", F.col("case_id").cast("string")).drop("case_id"))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def best_match(top: DataFrame) -> DataFrame:
    """(case_id, ref_id, is_fraud, similarity): the best of both labels; genuine wins ties."""
    order = F.struct(F.col("similarity"), (~F.col("is_fraud")).cast("int"), -F.col("rank"))
    return top.groupBy("case_id").agg(F.max_by(F.struct("ref_id", "is_fraud", "similarity"), order).alias("m")).select("case_id", "m.*")


#: Cases of either side of a cell of ``neighbours``, whose pairs are returned by steps.
PAIR_CELL = 50_000


def neighbours(cases: DataFrame, least: float = 60.0, within: str | None = None) -> DataFrame:
    """(case_id, other_id, similarity) of all pairs of cases that are at least so alike; within: only of one value of that column.

    Context is only a bonus and a missing value counts as alike, so no column keeps two cases apart: leaves of cases meet
    where their bound is at least ``least``, and in them steps of rows do.
    """
    names, rows = plain_features(cases.where("case_id IS NOT NULL"), ["case_id"])
    rows, floor, id_type = rows.select(F.col("case_id"), *([F.col(within).cast("string").alias("_within")] if within else []), *names), round(least * 10), cases.schema["case_id"].dataType
    rows = rows.withColumn("leaf", leaf(names))
    others = rows.withColumn("leaf", F.col("leaf") * 2)
    same = within if within in names and within in BONUSES and within not in TOOLS else None
    cells, _ = cells_between(rows, others, names, lambda low, theirs: np.full((len(low), 2), floor), PAIR_CELL, same)
    near = cells.near

    def work(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y = arrays(a, b)
        ids, kept_ids = [np.array(t["case_id"].to_pylist()) for t in (a, b)], [t["case_id"].combine_chunks() for t in (a, b)]
        codes: dict = {None: -1}
        groups = [np.array([codes.setdefault(v, len(codes)) for v in t["_within"].to_pylist()]) if within else np.zeros(t.num_rows, np.int64) for t in (a, b)]
        for _, rows_of_leaf, high in near.of(a["leaf"].to_numpy(), b["leaf"].to_numpy() * 2):
            some = np.flatnonzero((high >= floor) & (groups[1] >= 0))
            some = some[np.argsort(groups[1][some], kind="stable")]
            for group in np.unique(groups[0][rows_of_leaf]):
                mine, theirs = rows_of_leaf[groups[0][rows_of_leaf] == group], some[slice(*np.searchsorted(groups[1][some], [group, group + 1]))]
                if not len(theirs):
                    continue
                blocks = [theirs[at] for at in steps(picked(y, theirs))]
                for one in [mine[at] for at in steps(picked(x, mine))]:
                    p = picked(x, one)
                    for two in blocks:
                        q = picked(y, two)
                        if bound(p, q) < floor:
                            continue
                        score = tenths(p, q)
                        i, j = np.nonzero((score >= floor) & (ids[0][one][:, None] < ids[1][two][None]))
                        if len(i):
                            yield pa.RecordBatch.from_arrays([kept_ids[0].take(pa.array(one[i])), kept_ids[1].take(pa.array(two[j])), pa.array(score[i, j])], ["case_id", "other_id", "tenths"])

    found = cells.pairs(rows, "case_id", work, f"case_id {id_type.simpleString()}, other_id {id_type.simpleString()}, tenths long")
    return found.select("case_id", "other_id", (F.col("tenths").cast("decimal(9,0)") / 10).cast("decimal(9,1)").alias("similarity"))


def feature_vectors(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, ocr_confidence, metadata_score, pdf_producer, salary, identity, employer) from documents and findings.

    Every document after a suspicious producer counts against the metadata until another producer is named.
    """
    running = F.last("producer", ignorenulls=True).over(Window.partitionBy("case_id").orderBy("seq", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    docs = documents.withColumn("running", running)
    sums = docs.groupBy("case_id").agg(F.avg("ocr_confidence").alias("ocr_confidence"), F.count_if(F.lower("running").rlike(SUSPICIOUS)).alias("bad"), F.max_by("running", F.struct("seq", "doc_id")).alias("pdf_producer"))
    score = lambda kind, other: F.coalesce(F.max_by("score", F.when(F.lower("name").contains(kind), F.col("seq"))), F.when(F.bool_or(F.lower("name").contains(kind)), other), F.lit(1.0))
    found = findings.groupBy("case_id").agg(F.count_if(F.col("layer_source") == "FORENSIC").alias("forensic"), F.bool_or(F.lower("name").contains("income")).alias("salary_bad"), score("identity", F.lit(0.6)).alias("identity_similarity"), score("employer", F.lit(0.5)).alias("employer_consistency"))
    joined = sums.join(found, "case_id", "left")
    metadata = F.greatest(F.lit(0), 100 - 40 * F.col("bad") - 20 * F.coalesce("forensic", F.lit(0)))
    return joined.select("case_id", "ocr_confidence", metadata.cast("int").alias("metadata_score"), F.coalesce("pdf_producer", F.lit("None")).alias("pdf_producer"), (~F.coalesce("salary_bad", F.lit(False))).alias("salary_consistency"), F.coalesce("identity_similarity", F.lit(1.0)).alias("identity_similarity"), F.coalesce("employer_consistency", F.lit(1.0)).alias("employer_consistency"))


def upsert(repository: DataFrame, entries: DataFrame, key: str = "case_id") -> DataFrame:
    """The repository with entries put in place of those of the same key."""
    return repository.join(entries.select(key), key, "left_anti").unionByName(entries)


def remove(repository: DataFrame, keys: DataFrame, key: str = "case_id") -> DataFrame:
    return repository.join(keys.select(key), key, "left_anti")


def read_repository(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON repository: {features, metadata} by metadata.investigation_id."""
    schema = f"features struct<{VECTOR.replace(' decimal(9,1)', ': double').replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean')}>, metadata struct<investigation_id: string, title: string, context: string>"
    return spark.read.schema(schema).json(path, multiLine=True)


def delete_case(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """All tables of a case without the given cases."""
    return {name: remove(t, keys) for name, t in tables.items()}
