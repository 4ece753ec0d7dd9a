"""Quality classifier with hierarchical empirical Bayes.

A logistic model of a document's own signs (letters, signs, words, lines) gives its evidence. What the other documents
of its host and path look like on the whole tempers it: the mean of a host is shrunk toward the global mean, and that
of a path toward its host's, the more so the fewer documents it has. How strongly is fitted from the data by moments.
The sites' sums are made from stored evidence.
The host of a document is its source; its path within the host is its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import free_name, materialise, text_batches, working_on

#: The model is fitted on at most this many labelled rows: those with the least hashes of their doc_id.
SAMPLE_ROWS = 6000
KEEP_FROM = 0.5
FEATURES = 14
EDGE = 1e-4


def features(text: str | None) -> list[float]:
    """Shares of kinds of bytes, words and lines of a whole text."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        upper / max(1, upper + lower),
        count[33] / w,
        count[124] / w,
        int(count[48:58].sum()) / n,
        int(count[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]].sum()) / n,
        (count[44] + count[46]) / w,
        int(count[128:].sum()) / n,
        len(set(words)) / w,
        len(set(lines)) / max(1, len(lines)),
        float(lengths.mean()) / 10 if len(words) else 0.0,
        float((lengths <= 3).mean()) if len(words) else 0.0,
        np.log1p(len(words)) / 10,
        np.log1p(len(raw) / max(1, len(lines))) / 10,
        float((lengths > 20).mean()) if len(words) else 0.0,
    ]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model on standardised features by Newton's method; [means, scales, weights, bias] in rows."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    z = np.column_stack([z, z[:, :-1] ** 2])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.eye(z.shape[1]), z.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    d = x.shape[1]
    return np.stack([mean, scale, w[:d], w[d + 1 :], np.full(d, w[d])])


def predict(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    z = np.clip((x - model[0]) / model[1], -6, 6)
    return 1 / (1 + np.exp(-(z @ model[2] + z**2 @ model[3] + model[4, 0])))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """The model, from at most ``sample`` labelled rows outside the held-out third (crc32 of doc_id modulo 3 is 1)."""
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("good"))
    some = usable.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "good").limit(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "good", "x"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # at most ``sample`` rows
    rows = sorted(joined.mapInArrow(measure, "doc_id long, good double, x array<double>").collect())
    if not rows:
        return np.zeros((5, FEATURES)) + np.array([0, 1, 0, 0, 0])[:, None]
    return fit(np.array([r.x for r in rows]), np.array([r.good for r in rows]))


def with_evidence(docs: DataFrame, model: np.ndarray, name: str) -> DataFrame:
    """``docs`` and, as ``name``, what the document alone says; all other columns as they are."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, FEATURES)
            yield batch.append_column(name, pa.array(np.clip(predict(x, model), EDGE, 1 - EDGE)))

    return text_batches(docs).mapInArrow(judge, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


@dataclass(frozen=True)
class Priors:
    """The global mean, and how many documents the prior of a host and that of a path are worth."""

    mean: float
    host: float
    path: float

    def posteriors(self, p: Column) -> tuple[Column, Column, Column]:
        """(host's posterior, path's posterior, score) of a document of evidence ``p``, from the sums of ``site_sums``.

        A document's own evidence is left out of its sites' means, so it counts once: the score is its log-odds, moved
        by those of its path against those of the global mean.
        """
        host = (F.col("host_s") - p + self.host * self.mean) / (F.col("host_n") - 1 + self.host)
        path = (F.col("path_s") - p + self.path * host) / (F.col("path_n") - 1 + self.path)
        host, path = (F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), x)) for x in (host, path))
        return host, path, 1 / (1 + F.exp(logit(F.lit(self.mean)) - logit(p) - logit(path)))


def site_sums(judged: DataFrame) -> tuple[DataFrame, Priors]:
    """Sums of the evidence of (site_host, site_path, p) by path and host, and the priors that fit them."""
    paths = materialise(judged.groupBy("site_host", "site_path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_s")), "quality-paths")
    hosts = paths.groupBy("site_host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    mean = min(1 - EDGE, max(EDGE, total.s / total.n)) if total.n else 0.5

    def strength(rows: DataFrame, n: str, s: str, centre: Column) -> float:
        """Pseudo-documents of a prior: the spread of means beyond what their sizes explain, as a Beta prior's."""
        r = rows.agg(F.sum(F.col(n) * (F.col(s) / F.col(n) - centre) ** 2).alias("spread"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
        if not r.n:
            return 1.0
        extra = max(r.spread / r.n - mean * (1 - mean) * r.k / r.n, 1e-6)
        return float(min(1e6, max(1.0, mean * (1 - mean) / extra - 1)))

    own = strength(hosts, "host_n", "host_s", F.lit(mean))
    sums = materialise(paths.join(hosts, "site_host"), "quality-sites")
    inner = strength(sums, "path_n", "path_s", (F.col("host_s") + own * mean) / (F.col("host_n") + own))
    return sums, Priors(mean, own, inner)


def _site(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _light(judged: DataFrame, p: str) -> DataFrame:
    return judged.select(_site("source").alias("site_host"), _site("lang").alias("site_path"), F.col(f"`{p}`").alias("p"))


def _scored(judged: DataFrame, p: str, light: DataFrame) -> DataFrame:
    """The rows ``judged`` as the struct ``row``, with ``site_host``, ``site_path`` and what their sites, of which
    ``light`` holds the evidence, add."""
    sums, priors = site_sums(light)
    host, path, score = priors.posteriors(F.col("p"))
    rows = judged.select(F.struct(*(F.col(f"`{c}`") for c in judged.columns)).alias("row"), _site("source").alias("site_host"), _site("lang").alias("site_path"), F.col(f"`{p}`").alias("p"))
    return rows.join(sums, ["site_host", "site_path"]).withColumns({"host_posterior": host, "path_posterior": path, "score": score})


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, score, keep) of every document.

    Nulls: a null text is empty; a null source or language is the site ''; labels that are null are not learned
    from, and without any label the evidence is 0.5. Empty tables: an empty result. Repeated rows: one result each.
    Long texts are read whole. Ties: equal texts of one site have equal scores; a score of just ``KEEP_FROM`` is kept.
    Other columns are not read, whatever their names.
    """
    judged = with_evidence(docs.select("doc_id", "lang", "source", "text"), train(docs, labels, sample), "p").drop("text")
    judged = materialise(judged, "quality-evidence")
    scored = _scored(judged, "p", _light(judged, "p"))
    return scored.select("row.doc_id", F.col("site_host").alias("host"), F.col("site_path").alias("path"), F.col("p").alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= KEEP_FROM).alias("keep"))


def keep_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns and values.

    Nulls, ties, repeated rows, long texts and empty tables: as in ``score_quality``; repeated rows are all kept or all
    rejected. Columns of any name keep their values. The evidence is computed for the sites and again for the rows, as
    a copy of all texts beside it would take as much disk as the input.
    """
    p = free_name("quality_p", docs.columns)
    judged = with_evidence(docs, train(docs, labels, sample), p)
    light = materialise(_light(judged, p), "quality-evidence")
    return _scored(judged, p, light).where(F.col("score") >= KEEP_FROM).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
