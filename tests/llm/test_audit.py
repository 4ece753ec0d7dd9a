from __future__ import annotations

import re
from itertools import permutations

import numpy as np

from caselight.llm import audit

from .cases import DOCUMENTS, documents, no_documents

LABELS = "doc_id long, quality int, toxic int, part string, mask int, good int"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x", 1, 1), (1, 0, 0, "x", 1, 1), (2, 1, 1, "x", 1, 1), (8, None, None, "x", 1, 1), (15, 1, 1, "x", 1, 1), (None, 1, 1, "x", 1, 1), (4, 0, 1, "x", 1, 1)], LABELS)


def brute(docs, marks):
    """Every row, by running the filters in every order over the documents."""
    good, toxic = ({d for d, *x in marks if d is not None and x[k] == 1} for k in (0, 1))
    rows, out = [], {}
    for d in docs:
        text = d.text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        copy = d.doc_id is not None and any(o.doc_id is not None and o.doc_id < d.doc_id and (o.text or "") == text for o in docs)
        bad = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), copy]
        rows.append((d.source or "", {f for f, b in zip("ABCDE", bad) if b}, d.doc_id in good, d.doc_id in toxic))
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            here = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in here if f in r[1]]
                out[part, order, step] = [len(here) - len(removed), len(removed), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in rows if r[0] == part), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                here, gone = [r for r in here if f not in r[1]], gone + removed
    for key, row in out.items():
        row.append(sum(v[1] for (p, o, s), v in out.items() if p == key[0] and o[s - 1] == key[1][key[2] - 1]))
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[:3]: list(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_awkward_rows(spark):
    want = brute(documents(spark).collect(), [r[:3] for r in labels(spark).collect()])
    assert found(audit.filter_audit(documents(spark), labels(spark))) == want
    assert audit.filter_audit(no_documents(spark), labels(spark)).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert all(r[4:6] == [0, 0] for r in found(audit.filter_audit(documents(spark), none)).values())


def test_hot_copies(spark):
    text = "A b # c " * 30
    rows = [(k % 500, text if k % 3 else f"word{k} " * 60, "en", "src0", 1, "x", 1, 2, 0.5, "i", "k", 3, "l", "m", 0.1, 0.2) for k in range(900)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    assert found(audit.filter_audit(docs, labels(spark))) == brute(docs.collect(), [r[:3] for r in labels(spark).collect()])


def test_fields_do_not_overflow():
    rng, n = np.random.default_rng(1), (1 << 57) - 1
    counts = [(m, bool(rng.integers(2)), bool(rng.integers(2)), n) for m in range(32)]
    big, one = audit.audited("p", counts, "ABCDE").to_pylist(), audit.audited("p", [(*c[:3], 1) for c in counts], "ABCDE").to_pylist()
    assert all(x[c] == n * y[c] for x, y in zip(big, one) for c in audit.COUNTS[:-1])


def test_wide_masks():
    wide = audit.wide_masks("AB")
    steps, unique = audit.unpacked(3 * wide[1] + 5 * wide[3] + 2 * wide[0], "AB")
    assert audit.orders("AB") == ("AB", "BA") and unique.tolist() == [3, 0]
    assert steps.tolist() == [[2, 8, 0], [2, 0, 5], [5, 5, 0], [2, 3, 5]]
