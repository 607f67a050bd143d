"""op8_quality_classifier against plain Python and numpy: statistics, moments, shrinkage and densities by Mahalanobis distances."""

import re
from zlib import crc32

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm.data import SMALL, rows_of

SYMBOLS, UPPER, DIGITS = "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def statistics(text):
    text = text or ""
    n = len(text) + 60

    def share(chars):
        return sum(c in chars for c in text) / n

    parts = re.split("[ \n]", text)
    kinds = (len(set(parts)) + 20) / (len(parts) + 20)
    roots = [share(c) ** 0.5 for c in (SYMBOLS, "!", UPPER, DIGITS, ".,", "\n", " \t")]
    return [np.log1p(n), *roots, kinds, kinds * np.log1p(n)]


def expected(docs, labels):
    held = {d: crc32(str(d).encode()) % 5 == 0 for d, _ in docs}
    best = {}
    for d, q in labels:
        if d is not None and q is not None:
            best[d] = max(q, best.get(d, q))
    x = np.array([statistics(t) for _, t in docs])
    y = np.array([-1 if held[d] else best.get(d, -1) for d, _ in docs])
    n = [int((y == c).sum()) for c in (0, 1)]
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    prior = (n[1] + 1) / (sum(n) + 2)
    density = []
    for c in (0, 1):
        shrunk = 0.9 * cov[c] + 0.05 * np.diag(np.diag(cov[c])) + 0.05 * pooled + 1e-4 * np.eye(x.shape[1])
        away = x - x[y == c].mean(axis=0)
        # distances by solving against the covariance itself; no Cholesky factor as in the operator
        distance = (away * np.linalg.solve(shrunk, away.T).T).sum(axis=1)
        density.append(np.log(prior if c else 1 - prior) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * distance)
    score = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    return {d: (held[d], float(s)) for (d, _), s in zip(docs, score)}


def test_scores_equal_numpy_over_the_whole_table(spark):
    want = expected(rows_of("documents", "doc_id, text"), rows_of("labels", "doc_id, quality"))
    got = entry.queries()["op8_quality_classifier"](spark, SMALL).collect()
    assert len(got) == len(want) > 0
    for r in got:
        held, score = want[r["doc_id"]]
        assert r["held_out"] == held and r["score"] == pytest.approx(score, abs=1e-6), r["doc_id"]
        if abs(score - 0.3) > 1e-6:
            assert r["predicted"] == int(score >= 0.3)
