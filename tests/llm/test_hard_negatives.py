"""Hard negatives: exact scores from subset sums, and the whole result against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.llm import hard_negatives as hn

KIND = "vec_id long, label int, embedding array<double>, score int, j int, rank int, share int, bits int"


@pytest.mark.parametrize("low, high, d", [(-200, 200, 64), (-3, 4, 13), (-(2**40), 2**40, 9), (0, 1, 1), (-(2**62), 2**62, 5)])
def test_scores_equal_inner_products(low, high, d):
    rng = np.random.default_rng(d)
    rows, anchors = rng.integers(low, high, (50, d)), rng.integers(low, high, (7, d))
    got = hn.scores(np.ascontiguousarray(hn.bit_planes(rows).transpose(1, 2, 0)), hn.subset_sums(anchors))
    with np.errstate(over="ignore"):
        assert (got == (rows[:, None, :] * anchors[None]).sum(axis=2)).all()


def test_components_beyond_long_wrap():
    got = hn.whole_components(np.array([0.5, -0.001, 2.0**60, -(2.0**57), 1e30]))
    assert got.tolist()[:2] == [128, -1]
    assert [int(x) % 2**64 for x in got] == [int(math.floor(256 * x)) % 2**64 for x in (0.5, -0.001, 2.0**60, -(2.0**57), 1e30)]


def brute(rows, step, positives=5, negatives=10):
    least = {}
    for i, label, v in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[1], r[2])):
        least.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = set()
    for a in [i for i in least if i % step == 0]:
        label, v = least[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, (own, w) in least.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], KIND)


def test_whole_result_equals_brute_force(spark, monkeypatch):
    """Many equal vectors, vectors of other lengths, repeated and unusable rows, more shares than one."""
    monkeypatch.setattr(hn, "SHARE_ANCHORS", 7)
    monkeypatch.setattr(hn, "BLOCK", 64)
    rng = np.random.default_rng(4)
    common = rng.normal(0, 0.1, 24).tolist()
    rows = [(int(i), int(rng.integers(0, 4)), common if i % 3 == 0 else (rng.normal(0, 0.1, 24) + 0.5 * np.array(common)).tolist())
            for i in range(500)]
    rows += [(600 + i, i % 4, rng.normal(0, 3, int(rng.integers(0, 40))).tolist()) for i in range(60)]
    rows += [(20, 1, common), (20, 1, common), (40, 0, [1.0]), (-20, 2, common), (None, 1, common), (1001, None, common), (1002, 1, None),
             (1003, 1, [1.0, None]), (1004, 2, [float("nan")]), (1005, 2, [float("inf")]), (1020, 2, []), (1040, 3, [-5.0] * 24)]
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in got.collect()]
    want = brute(rows, 20)
    assert len(got) == len(want) > 500 and set(got) == want


def test_without_rows(spark):
    assert hn.hard_negatives(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert hn.hard_negatives(table(spark, [(1, 1, [1.0]), (2, 2, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert hn.hard_negatives(table(spark, [(20, 1, [1.0]), (2, 2, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
