"""Splits that keep companies whole."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from dealscope.operators import group_split
from dealscope.operators.group_split import company_split, test_companies as companies_for_test

COLUMNS = "company_id string, is_acquired boolean, x int"


def sides(rows):
    """company -> sides, and label -> (test, all)."""
    by_company, labels = defaultdict(set), defaultdict(Counter)
    for r in rows:
        by_company[r["company_id"]].add(r["split"])
        labels[r["is_acquired"]][r["split"]] += 1
    return by_company, labels


@pytest.mark.parametrize("digits", [1, 4])
def test_companies_stay_whole(spark, monkeypatch, digits):
    """Companies of many sizes and mixed labels, one with a third of all rows: the others make up for most of its 300 rows."""
    monkeypatch.setattr(group_split, "PREFIX_DIGITS", digits)
    random = np.random.default_rng(2)
    rows = [("hot", i % 4 == 0, i) for i in range(1500)]
    for c in range(1200):
        rows += [(f"c{c}", bool(random.random() < 0.4), i) for i in range(int(random.integers(1, 5)))]
    got = company_split(spark.createDataFrame(rows, COLUMNS).repartition(7)).collect()
    assert Counter((r["company_id"], r["is_acquired"], r["x"]) for r in got) == Counter(rows)
    by_company, labels = sides(got)
    assert all(len(s) == 1 for s in by_company.values())
    assert by_company["hot"] == {"train"}
    for found in labels.values():
        assert abs(found["test"] - 0.2 * found.total()) < 30


def test_labels_without_a_hot_company(spark):
    random = np.random.default_rng(4)
    rows = [(f"c{c}", bool(random.random() < 0.4), i) for c in range(900) for i in range(int(random.integers(1, 5)))]
    by_company, labels = sides(company_split(spark.createDataFrame(rows, COLUMNS)).collect())
    assert all(len(s) == 1 for s in by_company.values())
    assert all(abs(found["test"] - 0.2 * found.total()) <= 1 for found in labels.values())


def test_rows_without_company_and_repeats(spark):
    rows = [(None, i % 2 == 0, 1) for i in range(40)] + [("a", True, 1)] * 3 + [("b", False, 2)]
    got = company_split(spark.createDataFrame(rows, COLUMNS)).collect()
    assert Counter((r["company_id"], r["is_acquired"], r["x"]) for r in got) == Counter(rows)
    lone = Counter(r["split"] for r in got if r["company_id"] is None)
    assert lone == {"test": 8, "train": 32}
    assert all(len({r["split"] for r in got if r["company_id"] == c}) == 1 for c in "ab")


def test_empty(spark):
    assert company_split(spark.createDataFrame([], COLUMNS)).count() == 0


def test_quotas_over_random_signatures():
    """With companies of one row in either label, both labels end within one row of their share."""
    random = np.random.default_rng(3)
    for _ in range(300):
        signatures = {(int(y), int(n)): int(m) for y, n, m in zip(random.integers(0, 9, 15), random.integers(0, 9, 15), random.integers(1, 30, 15)) if y + n}
        signatures[1, 0] = signatures[0, 1] = 60
        chosen = companies_for_test([(y, n, m) for (y, n), m in signatures.items()], 0.2)
        assert all(0 <= chosen[s] <= m for s, m in signatures.items())
        for i in (0, 1):
            total = sum(s[i] * m for s, m in signatures.items())
            assert abs(sum(s[i] * t for s, t in chosen.items()) - 0.2 * total) <= 1
