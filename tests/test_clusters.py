"""Clusters whose last links are gone along in one task are those of rounds alone, and chains of ever longer links take no round each."""

import numpy as np
import pytest
from test_vectors import brute_clusters

from martlens.operators import vectors


@pytest.mark.parametrize("few, held", [(0, 0), (40, 400_000), (40, 30), (20_000, 400_000)])
def test_last_links_in_one_task(spark, few, held):
    rng = np.random.default_rng(5)
    members = [(int(i), int(s) if s < 30 else None, rng.choice(["a", "b", "", None], p=[0.5, 0.3, 0.1, 0.1])) for i in range(120) for s in rng.integers(0, 40, 3)]
    links = {tuple(sorted(map(int, rng.choice(120, 2, replace=False)))) for _ in range(300)}
    links = [(a, b, float(rng.integers(1, 30)) / 100) for a, b in sorted(links)]
    frame, own = spark.createDataFrame(links, "a long, b long, distance double"), spark.createDataFrame(members, "id long, shop long, sku string")
    got = {r.id: r.cluster for r in vectors.cluster_apart(frame, own, few, held).collect()}
    assert got == brute_clusters(links, members) and 1 < len(set(got.values())) < 120


def test_a_chain_takes_no_round_each(spark, monkeypatch):
    links = [(i, i + 1, (60 - i) / 100) for i in range(50)]
    members = [(i, i % 45, "s" if i % 7 else None) for i in range(60)]
    names = []
    monkeypatch.setattr(vectors, "written", lambda df, name, real=vectors.written: (names.append(name), real(df, name))[1])
    frame, own = spark.createDataFrame(links, "a long, b long, distance double"), spark.createDataFrame(members, "id long, shop long, sku string")
    got = {r.id: r.cluster for r in vectors.cluster_apart(frame, own).collect()}
    assert got == brute_clusters(links, members) and len(names) <= 6  # before: three a round
