"""The search of the graph of centroids holds a bounded number of links and vectors, however many it meets."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from tachygraph.llm import neighbours
from tachygraph.llm.neighbours import Graph


def cloud(n: int, width: int):
    rng = np.random.default_rng(5)
    return rng.normal(size=(n, width)), rng.normal(size=(neighbours.BATCH, width))


def test_memory_of_a_search():
    """Noise in many dimensions, where most nodes are met and some have hundreds of links: the links met are some 40 million."""
    centroids, q = cloud(3000, 48)
    graph = Graph(centroids)
    tracemalloc.start()
    far = graph.search(q, 1.15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(far).mean() > 0.5 and peak < 200e6


@pytest.mark.parametrize("edges, edge_bytes", [(1, 1), (50, 1000), (1 << 40, 1 << 40)])
def test_pieces_of_a_search(edges, edge_bytes, monkeypatch):
    """Whatever its pieces, a search gives the same distances, and the true ones."""
    centroids, q = cloud(120, 6)
    graph = Graph(centroids)
    want = graph.search(q[:9], 1.1)
    monkeypatch.setattr(neighbours, "EDGES", edges)
    monkeypatch.setattr(neighbours, "EDGE_BYTES", edge_bytes)
    got = graph.search(q[:9], 1.1)
    full = np.sqrt(((q[:9, None] - centroids) ** 2).sum(2))
    assert (got == want).all() and np.isfinite(got).any(1).all() and np.allclose(got[np.isfinite(got)], full[np.isfinite(got)])
    assert (full.argmin(1) == got.argmin(1)).all()


def test_one_centroid():
    assert Graph(np.ones((1, 3))).search(np.zeros((2, 3)), 1.15) == pytest.approx(np.full((2, 1), 3**0.5))
