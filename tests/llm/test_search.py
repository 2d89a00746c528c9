"""Exact top-k search and embedding near-duplicates against brute force."""

import math

import numpy as np
import pytest

from pacetrace.llm import embedding_duplicates as ed
from pacetrace.llm import top_k as tk

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, rank string")


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, ask, k, scale=256.0):
    good = [(i, [math.floor(scale * x) for x in np.array(v, np.float32).astype(float)]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, x in good:
        if ask(q):
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(x) == len(y))[:k]
            out += [(q, r, i, -v) for r, (v, i) in enumerate(s, 1)]
    return sorted(out)


def vectors(seed, n, dims=12):
    g = np.random.default_rng(seed)
    rows = [(i, g.integers(-3, 4, dims).astype(float).round(3).tolist()) for i in range(n)]
    rows[7:7] = [(n, None), (n + 1, [NAN] * dims), (n + 2, [INF] + [0.0] * (dims - 1)), (n + 3, []), (n + 4, [None] + [1.0] * (dims - 1)), (None, [1.0] * dims), (n + 5, [0.0] * dims), (n + 6, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize(("n", "k"), [(150, 5), (4, 5), (1, 5), (0, 3)])
def test_top_k_is_exact(spark, monkeypatch, n, k):
    monkeypatch.setattr(tk, "ROWS_A_BLOCK", 16)
    monkeypatch.setattr(tk, "QUERIES_A_BLOCK", 4)
    rows = vectors(3, max(n, 8))[: n + 8] if n else []
    df = frame(spark, rows)
    got = tk.top_k(df, df.filter("vec_id % 10 = 0"), k=k)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, lambda q: q % 10 == 0, k)


def brute_links(rows, least):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and usable(v) and any(v)]
    n, near = {}, {}
    for i, x in good:
        for j, y in good:
            if i != j and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                n[i] = n.get(i, 0) + 1
                near.setdefault(i, set()).add(j)
    out = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = None if i is None else min(seen)
        out.append((i, n.get(i, 0), c, c is None or c == i))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_dims", [4, 64])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_duplicates_are_exact(spark, monkeypatch, block_dims, kind):
    monkeypatch.setattr(ed, "BLOCK", 7)  # cells of many parts
    g = np.random.default_rng(5)
    centres = g.standard_normal((6, 12))
    rows = vectors(4, 40)
    rows += [(1000 + i, (centres[i % 6] + 0.18 * g.standard_normal(12)).astype(np.float32).tolist()) for i in range(90)]
    rows += [(2000 + i, (centres[0] * (1 + i)).astype(np.float32).tolist()) for i in range(8)]
    rows += [(3000 + i, rows[60][1]) for i in range(12)]  # exact copies
    got = ed.embedding_duplicates(frame(spark, rows, kind), block_dims=block_dims)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_links(rows, 0.9)


def test_empty_and_unusable_vectors(spark):
    assert ed.embedding_duplicates(frame(spark, [])).collect() == []
    got = ed.embedding_duplicates(frame(spark, [(3, None), (4, [0.0, 0.0]), (None, [1.0, 0.0])]))
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)]


@pytest.mark.parametrize("part", [3, 16, 61, 200])
def test_scaled_copies_are_counted_once_in_groups_of_any_size(spark, monkeypatch, part):
    monkeypatch.setattr(ed, "BLOCK", part)
    g = np.random.default_rng(11)
    rows = []
    for i in range(60):  # (x, 2x, 3x): apart by rounding alone, in every block
        v = g.standard_normal(16)
        rows += [(3 * i + k, ((1 + k) * v).tolist()) for k in range(3)]
    got = ed.embedding_duplicates(frame(spark, rows, "double"), block_dims=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_links(rows, 0.9)


def test_owner_of_a_pair_does_not_depend_on_its_company():
    g = np.random.default_rng(12)
    space = ed.Subspaces(64, 0.9, 16)
    x = space.turned(g.standard_normal((300, 64))).astype(np.float32)
    y = np.nextafter(x, np.float32(1)) * np.where(g.random(x.shape) < 0.5, 1, np.float32(1 + 1e-7)).astype(np.float32)
    whole = space.owner(x, y)
    assert [int(space.owner(y[i : i + 1], x[i : i + 1])[0]) for i in range(300)] == whole.tolist()
    assert space.owner(x[5:250:7], y[5:250:7]).tolist() == whole[5:250:7].tolist()
