"""Conversation repair, centroid clusters and learned partitions against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from pacetrace.llm import clusters, conversations as cv, nearest as nn, routing

NAN, INF = float("nan"), float("inf")
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def edits_of(rows, most):
    """Every (cost, audit, lines) that treats ``rows(role, text, must_go, truncated)`` with at most ``most`` insertions."""
    def go(i, cost, audit, lines, left):
        letters = "".join(r[:1] for r, _ in lines)
        if not re.match(r"(s?(ua)*u?)?\Z", letters):
            return
        if i == len(rows):
            if LEGAL.match(letters):
                yield cost, audit, lines
        else:
            role, text, gone, cut = rows[i]
            yield from go(i + 1, cost + 4, audit + "D", lines, left)
            if not gone:
                if role:
                    yield from go(i + 1, cost + 3 * cut, audit + "K", lines + [(role, text)], left)
                for r in ("user", "assistant"):
                    yield from go(i + 1, cost + 3 + 3 * cut, audit + "R", lines + [(r, text)], left)
        if left:
            for r in ("user", "assistant"):
                yield from go(i, cost + 3, audit + "I", lines + [(r, "")], left - 1)
    return go(0, 0, "", [], most)


def brute_repair(rows):
    """``rows(turn, role, text)`` of one conversation, any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, todo = set(), [0, 0, 0], []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        kind = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            faults[kind] += 1
        todo.append((role, text, kind in (0, 1), kind == 2))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit, lines = min(edits_of(todo, 4), key=lambda e: e[:2])
    body = "\n".join(f"{r}:{x}" for r, x in lines)
    return gaps, *faults, illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest(), lines


def spark_repair(spark, convs, **more):
    rows = [(c, t, r, x, "clash") for c, own in convs.items() for t, r, x in own]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    out = cv.repair(df, **more)
    return df, out


def check_repair(spark, convs):
    df, out = spark_repair(spark, convs)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out.collect()}
    want = {c: brute_repair(own) for c, own in convs.items()}
    assert got == {c: w[:-1] for c, w in want.items()}
    turns = {}
    for r in cv.repaired_turns(df, out).orderBy("position").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: w[-1] for c, w in want.items() if w[-1]}


def test_repair_is_the_cheapest_and_ascii_least(spark):
    g = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "User", None, ""]
    texts = ["a.", "b!", "c", "d? ", " \t", "", None, "é.", "e\n"]
    convs = {i: [(g.choice([None, 0, 1, 2, 3, 7]), g.choices(roles, [5, 5, 3, 1, 1, 1, 1])[0], g.choices(texts, [4, 4, 2, 2, 1, 1, 1, 2, 1])[0]) for _ in range(g.randrange(1, 5))] for i in range(150)}
    convs[None] = [(1, "user", "x."), (2, "user", "y.")]
    check_repair(spark, convs)


def test_long_conversations_go_over_batches_and_spill(spark, monkeypatch):
    g = random.Random(5)
    rows = [(i, g.choice(["user", "assistant", "system"]), f"t{g.randrange(400)}" + g.choice(["", ".", "?"])) for i in range(3000)]
    monkeypatch.setattr(cv, "TRAIL_ROWS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df, out = spark_repair(spark, {1: rows, 2: rows[:1]})
        spilled = {r.conv_id: tuple(r) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = cv.Conversation("1")
    seen = set()
    for t, r, x in rows:
        whole.row(t, r, x, False, (r, x) in seen, x[-1] not in ".!?")
        seen.add((r, x))
    assert spilled[1][1:] == whole.result()[1:]
    a, b = cv.Conversation("x"), cv.Conversation("x")
    monkeypatch.setattr(cv, "TRAIL_ROWS", 7)
    for c, most in ((a, 7), (b, 10**6)):
        monkeypatch.setattr(cv, "TRAIL_ROWS", most)
        for t, r, x in rows[:500]:
            c.row(t, r, x, False, False, False)
        monkeypatch.setattr(cv, "TRAIL_ROWS", most)
        c.done = c.result()
    assert a.done == b.done
    letters = "".join(r.role[0] for r in cv.repaired_turns(df, out).filter("conv_id = 1").orderBy("position").collect())
    assert LEGAL.match(letters)


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repair(empty).collect() == []
    assert cv.repaired_turns(empty, cv.repair(empty)).collect() == []
    damaged = cv.damaged(spark.createDataFrame([(i, 0, "user", "hello.") for i in range(200)], empty.schema))
    from pyspark.sql import functions as F

    out = {r.conv_id: r for r in cv.repair(damaged, present=F.col("present")).collect()}
    assert len(out) == 200
    none = [r for r in out.values() if r.audit == ""]
    assert none and all(tuple(r)[1:7] == (0,) * 6 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in none)


def lloyd(rows, dims, k, rounds, scale, seed):
    kept = [(i, [math.floor(scale * float(np.float64(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [c for _, c in start]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, x in kept:
            own[near(x)[1]].append(x)
        centres = [[sum(col) // len(o) for col in zip(*o)] if o else c for o, c in zip(own, centres)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str), centres


@pytest.mark.parametrize(("n", "block_dims"), [(300, 4), (300, 12), (5, 4)])
def test_clusters_are_exact(spark, monkeypatch, n, block_dims):
    monkeypatch.setattr(clusters, "PIECE", 16)
    g = np.random.default_rng(n)
    rows = [(i, g.standard_normal(12).round(2).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 3)]  # a third of equal vectors
    rows += [(0, rows[1][1]), (None, rows[2][1]), (9000, None), (9001, [NAN] * 12), (9002, [INF] * 12), (9003, [1.0] * 11), (9004, [None] * 12), (9005, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, piece int")
    found, values = clusters.cluster(df, dims=12, k=8, rounds=4, block_dims=block_dims)
    want, centres = lloyd(rows, 12, 8, 4, 1024.0, 3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    flat = {(r.cluster, r.block * block_dims + r.dim): r.v for r in values.collect()}
    assert flat == {(c, d): v for c, m in enumerate(centres) for d, v in enumerate(m)}
    report = clusters.cluster_report(found, values, block_dims=block_dims).collect()
    assert len(report) == len(want) and {r.inertia for r in report} == {sum(w[2] for w in want)}
    assert {r.cluster: r.centroid_sha256 for r in report} == {c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest() for c in {w[1] for w in want}}


def test_clusters_of_nothing_and_of_too_much(spark):
    empty = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    found, values = clusters.cluster(empty)
    assert found.collect() == [] and values.collect() == [] and clusters.cluster_report(found, values).collect() == []
    with pytest.raises(ArithmeticError):
        clusters.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dims=2)


def test_distances_are_exact_beyond_doubles():
    g = np.random.default_rng(1)
    for top in (10, 1 << 20, 1 << 28):
        x, c = g.integers(-top, top, (50, 16)), g.integers(-top, top, (5, 16))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, m)) for m in c] for r in x]
        assert clusters.squared_distances(x, c).tolist() == want


def brute_nearest(rows, ask, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if ask(q):
            s = sorted((-float(nn.cosines(x[None], y[None])[0]), i) for i, y in good if i != q and len(x) == len(y))[:k]
            out[q] = [(r, i, -c) for r, (c, i) in enumerate(s, 1)]
    return out


def neighbour_rows(seed, n, dims=12):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((12, dims)) * 2
    rows = [(i, (centres[i % 12] + g.standard_normal(dims)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(n // 3)]  # a third of equal vectors
    rows += [(5000 + i, None) for i in range(2)] + [(5002, [NAN] * dims), (5003, [0.0] * dims), (5004, []), (5010, [None] * dims), (None, [1.0] * dims), (5020, [1.0, 2.0]), (5030, [2.0, 1.0])]
    return rows


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_nearest_neighbours_when_all_parts_are_searched(spark, monkeypatch):
    monkeypatch.setattr(nn, "ROWS_A_BLOCK", 40)
    monkeypatch.setattr(nn, "QUERIES_A_BLOCK", 8)
    rows = neighbour_rows(2, 600)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, part int, rep string")
    got = by_query(nn.nearest(df, df.filter("vec_id % 10 = 0"), recall=1.0, parts=1))
    assert got == {q: a for q, a in brute_nearest(rows, lambda q: q % 10 == 0, 5).items() if a}


def test_recall_of_learned_partitions(spark, monkeypatch):
    monkeypatch.setattr(nn, "ROWS_A_BLOCK", 100)
    used = []
    probes = nn._probes
    monkeypatch.setattr(nn, "_probes", lambda *a: used.append((probes(*a), a[3])) or used[-1][0])
    rows = neighbour_rows(3, 1500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = by_query(nn.nearest(df, df.filter("vec_id % 7 = 0")))
    want = brute_nearest(rows, lambda q: q % 7 == 0, 5)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in a}) for q, a in want.items() if a)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(a) for q, a in want.items() if a)
    assert used and used[0][0] < used[0][1]  # parts were left out


def test_nearest_of_few_and_of_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert nn.nearest(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).collect() == []
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3.0, 3.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, schema)
    assert by_query(nn.nearest(df, df.filter("vec_id = 0")))[0] == [(1, 2, pytest.approx(1.0)), (2, 1, pytest.approx(0.5**0.5)), (3, 3, pytest.approx(-(0.5**0.5)))]


def test_parts_are_balanced_and_follow_the_graph():
    g = np.random.default_rng(8)
    unit = nn.unit_rows(np.repeat(g.standard_normal((8, 16)) * 3, 100, axis=0) + g.standard_normal((800, 16)))
    near = routing.neighbour_graph(unit)
    label = routing.balanced_parts(near, 8)
    assert np.bincount(label).tolist() == [100] * 8
    assert (label[near] == label[:, None]).mean() > 0.8
    router = routing.Router(unit, near, label, 8)
    assert (router.ranked(unit)[:, 0] == label).mean() > 0.9
