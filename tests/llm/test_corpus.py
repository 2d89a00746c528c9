"""Near duplicates, repeated passages, mixing, quality and the pipeline against brute force."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pacetrace.llm import mixing, packing, passages, pretokens, quality, workers
from pacetrace.llm import near_duplicates as nd
from pacetrace.llm.textops import U64, mix
from tests.llm.test_text import naive_sets
from tests.oracle import compare, make_duck

SF = "/root/testdata/sf0.001"


def words(g, n):
    return [f"w{x}" for x in g.integers(0, 5000, n)]


def changed(g, w, n):
    w = list(w)
    for i in g.integers(0, len(w), n):
        w[i] = f"new{g.integers(0, 10**6)}"
    return w


def corpus(seed):
    g, rows = np.random.default_rng(seed), []
    base = [words(g, n) for n in (60, 120, 300, 40, 200)]
    for i in range(160):
        kind = i % 8
        w = words(g, int(g.integers(1, 80))) if kind < 3 else changed(g, base[i % 5], int(g.integers(0, 4)))
        rows.append((int(g.permutation(1000)[0]) + 1000 * i, " ".join(w)))
    center = words(g, 150)
    rows += [(200_000 + i, " ".join(changed(g, center, 2))) for i in range(60)]  # one large group of near copies
    rows += [(300_000 - i, " ".join(center).upper()) for i in range(30)]  # and of exact ones
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one  two\nthree four"), (None, "one"), (None, None)]
    rows += [(8, rows[5][1])] * 3  # repeated rows
    return rows


def brute_components(rows, num, den):
    sets = [s for s, _ in naive_sets([t for _, t in rows])]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, s) for (i, _), s in zip(rows, sets) if i is not None and s]
    for k, (i, s) in enumerate(own):
        for j, z in own[:k]:
            c = len(s & z)
            if i != j and den * c >= num * (len(s) + len(z) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize(("num", "shape"), [(85, {}), (80, {"bands": 32, "rows": 6})])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, num, shape):
    monkeypatch.setattr(nd, "BLOCK", 9)  # buckets of many blocks
    rows = corpus(num)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, sketch string, n int").repartition(7)
    got = nd.near_duplicates(docs, num=num, **shape)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows, num, 100)
    assert nd.near_duplicates(docs.limit(0)).collect() == []


def test_an_id_with_two_texts_is_one_document(spark):
    texts = ["a b c d e f g", "h i j k l m n"]
    docs = spark.createDataFrame([(8, texts[0]), (8, texts[1]), (9, texts[0]), (10, texts[1])], "doc_id long, text string")
    got = sorted(tuple(r) for r in nd.near_duplicates(docs).collect())
    assert [r[:2] for r in got] == [(8, 3), (8, 3), (9, 3), (10, 3)] and got[0][2:] == got[1][2:] == (8, True)
    assert sorted([got[2][2], got[3][2]]) in ([8, 9], [8, 10])


def test_sketch_estimates_similarity():
    g = np.random.default_rng(2)
    for n in (1, 3, 50, 3000):
        items = mix(g.integers(0, 1 << 62, n).astype(U64))
        other = np.concatenate([items[: max(1, n * 8 // 10)], mix(g.integers(0, 1 << 62, n // 5).astype(U64))])
        a, b = nd.sketch(np.unique(items)), nd.sketch(np.unique(other))
        assert (a != np.iinfo(np.uint64).max).all()
        like = len(np.intersect1d(items, other)) / len(np.union1d(items, other))
        assert abs((a == b).mean() - like) < 0.16


def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree():
    g = np.random.default_rng(3)
    items, texts, width = mix(g.integers(0, 1 << 60, 400).astype(U64)), np.array([0, 90, 90, 95, 260, 400]), 12
    want = set()

    def walk(lo, hi, h):
        if hi - lo >= width:
            c = lo + int(np.argmin(h[lo:hi]))
            want.add((c, lo, hi - 1))
            walk(lo, c, h)
            walk(c + 1, hi, h)

    h = mix(items ^ U64(99))
    for a, b in zip(texts, texts[1:]):
        walk(int(a), int(b), h)
    c, lo, hi, _ = passages.compact_windows(items, texts, width, U64(99))
    assert set(zip(c.tolist(), lo.tolist(), hi.tolist())) == want


def test_passages_that_repeat_are_found_and_cut(spark):
    g = np.random.default_rng(4)
    shared = [words(g, n) for n in (51, 60, 200, 49)]
    texts = {i: words(g, 150) for i in range(60)}
    held = collections.defaultdict(list)
    for i in range(60):
        for k, s in enumerate(shared):
            if (i * 7 + k * 3) % 5 == 0 or (k == 1 and i % 3 == 0):
                at = int(g.integers(0, len(texts[i])))
                if any(a < at < b for a, b, _ in held[i]):
                    continue
                held[i] = [(a, b, j) if b <= at else (a + len(s), b + len(s), j) for a, b, j in held[i]]
                texts[i][at:at] = s
                held[i].append((at, at + len(s), k))
    near = changed(g, shared[2], 3)
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(100, " ".join(near)), (101, None), (102, ""), (None, " ".join(shared[2])), (103, "of " * 300)]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, t int, spans string").repartition(6)
    found = passages.repeated_passages(docs).collect()
    first = {k: min(i for i in held if any(j == k for _, _, j in held[i])) for k in range(4)}
    spans = collections.defaultdict(list)
    for r in found:
        assert r.n_words >= 50 and r.similarity >= 0.8 and r.first_doc_id < r.doc_id
        spans[r.doc_id].append((r.start_word, r.end_word))
    expected = {i for i in held for a, b, k in held[i] if k != 3 and i != first[k]} | {100}
    assert set(spans) == expected
    for i in held:
        for a, b, k in held[i]:
            if k != 3 and i != first[k]:
                assert any(s <= a and b <= e for s, e in spans[i]), (i, k)
                assert all(min(e, len(texts[i])) - max(s, 0) <= 2 * len(texts[i]) for s, e in spans[i])
    cut = {r.doc_id: r for r in passages.without_passages(docs, passages.repeated_passages(docs)).collect()}
    assert len(cut) == len(rows) and cut[1].t == 1 and cut[1].spans == "y"
    for i, w in texts.items():
        gone = np.zeros(len(w), bool)
        for s, e in spans[i]:
            gone[s:e] = True
        assert cut[i].text.split() == [x for x, z in zip(w, gone) if not z]
    assert passages.repeated_passages(docs.limit(0)).collect() == []


def test_a_passage_whose_words_lie_at_both_ends_of_the_other_text(spark):
    g = np.random.default_rng(12)
    head, tail = words(g, 40), words(g, 40)
    rows = [(1, " ".join([*head, *words(g, 2000), *tail])), (2, " ".join([*head, *tail])), (3, " ".join([*tail, *head, *tail]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.first_doc_id) for r in passages.repeated_passages(docs).collect()}
    assert (3, 2) in found and (2, 1) not in found
    assert len(passages._near(np.arange(2000).astype(U64), np.array([0, 1, 2, 1997, 1998, 1999]))) == 3


def test_a_window_that_meets_over_too_short_a_span_is_not_settled():
    span, context = (lambda n: n << 32 | n), 5 << 32 | 6
    rows = np.array([(8, 1, 50, span(20), context), (8, 2, 90, span(60), context), (8, 3, 70, span(60), context)])
    pairs, settled = passages._pairs_of(rows, 46)
    assert not len(pairs) and not settled.any()
    pairs, settled = passages._pairs_of(rows[1:], 46)
    assert pairs[:, :2].tolist() == [[3, 2]] and settled.tolist() == [False, True]


def verified_pairs(spark, monkeypatch, a, b):
    """Passages of the text ``a`` (id 2) that ``b`` (id 1) has, with the pair given."""
    pair = spark.createDataFrame([(2, 1, 15)], "a long, b long, hashes long")
    monkeypatch.setattr(passages, "candidate_pairs", lambda docs, min_words: pair)
    docs = spark.createDataFrame([(1, " ".join(b)), (2, " ".join(a))], "doc_id long, text string")
    return sorted((r.start_word, r.end_word) for r in passages.repeated_passages(docs).collect())


def test_a_phrase_of_the_passage_stands_before_it_too(spark, monkeypatch):
    g = np.random.default_rng(21)
    shared = words(g, 60)
    for gap in (15, 30, 85):
        b = [*words(g, 20), *shared[20:25], *words(g, gap), *shared, *words(g, 40)]
        assert verified_pairs(spark, monkeypatch, [*words(g, 30), *shared, *words(g, 30)], b) == [(30, 90)], gap
    b = [*words(g, 20), *shared[:20], *words(g, 50), *shared, *words(g, 40)]  # a third of it, before it
    assert verified_pairs(spark, monkeypatch, [*words(g, 30), *shared, *words(g, 30)], b) == [(30, 90)]


def test_passages_of_different_places_stand_side_by_side(spark, monkeypatch):
    g = np.random.default_rng(22)
    one, two = words(g, 60), words(g, 55)
    b = [*words(g, 20), *two, *words(g, 300), *one[50:], *two[:4], *words(g, 20), *one, *words(g, 30)]
    found = verified_pairs(spark, monkeypatch, [*words(g, 10), *one, *two, *words(g, 10)], b)
    held = {i for s, e in found for i in range(s, e)}
    assert set(range(10, 125)) <= held and len(held) <= 119
    b = [*one, *words(g, 60), *two]  # one run in a, two parts in b
    found = verified_pairs(spark, monkeypatch, [*one, *two], b)
    assert {i for s, e in found for i in range(s, e)} == set(range(115))
    items = mix(np.arange(300).astype(U64))
    assert passages._verbatim(items, np.concatenate([items[100:170], items[:60]]), np.ones(300, bool), 46, []) == [(0, 59), (100, 169)]


def brute_mix(rows, weights, budget, epochs, seed):
    leaves = collections.defaultdict(list)
    for i, path, n in rows:
        leaves[path].append((i, n))
    got = mixing.allocate(budget, {p: epochs * sum(n for _, n in v) for p, v in leaves.items()}, weights)
    out = []
    for p, v in leaves.items():
        size, left = sum(n for _, n in v), got[p]
        for e in range(epochs + 1):
            if size and left >= size:
                out += [(i, e) for i, _ in v]
                left -= size
            else:
                order = sorted(v, key=lambda x: (hashlib.md5(f"{seed}:{e}:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or 0, x[1]))
                s = 0
                for i, n in order:
                    s += n
                    if s <= left and left:
                        out.append((i, e))
                break
    return sorted(out, key=str)


def test_mixture_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PREFIX", 1)
    g = np.random.default_rng(6)
    rows = [(int(i), (str(g.choice(["a", "a", "a", "b", ""])), str(g.choice(["x", "y"]))), int(g.integers(0, 30))) for i in range(700)]
    rows += [(None, ("b", "x"), 5), (3, ("b", "x"), 4), (3, ("b", "x"), 4)]
    weights = ({"a": 1, "b": 5, "*": 2}, {"x": 3, "y": 1})
    docs = spark.createDataFrame([(i, p[0] or None, p[1], n, 1, 2) for i, p, n in rows], "doc_id long, source string, lang string, n int, epoch int, full int")
    for budget, epochs in ((4000, 1), (9000, 3), (10**7, 2), (0, 1), (17, 2)):
        got = mixing.mix(docs, [F.col("source"), F.col("lang")], weights, F.col("n"), budget, epochs, 9)
        assert got.columns == ["doc_id", "source", "lang", "n", "full", "epoch", "n_tokens"]
        assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=str) == brute_mix(rows, weights, budget, epochs, 9), (budget, epochs)
    assert mixing.mix(docs.limit(0), [F.col("source")], weights[:1], F.col("n"), 0.5).collect() == []
    monkeypatch.setattr(mixing, "MAX_LEAVES", 2)
    with pytest.raises(ValueError, match="leaves"):
        mixing.mix(docs, [F.col("source"), F.col("lang")], weights, F.col("n"), 10)


def test_shortages_go_to_siblings_before_ancestors():
    weights = ({"p": 1, "q": 1}, {"*": 1})
    got = mixing.allocate(100, {("p", "a"): 5, ("p", "b"): 80, ("q", "c"): 500}, weights)
    assert got == {("p", "a"): 5, ("p", "b"): 45, ("q", "c"): 50}
    got = mixing.allocate(100, {("p", "a"): 5, ("p", "b"): 10, ("q", "c"): 500}, weights)
    assert got == {("p", "a"): 5, ("p", "b"): 10, ("q", "c"): 85}
    assert mixing.allocate(10, {("z", "a"): 5}, weights) == {("z", "a"): 0}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    held = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = quality.score(docs, model).join(held, "doc_id").select("score", "quality").collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.97
    odd = spark.createDataFrame([(1, None, 0.5, "a"), (2, "", None, "b"), (3, " \n", 1.0, "c"), (None, "word " * 10_000, 2.0, "d")], "doc_id long, text string, score double, `whole text` string")
    got = quality.score(odd, model)
    assert got.columns == ["doc_id", "text", "whole text", "score"]
    assert all(0 <= r.score <= 1 for r in got.collect()) and got.count() == 4
    assert quality.score(odd.limit(0), model).collect() == []
    untrained = quality.train(docs, labels.limit(0))
    assert 0 <= quality.score(odd, untrained).first().score <= 1


def test_gradients_are_those_of_differences():
    g, model = np.random.default_rng(8), quality.GatedAttention()
    at, y = np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    x = g.standard_normal((9, quality.FEATURES))

    def loss():
        s = model.forward(x, at)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grad = model.gradients(model.forward(x, at), at, y)
    for name, d in grad.items():
        i = tuple(int(g.integers(n)) for n in d.shape)
        keep = model.p[name].copy()
        model.p[name][i] = keep[i] + 1e-6
        up = loss()
        model.p[name][i] = keep[i] - 1e-6
        down = loss()
        model.p[name] = keep
        assert abs((up - down) / 2e-6 - d[i]) < 1e-5, name


@pytest.mark.parametrize("name", ["op2_exact_top_k", "op5_warc_records", "op8_near_duplicates", "op9_embedding_duplicates", "op10_source_mixture"])
def test_query_matches_sql(spark, name):
    from pacetrace.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, SF).toArrow()
    assert compare(got, make_duck(SF).sql(ORACLE_SQL[name]).to_arrow_table()) is None


def test_pipeline_stage_by_stage(spark):
    """Each stage's decisions take effect on what the stage before it kept."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, names = source, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "mixture", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        docs = spark.createDataFrame(made.collect(), made.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    every = {r.doc_id: r.text for r in source.collect()}
    assert not bad & set(kept["quality"]) and len(kept["quality"]) > 0.75 * len(every)
    rows = [(i, kept["quality"][i].text) for i in kept["quality"]]
    assert set(kept["near_duplicates"]) == {i for i, _, _, keep in brute_components(rows, 80, 100) if keep}
    assert set(kept["repeated_passages"]) == set(kept["near_duplicates"])
    for i, r in kept["repeated_passages"].items():
        assert r.n_chars == len(r.text) and len(r.text) <= len(kept["near_duplicates"][i].text)
    held = collections.Counter()
    for r in kept["repeated_passages"].values():
        w = re.findall(r"\S+", r.text.lower())
        held.update({tuple(w[i : i + 50]) for i in range(len(w) - 49)})
    assert max(held.values(), default=1) == 1
    assert set(kept["mixture"]) <= set(kept["repeated_passages"]) and set(kept["packing"]) == set(kept["mixture"])


def test_a_first_document_with_the_neighbourhood_alone_hides_no_passage(spark):
    """Earlier documents hold either end of a passage; whatever windows meet there, the later ones have it from the first with the whole."""
    g = np.random.default_rng(8)
    rows, want = [], set()
    for k in range(8):
        passage, n = words(g, 50), 100 * k
        for i in range(60):
            rows.append((n + i, " ".join([*words(g, 80), *(passage[15:] if i % 2 else passage[:35]), *words(g, 80)])))
        for i in range(60, 63):
            rows.append((n + i, " ".join([*words(g, 80), *passage, *words(g, 80)])))
        want |= {n + 61, n + 62}
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = passages.repeated_passages(docs).collect()
        assert {r.doc_id for r in found} == want, parts
        assert all(60 <= r.first_doc_id % 100 < 62 and r.first_doc_id // 100 == r.doc_id // 100 for r in found)


def test_a_common_line_makes_no_pairs_of_all_its_documents(spark):
    """Windows in a line of less than a passage stay open; documents meet by what stands around them, not all with all."""
    g = np.random.default_rng(9)
    line, passage, n = words(g, 42), words(g, 70), 60
    other = [*passage[:44], "changed", *passage[45:]]
    texts = {i: [*words(g, 80), *line, *words(g, 80), *passage[:30], *words(g, 80)] for i in range(n)}
    for i, held in ((70, passage), (71, other), (72, passage)):
        texts[i] = [*words(g, 80), *held, *words(g, 80)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, t string").repartition(4)
    windows = passages.candidate_pairs(docs).filter("hashes <= 0")
    none = spark.createDataFrame([], "s_doc long, s_first long, s_last long")
    mine, theirs = passages.open_windows(windows, none)
    assert mine.select("a").distinct().count() >= n - 2
    assert passages.closer_pairs(docs, mine, theirs, 46).count() < 3 * n
    found = passages.repeated_passages(docs, "id", "t").collect()
    assert {(r.id, r.first_doc_id) for r in found} >= {(71, 70), (72, 70)} and {r.id for r in found} == {71, 72}


def test_passages_bound_their_batches_in_bytes(spark):
    """A batch's windows are sorted at once, so that batches of many rows made workers as large as their texts came in."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)
    spark.conf.unset(bound)
    docs = spark.createDataFrame([(i, f"w{i} " * 100_000) for i in range(40)], "doc_id long, text string").coalesce(1)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    try:
        assert max(r.n for r in sizes.collect()) > 2 * passages.BATCH
        passages.repeated_passages(docs.limit(1))
        got = [r.n for r in sizes.collect()]
        assert len(got) > 3 and max(got) < 1.25 * passages.BATCH
    finally:
        spark.conf.set(bound, before)


def test_the_pipeline_bounds_batches_and_cache_below_the_operators(spark):
    """Whole texts of any size pass with an encoder whose cache starts anew all the time."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40 * i))) for i in range(20)], "doc_id long, text string")
    rows = [sorted(map(tuple, packing.tokenised_pieces(docs, corpus_pipeline.WORD_BPE, "doc_id", "text", 2048, 1, *cache).drop("part", "nth").collect())) for cache in ((), (1,))]
    assert rows[0] == rows[1]
    assert corpus_pipeline.CACHE < pretokens.CACHE_BYTES and corpus_pipeline.BATCH < workers.BATCH_BYTES
