"""Pipeline stages on nulls, empty and long texts, ties, repeated rows and empty tables."""

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i}" for i in range(120))
OTHER = " ".join(f"other{i}" for i in range(120))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (None, "no id here at all"), (5, PROSE), (5, PROSE), (6, PROSE + " more"), (7, OTHER), (7, "a second text of seven"), (8, "x" * 300_000), (9, "long " * 60_000)]


def test_one_row_of_each_group_stays(spark):
    for rows in (ODD, ODD[::-1]):
        left = sorted(((r.doc_id, r.text) for r in cp.one_of_each_group(spark, docs(spark, rows), "").collect()), key=str)
        assert left == sorted({r for r in ODD if r[0] != 6}, key=str)


def test_passages_of_odd_texts(spark):
    got = {(r.doc_id, r.text): r for r in cp.passages_once(spark, docs(spark, ODD), "").collect()}
    assert {i for i, _ in got} == {i for i, _ in ODD}
    assert {t for i, t in got if i in (4, 8, None)} == {t for i, t in ODD if i in (4, 8, None)}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
    assert not any(i == 6 and PROSE in (t or "") for i, t in got)  # document 5 has it


def test_packing_of_odd_texts(spark):
    rows = cp.packed(spark, docs(spark, ODD), "").collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows if r.doc_id in (1, 2)) == 2  # their end ids


@pytest.mark.parametrize("stage", ["one_of_each_group", "passages_once", "mixture", "packed"])
def test_empty_tables(spark, stage):
    assert getattr(cp, stage)(spark, docs(spark, []), "").collect() == []
