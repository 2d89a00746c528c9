"""Words, shingles and token ids against plain Python and the tokenizer library."""

import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pacetrace.llm.pretokens import Encoder, WordTable, distinct
from pacetrace.llm.textops import LONG_BYTES, text_shingles, utf8, word_hashes
from pacetrace.llm.token_counts import token_counts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PIECES = ["'s", "'S", "'re", "'", "''", " ", "  ", "\n", "\t", "\r\n", "a", "B", "ß", "é", "1", "²", "½", "12", "中", "日本", "!", "...", "<|endoftext|>", "<|",
          "́", "é", " ", " ", "\x85", "İ", "Σ", "ς", "ﬁ", "가", "ᄀ", "'ll", "'Ve", "d", "\x00", "​", "ǅ", "Ⅷ", "😀", "n't", "x'sy", " 's", "\n's"]
texts = st.lists(st.sampled_from(PIECES) | st.characters(codec="utf-8"), max_size=14).map("".join)


def naive_sets(column, size=5):
    for t in column:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        yield (set(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else {tuple(w)} if w else set()), len(w)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(["a", "B", "b", "  ", "\n", " ", "é", " "]), max_size=30).map("".join), max_size=6))
def test_shingles_are_those_of_plain_python(column):
    found = list(text_shingles(pa.array(column, pa.string())))
    seen: dict = {}
    for (row, items, words), (want, n) in zip(found, naive_sets(column), strict=True):
        assert words == n
        assert len(set(items.tolist())) == len(want), row
        seen.setdefault(frozenset(want), frozenset(items.tolist()))
        assert seen[frozenset(want)] == frozenset(items.tolist())
    assert len(set(seen.values())) == len(seen)


def test_long_text_in_pieces():
    word = "abcdefg "
    text = word * (LONG_BYTES // len(word) + 100)
    data, off = utf8(pa.array([text]))
    whole, at = word_hashes(data, off)
    assert at.tolist() == [0, len(text) // len(word)]
    assert len(set(whole.tolist())) == 1


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(name):
    enc, lib = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.none() | texts, max_size=8))
    def check(column):
        got = [ids[ends[i] : ends[i + 1]].tolist() for _, ids, ends in enc.texts(pa.array(column, pa.string())) for i in range(len(ends) - 1)]
        assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in column]

    check()
    for t in ("x" * 50_000, " " * 3_000, "ab'" * 2_000, "word " * 5_000):
        assert [ids.tolist() for _, ids, _ in enc.texts(pa.array([t]))] == [lib.encode(t, add_special_tokens=False).ids]


def test_cache_starts_anew_when_full():
    enc = Encoder(public_tokenizers.path(FILES[0]))
    enc.MAX_BYTES = 3
    lib = enc.tokenizer
    for t in ("one two three four five", "six seven", "one two nine", "a" * 40 + " " + "b" * 40):
        (_, ids, _), = enc.texts(pa.array([t]))
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_word_table_finds_what_was_put_in():
    g = np.random.default_rng(1)
    keys = g.integers(1, 1 << 60, (3, 5000)).astype(np.uint64)
    table = WordTable(64)
    for a in range(0, 4000, 500):
        table.add(keys[:, a : a + 500], np.arange(a, a + 500))
    assert table.find(keys).tolist() == [*range(4000), *[-1] * 1000]
    one, which, n = distinct(np.concatenate([keys[:, :5], keys[:, :3]], axis=1))
    assert sorted(n.tolist()) == [1, 1, 2, 2, 2] and len(one) == 5 and (which[:3] == which[5:]).all()


def test_token_counts_keep_rows_and_columns(spark):
    path = public_tokenizers.path(FILES[0])
    lib = Tokenizer.from_file(path)
    rows = [(1, "A word, it's here.", "x", 9), (1, "A word, it's here.", "x", 9), (None, None, None, None), (3, "", "y", 1), (4, "<|endoftext|> naïve é", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __t string, n_tokens int")
    got = token_counts(docs, path)
    assert got.columns == ["doc_id", "text", "__t", "n_tokens"]
    want = sorted((str(i), str(t), str(x), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, x, _ in rows)
    assert sorted((str(r[0]), str(r[1]), str(r[2]), r[3]) for r in got.collect()) == want
    assert token_counts(docs.limit(0), path).collect() == []
