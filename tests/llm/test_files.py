"""WARC archives, the entropy coder, binary token ids and packing: round trips and brute force."""

import base64
import collections
import gzip
import hashlib
import itertools
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pacetrace.llm import ans, binary_ids, packing, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


PAGES = [
    (5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, None, "same"), (2, "http://a/2", "same"), (3, "http://b\r\nX: y", None), (4, "u", ""), (None, "n", "same"), (None, "m", "only null"),
    (6, "long", "α<p>\r\n\r\nWARC/1.1\r\n" * 500), (7, "long", "α<p>\r\n\r\nWARC/1.1\r\n" * 500), (8, "one", "x" * 300),
]


def wanted(pages, least):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    seen, out = set(), []
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        h = h or ""
        data, own = h.encode(), first.get(h)
        response = len(data) < least or (i == own and h not in seen)
        if i == own:
            seen.add(h)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else own))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame([(i, u, h, "extra") for i, u, h in PAGES], "page_id long, url string, html string, sha string")
    where = folder(tmp_path)
    warc.write_archives(pages, where, min_bytes=least, segment_bytes=100)
    got = warc.read_archives(spark, where).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == wanted(PAGES, least)
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload).decode()) in {(i, h or "") for i, _, h in PAGES}
    raw = b"".join(gzip.open(f).read() for f in sorted(tmp_path.rglob("*.gz")))
    kinds = collections.Counter(f["warc-type"] for f, _ in warc.parse(raw))
    assert kinds["continuation"] > 10 and kinds["response"] + kinds["revisit"] == len(PAGES)


def test_warc_reads_every_member_of_a_compressed_archive(spark, tmp_path):
    bodies = [b"one", b"", bytes(range(256)) * 900]
    records = [r for i, b in enumerate(bodies) for r in warc.page_records(f"<urn:page:{i}:x:1>", "u", b, warc.digest(b), None)]
    packed = [gzip.compress(r + warc.END) for r in records]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.warc.gz").write_bytes(b"".join(packed) + b"\0" * 9)
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "m")).collect()}
    assert got == dict(enumerate(bodies))
    with pytest.raises(ValueError, match="inside a member"):
        warc.inflated(b"".join(packed)[:-3])


def test_warc_finds_damage(spark, tmp_path):
    where = folder(tmp_path)
    records = warc.page_records("<urn:page:1:x:1>", "u", b"y" * 500, warc.digest(b"y" * 500), None, 100)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(r + warc.END for i, r in enumerate(records) if i != 2))
    with pytest.raises(Exception, match="missing or repeated"):
        warc.read_archives(spark, str(tmp_path / "w")).collect()
    bad = warc.page_records("<urn:page:1:x:1>", "u", b"z", warc.digest(b"y"), None)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.warc").write_bytes(bad[0] + warc.END)
    with pytest.raises(Exception, match="payload digest differs"):
        warc.read_archives(spark, str(tmp_path / "v")).collect()
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), where)
    assert warc.read_archives(spark, where).collect() == []


def test_chunked_framing():
    for n in (0, 1, warc.CHUNK_BYTES, warc.CHUNK_BYTES + 1, 3 * warc.CHUNK_BYTES + 7):
        assert warc.unchunked(warc.chunked(b"a" * n)) == b"a" * n
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60_000), st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(0, 9))
def test_entropy_coder_round_trip(n, shares, seed):
    p = np.array(shares) / sum(shares)
    s = np.random.default_rng(seed).choice(len(p), n, p=p)
    freq = ans.shared_table(np.bincount(s, minlength=60_000))
    assert freq.sum() == 1 << ans.SCALE_BITS
    table = ans.decoding_tables(freq)
    assert (ans.decode_block(ans.encode_block(s, *table[:2]), n, *table) == s).all()


DOCS = [(7, "The first."), (1, None), (3, ""), (-4, "a b c " * 400), (7, "Another seven"), (None, "no id"), (12, "naïve 😀 <|endoftext|> é")] + [(20 + i, f"text {i} " * (i * 7)) for i in range(40)]


def test_binary_ids_round_trip(spark, tmp_path):
    lib, where = Tokenizer.from_file(BYTE_BPE), folder(tmp_path)
    binary_ids.write_ids(spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, id int"), where, BYTE_BPE, file_ids=300, block_ids=128)
    got = binary_ids.read_ids(spark, where).join(binary_ids.file_starts(spark, where), ["part", "file"]).collect()
    rows = sorted((r.before + r.within, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    at = 0
    for start, _, ids in rows:
        assert start == at
        at += len(ids)
    assert sorted(((i, lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in DOCS), key=str) == sorted(((i, ids) for _, i, ids in rows), key=str)
    order = [i for _, i, _ in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert len({(r.part, r.file) for r in got}) > 3


def test_binary_ids_empty_and_damaged(spark, tmp_path):
    empty = folder(tmp_path)
    binary_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), empty, BYTE_BPE)
    assert binary_ids.read_ids(spark, empty).collect() == []
    image = bytearray(binary_ids._file(0, 0, [1], [3000], np.arange(3000) % 50))
    image[-20] ^= 1
    with pytest.raises((ValueError, IndexError)):
        binary_ids._content(memoryview(bytes(image)))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(1, 60))
def test_best_fill_is_the_best(counts, capacity):
    used = packing.best_fill(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in used.items())
    got = sum(k * n for k, n in used.items())
    best = max(s for c in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(k * m for k, m in zip(counts, c))) <= capacity)
    assert got == best


def test_packing_places_every_id_once(spark):
    lib, size = Tokenizer.from_file(WORD_BPE), 64
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id long, text string, rank int, lo int").repartition(5)
    rows = packing.pack(docs, WORD_BPE, capacity=size).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 < r.length <= size and len(r.ids) == 4 * r.length
        by[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    want = collections.defaultdict(list)
    for i, t in DOCS:
        want[i] += lib.encode(t or "", add_special_tokens=False).ids + [1]
    for i, ids in want.items():
        assert collections.Counter(x for p in by[i] for x in p[1]) == collections.Counter(ids)
        if i != 7:
            assert [x for p in sorted(by[i]) for x in p[1]] == ids and {p[2] for p in by[i]} == {len(ids)}
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    narrow = packing.placements(docs, WORD_BPE, capacity=size)
    crcs = sorted((str(r.doc_id), r.start, zlib.crc32(bytes(r.ids))) for r in rows)
    assert sorted((str(r.doc_id), r.start, r.ids_crc32) for r in narrow.collect()) == crcs
    assert packing.pack(docs.limit(0), WORD_BPE).collect() == []
