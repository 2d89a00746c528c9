"""Passages that repeat across documents, found by compact windows of min-hashes and verified on the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.storage import materialise
from .groups import free_name, split_by_ids
from .textops import U64, chunks, mix, random_u64, shingle_hashes, text_shingles, utf8, word_bounds, word_hashes
from .workers import small_batches, tidy

#: Bytes of an Arrow batch: a batch's windows are held and sorted at once, several times as large as its texts.
BATCH = 4 << 20
HASHES = 4
ENOUGH = 1
MIN_WORDS = 50
SHINGLE = 5
SIMILARITY = 0.8
NEAR = (6, 12)
_SEED = random_u64(64, 21)
_CONTEXT = random_u64(4, 22)


def compact_windows(items: np.ndarray, texts: np.ndarray, width: int, seed: np.uint64) -> tuple[np.ndarray, ...]:
    """Centre, first and last item, and hash of the centre, of every compact window of at least ``width`` items.

    The Cartesian tree of a text's item hashes has a node for each item: the widest run of items of which it is the minimum.
    Nodes of at least ``width`` items are those whose item is the minimum of some ``width`` consecutive items; a sliding
    minimum, made by doubling, finds them.  A node ends where its ancestors stand, which are as wide, so that the nearest
    smaller ones among the nodes found give its bounds.  Equal hashes count to the first; neighbours of one hash are one
    window.
    """
    n = len(items)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, np.zeros(0, U64)
    bits = U64(max(1, int(n).bit_length()))
    h = mix(items ^ seed)
    m = (h >> bits << bits) | np.arange(n, dtype=U64)
    size = 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: n - width + 1], m[width - size : width - size + n - width + 1])
    at = (m & ((U64(1) << bits) - U64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(texts) - 1), np.diff(texts))
    start = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    if not len(start):
        return none, none, none, np.zeros(0, U64)
    centre = at[start]
    centre = centre[np.append(True, centre[1:] != centre[:-1])]
    own, value = text[centre], (h[centre] >> bits << bits) | centre.astype(U64)
    before, after = _nearest_smaller(value, own), len(centre) - 1 - _nearest_smaller(value[::-1], own[::-1])[::-1]
    inside = (before >= 0) & (own[np.maximum(before, 0)] == own)
    first = np.where(inside, centre[np.maximum(before, 0)] + 1, texts[own])
    inside = (after < len(centre)) & (own[np.minimum(after, len(centre) - 1)] == own)
    last = np.where(inside, centre[np.minimum(after, len(centre) - 1)], texts[own + 1]) - 1
    new = np.append(True, (h[centre[1:]] != h[centre[:-1]]) | (own[1:] != own[:-1]))
    return centre[new], first[new], last[new], h[centre[new]]


def _nearest_smaller(value: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each one, or of a value of another text where that comes first; or -1."""
    to = np.arange(len(value)) - 1
    left = np.arange(len(value))
    while len(left):
        p = to[left]
        left = left[(p >= 0) & (own[np.maximum(p, 0)] == own[left]) & (value[np.maximum(p, 0)] > value[left])]
        to[left] = to[to[left]]  # what lies between is larger still
    return to


def _context(items: np.ndarray, texts: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of two items before each centre and of two after it; 0 where the text does not reach so far."""
    text = np.searchsorted(texts, centre, "right") - 1
    lo, hi = texts[text], texts[text + 1]
    left = right = np.zeros(len(centre), U64)
    for d, k in zip(NEAR, _CONTEXT):
        left = left + items[np.maximum(centre - d, 0)] * k
        right = right + items[np.minimum(centre + d, len(items) - 1)] * k
    far = max(NEAR)
    left, right = mix(left) >> U64(33) | U64(1), mix(right) >> U64(33) | U64(1)  # 31 bits, not 0
    return np.where(centre - far >= lo, left, 0).astype(np.int64), np.where(centre + far < hi, right, 0).astype(np.int64)


_COLUMNS = ["key", "doc", "c", "span", "context"]
_LOW = np.int64(0xFFFFFFFF)
#: This context marks a window that is told and does not meet again; pairs have minus their hash functions there.
_TOLD = np.int64(-(1 << 63))
HASHES_END = 1 << HASHES
_PAIRS = ["a", "b", "hashes", "c"]
#: In place of hash functions: a window that is the first of its key and context, and one that has earlier ones.
HEAD, LATER = 0, -1


def _pairs_of(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each window with the first document's window of the same key and context, and which windows met on both sides."""
    return _meeting(rows, width)[:2]


def _meeting(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``_pairs_of`` says, which windows have the key and context of another document's at all, and which of an earlier one's.

    ``rows`` has the columns of ``_COLUMNS``: ``span`` holds the items before and after the centre that the window takes in,
    ``context`` the hashes of those a little before and after it.  The lowest bits of a key name its hash function.
    """
    found, met, company, later = [], [], np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    rows = np.column_stack([rows[:, :3], rows[:, 3] >> 32, rows[:, 3] & _LOW, rows[:, 4] >> 32, rows[:, 4] & _LOW])
    for side in (5, 6):
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, side], rows[:, 0]))
        r = rows[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:, 0] != r[:-1, 0]) | (r[1:, side] != r[:-1, side])
        first = np.flatnonzero(new)
        head = r[first[np.cumsum(new) - 1]]
        tail = r[np.append(first[1:], len(r))[np.cumsum(new) - 1] - 1]
        company[order] |= (r[:, side] != 0) & (head[:, 1] < tail[:, 1])
        later[order] |= (r[:, side] != 0) & (head[:, 1] < r[:, 1])
        lo, hi = r[:, 2] - np.minimum(r[:, 3], head[:, 3]), r[:, 2] + np.minimum(r[:, 4], head[:, 4])
        ok = (r[:, side] != 0) & (head[:, 1] < r[:, 1]) & (hi - lo + 1 >= width)  # over too short a span nothing is met
        both = np.zeros(len(rows), bool)
        both[order] = ok
        met.append(both)
        found.append(np.column_stack([r[:, 1], head[:, 1], r[:, 2] - head[:, 2], lo, hi, 1 << (r[:, 0] & (HASHES - 1))])[ok])
    return _merged(np.concatenate(found)), met[0] & met[1], company, later


def _merged(pairs: np.ndarray) -> np.ndarray:
    """Pairs of the same documents and shift with overlapping intervals as one, with all their hash functions."""
    if not len(pairs):
        return pairs
    p = pairs[np.lexsort((pairs[:, 3], pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    group = np.cumsum(np.append(True, (p[1:, :3] != p[:-1, :3]).any(axis=1)))
    # A running maximum of the ends inside each group: groups are lifted apart, so that one pass serves all.
    lift = group * (int(p[:, 4].max()) + 2)
    reach = np.maximum.accumulate(p[:, 4] + lift) - lift
    new = np.append(True, (group[1:] != group[:-1]) | (p[1:, 3] > reach[:-1] + 1))
    at = np.flatnonzero(new)
    return np.column_stack([p[at, :4], np.maximum.reduceat(p[:, 4], at), np.bitwise_or.reduceat(p[:, 5], at)])


def _batch(values: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(values.shape[1])], names=names)


def _told(pairs: np.ndarray, windows: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_PAIRS``: pairs ``a, b, hashes``, and windows with ``HEAD`` or ``LATER``, the document and key as ``a, b``."""
    none = np.zeros(len(pairs), np.int64)
    return _batch(np.concatenate([np.column_stack([pairs, none]), np.column_stack([windows[:, [1, 0]], np.where(later, LATER, HEAD), windows[:, 2]])]), _PAIRS)


def _whole_texts(items: np.ndarray, texts: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """One row for each text of at least ``width`` items, keyed by all of them, so that equal texts meet whoever else does."""
    n = np.diff(texts)
    long = np.flatnonzero(n >= width)
    if not len(long):
        return np.zeros((0, 5), np.int64)
    place = np.arange(len(items), dtype=np.int64) - np.repeat(texts[:-1], n)
    total = np.concatenate([[U64(0)], np.cumsum(mix(items + place.astype(U64) * _SEED[-1]), dtype=U64)])
    key = mix(total[texts[1:]] - total[texts[:-1]]) & ~U64(HASHES - 1)
    zero = np.zeros(len(long), np.int64)
    return np.column_stack([key[long].view(np.int64), ids[long], zero, n[long] - 1, zero + (1 << 32 | 1)])


def _met(rows: np.ndarray, width: int) -> pa.RecordBatch:
    pairs, _, company, later = _meeting(rows, width)
    return _told(pairs[:, [0, 1, 5]] if len(pairs) else np.zeros((0, 3), np.int64), rows[company], later[company])


def candidate_pairs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``a, b, hashes``: documents ``a`` that may repeat a passage of the earlier document ``b``, by which hash functions;
    and with ``HEAD`` or ``LATER`` for them, every window that has the key and context of another document's: its document
    ``a``, key ``b`` and centre ``c``, for ``open_windows``.  A window may come twice; one with an earlier document's comes as
    ``LATER`` at least once.

    Windows are keyed by hash function and minimum; among the windows of a key, each meets the first document with the same
    items a little before its centre, and the first with the same items a little after it; equal texts also meet as wholes.
    What meets on both sides inside
    an Arrow batch stays there, so that a passage that very many documents hold sends one window a batch to its key.
    """
    width = min_words - SHINGLE + 1
    schema = StructType([StructField(c, LongType()) for c in _COLUMNS])

    @tidy
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, (data, off), rows = b.column(0).to_numpy(), utf8(b.column(1)), []
            for row, end, part, part_off in chunks(data, off):
                items, texts = shingle_hashes(*word_hashes(part, part_off), SHINGLE)
                name = np.repeat(ids[row:end], np.diff(texts))
                begin = np.repeat(texts[:-1], np.diff(texts))
                rows.append(_whole_texts(items, texts, ids[row:end], width))
                for f in range(HASHES):
                    c, lo, hi, value = compact_windows(items, texts, width, _SEED[f])
                    key = (mix(value) & ~U64(HASHES - 1) | U64(f)).view(np.int64)
                    before, after = _context(items, texts, c)
                    rows.append(np.column_stack([key, name[c], c - begin[c], (c - lo) << 32 | (hi - c), before << 32 | after]) if len(c) else np.zeros((0, 5), np.int64))
            own = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
            pairs, settled, company, later = _meeting(own, width)
            yield _batch(own[~settled], _COLUMNS)
            if company.any():  # those that go on may find company under their key as well, and may come twice
                yield _batch(np.column_stack([own[company][:, :3], later[company], np.full(int(company.sum()), _TOLD)]), _COLUMNS)
            if len(pairs):  # what is settled goes on under keys of its own, with minus its hash functions for a context
                key = mix(np.ascontiguousarray(pairs[:, 0]).view(U64) * U64(31) + np.ascontiguousarray(pairs[:, 1]).view(U64)).view(np.int64)
                yield _batch(np.column_stack([key, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64), -pairs[:, 5]]), _COLUMNS)

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)
        for b in batches:
            rows = np.column_stack([c.to_numpy() for c in b.columns]) if b.num_rows else np.zeros((0, 5), np.int64)
            told, seen = (rows[:, 4] < 0) & (rows[:, 4] > -HASHES_END), rows[:, 4] <= -HASHES_END
            yield _told(np.column_stack([rows[told, 1], rows[told, 2], -rows[told, 4]]), rows[seen], rows[seen, 3] > 0)
            held = np.concatenate([held, rows[~told & ~seen]])
            if len(held):
                done = held[:, 0] != held[-1, 0]  # the last key may go on in the next batch
                yield _met(held[done], width)
                held = held[~done]
        yield _met(held, width)

    found = docs.mapInArrow(windows, schema).repartition("key").sortWithinPartitions("key")
    return found.mapInArrow(meet, StructType([StructField(c, LongType()) for c in _PAIRS]))


def _segments(hit: np.ndarray, width: int, share: float) -> list[tuple[int, int]]:
    """Runs of at least ``width`` items, from hit to hit, of which at least ``share`` are hits."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    runs, out = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), []
    at = 0
    while at < len(runs):
        lo, hi = runs[at]
        got, nxt = hi - lo, at + 1
        while nxt < len(runs) and got + runs[nxt][1] - runs[nxt][0] >= share * (runs[nxt][1] - lo):
            got += runs[nxt][1] - runs[nxt][0]
            hi = runs[nxt][1]
            nxt += 1
        if hi - lo >= width:
            out.append((lo, hi - 1))
        at = nxt
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, first_doc_id, similarity``: passages that an earlier document has too.

    A passage of at least ``min_words`` words (from ``start_word`` up to and without ``end_word``, counted from 0) is
    reported where its set of five-word shingles has a Jaccard similarity of at least ``similarity`` with a passage of the
    document ``first_doc_id``, of smaller id.  Candidates come from ``HASHES`` hash functions (``candidate_pairs``); a
    passage that is repeated word for word shares the windows of all of them.  A pair that meets under ``ENOUGH`` of them is
    verified on both texts.  A window meets the first document of its key and context; where no passage around its centre comes
    of that, the text around it meets that of all others by content (``closer_pairs``): a passage that is repeated word for word
    is found whichever document has it.  A passage that several earlier documents have need not be listed with each of them.
    Documents without such passages have no row.

    Null, empty or shorter texts, and null ids, have no rows.  Rows that repeat an id are compared with other ids only.
    Extra columns are ignored; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession, BATCH)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null and t is not null")
    met = materialise(candidate_pairs(texts, min_words))
    pairs = met.filter("hashes > 0").groupBy("a", "b").agg(F.bit_or("hashes").alias("h"))
    pairs = materialise(pairs.filter(F.bit_count("h") >= ENOUGH).select("a", "b"))
    width = min_words - SHINGLE + 1
    schema = StructType([*(StructField(c, LongType()) for c in (id_col, "start_word", "end_word", "first_doc_id")), StructField("similarity", DoubleType())])

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            a, z, ta, tb = b.columns
            for (i, x, _), (_, y, _) in zip(text_shingles(ta, SHINGLE), text_shingles(tb, SHINGLE)):
                order = np.argsort(y, kind="stable")
                sort = y[order]
                place = np.minimum(np.searchsorted(sort, x), max(len(sort) - 1, 0))
                hit = sort[place] == x if len(sort) else np.zeros(len(x), bool)
                todo, done = _segments(hit, width, 2 * similarity / (1 + similarity)), []
                while todo:
                    lo, hi = todo.pop()
                    here = hit[lo : hi + 1]
                    where = order[place[lo : hi + 1][here]]
                    p, q = np.unique(x[lo : hi + 1]), np.unique(_near(y, where))
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    like = common / (len(p) + len(q) - common)
                    if like < similarity:  # the first places of its items are not the passage's: the likest run of the other text
                        s, e, like = _likest(p, y, hi - lo + 1, similarity)
                    if like >= similarity:
                        done.append((lo, hi, like))
                    else:
                        todo += [(u, v) for u, v in _parts(x[lo : hi + 1], here, y[s : e + 1], lo, width, similarity) if v - u + 1 >= width]
                done += [(lo, hi, 1.0) for lo, hi in _verbatim(x, y, hit, width, done)]
                out += [(a[i].as_py(), lo, hi + SHINGLE, z[i].as_py(), like) for lo, hi, like in done]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.float64())], names=schema.names)

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        some, _ = split_by_ids(texts, ends, "id")
        with_b = some.select(F.col("id").alias("b"), F.col("t").alias("tb")).join(pairs, "b")
        both = with_b.join(some.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")
        return both.mapInArrow(verify, schema)

    found = verified(pairs)
    if "c" in met.columns:
        found = materialise(found)
        mine, theirs = open_windows(met.filter("hashes <= 0"), _spans(found, id_col))
        more = materialise(closer_pairs(texts, mine, theirs, width).join(pairs, ["a", "b"], "left_anti"))
        here = mine.select(F.col("a").alias("at"), "c").distinct()
        inside = (F.col(id_col) == F.col("at")) & F.col("c").between(F.col("start_word"), F.col("end_word") - SHINGLE)
        found = found.unionByName(verified(more).join(here, inside, "left_semi"))
    return found.select(id_col, "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id", "similarity")


def _spans(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col(id_col).alias("s_doc"), F.col("start_word").alias("s_first"), (F.col("end_word") - SHINGLE).alias("s_last")).distinct()


def open_windows(windows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, c`` of windows that the first document of their key and context did not answer for, and of all of their keys.

    A window is answered for where its centre lies in a verified passage of its document; the first of all has nothing to meet.
    """
    inside = (F.col("a") == F.col("s_doc")) & F.col("c").between(F.col("s_first"), F.col("s_last"))
    mine = materialise(windows.filter(F.col("hashes") == LATER).select("a", "b", "c").join(spans, inside, "left_anti"))
    return mine, windows.select("a", "b", "c").join(mine.select("b").distinct(), "b", "left_semi")


def _closer_keys(items: np.ndarray, centre: np.ndarray, width: int) -> np.ndarray:
    """Keys of the text around ``centre``: every run of ``width`` items that takes one in, and a few items of nearly as wide a run.

    The latter are, for some places of the centre in the run, the items at both ends, and the smallest of its first and last
    thirds, which stay where a word between is changed, or comes in or goes.
    """
    n, reach = len(items), width - width // 8 - 1
    if n < width:
        return np.zeros(0, U64)
    run = np.zeros(n + 1, np.int64)
    np.add.at(run, np.maximum(centre - width + 1, 0), 1)
    np.add.at(run, np.minimum(centre, n - width) + 1, -1)
    keys = [_run_hashes(items, width)[np.cumsum(run)[: n - width + 1] > 0]]
    third = max(1, (reach + 1) // 3)
    least = np.lib.stride_tricks.sliding_window_view(mix(items ^ _SEED[9]), third).min(axis=1)
    for i in range(0, reach + 1, max(1, width // 9)):
        c = centre[(centre >= i) & (centre - i + reach < n)]
        lo, hi = c - i, c - i + reach
        own = items[c] * _SEED[10] + U64(i)
        keys.append(mix(own + items[lo] * _SEED[11] + items[hi] * _SEED[12]))
        keys.append(mix(own + least[lo] * _SEED[13] + least[hi - third + 1] * _SEED[14]))
    return np.unique(np.concatenate(keys))


def closer_pairs(texts: DataFrame, mine: DataFrame, theirs: DataFrame, width: int) -> DataFrame:
    """``a, b``: the document of each window of ``mine`` with the first one that has a key of ``_closer_keys`` around it, per key.

    A run of ``width`` items that the documents of ``theirs`` share is a key of all of them, so that its first holder has it
    word for word, and no holder need meet any other: the pairs grow with the keys, however many documents share one.
    """
    schema = StructType([StructField("k", LongType()), StructField("a", LongType()), StructField("open", BooleanType())])
    spots = theirs.select("a", "c", F.lit(False).alias("open")).unionByName(mine.select("a", "c", F.lit(True).alias("open")))
    spots = materialise(spots.groupBy("a").agg(F.collect_set("c").alias("all"), F.collect_set(F.when(F.col("open"), F.col("c"))).alias("open")))
    some, _ = split_by_ids(texts, spots.select(F.col("a").alias("id")), "id")
    both = some.select(F.col("id").alias("a"), "t").join(spots, "a").select("a", "t", "all", "open")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none, cols = np.zeros(0, np.int64), []
            for i, items, _ in text_shingles(b.column(1), SHINGLE):
                every, own = (np.sort(b.column(c)[i].values.to_numpy()) for c in (2, 3))
                keys, open_keys = (_closer_keys(items, at[at < len(items)], width) for at in (every, own))
                cols.append((keys.view(np.int64), np.full(len(keys), b.column(0)[i].as_py()), np.isin(keys, open_keys)))
            k, a, own = (np.concatenate([none.astype(t), *c]) for t, c in zip((np.int64, np.int64, bool), list(zip(*cols)) or [()] * 3))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(a), pa.array(own)], names=schema.names)

    keys = materialise(both.mapInArrow(run, schema))
    first = keys.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").select("k", "b")
    return keys.filter("open").join(first, "k").filter("b < a").select("a", "b").distinct()


def _near(items: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The items of the other text from the first to the last place that belongs to the passage.

    An item that occurs more than once may have been found far off; places beyond twice the passage from the middle one are
    left out.
    """
    mid, reach = int(np.sort(where)[len(where) // 2]), 2 * len(where) + SHINGLE
    where = where[np.abs(where - mid) <= reach]
    return items[where.min() : where.max() + 1]


def _likest(p: np.ndarray, items: np.ndarray, n: int, similarity: float) -> tuple[int, int, float]:
    """First and last place of a run of ``items`` that is like the set ``p`` of a passage of ``n`` items, and its similarity.

    For each of some lengths around ``n`` the run with the most different items of ``p`` is found in one pass; from there the
    ends move, one at a time, to where the similarity is largest.
    """
    at = np.minimum(np.searchsorted(p, items), len(p) - 1)
    has = p[at] == items
    where = np.flatnonzero(has)
    order = np.argsort(at[where], kind="stable")
    same = np.flatnonzero(np.diff(at[where][order]) == 0)
    before = np.full(len(where), -1)
    before[order[same + 1]] = where[order[same]]
    best = (0, -1, 0.0)
    for size in np.unique(np.linspace(similarity * len(p), n / similarity + 1, 8).astype(np.int64)):
        # The item at a place counts for the runs that begin after its last occurrence and reach the place.
        gain = np.bincount(np.maximum(before, where - size) + 1, minlength=len(items) + 1) - np.bincount(where + 1, minlength=len(items) + 1)
        s = int(np.cumsum(gain)[:-1].argmax())
        e, like, last = min(s + int(size), len(items)) - 1, 0.0, -1.0
        while like > last:
            last = like
            k, _ = _best_end(items[s : s + 2 * n], has[s : s + 2 * n], len(p))
            e = s + k
            begin = max(0, e + 1 - 2 * n)
            k, like = _best_end(items[begin : e + 1][::-1], has[begin : e + 1][::-1], len(p))
            s = e - k
        best = max(best, (s, e, like), key=lambda b: b[2])
    return best


def _best_end(items: np.ndarray, has: np.ndarray, n: int) -> tuple[int, float]:
    """Where to end a run that begins with ``items[0]`` so that it is most like a set of ``n`` items, and how like it is."""
    new = np.zeros(len(items), bool)
    new[np.unique(items, return_index=True)[1]] = True
    common = np.cumsum(new & has)
    like = common / (n + np.cumsum(new) - common)
    k = int(like.argmax())
    return k, float(like[k])


def _parts(x: np.ndarray, here: np.ndarray, run: np.ndarray, lo: int, width: int, similarity: float) -> list[tuple[int, int]]:
    """Where to go on in a passage ``x`` from ``lo`` on that is like no run of the other text as a whole.

    What the likest ``run`` has and what it has not go apart.  A passage all of which is in that run is parted at its widest
    gap, or where there is none, where its places in the run lie farthest apart.
    """
    hi, n = lo + len(x) - 1, len(x)
    inside = np.isin(x, run)
    own = _segments(inside, width, 2 * similarity / (1 + similarity))
    if own and own != [(0, n - 1)]:
        ends = [-1, *(v for part in own for v in part), n]
        rest = [(ends[i] + 1, ends[i + 1]) for i in range(0, len(ends), 2)]
        own += [(u + a, u + b) for u, v in rest for a, b in _segments(here[u:v], width, 2 * similarity / (1 + similarity))]
        return [(lo + u, lo + v) for u, v in own]
    if not here.all():  # the parts on both sides of its widest gap
        at = np.flatnonzero(here)
        k = int(np.diff(at).argmax())
        return [(lo, lo + int(at[k])), (lo + int(at[k + 1]), hi)]
    at = np.flatnonzero(inside)
    if len(at) < 2:
        return []
    values, first = np.unique(run, return_index=True)
    k = int(np.abs(np.diff(first[np.searchsorted(values, x[at])])).argmax())
    return [(lo, lo + int(at[k])), (lo + int(at[k + 1]), hi)]


def _verbatim(x: np.ndarray, y: np.ndarray, hit: np.ndarray, width: int, done: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Runs of at least ``width`` items that ``y`` has word for word and of which a part is in no passage of ``done``."""
    if len(x) < width or len(y) < width:
        return []
    total = np.concatenate([[0], np.cumsum(hit)])
    free = total[width:] - total[:-width] == width
    for lo, hi, _ in done:
        free[lo : max(lo, hi - width + 2)] = False
    if not free.any():
        return []
    known, first = np.unique(_run_hashes(y, width), return_index=True)
    mine = _run_hashes(x, width)
    place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    out, end = [], -1
    for i in np.flatnonzero(free & (known[place] == mine)).tolist():
        if i + width - 1 > end:
            j = int(first[place[i]])
            n = min(len(x) - i, len(y) - j)
            other = np.flatnonzero(x[i : i + n] != y[j : j + n])
            end = i + (int(other[0]) if len(other) else n) - 1
            out.append((i, end))
    return out


def _run_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` items."""
    total, size = items.copy(), 1  # doubled: the hash of a run of 2n from those of its two halves
    out, done = np.zeros(len(items) - width + 1, U64), 0
    while done < width:
        if width & size:
            out = mix(out + total[done : done + len(out)] * _SEED[7])
            done += size
        if done < width:
            total = mix(total[:-size] * _SEED[8] + total[size:])
            size *= 2
    return out


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of ``passages`` cut from ``text_col``; all other bytes, columns and rows stay as they are."""
    spans = passages.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    docs, untouched = split_by_ids(docs, passages.select(F.col(id_col).cast("long").alias("id")), id_col)
    both = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(spans, "id", "left")
    whole, spans_of, new = (free_name(docs.columns, c) for c in ("whole text", "spans", "new text"))
    cut = both.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("t").alias(whole), F.col("spans").alias(spans_of))
    schema = StructType([*docs.schema.fields, StructField(new, StringType())])
    n = len(docs.columns)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str | None] = []
            for text, spans in zip(b.column(n), b.column(n + 1)):
                if not spans.is_valid or not text.is_valid:
                    texts.append(text.as_py())
                    continue
                data = np.frombuffer(text.as_buffer(), np.uint8)
                start, length, _ = word_bounds(data, np.array([0, len(data)]))
                begin, keep = np.append(start, len(data)), np.ones(len(data), bool)
                for s in spans.as_py():
                    keep[begin[s["start_word"]] : begin[min(s["end_word"], len(start))]] = False
                texts.append(data[keep].tobytes().decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string())], names=schema.names)

    made = cut.mapInArrow(run, schema)
    made = made.select(*(F.col(new).alias(c) if c == text_col else F.col(c) for c in docs.columns))
    return made.unionByName(untouched.withColumn(text_col, F.col(text_col).cast("string")))
