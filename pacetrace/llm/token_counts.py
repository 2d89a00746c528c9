"""Token counts by a two-tier lookup of pre-tokens on the map side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .groups import free_name
from .pretokens import KEY_BYTES, WordTable, distinct, encoder, word_keys
from .workers import tidy
from .textops import chunks, utf8

TABLE_WORDS = 1 << 14
TASK_WORDS = 1 << 12
HELD_WORDS = 1 << 17


def frequent_pretokens(texts: DataFrame, path: str) -> np.ndarray:
    """The ``TABLE_WORDS`` most frequent pre-tokens of up to ``KEY_BYTES`` bytes, as the columns of a key array.

    Every task counts all its pre-tokens in a table of ``HELD_WORDS`` words, from which rarer words give way, and passes on
    a summary of its ``TASK_WORDS`` most frequent ones; only these summaries are shuffled and added up.  What a summary
    misses costs a look into the second tier, never a wrong count.
    """
    schema = StructType([StructField(c, LongType()) for c in ("k0", "k1", "k2", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = encoder(path).cutter
        held, count = np.zeros((3, 0), np.uint64), np.zeros(0, np.int64)
        for b in batches:
            data, off = utf8(b.column(0))
            for _, _, part, part_off in chunks(data, off, 4 << 20):
                at, length, _, _ = cutter.cut(part, part_off)
                short = length <= KEY_BYTES
                keys = word_keys(part, at[short], length[short])
                one, _, n = distinct(keys)
                keys, n = np.concatenate([held, keys[:, one]], axis=1), np.concatenate([count, n])
                one, which, _ = distinct(keys)
                held, count = keys[:, one], np.bincount(which, n, len(one)).astype(np.int64)
                if len(count) > HELD_WORDS:
                    top = np.argpartition(-count, HELD_WORDS // 2)[: HELD_WORDS // 2]
                    held, count = held[:, top], count[top]
        top = np.argsort(-count, kind="stable")[:TASK_WORDS]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[top].view(np.int64)) for k in np.ascontiguousarray(held)), pa.array(count[top])], names=schema.names)

    best = texts.mapInArrow(run, schema).groupBy("k0", "k1", "k2").agg(F.sum("n").alias("n"))
    rows = best.orderBy(F.desc("n"), "k0", "k1", "k2").limit(TABLE_WORDS).collect()  # a bounded table, whatever the corpus
    return np.array([[r.k0 for r in rows], [r.k1 for r in rows], [r.k2 for r in rows]], np.int64).view(np.uint64).reshape(3, -1)


def length_table(keys: np.ndarray, path: str) -> WordTable:
    """The compact table that is broadcast: pre-token to number of ids."""
    table = WordTable(1 << (4 * TABLE_WORDS - 1).bit_length())
    if keys.shape[1]:
        raw = np.ascontiguousarray(keys.T).view(np.uint8).reshape(-1, KEY_BYTES)
        ok, words = [], []
        for i, w in enumerate(raw):
            try:
                words.append(w.tobytes().rstrip(b"\0").decode())
                ok.append(i)
            except UnicodeDecodeError:  # a word that holds zero bytes, from a text that is encoded whole
                pass
        table.add(keys[:, ok], encoder(path).encode_words(words)[1])
    return table


def token_counts(docs: DataFrame, path: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with a column ``into``: the number of ids that the tokenizer file ``path`` gives for the whole text.

    No special tokens are added; the strings of special tokens inside a text count as the library's default has it.
    Method: texts are cut into pre-tokens where they lie.  Tier one is a broadcast table of at most ``TABLE_WORDS`` frequent
    pre-tokens and their lengths; a miss goes to tier two, the worker's cache, which has the library encode each new
    pre-token once.  No pre-token is shuffled.  Texts that the cutter can't be sure of are encoded whole.

    A null or empty text has 0 tokens.  All columns and rows are kept; a column named ``into`` is replaced.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(length_table(frequent_pretokens(texts, path), path))
    kept = [c for c in docs.columns if c != into]
    schema = StructType([*docs.select(*(docs[c] for c in kept)).schema.fields, StructField(into, LongType(), False)])
    place = len(kept)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier, enc = shared.value, encoder(path)
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            data, off = utf8(b.column(place))
            for row, end, part, part_off in chunks(data, off):
                at, length, per, unsafe = enc.cutter.cut(part, part_off)
                length = np.where(np.repeat(unsafe, np.diff(per)), 0, length)
                short = (length > 0) & (length <= KEY_BYTES)
                count = np.zeros(len(at), np.int64)
                keys = word_keys(part, at[short], length[short])
                found = tier.find(keys)
                count[np.flatnonzero(short)[found >= 0]] = found[found >= 0]
                miss = length > 0
                miss[np.flatnonzero(short)[found >= 0]] = False
                number = enc.numbers(part, at[miss], length[miss])
                count[miss] = enc.count[number]
                total = np.concatenate([[0], np.cumsum(count)])[per]
                out[row:end] = np.diff(total)
                for i in np.flatnonzero(unsafe).tolist():
                    out[row + i] = len(enc.whole(part[part_off[i] : part_off[i + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns[:place], pa.array(out)], names=schema.names)

    return docs.select(*(docs[c] for c in kept), F.col(text_col).cast("string").alias(free_name(kept, "whole text"))).mapInArrow(run, schema)
