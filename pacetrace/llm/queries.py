"""One query per operator over the supplied tables, and the SQL that must agree where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import scratch_path
from . import binary_ids, clusters, conversations, mixing, packing, passages, quality, warc
from .embedding_duplicates import embedding_duplicates
from .near_duplicates import near_duplicates
from .nearest import nearest
from .token_counts import token_counts
from .top_k import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


#: Score from which the quality classifier keeps a document.
QUALITY_FROM = 0.3

#: The tree of sources: domain, then language, then source.
DOMAIN = "CASE WHEN source = 'src0' THEN 'web' WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'books' ELSE 'reference' END"
WORDS = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"
WEIGHTS = ({"web": 5, "books": 3, "reference": 2}, {"en": 6, "de": 2, "fr": 2, "es": 1, "*": 1}, {"*": 1})
SHARE, EPOCHS, SEED = 0.5, 2, 17


def mixed(docs: DataFrame) -> DataFrame:
    """Documents by the tree above: half of all words, no leaf more than twice."""
    levels = [F.expr(DOMAIN), F.col("lang"), F.col("source")]
    return mixing.mix(docs, levels, WEIGHTS, F.expr(WORDS), SHARE, EPOCHS, SEED)


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query(
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.v) = len(v.v))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5"""
)
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query()
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


@query(
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, strlen(h) AS n, min(page_id) AS o FROM p GROUP BY ALL)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(p.x, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to
FROM p JOIN f ON f.x = p.x AND f.n = strlen(h)"""
)
def op5_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), where)
    return warc.read_archives(spark, where, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_binary_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch_path(spark, "ids")
    binary_ids.write_ids(table(spark, sf_dir, "documents"), where, BYTE_BPE, end_id=2)
    docs = binary_ids.read_ids(spark, where).select("doc_id", "part", "file", "within", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    starts = binary_ids.file_starts(spark, where)
    return docs.join(starts, ["part", "file"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


@query()
def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.placements(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048, end_id=1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query(
    f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE {_USABLE}
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
w AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9e0),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT x AS vec_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links, min(y) AS component_id, min(y) = x AS kept
FROM r LEFT JOIN k ON k.a = x GROUP BY x"""
)
def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), u AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id, min(r.y) = n.doc_id AS kept FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n"""
)
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _shares(level: int, table_: str) -> str:
    """SQL of one level of the tree: the budget ``b`` of each parent over its children."""
    keys = [f"l{i}" for i in range(1, level + 1)]
    up, own, w = keys[:-1], keys[-1], WEIGHTS[level - 1]
    weight = f"CASE {own} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items() if k != "*") + f" ELSE {w.get('*', 0)} END" if len(w) > 1 else "1"
    part = f"PARTITION BY {', '.join(up)} " if up else ""
    budget = f"JOIN {table_} USING ({', '.join(up)})" if up else f"CROSS JOIN {table_}"
    return f"""SELECT {', '.join(keys)}, CASE WHEN full_ THEN cap WHEN w = 0 THEN 0 ELSE (b - coalesce(sum(cap) FILTER (full_) OVER ({part}), 0)) * w //
    sum(w) FILTER (NOT full_) OVER ({part}) END AS b
  FROM (SELECT *, w > 0 AND cap * (sum(w) OVER ({part}ORDER BY cap / w, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      <= (b - coalesce(sum(cap) OVER ({part}ORDER BY cap / w, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS full_
    FROM (SELECT {', '.join(keys)}, b::HUGEINT AS b, cap, {weight} AS w FROM (SELECT {', '.join(keys)}, sum(size * {EPOCHS})::HUGEINT AS cap FROM leaf GROUP BY ALL) {budget}))"""


@query(
    rf"""WITH d AS (SELECT doc_id, lang, source, {DOMAIN} AS l1, coalesce(lang, '') AS l2, coalesce(source, '') AS l3,
  len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n FROM documents),
leaf AS (SELECT l1, l2, l3, sum(n)::HUGEINT AS size FROM d GROUP BY ALL),
b0 AS (SELECT floor(sum(size) * {SHARE})::HUGEINT AS b FROM leaf),
b1 AS ({_shares(1, "b0")}), b2 AS ({_shares(2, "b1")}), b3 AS ({_shares(3, "b2")}),
p AS (SELECT d.*, CASE WHEN size > 0 THEN b // size ELSE 0 END AS full_, CASE WHEN size > 0 THEN b % size ELSE 0 END AS rest
  FROM d JOIN leaf USING (l1, l2, l3) JOIN b3 USING (l1, l2, l3)),
o AS (SELECT *, sum(n) OVER (PARTITION BY l1, l2, l3 ORDER BY md5('{SEED}:' || full_ || ':' || coalesce(doc_id::VARCHAR, 'null')), doc_id, n
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM p)
SELECT doc_id, lang, source, e::INTEGER AS epoch, n AS n_tokens FROM (SELECT *, unnest(range(full_::BIGINT)) AS e FROM p)
UNION ALL SELECT doc_id, lang, source, full_::INTEGER AS epoch, n AS n_tokens FROM o WHERE rest > 0 AND s <= rest"""
)
def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "epoch", "n_tokens")


_CRC32 = """(SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS t)"""


@query(
    rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS f FROM conversations, {_CRC32}),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS k FROM c WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS i, left(role, 1) AS l,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) > 1 AS again,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM d),
r AS (SELECT *, solid = '' AS blank, solid <> '' AND again AS dup, solid <> '' AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS trunc,
  l || lag(l) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('us', 'au', 'ua')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
m(state, ins, lines, mid) AS (VALUES (0, '', '', 0), (0, 'I', chr(10) || 'user:', 2), (0, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
  (1, '', '', 1), (1, 'I', chr(10) || 'user:', 2), (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
  (3, '', '', 3), (3, 'I', chr(10) || 'user:', 2), (3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
  (2, '', '', 2), (2, 'I', chr(10) || 'assistant:', 3), (2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 2)),
s AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS body FROM n
  UNION ALL SELECT conv_id, i, state, cost, audit, body FROM (
    SELECT s.conv_id, r.i, CASE e WHEN 'D' THEN mid WHEN 'R' THEN CASE mid WHEN 2 THEN 3 ELSE 2 END ELSE CASE l WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
      cost + 3 * length(ins) + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN trunc AND e <> 'D' THEN 3 ELSE 0 END AS cost, audit || ins || e AS audit,
      body || lines || CASE e WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || CASE mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || text ELSE chr(10) || role || ':' || text END AS body
    FROM s JOIN m USING (state) JOIN r ON r.i = s.i + 1 AND r.conv_id IS NOT DISTINCT FROM s.conv_id, (VALUES ('D'), ('K'), ('R')) AS x(e)
    WHERE e = 'D' OR NOT (blank OR dup) AND (e = 'R' OR l = 's' AND mid = 0 OR l = 'u' AND mid IN (0, 1, 3) OR l = 'a' AND mid = 2))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
b AS (SELECT s.conv_id, cost + 3 * length(ins) AS cost, audit || ins AS audit, sha256(substr(body || lines, 2)) AS h FROM s JOIN m USING (state)
  JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.n = s.i WHERE mid IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY cost + 3 * length(ins), audit || ins) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id"""
)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


def _lloyd_sql(rounds: int) -> str:
    """SQL of Lloyd's rounds, one pair of common tables each."""
    nearest = """SELECT vec_id, any_value(x) AS x, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS distance FROM
  (SELECT v.n, v.vec_id, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {m} m) GROUP BY n, vec_id"""
    out = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x AS m FROM v ORDER BY sha256('3:' || vec_id), x LIMIT 8)",
    ]
    for r in range(rounds):
        out.append(f"a{r} AS MATERIALIZED ({nearest.format(m=f'm{r}')})")
        out.append(f"""m{r + 1} AS MATERIALIZED (SELECT c, coalesce(u.m, o.m) AS m FROM m{r} o LEFT JOIN
  (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM (SELECT c, i, sum(y) AS s, count(*) AS n FROM
    (SELECT c, unnest(x) AS y, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) u USING (c))""")
    return f"""WITH {', '.join(out)}, z AS MATERIALIZED ({nearest.format(m=f'm{rounds}')})
SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN m{rounds} USING (c)"""


@query(_lloyd_sql(10))
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_report(*clusters.cluster(table(spark, sf_dir, "embeddings")))


@query()
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
