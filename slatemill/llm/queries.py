"""The corpus operators as registered queries, each over its whole table with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatemill.llm.backoff_lm import backoff_scores
from slatemill.llm.collision_ann import nearest
from slatemill.llm.common import table
from slatemill.llm.conversation_trie import prefix_trie
from slatemill.llm.covering_simhash import simhash_components
from slatemill.llm.hard_negatives import hard_negatives
from slatemill.llm.hnsw_dedup import cosine_groups
from slatemill.llm.language_id import language_id
from slatemill.llm.length_buckets import BATCH_TOKENS, BUCKETS, MAX_LENGTH, pack
from slatemill.llm.mixing import mix, shuffled_place
from slatemill.llm.page_diff import main_text
from slatemill.llm.preference import preference_rows
from slatemill.llm.quality import quality_scores
from slatemill.llm.token_files import token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
END_OF_DOCUMENT = 2


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            # whole texts travel to Python: bound a batch by bytes too
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    return token_files(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_OF_DOCUMENT)


@query("op6_covering_simhash")
def op6_covering_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(table(spark, sf, "documents"))


@query("op4_collision_ann")
def op4_collision_ann(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_hnsw_dedup")
def op7_hnsw_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return cosine_groups(table(spark, sf, "embeddings"))


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIX_SQL = f"""WITH d AS (SELECT doc_id, source, {WORDS_SQL} AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
  w AS (SELECT *, [3.0e0, 1.0e0, 2.0e0][sid % 3 + 1] AS weight, source_size * 2.0e0 AS most FROM s),
  r AS (SELECT *, sum(most) OVER a AS full_, coalesce(sum(weight) OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0e0) AS open_, sum(source_size) OVER () * 1.5e0 AS spend, most / weight AS ratio FROM w WINDOW a AS (ORDER BY most / weight, sid)),
  f AS (SELECT *, full_ + ratio * open_ <= spend AS fits FROM r),
  l AS (SELECT (any_value(spend) - coalesce(max(full_) FILTER (fits), 0.0e0)) / nullif(sum(weight) FILTER (NOT fits), 0) AS level FROM f),
  t AS (SELECT source, source_size, CASE WHEN fits THEN most ELSE least(most, level * weight) END AS target FROM f, l),
  p AS (SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS quota, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY {shuffled_place('doc_id', 7)}, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS pos
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
  SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(greatest(0, least(pos + size, quota) - pos) + greatest(0, least(pos + source_size + size, quota) - pos - source_size) AS BIGINT) AS taken FROM p"""


def _buckets_sql() -> str:
    """Rounds of the dynamic programme as one common table each, then the bounds from the last round back."""
    rounds = ["c0 AS (SELECT j, CASE WHEN j = 0 THEN 0 ELSE 1000000000000000 END AS cost, -1 AS cut FROM h)"]
    for k in range(1, BUCKETS + 1):
        rounds.append(f"""c{k} AS (SELECT h.j, least(o.cost, coalesce(b.cost, 1000000000000000)) AS cost, CASE WHEN b.cost < o.cost THEN b.cut ELSE -1 END AS cut
    FROM h JOIN c{k - 1} o USING (j) LEFT JOIN (SELECT y.j, min(c.cost + (y.below - x.below) * y.length) AS cost, arg_min(x.j, (c.cost + (y.below - x.below) * y.length) * 10000 + x.j) AS cut
      FROM h y JOIN h x ON x.j < y.j JOIN c{k - 1} c ON c.j = x.j AND c.cost < 1000000000000000 GROUP BY y.j) b USING (j))""")
    back = [f"b{BUCKETS} AS (SELECT max(j) AS j FROM h)"]
    for k in range(BUCKETS, 0, -1):
        back.append(f"b{k - 1} AS (SELECT CASE WHEN c.cut >= 0 THEN c.cut ELSE b.j END AS j FROM b{k} b JOIN c{k} c USING (j))")
    ends = " UNION ".join(f"SELECT b.j FROM b{k} b JOIN c{k} c USING (j) WHERE c.cut >= 0" for k in range(1, BUCKETS + 1))
    return ",\n  ".join([*rounds, *back, f"bounds AS (SELECT length AS bucket_length, row_number() OVER (ORDER BY length) AS bucket FROM h JOIN ({ends}) e USING (j))"])


PACK_SQL = f"""WITH d AS (SELECT doc_id, CAST({WORDS_SQL} AS BIGINT) AS size FROM documents),
  parts AS (SELECT doc_id, part, part * {MAX_LENGTH} AS start, least({MAX_LENGTH}, size - part * {MAX_LENGTH}) AS length FROM (SELECT *, unnest(range(0, greatest(0, (size - 1) // {MAX_LENGTH}) + 1)) AS part FROM d)),
  h AS (SELECT row_number() OVER (ORDER BY length) AS j, length, CAST(sum(n) OVER (ORDER BY length) AS BIGINT) AS below FROM (SELECT length, count(*) AS n FROM parts GROUP BY 1) UNION ALL SELECT 0, 0, 0),
  {_buckets_sql()},
  g AS (SELECT p.*, (SELECT min(bucket_length) FROM bounds WHERE bucket_length >= p.length) AS bucket_length FROM parts p),
  r AS (SELECT g.*, bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, part, length) - 1 AS rank, greatest(1, {BATCH_TOKENS} // greatest(1, bucket_length)) AS room FROM g JOIN bounds USING (bucket_length))
  SELECT doc_id, part, start, length, bucket, bucket_length, rank // room AS batch, rank % room AS slot FROM r"""

PREFERENCE_SQL = """WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY turns[1] ORDER BY conv_id) - 1 AS rk, list_max([CASE WHEN x.role = 'assistant' THEN i END FOR x, i IN turns]) AS last FROM c),
  g AS (SELECT turns[1] AS first, rk // 2 AS pair, min(conv_id) AS chosen_id, max(conv_id) AS rejected_id, count(*) AS n, max(last) AS last FROM k GROUP BY 1, 2),
  a AS (SELECT chosen_id, last, row_number() OVER (ORDER BY chosen_id) - 1 AS rk, count(*) OVER () AS n FROM g WHERE n = 1 AND last IS NOT NULL),
  p AS (SELECT chosen_id, rejected_id, x.turns AS chosen, y.turns AS rejected FROM g JOIN c x ON x.conv_id = chosen_id JOIN c y ON y.conv_id = rejected_id WHERE n = 2
    UNION ALL SELECT a.chosen_id, b.chosen_id, x.turns, list_concat(x.turns[:a.last - 1], [y.turns[b.last]]) FROM a JOIN a b ON b.rk = (a.rk + 1) % a.n AND b.chosen_id <> a.chosen_id JOIN c x ON x.conv_id = a.chosen_id JOIN c y ON y.conv_id = b.chosen_id),
  n AS (SELECT *, least(len(chosen) - 1, len(rejected) - 1, coalesce(list_min([i FOR i IN range(1, least(len(chosen), len(rejected)) + 1) IF chosen[i] <> rejected[i]]) - 1, least(len(chosen), len(rejected)))) AS shared FROM p),
  e AS (SELECT chosen_id, rejected_id, shared, side, i, turn.role AS role, '<|' || turn.role || '|>' || chr(10) || turn.text || '<|end|>' || chr(10) AS piece FROM (
    SELECT chosen_id, rejected_id, shared, side, unnest(ts) AS turn, generate_subscripts(ts, 1) AS i FROM (SELECT chosen_id, rejected_id, shared, 'c' AS side, chosen AS ts FROM n UNION ALL SELECT chosen_id, rejected_id, shared, 'r', rejected FROM n))),
  m AS (SELECT *, i > shared AS rest, sum(length(piece)) OVER (PARTITION BY chosen_id, side, i > shared ORDER BY i) AS stop FROM e),
  o AS (SELECT chosen_id, side, rest, string_agg(piece, '' ORDER BY i) AS body, string_agg((stop - length(piece) + length(role) + 5) || '-' || stop, ',' ORDER BY i) FILTER (role = 'assistant') AS mask FROM m GROUP BY 1, 2, 3)
  SELECT n.chosen_id AS pair_id, n.chosen_id, n.rejected_id, CAST(shared AS BIGINT) AS shared_turns, coalesce(h.body, '') AS prompt, x.body AS chosen, y.body AS rejected, coalesce(x.mask, '') AS chosen_mask, coalesce(y.mask, '') AS rejected_mask, n.chosen = n.rejected AS same
  FROM n LEFT JOIN o h ON h.chosen_id = n.chosen_id AND h.side = 'c' AND NOT h.rest JOIN o x ON x.chosen_id = n.chosen_id AND x.side = 'c' AND x.rest JOIN o y ON y.chosen_id = n.chosen_id AND y.side = 'r' AND y.rest"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_length_buckets", PACK_SQL)
def op10_length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"))


@query("op5_backoff_lm")
def op5_backoff_lm(spark: SparkSession, sf: str) -> DataFrame:
    return backoff_scores(table(spark, sf, "documents"), order=3)


@query("op8_preference", PREFERENCE_SQL)
def op8_preference(spark: SparkSession, sf: str) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias(c)
    rows = preference_rows(table(spark, sf, "conversations"))
    return rows.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


@query("op9_page_diff")
def op9_page_diff(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(spark, sf, "pages"))


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id(table(spark, sf, "documents"))


NEGATIVES_SQL = """WITH e AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  f AS (SELECT * FROM e WHERE len(v) = (SELECT len(v) FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
  s AS (SELECT a.row, a.vec_id AS anchor_id, b.row AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM f a JOIN f b ON a.row <> b.row WHERE a.vec_id % 50 = 0),
  p AS (SELECT row, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other) <= 5),
  n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.row, p.other ORDER BY s.score DESC, s.vec_id, s.other) AS rank
    FROM p JOIN s ON s.row = p.row AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
  SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query("op12_rns_negatives", NEGATIVES_SQL)
def op12_rns_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


# crc32 of the decimal text, bit by bit (reflected polynomial 0xEDB88320)
_CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

TRIE_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns FROM t GROUP BY 1),
  h AS (SELECT *, {_CRC_SQL} % 4 AS h FROM o),
  r AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
  p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r),
  n AS (SELECT d AS depth, turns[:d] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '') AS ends FROM p GROUP BY 1, 2),
  k AS (SELECT n.path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
  c AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * {WORDS_SQL.replace("text", "n.path[depth].text")} END AS saved FROM n LEFT JOIN k ON k.path = n.path),
  a AS (SELECT list_slice(x.path, 1, up) AS path, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM c) x GROUP BY 1)
  SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, sha256(c.ends) AS ends_sha256
  FROM c JOIN a ON a.path = c.path LEFT JOIN n u ON c.depth > 0 AND u.depth = c.depth - 1 AND u.path = c.path[:c.depth - 1]"""


@query("op13_conversation_trie", TRIE_SQL)
def op13_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(table(spark, sf, "conversations"))
