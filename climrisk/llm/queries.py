"""The operators and the pipeline as registered queries, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climrisk.llm import decontaminate, hardnegatives, jaccard, lengths, lines, merkle, mixing, packing, quality, substrings, suffixarray, toxicity, vafile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


_SQL_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op8_benchmark_decontamination",
    f"""
    WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
    b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS gram
          FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p
                FROM (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
    t AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS gram
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
                FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
    h AS (SELECT doc_id, p, k, item_id FROM t JOIN g USING (k, gram)),
    c AS (SELECT doc_id, count(DISTINCT q) AS n_hit
          FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
    """,
)
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    marked = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query(
    "op5_exact_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
               FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
          FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op5_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return vafile.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64)


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), limit=4096, end=1)


@query("op3_quality_neighbours")
def op3_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"), threshold=0.3)


@query("op4_toxicity_compression")
def op4_toxicity_compression(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"), threshold=0.5)


@query(
    "op7_substring_dedup",
    """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    t AS (SELECT doc_id, p, hash(w[p:p + 12]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
    f AS (SELECT g, min(doc_id) AS first FROM t GROUP BY g),
    c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM t JOIN f USING (g) WHERE first < doc_id),
    r AS (SELECT doc_id, count(*) AS n, list(q) AS q FROM c GROUP BY doc_id),
    k AS (SELECT doc_id, string_agg(w[q], ' ' ORDER BY q) AS kept
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d) a ANTI JOIN c USING (doc_id, q)
          GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
)
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.deduplicate(_table(spark, folder, "documents"), width=13)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffixarray.deduplicate(_table(spark, folder, "documents"), width=400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    "op10_ngram_jaccard_join",
    """
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(w[p:p + k - 1], k) AS g
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
                FROM (SELECT *, least(5, len(w)) AS k FROM d WHERE len(w) > 0))),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY 1, 2),
    e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
    r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
    SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
    FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) USING (doc_id)
    """,
)
def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(_table(spark, folder, "documents"), words_each=5, percent=80)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.with_suffix_sums(lengths.histogram(_table(spark, folder, "documents")))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.deduplicate(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: crc32 (reflected polynomial EDB88320) of the decimal doc_id, bit by bit.
_SQL_CRC = """xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                 lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
_SQL_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_SQL_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


@query(
    "op11_merkle_manifest",
    f"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS row, doc_id, lang, {_sql_leaf("text")} AS leaf,
               CASE WHEN {_SQL_CRC} % 3 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
        FROM documents),
    n AS (SELECT *, {_SQL_PART.format("lang")} AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                 count(*) OVER (PARTITION BY lang) AS width FROM d),
    t AS (SELECT tree, 0 AS level, i, leaf AS h, width FROM n
          UNION ALL
          SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(width) + 7) // 8 FROM t WHERE width > 1 GROUP BY tree, level, i // 8),
    r AS (SELECT k.tree, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS width
          FROM (SELECT DISTINCT tree, lang FROM n) k JOIN t ON t.tree = k.tree AND t.width = 1),
    u AS (SELECT 0 AS level, i, subroot AS h, width FROM r
          UNION ALL
          SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(width) + 7) // 8 FROM u WHERE width > 1 GROUP BY level, i // 8),
    below AS (SELECT row, level AS step, i // CAST(pow(8, level) AS BIGINT) AS own, tree FROM n JOIN (SELECT DISTINCT tree, level FROM t WHERE width > 1) USING (tree)),
    above AS (SELECT row, a.level + (SELECT max(level) FROM t x WHERE x.tree = n.tree) AS step, a.level, r.i // CAST(pow(8, a.level) AS BIGINT) AS own
              FROM n JOIN r USING (tree), (SELECT DISTINCT level FROM u WHERE width > 1) a),
    run AS (
        SELECT row, step, coalesce(string_agg(h, '' ORDER BY t.i) FILTER (t.i < own), '') AS l, coalesce(string_agg(h, '' ORDER BY t.i) FILTER (t.i > own), '') AS g
        FROM below b JOIN t ON t.tree = b.tree AND t.level = b.step AND t.i // 8 = own // 8 GROUP BY row, step
        UNION ALL
        SELECT row, step, coalesce(string_agg(h, '' ORDER BY u.i) FILTER (u.i < own), ''), coalesce(string_agg(h, '' ORDER BY u.i) FILTER (u.i > own), '')
        FROM above a JOIN u ON u.level = a.level AND u.i // 8 = own // 8 GROUP BY row, step),
    f AS (SELECT row, 0 AS step, coalesce(changed, leaf) AS h FROM n
          UNION ALL SELECT f.row, f.step + 1, sha256(l || h || g) FROM f JOIN run ON run.row = f.row AND run.step = f.step),
    p AS (SELECT row, string_agg(l || g, '' ORDER BY step) AS proof FROM run GROUP BY row),
    e AS (SELECT row, arg_max(h, step) AS folded FROM f GROUP BY row)
    SELECT doc_id, leaf, subroot, u.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = u.h AS verified
    FROM n JOIN r USING (tree) JOIN e USING (row) LEFT JOIN p USING (row), (SELECT h FROM u WHERE width = 1) u
    """,
)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.prove(_table(spark, folder, "documents"))


@query("op12_source_mixing")
def op12_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(_table(spark, folder, "documents"))


@query(
    "op13_hard_negatives",
    """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
               FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.e) = len(a.e)),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    r AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
          FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
    """,
)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label, scale=256, k=5)
