"""The registered queries of the training-data operators, and their SQL where SQL can say it.

Each query runs one operator over its whole table with production parameters
and derives digest columns from the operator's own output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import bpe, collisions, jaccard, licenses, merkle, neighbours, packing, quality, ranking, suffixes, toxicity, tries
from linkloom.llm.common import documents, fold_of, table

#: Tokens in a training sequence.
CONTEXT = 2048


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = merkle.compare_with_edit(documents(spark, sf_dir))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        F.round(merkle.likeness("tree", "edited_tree"), 9).alias("near_edited"),
        F.round(merkle.likeness("tree", "next_tree"), 9).alias("near_next"),
        merkle.first_difference("tree", "edited_tree").alias("first_edit"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.drop_repeats(documents(spark, sf_dir))
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_documents(documents(spark, sf_dir)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


#: A document is predicted to have label 1 from this score on.
ACCEPT = 0.7


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "quality", fold_of("doc_id", 4) != 2)
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "toxic", fold_of("doc_id", 3) != 1)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), CONTEXT)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_documents(documents(spark, sf_dir))
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collisions.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(tries.rebuilt(tries.paths(table(spark, sf_dir, "conversations"))))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_quality_rules": op2_quality_rules,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pruned_graph_search": op10_pruned_graph_search,
    "op11_collision_counts": op11_collision_counts,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_ranked_search": op13_ranked_search,
}

_TREE = r"""list_transform(regexp_extract_all({0}, '(?s).+?(?:\n\n+|\z)'), lambda s: list_transform(regexp_extract_all(s, '[^\n]*\n|[^\n]+'), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,32}}'), lambda b: md5(b))))"""
_PARAGRAPHS = "list_transform({0}, lambda s: list_transform(s, lambda p: md5('p' || array_to_string(p, ''))))"
_SECTIONS = "list_transform({0}, lambda s: md5('s' || array_to_string(s, '')))"
_DISTINCT = "list_distinct(list_transform(flatten(flatten({0})), lambda b: substr(b, 1, 15)))"
_LIKENESS = "CASE WHEN {0}r = {1}r THEN 1.0 ELSE round(2.0 * len(list_intersect({0}b, {1}b)) / (len({0}b) + len({1}b)), 9) END"
_FIRST = "coalesce(list_filter(range(greatest(coalesce(len({0}), 0), coalesce(len({1}), 0))), lambda i: {0}[i + 1] IS DISTINCT FROM {1}[i + 1])[1], 0)"

OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), n AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM d
), e AS (
  SELECT *, substr(text, 1, n - n // 4) || substr(following, 1, n // 4) AS edited FROM n
), t AS (
  SELECT *, {_TREE.format("text")} AS al, {_TREE.format("edited")} AS bl, {_TREE.format("following")} AS cl FROM e
), p AS (
  SELECT *, {_PARAGRAPHS.format("al")} AS ap, {_PARAGRAPHS.format("bl")} AS bp, {_PARAGRAPHS.format("cl")} AS cp FROM t
), s AS (
  SELECT *, {_SECTIONS.format("ap")} AS sa, {_SECTIONS.format("bp")} AS sb, {_SECTIONS.format("cp")} AS sc FROM p
), r AS (
  SELECT *, sha256('d' || array_to_string(sa, '')) AS ar, sha256('d' || array_to_string(sb, '')) AS br, sha256('d' || array_to_string(sc, '')) AS cr,
         {_DISTINCT.format("al")} AS ab, {_DISTINCT.format("bl")} AS bb, {_DISTINCT.format("cl")} AS cb, {_FIRST.format("sa", "sb")} AS fs FROM s
), f AS (
  SELECT *, {_FIRST.format("ap[fs + 1]", "bp[fs + 1]")} AS fp FROM r
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, ar AS fingerprint, br AS edited_fingerprint,
       {_LIKENESS.format("a", "b")} AS near_edited, {_LIKENESS.format("a", "c")} AS near_next,
       CASE WHEN ar <> br THEN concat_ws('/', fs, fp, {_FIRST.format("al[fs + 1][fp + 1]", "bl[fs + 1][fp + 1]")}) END AS first_edit
FROM f
"""

OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), n AS (
  SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s
), x AS (
  SELECT doc_id, hash(unnest(s)) AS h FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n >= 75 * (p.n_shingles + q.n_shingles - n)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT n.doc_id, n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id
"""

OP11_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM e JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
"""

OP12_SQL = """
WITH t AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS p,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT)))) % 9 AS h
  FROM t GROUP BY conv_id
), b AS (
  SELECT c.conv_id, list_concat(coalesce(f.p[1:c.h], []), c.p[c.h + 1:]) AS p FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % 5
), x AS (
  SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM b
), y AS (
  SELECT conv_id, d, array_to_string(list_transform(p[1:d], lambda s: s.k), '') AS key, CASE WHEN d > 0 THEN p[d].w ELSE 0 END AS w, d = len(p) AS ended FROM x
), n AS (
  SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM y GROUP BY key, d
), k AS (
  SELECT substr(key, 1, length(key) - 32) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), u AS (
  SELECT n.key, n.own, k.key IS NULL AS leaf, unnest(range(0, n.depth + 1)) AS a FROM n LEFT JOIN k ON k.key = n.key
), s AS (
  SELECT substr(key, 1, 32 * a) AS key, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM u GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.key = n.key LEFT JOIN k ON k.key = n.key LEFT JOIN n p ON n.depth > 0 AND p.key = substr(n.key, 1, length(n.key) - 32)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), t AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term
), q AS (
  SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), r AS (
  SELECT item_id, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 20
"""

#: Subword merging and fitted models are not relational computations; their tests compare with libraries and held-out rows.
SQL: dict[str, str] = {
    "op3_merkle_fingerprints": OP3_SQL,
    "op5_license_scan": licenses.sql(),
    "op9_jaccard_join": OP9_SQL,
    "op11_collision_counts": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
