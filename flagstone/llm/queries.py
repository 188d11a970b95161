"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone.llm import ann, bpe, hard_negatives, langid, line_dedup, mixing, near_dup, passages, prefix_trie, quality, sharding, url_filter, word_bpe
from flagstone.llm.common import read, written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

# Fixed values: the url rules as (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(read(spark, sf_dir, "documents"), RANKS, PATTERN))


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), shards=8)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10))
    return done.select(
        "doc_id",
        F.col("line_dedup.n_lines").alias("n_lines"),
        F.col("line_dedup.n_dropped").alias("n_dropped"),
        F.sha2(F.col("line_dedup.kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.measured(read(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    mixed = mixing.mix_measured(written(rows, "measures"))
    fields = ["topic", "n_tokens", F.round("mix.rate", 6).alias("rate"), "sampled"]
    return mixed.select("doc_id", "source", "lang", *[F.col(f"mix.{c}").alias(c) if isinstance(c, str) else c for c in fields])


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, read(spark, sf_dir, "pages"), URL_RULES)


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by crc32 of the id as text: remainder 0 of 5 is held out of the training."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = langid.train(docs.filter("not held_out").select("text", "lang", "doc_id"), F.xxhash64("doc_id"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op8_super_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op9_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]
    judged = quality.judge(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in fields])


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.near_passages(read(spark, sf_dir, "documents"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_tree_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(read(spark, sf_dir, "documents"), WORD_BPE)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), family=5, longest=8)


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_label_propagation,
        op3_line_dedup,
        op4_raked_mixture,
        op5_url_rules,
        op6_hnsw,
        op7_language_id,
        op8_super_min_hash,
        op9_line_first_quality,
        op10_compact_windows,
        op11_four_russians,
        op12_tree_concatenation,
        op13_prefix_trie,
    )
}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPLIT_WORDS = r"'[^\x20\x09-\x0D]+'"


def any_of(texts: list[str], test: str) -> str:
    """SQL that holds if ``test`` does for one of ``texts``."""
    return " OR ".join(test.format(f"'{t}'") for t in texts)


SQL = {
    "op8_super_min_hash": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), {SPLIT_WORDS}) AS w FROM documents
        ), sets AS (
            SELECT doc_id, len(w) AS n_words, unnest(CASE WHEN len(w) = 0 THEN [NULL] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
        ), shingles AS (
            SELECT DISTINCT doc_id, s FROM sets WHERE s IS NOT NULL
        ), sizes AS (
            SELECT doc_id, count(s) AS n FROM (SELECT DISTINCT doc_id, s FROM sets) GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
        ), links AS (
            SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)
        ), reach(doc_id, r) AS (
            SELECT doc_id, doc_id FROM sizes UNION SELECT reach.doc_id, v FROM reach JOIN links ON r = u
        )
        SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept
        FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op9_line_first_quality": rf"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPLIT_WORDS}) AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS times
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)
        ), repeated AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(5) AS steps(k) WHERE times > 1 GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, line, lower(line) AS low, trim(lower(line), ' ') AS bare, length(line) AS n,
                   length(regexp_replace(line, '[ 	-]', '', 'g')) AS chars
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, {SPLIT_WORDS})
        ), judged AS (
            SELECT doc_id, line, chars,
                   NOT regexp_matches(line, '\p{{L}}')
                   OR n - length(translate(line, '{quality.SYMBOLS}{{}}[]~^=_', '')) > 0.15::DOUBLE * n
                   OR (upper(line) = line AND n - length(replace(line, '!', '')) >= 3)
                   OR regexp_matches(line, '^([ 	-]*[^ 	-|»›·]+([ 	-]+[^ 	-|»›·]+){{0,3}}[ 	-]*[|»›·]){{3,}}')
                   OR {any_of(quality.MENU_WORDS, "bare = {}")}
                   OR {any_of(quality.BOILERPLATE, "contains(low, {})")} AS failed FROM lines
        ), per_doc AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup, sum(chars) AS chars, coalesce(sum(chars) FILTER (failed), 0) AS lost FROM judged GROUP BY doc_id
        ), measured AS (
            SELECT doc_id, len(w) AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^{quality.SYMBOLS}]', '', 'g')) AS n_symbols,
                   coalesce(n_dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
            FROM docs LEFT JOIN per_doc USING (doc_id) LEFT JOIN repeated USING (doc_id)
        )
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= 0.5 * word_chars AS kept
        FROM measured""",
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, pos, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
        ), often AS (
            SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN often.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM lines LEFT JOIN often ON lines.k = often.k GROUP BY doc_id""",
    "op5_url_rules": r"""
        WITH rules(verdict, h, p) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
        )
        SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule,
               coalesce(arg_max(verdict, length(h || p)), 'allow') AS verdict
        FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY page_id, host, path""",
    "op11_four_russians": r"""
        WITH vectors AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM vectors a JOIN vectors b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER best AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER best <= 3""",
    "op13_prefix_trie": r"""
        WITH RECURSIVE ids AS (
            SELECT conv_id AS c, count(*) AS n, conv_id::VARCHAR AS name FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), crc(c, name, read, bits, v) AS (  -- CRC-32, a byte or a bit a step
            SELECT c, name, 0, 8, 4294967295 FROM ids
            UNION ALL
            SELECT c, name, CASE WHEN bits = 8 THEN read + 1 ELSE read END, CASE WHEN bits = 8 THEN 0 ELSE bits + 1 END,
                   CASE WHEN bits = 8 THEN xor(v, ascii(name[read + 1])) WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
            FROM crc WHERE bits < 8 OR read < length(name)
        ), turns AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS place, key, strlen(text) AS bytes
            FROM (SELECT conv_id, turn, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
                  FROM conversations WHERE conv_id IS NOT NULL)
        ), convs AS (
            SELECT ids.c, h, least(h, coalesce(base.n, 0)) AS taken
            FROM ids JOIN (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE bits = 8 AND read = length(name)) USING (c)
            LEFT JOIN ids base ON base.c = ids.c - ids.c % 5
        ), rebuilt AS (
            SELECT c, place - h + taken AS d, key, bytes FROM convs JOIN turns USING (c) WHERE place > h
            UNION ALL SELECT convs.c, place, key, bytes FROM convs JOIN turns ON turns.c = convs.c - convs.c % 5 AND place <= taken
            UNION ALL SELECT c, 0, '', 0 FROM convs
        ), paths AS (
            SELECT c, d, bytes, string_agg(key, ',') OVER (PARTITION BY c ORDER BY d) AS p, max(d) OVER (PARTITION BY c) AS last FROM rebuilt
        ), linked AS (
            SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS q FROM paths
        ), nodes AS (
            SELECT p, any_value(q) AS q, min(c) AS c, any_value(d) AS d, count(*) AS n_convs, any_value(bytes) AS bytes,
                   coalesce(string_agg(c, ',' ORDER BY c) FILTER (d = last), '') AS ends FROM linked GROUP BY p
        ), kids AS (
            SELECT q AS p, count(*) AS n_children FROM nodes WHERE q IS NOT NULL GROUP BY q
        ), below AS (  -- a node counts once, in the row of its smallest member, for all nodes above that row
            SELECT linked.p, sum(CASE WHEN nodes.p IS NULL THEN 0 ELSE (n_convs - 1) * nodes.bytes END) OVER up AS saved,
                   sum(CASE WHEN nodes.p IS NOT NULL AND n_children IS NULL THEN 1 ELSE 0 END) OVER up AS leaves
            FROM linked LEFT JOIN nodes ON nodes.p = linked.p AND nodes.c = linked.c LEFT JOIN kids ON kids.p = nodes.p
            WINDOW up AS (PARTITION BY linked.c ORDER BY linked.d DESC)
        ), sums AS (
            SELECT p, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM below GROUP BY p
        )
        SELECT nodes.c AS conv_id, nodes.d AS depth, above.c AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children,
               n_leaves, saved_tokens, sha256(nodes.ends) AS ends_sha256
        FROM nodes JOIN sums USING (p) LEFT JOIN kids USING (p) LEFT JOIN nodes above ON above.p = nodes.q""",
}


def build_queries() -> dict:
    return dict(QUERIES)


def build_oracles() -> dict[str, str]:
    return dict(SQL)
