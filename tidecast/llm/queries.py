"""Registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import bpe, kmtree, knnjoin, licenses, neardup, packing, ranked, secrets, spelling, substrings, tokenfile, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.search(table(spark, sf_dir, "embeddings"))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    # only the id passes through the scoring tasks next to the text
    scored = toxicity.score(docs.select("doc_id", "text"), machine, keep=["doc_id"])
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op7_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knnjoin.search(table(spark, sf_dir, "embeddings"))


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # words of a text from which nothing went may still stand apart by any white space
    gaps = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return cleaned.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
        F.sha2(F.trim(gaps).cast("binary"), 256).alias("kept_sha256"),
    )


def op9_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat(F.col("places.label"), F.col("spans.label"))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.covered"), F.lit(0.0))).alias("score"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op11_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read(spark, folder, with_ids=False)


QUERIES = {
    "op1_url_templates": op1_url_templates,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_kmeans_tree": op3_kmeans_tree,
    "op4_hilbert_packing": op4_hilbert_packing,
    "op5_factorization_machine": op5_factorization_machine,
    "op6_lsh_forest": op6_lsh_forest,
    "op7_voronoi_join": op7_voronoi_join,
    "op8_fm_index": op8_fm_index,
    "op9_license_automaton": op9_license_automaton,
    "op10_secret_scan": op10_secret_scan,
    "op11_presence_masks": op11_presence_masks,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_bit_packing": op13_bit_packing,
}

# Plain SQL of the operators that have one: all pairs or all windows, for small tables.
ORACLES: dict[str, str] = {
    "op6_lsh_forest": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), places AS (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM places
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op7_voronoi_join": """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
""",
    "op8_fm_index": r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50
), windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM starts
), firsts AS (
    SELECT k, min(doc_id) AS lowest FROM windows GROUP BY k
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
    FROM windows JOIN firsts USING (k) WHERE lowest < doc_id
), cells AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
    SELECT c.doc_id, string_agg(word, ' ' ORDER BY c.p) AS t
    FROM cells c ANTI JOIN gone g ON g.doc_id = c.doc_id AND g.p = c.p GROUP BY c.doc_id
), removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)
""",
    "op11_presence_masks": r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), wanted AS (
    SELECT item_id, t, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
    GROUP BY item_id, t
), lengths AS (
    SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), counts AS (
    SELECT doc_id, t, count(*) AS tf FROM terms WHERE t IN (SELECT t FROM wanted) GROUP BY doc_id, t
), weights AS (
    SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT t, count(*) AS df FROM counts GROUP BY t), totals
), worth AS (
    SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS v
    FROM counts JOIN lengths USING (doc_id) JOIN weights USING (t), totals
), scores AS (
    SELECT item_id, doc_id, CAST(sum(repeats * v) AS BIGINT) AS score FROM worth JOIN wanted USING (t) GROUP BY item_id, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
""",
}
