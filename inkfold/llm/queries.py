"""The corpus operators' queries, each over its whole table, and the pipeline over documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from inkfold.llm import decontaminate, exact_dedup, language_id, lexical, line_dedup, lm_scoring, packing, pii, quality, sharding, simhash, substring, vector_codes
from inkfold.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), emit_ids=False)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.link(table(spark, sf_dir, "documents")).drop("tag")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), emit_text=False)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: counts differ by one at most, so a larger number of shards moves rows between old ones too."""
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one that stays of those with its text."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's code of four bytes, with its error and its label's."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_packing, op3_pii, op4_line_dedup, op5_lm_scoring, op6_quality, op7_simhash, op8_decontamination, op9_substring_dedup, op10_sharding, op11_lexical_search, op12_exact_dedup, op13_vector_codes)}
QUERIES["pipeline"] = corpus_pipeline.run

def _codes_sql() -> str:
    """The rounds of op13, one after another: squared distances to all entries, and floored means."""
    steps = ["""ints AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT r, vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM ints, (SELECT unnest(range(4)) AS p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, r) - 1 AS e, x FROM parts QUALIFY e < 256)"]
    square = "CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) AS BIGINT)"
    for k in range(5):
        steps.append(f"near{k} AS MATERIALIZED (SELECT a.r, p, any_value(a.x) AS x, min({{'d': {square}, 'e': b.e}}) AS best FROM parts a JOIN b{k} b USING (p) GROUP BY a.r, p)")
        if k < 4:
            steps.append(f"cells{k} AS (SELECT p, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS c FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY ALL)")
            steps.append(f"means{k} AS (SELECT p, e, list(c ORDER BY i) AS x FROM cells{k} GROUP BY ALL)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN means{k} m USING (p, e))")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b4) AS codebooks_sha256 FROM coded JOIN ints USING (r)"""


#: Weights, 64-bit hashes and online orders aren't SQL, and an edit distance over characters isn't DuckDB's: there,
#: brute-force tests stand in.
ORACLES: dict[str, str] = {
    "op9_substring_dedup": r"""
WITH texts AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS content FROM starts),
firsts AS (SELECT content, min(doc_id) AS first_id FROM windows GROUP BY content),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM windows JOIN firsts USING (content) WHERE doc_id > first_id),
each AS (SELECT doc_id, words[j] AS word, j FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS j FROM texts)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS left_over, count(*) AS n_kept FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)""",
    "op11_lexical_search": rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY 1),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 50""",
    "op12_exact_dedup": r"""
WITH texts AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER best = 1 AS kept, text_sha256
FROM texts WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""",
    "op13_vector_codes": _codes_sql(),
}
