"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, exact_dedup, language_model, lexical, near_dedup, prefix_trie, quality, simhash, substring_dedup, suffix_dedup, token_files, url_filter


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.col("doc_id")
    model = quality.fit(docs, labels.where(~quality.held_out(out, 4, 2)))
    return quality.score(docs, model).select("doc_id", quality.held_out(out, 4, 2).alias("held_out"), "score", "predicted")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rules_of(spark, block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_dir(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.read(spark, path, with_ids=False)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), F.col("doc_id")
    scored = language_model.score(docs, docs.where(~quality.held_out(out, 10, 0)))
    return scored.select("doc_id", quality.held_out(out, 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


_UPPER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_token_files": op6_token_files,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_model": op8_language_model,
    "op9_decontamination": op9_decontamination,
    "op10_bpe": op10_bpe,
    "op11_lexical": op11_lexical,
    "op12_simhash": op12_simhash,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_UPPER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op4_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
        h AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h FROM s),
        f AS (SELECT h, min(doc_id) AS first_id FROM h GROUP BY h),
        g AS (SELECT doc_id, i FROM h JOIN f USING (h) WHERE first_id < doc_id),
        b AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g),
        p AS (SELECT DISTINCT doc_id, unnest(range(greatest(i, coalesce(p + 50, 0)), i + 50)) AS k FROM b),
        r AS (SELECT doc_id, list(k) AS gone FROM p GROUP BY doc_id),
        k AS (SELECT w.doc_id, len(words) AS n, coalesce(len(gone), 0) AS n_removed,
                     CASE WHEN gone IS NULL THEN words
                          ELSE list_transform(list_filter(range(1, len(words) + 1), lambda j: NOT list_contains(gone, j)), lambda j: words[j]) END AS kept
              FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
        SELECT doc_id, n AS n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op5_url_filter": r"""
        WITH p AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r(rule, action, h, q) AS (VALUES
            ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
            ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
        m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
              FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id""",
    "op9_decontamination": r"""
        WITH a AS (
            SELECT 'd' AS side, doc_id AS id, list_filter(string_split(translate(lower(text), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS words FROM documents
            UNION ALL
            SELECT 'i', item_id, list_filter(string_split(translate(lower(text), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') FROM benchmark),
        s AS (SELECT side, id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM a WHERE len(words) > 0),
        t AS (SELECT DISTINCT side, id, array_to_string(words[i:i + 4], ' ') AS s FROM s),
        n AS (SELECT id, count(*) AS n FROM t WHERE side = 'i' GROUP BY id),
        m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM t d JOIN t b ON d.s = b.s AND d.side = 'd' AND b.side = 'i' GROUP BY ALL)
        SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n AS containment FROM m JOIN n ON item_id = id WHERE n_shared >= 0.8 * n""",
    "op11_lexical": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, n_terms AS n, t FROM (
            SELECT doc_id, len(t)::BIGINT AS n_terms, t FROM (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents)) WHERE n_terms > 0),
        f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
        g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_all FROM d),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (SELECT item_id, r, doc_id,
                     sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all))))::BIGINT AS score
              FROM i JOIN df USING (term) JOIN f USING (term) JOIN d USING (r), g GROUP BY ALL),
        k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
