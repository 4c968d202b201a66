"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .collocations import collocations
from .ctw import corpus_scores
from .decontaminate import contamination_report
from .jaccard_join import jaccard_components
from .language_id import fit_languages, identify
from .line_dedup import dedup_lines
from .media import media_digest
from .packing import pack
from .quality import fit_quality, score_quality
from .quality_rules import CAPITALS, MARKS, MEASURES, PRECISION, SPREAD, SYMBOLS, quality_report
from .tokenizing import token_counts
from .url_filters import PATTERNS, judge_urls

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_scores(table(spark, sf_dir, "documents"), depth=7, modulus=7, held_out=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs, modulus=4, held_out=2), modulus=4, held_out=2)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that keep a line, with a digest of what is left of each text."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), modulus=3, held_out=1)
    return score_quality(docs, model, modulus=3, held_out=1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end=0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_report(table(spark, sf_dir, "documents")).select("doc_id", *columns, "level", F.array_join("broken", ",").alias("broken"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=10, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_context_tree, op2_decontamination, op3_language_id, op4_jaccard_join, op5_line_dedup, op6_url_filters, op7_webp_media, op8_token_counts, op9_quality, op10_packing, op11_alignment, op12_quality_rules, op13_collocations, pipeline)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER.format('text')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

_TEXT_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_TEXT_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
_BUCKET = f"((v >> greatest(length(bin(v)) - {PRECISION}, 0)) << greatest(length(bin(v)) - {PRECISION}, 0))"
_FENCES = ", ".join(f"CASE WHEN {m.name} > h['{m.name}']" + (f" OR {m.name} < l['{m.name}']" if m.low else "") + f" THEN '{m.name}' END" for m in MEASURES)

ORACLES: dict[str, str] = {
    "op13_collocations": f"""
        WITH pieces AS (
            SELECT row_number() OVER () AS p, lang, w
            FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w
                FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents))
            WHERE len(w) > 0),
        grams AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k) GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
        cuts AS (
            SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
        rated AS (
            SELECT c.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
            FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.c], ' ') JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.c + 1:], ' ')),
        lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        inner_ AS (SELECT lang, a AS f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM lowest WHERE k = 3),
        kept AS (SELECT * FROM lowest t WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = t.lang AND i.phrase = t.phrase AND 100 * i.f >= 50 * t.a))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op12_quality_rules": f"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {_TEXT_WORDS} AS w, {_TEXT_LINES} AS lines FROM documents),
        windows AS (SELECT r, k, array_to_string(w[k:k + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS k FROM texts WHERE len(w) >= 8)),
        twice AS (SELECT r, k FROM windows SEMI JOIN (SELECT r, s FROM windows GROUP BY ALL HAVING count(*) > 1) USING (r, s)),
        repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 8)) AS p FROM twice) GROUP BY r),
        counts AS (
            SELECT r, doc_id, lang, source, len(w) AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
                length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, length(text) - length(translate(text, '{MARKS}', '')) AS n_marks,
                length(text) - length(translate(text, '{CAPITALS}', '')) AS n_capitals, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM texts LEFT JOIN repeated USING (r)),
        rated AS (
            SELECT *, word_chars * 1000 // greatest(n_words, 1) AS mean_length, n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_marks * 1000 // greatest(n_words, 1) AS marks,
                n_capitals * 1000 // greatest(word_chars, 1) AS capitals, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats,
                n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
            FROM counts),
        tall AS (
            SELECT lang, source, m.name AS measure, m.slack, {_BUCKET} AS bucket
            FROM (SELECT lang, source, m, m.v AS v FROM (SELECT lang, source, unnest([{", ".join(f"{{'name': '{m.name}', 'v': {m.name}::BIGINT, 'slack': {m.slack}}}" for m in MEASURES)}]) AS m FROM rated WHERE NOT base_failed))),
        leveled AS (
            SELECT 'source' AS level, * FROM tall UNION ALL SELECT 'lang', * REPLACE (NULL AS source) FROM tall UNION ALL SELECT 'corpus', * REPLACE (NULL AS lang, NULL AS source) FROM tall),
        bounds AS (
            SELECT level, lang, source, measure, slack, count(*) AS n, quantile_disc(bucket, 0.25) AS lower, quantile_disc(bucket, 0.75) AS upper FROM leveled GROUP BY ALL),
        groups AS (
            SELECT level, lang, source, max(n) AS n, map_from_entries(list((measure, upper + greatest({SPREAD} * (upper - lower), slack)))) AS h,
                map_from_entries(list((measure, lower - greatest({SPREAD} * (upper - lower), slack)))) AS l
            FROM bounds GROUP BY ALL),
        chosen AS (
            SELECT o.lang, o.source, CASE WHEN o.n >= 200 THEN 'source' WHEN g.n >= 200 THEN 'lang' ELSE 'corpus' END AS level,
                CASE WHEN o.n >= 200 THEN o.h WHEN g.n >= 200 THEN g.h ELSE c.h END AS h, CASE WHEN o.n >= 200 THEN o.l WHEN g.n >= 200 THEN g.l ELSE c.l END AS l
            FROM (SELECT * FROM groups WHERE level = 'source') o JOIN (SELECT * FROM groups WHERE level = 'lang') g ON o.lang IS NOT DISTINCT FROM g.lang, (SELECT * FROM groups WHERE level = 'corpus') c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, level, broken
        FROM (SELECT rated.*, level, concat_ws(',', {_FENCES}) AS broken FROM rated LEFT JOIN chosen ON rated.lang IS NOT DISTINCT FROM chosen.lang AND rated.source IS NOT DISTINCT FROM chosen.source)""",
    "op2_decontamination": f"""
        WITH items AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
        windows AS (
            SELECT DISTINCT item_id, len(w[k:k + 9]) AS n, array_to_string(w[k:k + 9], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
        docs AS (SELECT doc_id, coalesce({_WORDS}, []::VARCHAR[]) AS w FROM documents),
        runs AS (
            SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, n, k FROM runs JOIN windows USING (n, s)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op6_url_filters": f"""
        WITH cut AS (
            SELECT page_id, url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, coalesce(url, '') AS url, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*')")} AS host,
                regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
        rules(rule, rule_host, rule_path, action) AS (VALUES
            ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
            ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
        best AS (
            SELECT page_id, url, host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
            FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY ALL)
        SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(lower(url), '{"|".join(PATTERNS)}') THEN 'block' ELSE 'allow' END) AS verdict
        FROM best""",
}
