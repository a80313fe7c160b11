"""The registered queries of the operators: each applies one to its whole table and gives what its contract asks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillstone.functions.runtime import scratch_path, small_batches, use_utc
from rillstone.llm import (
    bpe, collocations, contamination, fair_mix, minhash_dedup, multiset_hash, quality_gam, rotation_codes, spelling, substring_dedup, token_files, toxicity,
    url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return small_batches(use_utc(spark)).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op6_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return rotation_codes.embedding_duplicates(_table(spark, folder, "embeddings"), threshold=0.95)


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, folder, "documents"), width=5, percent=85)


QUERIES.update({f.__name__: f for f in (op6_embedding_near_dedup, op10_minhash_near_dedup)})


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(_table(spark, folder, "documents"), _vocabulary(), path, end_id=1)
    return token_files.read_documents(spark, path)


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded_digests(_table(spark, folder, "documents"), _vocabulary())


def op9_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    return fair_mix.mix(_table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, repeats=2)


QUERIES.update({f.__name__: f for f in (op4_token_files, op5_bpe, op9_fair_mix)})


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(_table(spark, folder, "pages"), url_rules.RULES)


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.edited_likeness(_table(spark, folder, "documents"))


QUERIES.update({f.__name__: f for f in (op7_url_filters, op8_fingerprints)})


def url_rules_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """What the given rules alone say of each page."""
    return op7_url_filters(spark, folder).select("page_id", "host", "path", "rule")


def edited_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What the fingerprints of edited texts are taken of."""
    return op8_fingerprints(spark, folder).select("doc_id", "n_chars", "edited_sha256")


QUERIES.update({f.__name__: f for f in (url_rules_of_pages, edited_texts)})


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, folder, "labels")))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality_gam.score(docs, quality_gam.learn(docs, _table(spark, folder, "labels")))


QUERIES.update({f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_quality)})


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"), words=3, least=10, within=50, top=2000)


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), size=10)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, folder, "documents"), shortest=5, least=3, every=97, times=2)


QUERIES.update({f.__name__: f for f in (op11_collocations, op12_decontamination, op13_spelling_variants)})

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op11_collocations"] = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array({_LOWER.format('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), sizes AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), spots AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM spots, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), kept AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT lang, k, phrase, a, w, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:k], ' ') AS y
    FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
), scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, c.c,
        (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.x JOIN grams y ON y.lang = c.lang AND y.phrase = c.y
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), around AS (
    SELECT lang, part, max(a) AS longer FROM (
        SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM kept WHERE k = 3
    ) GROUP BY lang, part
), ranked AS (
    SELECT l.lang, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank, l.phrase, a, l.l, l.r, score
    FROM lowest l LEFT JOIN around o ON o.lang = l.lang AND o.part = l.phrase
    WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN sizes s USING (lang) WHERE rank <= 2000
"""

ORACLES["op12_decontamination"] = f"""
WITH items AS (
    SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents
), spots AS (
    SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM docs
), found AS (
    SELECT d.row, d.i, d.k, m.item_id FROM (
        SELECT row, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM spots, (SELECT DISTINCT k FROM item_windows) WHERE i + k - 1 <= len(w)
    ) d JOIN item_windows m ON m.k = d.k AND m.s = d.s
), hits AS (
    SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS j FROM found) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN named USING (row)
"""

ORACLES["op9_fair_mix"] = """
WITH s AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), t AS (
    SELECT *, CAST('0x' || substr(md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))), 1, 15) AS BIGINT) AS ticket FROM s
), b AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s GROUP BY source
), w AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((number - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 2.0::DOUBLE AS most FROM b
), l AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(most) OVER o - most)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
    FROM w WINDOW o AS (ORDER BY most / weight, number)
), targets AS (
    SELECT source, number, source_size, least(most, max(level) OVER () * weight) AS target FROM l
), placed AS (
    SELECT t.*, number, source_size, target,
        sum(size) OVER (PARTITION BY number ORDER BY ticket, doc_id, size ROWS UNBOUNDED PRECEDING) AS ends
    FROM t JOIN targets g ON g.source IS NOT DISTINCT FROM t.source
), copies AS (
    SELECT *, (ends + copy * source_size) / target AS finish FROM placed, (SELECT unnest([0, 1]) AS copy) WHERE size > 0 AND target > 0
), ordered AS (
    SELECT *, sum(size) OVER (ORDER BY finish, number, ticket, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS upto FROM copies
), taken AS (
    SELECT doc_id, ticket, number, sum(size) AS taken FROM ordered WHERE upto <= (SELECT round(sum(target)) FROM targets) GROUP BY ALL
)
SELECT p.doc_id, p.size, source_size, target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN taken k ON k.doc_id = p.doc_id AND k.ticket = p.ticket AND k.number = p.number
"""

_HOST = _LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")

ORACLES["url_rules_of_pages"] = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT unnest(['org/', 'example.org/es/', 'example.org/en/1', 'com/fr/', 'com/de/']) AS rule),
c AS (SELECT rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS q FROM r)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule
FROM p LEFT JOIN c ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id, host, path
"""

ORACLES["edited_texts"] = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS after
    FROM documents WINDOW w AS (ORDER BY doc_id)
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
    sha256(substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2)) AS edited_sha256
FROM d
"""
