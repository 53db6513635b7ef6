"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamis.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


@query("op1_simhash_dedup")
def op1_simhash_dedup(spark, sf_dir):
    from tamis.llm.simhash import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
        SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
            CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
                + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a,
            length(hits[i]) AS n, length(measured[i]) AS m, {least} AS least
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits,
                regexp_extract_all(t, '{pattern}', {group}) AS measured
              FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) s,
            LATERAL (SELECT unnest(generate_series(1, len(hits))) AS i) u"""


def _op2_sql() -> str:
    from tamis.llm.secret_scan import ALL_RULES, RULES

    spans = " UNION ALL ".join(_spans_sql(r.kind, n, r.pattern, r.measured, r.least) for n, r in enumerate(ALL_RULES))
    return f"""
        WITH found AS (SELECT * FROM ({spans}) WHERE m >= least),
        by_doc AS (SELECT doc_id,
            count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) FILTER (rank < {len(RULES)}) AS base,
            string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS spans FROM found GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN by_doc b ON d.doc_id = b.doc_id"""


@query("op2_secret_scan", _op2_sql())
def op2_secret_scan(spark, sf_dir):
    from tamis.llm.secret_scan import ALL_RULES, digest, scan

    return digest(scan(table(spark, sf_dir, "documents"), ALL_RULES), ALL_RULES)


OP3_SQL = """
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
              FROM b WHERE len(w) > 0)),
    hits AS (SELECT doc_id, item_id, i, n FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
                  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)) p JOIN bw USING (n, phrase)),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
    ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id"""


@query("op3_decontaminate", OP3_SQL)
def op3_decontaminate(spark, sf_dir):
    from tamis.llm.decontaminate import decontaminate, digest

    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    from tamis.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


OP7_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


@query("op7_exact_topk", OP7_SQL)
def op7_exact_topk(spark, sf_dir):
    from tamis.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


@query("op8_mixture_packing")
def op8_mixture_packing(spark, sf_dir):
    import public_tokenizers

    from tamis.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), length=2048)


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    from tamis.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    from tamis.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


OP4_SQL = r"""
    WITH all_lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    l AS (SELECT doc_id, i, trim(line, ' ') AS line, len(regexp_extract_all(line, '\S+')) AS words,
            row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM all_lines WHERE trim(line, ' ') <> ''),
    c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY n) AS upto, sum(words) OVER (PARTITION BY doc_id) AS total FROM l),
    e AS (SELECT *, upto - words AS before,
            count(*) OVER (PARTITION BY doc_id ORDER BY upto - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS fwd,
            count(*) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS bwd FROM c),
    r AS (SELECT doc_id, n AS s, fwd AS m FROM e WHERE total - before >= 50
          UNION SELECT doc_id, n - bwd + 1, bwd FROM e WHERE upto >= 50),
    d AS (SELECT doc_id, list(line ORDER BY n) AS ls FROM l GROUP BY doc_id),
    k AS (SELECT r.doc_id, s, m, array_to_string(ls[s:s + m - 1], chr(10)) AS run FROM r JOIN d ON r.doc_id = d.doc_id),
    f AS (SELECT doc_id, s, m, first_value(doc_id) OVER w AS fd, first_value(s) OVER w AS fs FROM k
          WINDOW w AS (PARTITION BY m, run ORDER BY doc_id, s)),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + m - 1)) AS n FROM f WHERE fd <> doc_id OR fs <> s),
    marked AS (SELECT a.doc_id, a.i, a.line, g.n IS NOT NULL AS removed FROM all_lines a
        LEFT JOIN l ON l.doc_id = a.doc_id AND l.i = a.i LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS text_sha256
    FROM marked GROUP BY doc_id"""


@query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark, sf_dir):
    from tamis.llm.line_dedup import digest, without_repeated_lines

    return digest(without_repeated_lines(table(spark, sf_dir, "documents"), min_words=50))


def _op5_sql() -> str:
    from tamis.llm.licenses import RULES, SENTENCES, rule_pattern

    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    every = "|".join(rule_pattern(needs) for needs, _, _ in ordered)
    letters = " ".join(f"WHEN '{s}' THEN '{letter}'" for letter, s in SENTENCES.items())

    def named(which):
        return " ".join(f"WHEN regexp_full_match(m, '{rule_pattern(r[0])}') THEN '{r[which]}'" for r in ordered)

    return rf"""
        WITH s AS (SELECT doc_id, list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)),
                lambda x: CASE trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) {letters} ELSE '' END) AS ids FROM documents),
        i AS (SELECT doc_id, array_to_string(ids, '') AS sentence_ids, regexp_extract_all(array_to_string(ids, ''), '{every}', 0) AS ms FROM s)
        SELECT doc_id, sentence_ids, CAST(len(ms) AS BIGINT) AS n_licenses,
            array_to_string(list_transform(ms, lambda m: CASE {named(1)} END), ',') AS licenses,
            array_to_string(list_sort(list_distinct(list_transform(ms, lambda m: CASE {named(2)} END))), ',') AS classes FROM i"""


@query("op5_license_scan", _op5_sql())
def op5_license_scan(spark, sf_dir):
    from tamis.llm.licenses import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS run
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
    again AS (SELECT run FROM s GROUP BY run HAVING count(*) > 1),
    gone AS (SELECT r, list(DISTINCT n) AS ns
        FROM (SELECT r, unnest(generate_series(i, i + 34)) AS n FROM s JOIN again USING (run)) GROUP BY r),
    k AS (SELECT doc_id, w, coalesce(ns, []) AS ns FROM d LEFT JOIN gone USING (r)),
    l AS (SELECT doc_id, w, ns, list_sort(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(ns, i))) AS stay FROM k)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ns) AS BIGINT) AS n_removed,
        sha256(array_to_string(list_transform(stay, lambda i: w[i]), ' ')) AS kept_sha256 FROM l"""


@query("op13_substring_dedup", OP13_SQL)
def op13_substring_dedup(spark, sf_dir):
    from tamis.llm.substring_dedup import digest, without_repeated_substrings

    return digest(without_repeated_substrings(table(spark, sf_dir, "documents"), window=35))


OP12_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
    t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
    total AS (SELECT count(*) AS rows, coalesce(sum(len(w)), 0)::BIGINT AS words FROM d WHERE len(w) > 0),
    f AS (SELECT term, floor(1000 * ln((2 * rows + 2) / (2 * df + 1)))::BIGINT AS weight
        FROM (SELECT term, count(*) AS df FROM t GROUP BY term), total),
    i AS (SELECT r, doc_id, len(w) AS n, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(w) * rows) // words))) AS part
        FROM t JOIN d USING (r) JOIN f USING (term), total),
    s AS (SELECT item_id, r, doc_id, n, sum(part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, r, doc_id, n HAVING sum(part) > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, n) AS rank FROM s) WHERE rank <= 50"""


@query("op12_ranked_search", OP12_SQL)
def op12_ranked_search(spark, sf_dir):
    from tamis.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    from tamis.llm.periodic_runs import digest, periodic_runs, with_planted_runs

    return digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), min_words=6))
