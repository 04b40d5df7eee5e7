"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from promptgov.llm.secrets import BASE_KINDS, CANDIDATE, MAX_OWNERS, MAX_REPOSITORIES

NOT_SPACE = r"[^\x20\x09-\x0D]"


def warc() -> str:
    letters = ", ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * i + 1}, 5))::INT >> {s}) % 32 + 1, 1)"
        for i in range(8) for s in (15, 10, 5, 0))
    return f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes, concat({letters}) AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM k"""


def quality() -> str:
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+') AS w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS l
                   FROM documents),
        g AS (SELECT doc_id, i, w[i:i + 4] AS k FROM (
                  SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
        c AS (SELECT doc_id, sum(least(5, j - i))::BIGINT AS n FROM (
                  SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 5) AS j FROM r) GROUP BY doc_id),
        m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
                     length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                     (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
                     coalesce(c.n, 0)::BIGINT AS n_repeat_words
              FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines) AS kept
        FROM b"""


def ownership() -> str:
    quoted = lambda p: p.replace("'", "''")
    kinds = [*BASE_KINDS, ("owned", CANDIDATE, 0, 20)]
    found = " UNION ALL ".join(f"""
        SELECT doc_id, o, lg, {rank} AS rank, '{kind}' AS kind, v[i] AS value,
               (list_sum(list_transform(g[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS s, length(m[i])::INT AS n
        FROM (SELECT doc_id, o, lg, m, v, g, unnest(generate_series(1, len(m))) AS i FROM (
            SELECT doc_id, o, lg, regexp_extract_all(t, '{quoted(p)}', 0) AS m,
                   regexp_extract_all(t, '{quoted(p)}', {group}) AS v, string_split_regex(t, '{quoted(p)}') AS g
            FROM d WHERE regexp_matches(t, '{quoted(p)}'))) WHERE length(v[i]) >= {least}"""
        for rank, (kind, p, group, least) in enumerate(kinds))
    line = "kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank, n"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS o,
                          coalesce('=' || lang, '') AS lg FROM documents),
        f AS ({found}),
        e AS (SELECT * FROM f WHERE rank < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
              AND NOT EXISTS (SELECT 1 FROM f b WHERE b.rank < 3 AND b.doc_id = f.doc_id
                              AND b.s < f.s + f.n AND f.s < b.s + b.n))),
        h AS (SELECT value, count(DISTINCT o) <= {MAX_OWNERS} AND count(DISTINCT (o, lg)) <= {MAX_REPOSITORIES} AS live
              FROM e GROUP BY value),
        x AS (SELECT e.*, live FROM e JOIN h ON h.value = e.value),
        a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1,
                     count(*) FILTER (rank = 2) AS n2, string_agg({line}) FILTER (rank < 3) AS base,
                     string_agg({line}) FILTER (rank < 3 OR live) AS spans,
                     count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM x GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
        FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


def divergence(least: int = 3, top: int = 200) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = "1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY {by}) + v)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
                   FROM documents),
        u AS (SELECT i, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term FROM (SELECT DISTINCT i, lang, term FROM u) GROUP BY ALL HAVING count(*) >= {least}),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM u JOIN k USING (lang, term) GROUP BY ALL),
        f AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, v
              FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (SELECT lang, source, term, n, {share.format(by='lang, source')} AS p FROM f),
        q AS (SELECT lang, term, {share.format(by='lang')} AS q
              FROM (SELECT lang, term, v, sum(n)::HUGEINT AS n FROM f GROUP BY ALL)),
        a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
              FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
              FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
              LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
              UNION ALL
              SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT
              FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM r QUALIFY part = 'pair' OR rank <= {top}"""


def negatives() -> str:
    return """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(
                       embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
                     list_dot_product(a.v, b.v)::BIGINT AS score
              FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor, other AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
        SELECT p.anchor AS anchor_id, positive_id,
               row_number() OVER (PARTITION BY p.anchor, positive_id ORDER BY score DESC, other)::INT AS rank,
               other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.anchor = s.anchor AND NOT same
             AND score * 100 BETWEEN 50 * positive_score AND 95 * positive_score
        QUALIFY rank <= 3"""


def oracles() -> dict[str, str]:
    return {
        "op3_warc": warc(),
        "op7_quality_cascade": quality(),
        "op9_secret_ownership": ownership(),
        "op11_source_divergence": divergence(),
        "op12_hard_negatives": negatives(),
    }
