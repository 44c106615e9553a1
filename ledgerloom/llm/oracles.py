"""SQL that gives the rows of the text queries, for DuckDB."""

from __future__ import annotations

from ledgerloom.llm import clustering, hard_negatives, mixing, quality_rules

QUALITY = f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
),
windows AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM texts)
),
repeated AS (
    SELECT doc_id, count(DISTINCT place) AS n
    FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS times FROM windows)
        WHERE times > 1
    )
    GROUP BY doc_id
),
lines AS (
    SELECT doc_id, count(*) AS n, count(DISTINCT line) AS n_distinct
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
    GROUP BY doc_id
),
counted AS (
    SELECT t.doc_id, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(l.n - l.n_distinct, 0)::BIGINT AS n_dup_lines,
        coalesce(l.n, 0)::BIGINT AS n_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda w: lower(w) IN ({", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)})))::BIGINT
            AS n_stop_words,
        length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper
    FROM texts t LEFT JOIN repeated r USING (doc_id) LEFT JOIN lines l USING (doc_id)
),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed
        AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 14
        AND n_symbols / greatest(n_words, 1) <= 0.1
        AND n_stop_words / greatest(n_words, 1) >= 0.02
        AND n_dup_lines / greatest(n_lines, 1) <= 0.5
        AND n_upper / greatest(word_chars, 1) <= 0.5 AS kept,
    n_stop_words, n_upper
FROM judged
"""

MIXING = f"""
WITH RECURSIVE sources AS (
    SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source
),
weighed AS (SELECT *, pow(size, {mixing.ALPHA}) AS weight FROM sources),
rated AS (
    SELECT *, CASE WHEN size > 0 THEN (SELECT sum(size) FROM sources) * {mixing.EPOCHS}
        * (weight / (SELECT sum(weight) FROM weighed)) / size ELSE 0.0 END AS rate
    FROM weighed
),
drawn AS (
    SELECT *, greatest(1, ceil(rate / {mixing.MEAN_OF_DRAW}))::INTEGER AS draws FROM rated
),
terms AS (
    SELECT source, rate, draws, 0 AS k, exp(-rate / draws) AS term, exp(-rate / draws) AS below
    FROM drawn
    UNION ALL
    SELECT source, rate, draws, k + 1, term * (rate / draws) / (k + 1),
        below + term * (rate / draws) / (k + 1)
    FROM terms WHERE k < {mixing.TERMS}
),
laws AS (
    SELECT source, rate, draws, list(below ORDER BY k) AS cumulative FROM terms
    GROUP BY source, rate, draws
),
counted AS (
    SELECT d.*, rate, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cumulative,
        lambda c: c <= ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, 'null:' || md5(coalesce(d.text, ''))) || ':' || j), 1, 13))::BIGINT
            / pow(2, 52)))))::INTEGER AS n_copies
    FROM documents d JOIN laws l ON d.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, source, copy::INTEGER AS copy, n_copies,
    ('0x' || substr(md5('{mixing.SEED + 1}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':' || copy), 1, 15))::BIGINT
        AS shuffle_key, text
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted)
"""

FINITE = """embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _clustering() -> str:
    """One assignment and one move of the centroids per round, as common table expressions."""
    away = "list_sum(list_transform(range(1, 65), lambda i: (r.v[i] - c.v[i]) * (r.v[i] - c.v[i])))"
    steps = [
        f"""rows AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = 64 AND {FINITE}
),
centroids0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY digest) - 1 AS number, v FROM (
        SELECT v, sha256('{clustering.SEED}:' || vec_id) AS digest FROM rows
        ORDER BY digest LIMIT {clustering.CLUSTERS}
    )
)"""
    ]
    for k in range(clustering.ROUNDS + 1):
        steps.append(
            f"""assigned{k} AS MATERIALIZED (
    SELECT vec_id, v, least[2] AS cluster, least[1] AS distance FROM (
        SELECT r.vec_id, any_value(r.v) AS v, min([{away}, c.number]) AS least
        FROM rows r, centroids{k} c GROUP BY r.vec_id
    )
)"""
        )
        if k < clustering.ROUNDS:
            steps.append(
                f"""means{k} AS (
    SELECT cluster, i, (total - ((total % n) + n) % n) // n AS mean FROM (
        SELECT cluster, i, sum(v[i])::BIGINT AS total, count(*) AS n
        FROM (SELECT cluster, v, unnest(range(1, 65)) AS i FROM assigned{k}) GROUP BY cluster, i
    )
),
centroids{k + 1} AS MATERIALIZED (
    SELECT c.number, coalesce(m.v, c.v) AS v FROM centroids{k} c
    LEFT JOIN (SELECT cluster, list(mean ORDER BY i) AS v FROM means{k} GROUP BY cluster) m
        ON c.number = m.cluster
)"""
            )
    last = clustering.ROUNDS
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
    (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM assigned{last} a JOIN centroids{last} c ON a.cluster = c.number
"""
    )


NEGATIVES = f"""
WITH rows AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND {FINITE}
),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS other_id,
        list_dot_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {hard_negatives.POSITIVES}
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
    SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT alike AND {hard_negatives.WINDOW[0]} * positive_score <= 100 * score
        AND 100 * score <= {hard_negatives.WINDOW[1]} * positive_score
) WHERE rank <= {hard_negatives.NEGATIVES}
"""

ORACLES = {
    "op2_quality_rules": QUALITY,
    "op3_mixing": MIXING,
    "op12_clustering": _clustering(),
    "op13_hard_negatives": NEGATIVES,
}
