"""DuckDB SQL for the queries that SQL can express; tables are views of the same names."""

from __future__ import annotations

from . import license_scan as lic
from . import mixing, ranked_search, resampling

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted('(?m)' + lic.COPYRIGHT_LINE)}, '', 'g')"
    out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for old, new in lic.SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


def license_scan() -> str:
    known = ",\n".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in lic.KNOWN)
    return rf"""
WITH known AS (
  SELECT sha256({_canonical('t')}) AS digest, min(license_id) AS license_id FROM (VALUES {known}) AS k(license_id, t) GROUP BY 1
), texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT DISTINCT doc_id, part FROM (
    SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)))) AS part FROM texts
  ) WHERE regexp_matches(lower(part), '{lic.MARKER}')
), units AS (
  SELECT doc_id, TRUE AS whole, sha256({_canonical('text')}) AS digest FROM texts
  UNION ALL
  SELECT doc_id, FALSE, sha256({_canonical('part')}) FROM parts
)
SELECT doc_id, min(CASE WHEN whole THEN units.digest END) AS text_digest, min(CASE WHEN whole THEN license_id END) AS license,
       coalesce(array_to_string(list_sort(list(DISTINCT license_id) FILTER (WHERE NOT whole AND license_id IS NOT NULL)), ','), '') AS notices
FROM units LEFT JOIN known ON units.digest = known.digest
GROUP BY doc_id"""


INT8_SEARCH = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_reduce(list_transform(q.x, lambda c, i: c * v.x[i]), lambda a, b: a + b)
         / (sqrt(list_reduce(list_transform(q.x, lambda c: c * c), lambda a, b: a + b)) * sqrt(list_reduce(list_transform(v.x, lambda c: c * c), lambda a, b: a + b))) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.x) = len(q.x)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


SUFFIX_DEDUP = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), q AS (  -- pieces of a thousand bytes and the 49 after them: taking a part of a long string costs its length
  SELECT doc_id, c, length(h) // 2 - c AS n, substr(h, 2 * c + 1, 2098) AS piece FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 1000)) AS c FROM b)
), w AS (
  SELECT doc_id, c + j AS i, substr(piece, 2 * j + 1, 2) AS byte, substr(piece, 2 * j + 1, 100) AS s
  FROM (SELECT *, unnest(range(0, least(1000, n))) AS j FROM q)
), f AS (
  SELECT s, min(doc_id) AS first FROM w WHERE length(s) = 100 GROUP BY s
), m AS (
  SELECT w.doc_id, w.i, w.byte, coalesce(f.first < w.doc_id, FALSE) AS starts FROM w LEFT JOIN f ON w.s = f.s AND length(w.s) = 100
), c AS (
  SELECT doc_id, i, byte, max(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m
), e AS (
  SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM c
), r AS (
  SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans,
         sha256(unhex(coalesce(string_agg(CASE WHEN gone = 0 THEN byte END, '' ORDER BY i), ''))) AS kept_sha256
  FROM e GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM b LEFT JOIN r USING (doc_id)"""


JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format('text')} AS words FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda k: array_to_string(words[k:k + 4], ' '))) AS shingle
  FROM w WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 5 * common >= 4 * (x.n + y.n - common)
), reach AS (
  SELECT u, v FROM links
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
)
SELECT d.doc_id, least(d.doc_id, coalesce(c.class_id, d.doc_id)) AS class_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) AS d
LEFT JOIN (SELECT u, min(v) AS class_id FROM reach GROUP BY u) AS c ON c.u = d.doc_id
LEFT JOIN (SELECT u, count(*) AS n_links FROM links GROUP BY u) AS k ON k.u = d.doc_id"""


def _weight(level: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {w}" for n, w in mixing.WEIGHTS.get(level, {}).items())
    return f"CASE {level} {cases} ELSE 1 END" if cases else "1"


def _shared(source: str, parents: str, node: str) -> str:
    """The children of `source` (with budget, weight, capacity) and what each is granted."""
    order = f"PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {node}"
    return f"""
  SELECT *, CASE WHEN is_full THEN capacity ELSE ((rest * upto) // all_open - (rest * (upto - open_weight)) // all_open)::BIGINT END AS granted FROM (
    SELECT *, sum(open_weight) OVER (PARTITION BY {parents}) AS all_open, sum(open_weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM (
      SELECT *, CASE WHEN is_full THEN 0 ELSE weight END AS open_weight, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {parents}) AS rest FROM (
        SELECT *, capacity::HUGEINT * (sum(weight) OVER (PARTITION BY {parents}) - coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          <= weight::HUGEINT * (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
        FROM ({source})
      )
    )
  )"""


def source_mixing() -> str:
    epochs = mixing.MAX_EPOCHS
    number = "right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 18)"
    return rf"""
WITH items AS (
  SELECT doc_id, CASE WHEN {number} = '' THEN 'other' ELSE 'd' || ({number}::BIGINT % 4) END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len({_WORDS.format('text')}) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {epochs} * sum(n_tokens)::BIGINT AS capacity FROM items WHERE n_tokens > 0 GROUP BY ALL
), top AS ({_shared(f"SELECT domain, 0 AS root, capacity, least(total // 5 * 4, {epochs} * total) AS budget, {_weight('domain')} AS weight FROM (SELECT domain, sum(capacity)::BIGINT AS capacity, (SELECT sum(tokens)::BIGINT FROM leaves) AS total FROM leaves GROUP BY domain)", 'root', 'domain')}
), middle AS ({_shared(f"SELECT l.domain, l.lang, l.capacity, top.granted AS budget, {_weight('lang').replace('CASE lang', 'CASE l.lang')} AS weight FROM (SELECT domain, lang, sum(capacity)::BIGINT AS capacity FROM leaves GROUP BY ALL) AS l JOIN top USING (domain)", 'domain', 'lang')}
), leaf AS ({_shared(f"SELECT leaves.*, middle.granted AS budget, {_weight('source')} AS weight FROM leaves JOIN middle USING (domain, lang)", 'domain, lang', 'source')}
), keyed AS (
  SELECT items.*, granted // tokens AS whole, granted % tokens AS left_over,
         md5('{mixing.SEED}|' || (granted // tokens)::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM items JOIN leaf USING (domain, lang, source) WHERE n_tokens > 0
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - sum(n_tokens) OVER (PARTITION BY domain, lang, source, k) AS before FROM keyed
)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(whole + CASE WHEN before < left_over THEN 1 ELSE 0 END))::INTEGER AS epoch FROM placed"""


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{{{80}}}}-\x{{{{10FFFF}}}}]+')"

RANKED_SEARCH = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, {_TERMS.format('text')} AS words FROM documents
), s AS (
  SELECT count(*) FILTER (WHERE len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d
), q AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL
), p AS (
  SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), c AS (
  SELECT p.row_no, p.term, (1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + (25 * len(d.words) * s.n_docs) // s.n_terms)) AS value FROM p JOIN d USING (row_no), s
), r AS (
  SELECT item_id, row_no, sum(times * weight * value)::BIGINT AS score FROM q JOIN w USING (term) JOIN c USING (term) GROUP BY ALL
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score FROM r JOIN d USING (row_no) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {ranked_search.K}"""

#: crc32 of the bytes of `w`, with the table of the reflected polynomial 0xEDB88320 made from its rule.
_CRC_TABLE = "SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))"
_BYTES = "list_transform(range(0, length(hex(encode(w))), 2), lambda k: 16 * (strpos('123456789ABCDEF', hex(encode(w))[k + 1]) )::BIGINT + strpos('123456789ABCDEF', hex(encode(w))[k + 2]))"

RESAMPLING = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, {_TERMS.format('text')} AS words FROM documents
), b AS (
  SELECT unnest({_TERMS.format('text')}) AS w FROM benchmark
), o AS (
  SELECT row_no, unnest(words) AS w FROM d
), v AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket
  FROM (SELECT w FROM o UNION SELECT w FROM b), ({_CRC_TABLE})
), s AS (
  SELECT bucket, count(*)::DOUBLE AS s FROM o JOIN v USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN v USING (w) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {resampling.BUCKETS})) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {resampling.BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), x AS (
  SELECT row_no, sum(gain)::BIGINT AS weight FROM o JOIN v USING (w) JOIN g USING (bucket) GROUP BY row_no
), y AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((concat('0x', sha256(concat('{resampling.SEED}:', doc_id))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN x USING (row_no)
), z AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {resampling.LEAST_TERMS} ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS place,
         count(*) FILTER (WHERE n_features >= {resampling.LEAST_TERMS}) OVER () AS n
  FROM y
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {resampling.LEAST_TERMS} AND place <= {resampling.SHARE[0]} * n // {resampling.SHARE[1]} THEN place END AS rank FROM z"""


ORACLES = {
    "op1_license_scan": license_scan(),
    "op3_int8_search": INT8_SEARCH,
    "op5_suffix_dedup": SUFFIX_DEDUP,
    "op6_jaccard_join": JACCARD_JOIN,
    "op10_source_mixing": source_mixing(),
    "op11_ranked_search": RANKED_SEARCH,
    "op12_resampling": RESAMPLING,
}
