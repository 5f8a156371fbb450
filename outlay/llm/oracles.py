"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from outlay.llm.chat import CONTROL, END, START
from outlay.llm.licenses import ALL, NEEDS, rivals

WORD = r"[^\x20\x09-\x0D]+"

OP9 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM per
), capped AS (
  SELECT *, source_size * 3 / weight AS full_at,
    coalesce(sum(source_size * 3) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS weights
  FROM ranked WINDOW w AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per) - capped)::DOUBLE / ((SELECT sum(weight) FROM ranked) - weights)::DOUBLE AS level FROM capped
), targets AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, (SELECT max(level) FROM levels WHERE level <= full_at) * weight) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, coalesce(t.target, 0.0) AS target,
    CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
    ('0x' || substr(md5('7:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS coin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * least(floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM rated
"""

OP5 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents
), patterns(kind, rank, least, pattern, grp) AS (
  VALUES ('assign', 0, 6, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1),
         ('access', 1, 20, 'AKIA[A-Z0-9]+', 0), ('hex', 2, 24, '[0-9a-f]+', 0), ('bare', 3, 20, '[A-Za-z0-9_+/-]+', 0)
), matched AS (
  SELECT row, kind, rank, least, string_split_regex(text, pattern) AS pieces, regexp_extract_all(text, pattern, 0) AS found,
    CASE WHEN grp = 1 THEN regexp_extract_all(text, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)
      ELSE regexp_extract_all(text, pattern, 0) END AS found_values
  FROM docs, patterns
), each AS (
  SELECT row, kind, rank, least, unnest(pieces[1:len(found)]) AS piece, unnest(found) AS hit, unnest(found_values) AS val, generate_subscripts(found, 1) AS i
  FROM matched WHERE len(found) > 0
), placed AS (
  SELECT row, kind, rank, least, val, hit,
    sum(length(piece)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY row, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM each WINDOW w AS (PARTITION BY row, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), places AS (
  SELECT row, kind, rank, s, s + length(hit) AS e, val,
    regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 8
      AND NOT regexp_matches(val, '(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|test|123456|abcdef') AS live
  FROM placed WHERE length(val) >= least
), owned AS (
  SELECT val, count(DISTINCT source) AS owners FROM places JOIN docs USING (row) WHERE rank < 3 OR live GROUP BY val
), base AS (SELECT * FROM places WHERE rank < 3
), kept AS (
  SELECT p.*, o.owners FROM places p JOIN owned o USING (val)
  WHERE p.rank < 3 OR (p.live AND o.owners <= 1 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = p.row AND b.s < p.e AND p.s < b.e))
), listed AS (
  SELECT row, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 3) AS base,
    count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    count(*) FILTER (live AND owners < 3) AS n_live, count(*) FILTER (owners >= 3) AS n_copied
  FROM kept GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::INT AS n_live, coalesce(n_copied, 0)::INT AS n_copied
FROM docs LEFT JOIN listed USING (row)
"""


def _op8() -> str:
    quoted = lambda t: t.replace("'", "''")
    values = ", ".join(f"('{quoted(k)}', '{quoted(t)}')" for k, t in ALL.items())
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in rivals(ALL))
    needed = " AND ".join(f"(license <> '{k}' OR contains(place, ' {run} '))" for k, runs in NEEDS.items() for run in runs)
    shingles = "list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))"
    return rf"""
WITH templates AS (
  SELECT license, regexp_extract_all(lower(t), '[a-z0-9]+') AS words FROM (VALUES {values}) v(license, t)
), of_template AS (
  SELECT DISTINCT license, len(words) AS m, unnest({shingles}) AS s FROM templates
), sized AS (
  SELECT license, m, count(*) AS n FROM of_template GROUP BY ALL
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents WHERE text IS NOT NULL
), each AS (
  SELECT row, doc_id, unnest({shingles}) AS s, unnest(range(0, len(words) - 4)) AS p FROM docs WHERE len(words) >= 5
), hits AS (
  SELECT row, doc_id, license, m, p, s FROM each JOIN of_template USING (s)
), windows AS (
  SELECT DISTINCT row, license, m, 8 * j AS w_at
  FROM (SELECT row, license, m, p, unnest([p // 8 - 1, p // 8]) AS j FROM hits) WHERE j >= 0 AND p + 5 <= 8 * j + 16
), parts AS (
  SELECT h.doc_id, h.row, w.license, w.m, w.w_at, count(DISTINCT h.s) AS common, min(h.p) AS first_word, max(h.p) + 5 AS end_word
  FROM windows w JOIN hits h ON h.row = w.row AND h.license = w.license AND h.p BETWEEN w.w_at - w.m AND w.w_at + 16 + w.m - 5
  GROUP BY ALL
), placed AS (
  SELECT p.*, common / n AS containment, ' ' || array_to_string(d.words[first_word + 1:end_word], ' ') || ' ' AS place
  FROM parts p JOIN sized USING (license, m) JOIN docs d ON d.row = p.row WHERE common / n >= 0.8
), needed AS (
  SELECT * FROM placed WHERE {needed}
), rivals(license, rival) AS (
  VALUES {pairs}
), kept AS (
  SELECT * FROM needed h WHERE NOT EXISTS (
    SELECT 1 FROM needed o JOIN rivals v ON v.rival = o.license
    WHERE v.license = h.license AND o.row = h.row AND o.first_word < h.end_word AND h.first_word < o.end_word AND o.common > h.common)
), ranked AS (
  SELECT doc_id, license, containment, first_word, end_word,
    row_number() OVER (PARTITION BY doc_id, license ORDER BY common DESC, w_at, first_word DESC, end_word DESC) AS k
  FROM kept
)
SELECT doc_id, license, containment::DOUBLE AS containment, first_word::INT AS first_word, end_word::INT AS end_word FROM ranked WHERE k = 1
"""

OP10 = """
WITH paged AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM paged
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""


def _op4() -> str:
    # a backslash more for each backslash and each control string
    more = lambda c: " + ".join([f"length({c}) - length(replace({c}, '\\', ''))", *[f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in CONTROL]])
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, {len(START) + 1 + len(END)} + length(role) + length(text) + {more("role")} + length(role) - length(replace(role, chr(10), '')) + {more("text")} AS size FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP6 = """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score FROM vectors q JOIN vectors r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang
), each AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM split, (VALUES (1), (2), (3), (4)) s(k) WHERE len(words) >= k
), grams AS (
  SELECT lang, k, phrase, count(*) AS a FROM each GROUP BY ALL HAVING count(*) >= 30
), phrases AS (
  SELECT *, string_split(phrase, ' ') AS words FROM grams WHERE k >= 2
), cuts AS (
  SELECT lang, phrase, k, a, words, unnest(range(1, k)) AS cut FROM phrases
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.cut], ' ')
    JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT p.lang, array_to_string(p.words[s:s + m - 1], ' ') AS phrase, max(p.a) AS longer
  FROM phrases p, (VALUES (2), (3)) sizes(m), (VALUES (1), (2), (3)) starts(s) WHERE m < p.k AND s + m - 1 <= p.k GROUP BY ALL
), ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank
  FROM lowest l LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * l.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": _op4(), "op5_secrets": OP5, "op6_topk": OP6, "op8_licenses": _op8(), "op9_mixing": OP9, "op10_warc": OP10, "op13_phrases": OP13}
