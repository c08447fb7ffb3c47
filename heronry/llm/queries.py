"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from .chat import op4_chat_format
from .decontaminate import op9_decontamination
from .embed_dedup import op7_embedding_dedup
from .langid import op10_language_id
from .lm_score import op6_lm_scoring
from .mixing import op2_mixing
from .ranked_search import op12_ranked_search
from .repetition import LIMITS, LINE_CHARS, op11_quality_rules
from .simhash import op3_simhash
from .suffix_dedup import op8_suffix_dedup
from .token_alignment import op13_token_alignment
from .warc import op5_warc
from .wrapper import op1_html_extraction

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_chat_format": op4_chat_format,
    "op5_warc": op5_warc,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_quality_rules": op11_quality_rules,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_alignment": op13_token_alignment,
}

#: op4: the template, the escapes and the loss mask, written out.
_CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    sum(length('<turn:' || url_encode(role) || '>') + 1 + length(regexp_replace(text, '(\\|<turn:|</turn>)', '\\\1', 'g')) + length('</turn>') + 1)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""

#: op5: the digest's 40 hexadecimal digits as bits, five at a time as letters.
_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), b AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes,
    array_to_string(list_transform(string_split(sha1(html), ''), lambda x: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', x) - 1) + 1, 4)), '') AS bits FROM p),
    d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
        + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest FROM b),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

#: op6: every count less the row's own.
_SCORES = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x0B]', ' ', 'g'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT r, unnest(ws) AS b, unnest(list_prepend(NULL, ws[:-2])) AS a, len(ws) AS size FROM d WHERE len(ws) > 0),
    c1 AS (SELECT b, count(*) AS n FROM w GROUP BY b), o1 AS (SELECT r, b, count(*) AS o FROM w GROUP BY ALL),
    c2 AS (SELECT a, b, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY ALL), o2 AS (SELECT r, a, b, count(*) AS o FROM w WHERE a IS NOT NULL GROUP BY ALL),
    s2 AS (SELECT a, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY ALL), os AS (SELECT r, a, count(*) AS o FROM w WHERE a IS NOT NULL GROUP BY ALL),
    x AS (SELECT w.r, CASE WHEN c2.n > o2.o THEN ln((c2.n - o2.o) / greatest(s2.n - os.o, 1)) ELSE CASE WHEN w.a IS NULL THEN 0 ELSE ln(0.4) END + ln(greatest(c1.n - o1.o, 1) / greatest((SELECT count(*) FROM w) - w.size, 1)) END AS s
        FROM w JOIN c1 USING (b) JOIN o1 ON o1.r = w.r AND o1.b = w.b LEFT JOIN c2 ON c2.a = w.a AND c2.b = w.b LEFT JOIN o2 ON o2.r = w.r AND o2.a = w.a AND o2.b = w.b LEFT JOIN s2 ON s2.a = w.a LEFT JOIN os ON os.r = w.r AND os.a = w.a),
    y AS (SELECT r, sum(s) AS s FROM x GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s, 0), 6) AS log_score, round(s / nullif(len(ws), 0), 9) AS mean_score FROM d LEFT JOIN y USING (r)"""

#: op7: every pair, and the smallest vector reachable.
_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
    m AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON m.a = vec_id"""

#: op8: every string of 200 bytes of every text, in hexadecimal.
_STRINGS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    b AS (SELECT r, n, j, substr(h, 400 * j + 1, 800) AS ch FROM (SELECT r, h, n, unnest(range(0, n // 200)) AS j FROM d)),
    w AS (SELECT r, 200 * j + k AS i, md5(substr(ch, 2 * k + 1, 400)) AS k FROM (SELECT r, n, j, ch, unnest(range(200)) AS k FROM b) WHERE 200 * j + k <= n - 200),
    s AS (SELECT r, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
    g AS (SELECT r, i, sum(CASE WHEN i - before > 200 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s)),
    c AS (SELECT r, run, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY ALL), p AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS last FROM c),
    q AS (SELECT r, sum(hi - lo) AS removed, count(*) AS spans, string_agg(substr(h, 2 * last + 1, 2 * (lo - last)), '' ORDER BY lo) AS kept, max(hi) AS top FROM p JOIN d USING (r) GROUP BY r)
    SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN q.r IS NULL THEN h ELSE kept || substr(h, 2 * top + 1) END)) AS kept_sha256 FROM d LEFT JOIN q USING (r)"""

#: op11: every window of 5 to 10 words as text, and the words that one held twice covers.
_REPEATS = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
    e AS (SELECT *, {", ".join(f"lead(word, {j}) OVER o AS w{j}" for j in range(1, 10))} FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
    g AS ({" UNION ALL ".join(f"SELECT r, i, length(word) AS chars, {n} AS n, CASE WHEN w{n - 1} IS NOT NULL THEN md5(concat_ws(' ', word, {', '.join(f'w{j}' for j in range(1, n))})) END AS k FROM e" for n in LIMITS)}),
    t AS (SELECT r, i, chars, n, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY r, n, k) > 1 THEN i END AS last FROM g),
    c AS (SELECT r, chars, n, i - max(last) OVER (PARTITION BY r, n ORDER BY i) < n AS inside FROM t),
    s AS (SELECT r, count(*) FILTER (n = 8 AND inside) AS repeated, {", ".join(f"coalesce(sum(chars) FILTER (n = {n} AND inside), 0)::BIGINT AS chars_{n}" for n in LIMITS)} FROM c GROUP BY r),
    l AS (SELECT r, length(line) AS chars, row_number() OVER (PARTITION BY r, line) > 1 AS again FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    m AS (SELECT r, count(*) FILTER (again) AS n_dup_lines, sum(chars) AS line_chars, coalesce(sum(chars) FILTER (again), 0) AS dup_line_chars FROM l GROUP BY r),
    x AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(repeated, 0) AS n_repeat_words,
        coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(chars_{n}, 0) AS chars_{n}" for n in LIMITS)} FROM d LEFT JOIN s USING (r) LEFT JOIN m USING (r)),
    y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {", ".join(f"chars_{n}" for n in LIMITS)},
    NOT base_failed AND dup_line_chars <= {LINE_CHARS} * line_chars AND {" AND ".join(f"chars_{n} <= {share} * word_chars" for n, share in LIMITS.items())} AS kept FROM y"""

#: op12: every document's score for every item.
_RANKS = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    b AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark),
    a AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
    p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) SEMI JOIN b USING (t) GROUP BY ALL),
    f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), a),
    i AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ts) * n_docs) // n_terms))) AS impact FROM p JOIN f USING (t) JOIN d USING (r), a),
    s AS (SELECT q, item_id, r, sum(impact)::BIGINT AS score FROM b JOIN i USING (t) GROUP BY ALL),
    o AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
    SELECT * FROM o WHERE rank <= 50"""

#: The others can't be put in SQL: they are tested against brute force or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": _CHAT,
    "op5_warc": _WARC,
    "op6_lm_scoring": _SCORES,
    "op7_embedding_dedup": _VECTORS,
    "op8_suffix_dedup": _STRINGS,
    "op11_quality_rules": _REPEATS,
    "op12_ranked_search": _RANKS,
}
