"""DuckDB SQL for the queries that SQL can express on tables of moderate size.

The others are tested in ``tests/llm`` against plain loops: 3, 4, 5 and 9 need the method's own verdicts, 7 a
hash that SQL hasn't, 6 all strings of 100 bytes, 8 cuts along a hashed order, 11 and 13 need tokenizers, 12 a search.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op1_warc_capture_index": """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS dg FROM pages),
f AS (SELECT *, n >= 100 AND page_id <> min(page_id) OVER (PARTITION BY dg) AS again, min(page_id) OVER (PARTITION BY dg) AS first FROM d)
SELECT page_id, n AS payload_bytes, dg AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM f""",
    "op2_benchmark_decontamination": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 12] AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM bw WHERE len(w) > 0)),
st AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT len(g) AS n FROM win))),
hit AS (SELECT doc_id, i, n, item_id FROM st JOIN win USING (g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT cast(item_id AS varchar))) AS l FROM hit GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(h, 0) AS n_hit, coalesce(len(l), 0) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
  coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(w) AS contaminated FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id""",
    "op10_substring_dedup": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
st AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM dw)),
rep AS (SELECT doc_id, i FROM st WHERE g IN (SELECT g FROM st GROUP BY 1 HAVING count(*) > 1)),
cov AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM rep),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM dw),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM tok ANTI JOIN cov USING (doc_id, p) GROUP BY 1),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM dw LEFT JOIN gone ON gone.doc_id = dw.doc_id LEFT JOIN kept ON kept.doc_id = dw.doc_id""",
}
