"""DuckDB SQL of the operators that SQL can express, over the same tables.

The others have none: fingerprints need XXH64, tokens a merge table, and scores a fitted model. Those are
tested against the libraries, brute force or held-out rows in ``tests/llm``.
"""

#: A-Z to a-z and nothing else, then the words.
_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLES = {
    "op3_exact_dedup": r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
  g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM n)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op10_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  i AS (SELECT item_id, row_number() OVER () AS r, w, least(10, len(w)) AS size
    FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
  wins AS (SELECT item_id, r, j, size, array_to_string(w[j:j + size - 1], ' ') AS k
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS j FROM i)),
  sizes AS (SELECT DISTINCT size FROM i),
  places AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS k
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
  hits AS (SELECT doc_id, p, size, item_id, r, j FROM places JOIN wins USING (k, size)),
  marked AS (SELECT DISTINCT doc_id, p + o AS place FROM (
    SELECT doc_id, p, unnest(range(0, size)) AS o FROM (SELECT DISTINCT doc_id, p, size FROM hits))),
  runs AS (SELECT doc_id, size + count(*) - 1 AS n FROM (
    SELECT doc_id, size, r, p - j AS shift, p - row_number() OVER (PARTITION BY doc_id, r, p - j ORDER BY p) AS island
    FROM hits) GROUP BY doc_id, size, r, shift, island),
  longest AS (SELECT doc_id, max(n) AS longest FROM runs GROUP BY doc_id),
  stretch AS (SELECT doc_id, n_hit, longest FROM (SELECT doc_id, count(*) AS n_hit FROM marked GROUP BY doc_id) JOIN longest USING (doc_id)),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
  FROM d LEFT JOIN stretch USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
