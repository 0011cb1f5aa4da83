"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables."""

def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _urn(expr: str) -> str:
    h = f"sha256({expr})"
    return f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"


def _text() -> str:
    """Text of the tables' pages, whose markup is plain: no nested quotes, and references of a few kinds."""
    out = "regexp_replace(replace(payload, chr(10), ' '), '<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'g')"
    out = f"regexp_replace({out}, '</?(?:p|div|br|li|ul|h1|nav|footer|article|title|head|body|html)(?: [^>]*)?>', chr(10), 'g')"
    out = f"regexp_replace(regexp_replace({out}, '<!?[a-zA-Z/][^>]*>', '', 'g'), '[ ' || chr(9) || chr(13) || ']+', ' ', 'g')"
    for name, char in (("&quot;?", '"'), ("&#(39|x27);", "'"), ("&lt;?", "<"), ("&gt;?", ">"), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        out = f"regexp_replace({out}, {_quote(name)}, {_quote(char)}, 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _count(pattern: str) -> str:
    return f"length(regexp_replace(coalesce(text, ''), {_quote(pattern)}, '', 'g'))"


#: Measurements and failure bits of every document, up to the relation f.
_LEDGER = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM w WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n, length(array_to_string(w, '')) AS chars, length(text) - {_count('[#*$%&|<>]')} AS symbols, len(lines) - len(list_distinct(lines)) AS dup, coalesce(cover.n, 0) AS repeated,
      length(text) - {_count('!')} AS shouts, length(text) - {_count('[A-Za-z]|[^' + chr(92) + 'x{0}-' + chr(92) + 'x{BF}]')} AS letters, length(text) - {_count('[A-Z]')} AS capitals,
      len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS near, len(list_distinct(w)) AS distinct_, len(lines) AS lines FROM w LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, (n < 20)::BIGINT + 2 * (100 * repeated > 30 * n)::BIGINT + 4 * (100 * symbols > 25 * n)::BIGINT + 8 * (100 * shouts > 30 * n)::BIGINT + 16 * (n >= 20 AND 100 * capitals > 50 * letters)::BIGINT
      + 32 * (100 * near > 20 * n)::BIGINT + 64 * (n >= 20 AND 1000 * distinct_ < 250 * least(n, 400))::BIGINT + 128 * (lines >= 4 AND 100 * dup > 50 * lines)::BIGINT
      + 256 * (n >= 20 AND (100 * chars < 180 * n OR 100 * chars > 2500 * n))::BIGINT + 512 * (n >= 20 AND 100 * letters < 40 * chars)::BIGINT AS failed FROM m)
"""

#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))))"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, '{_UPPER}', '{_LOWER}')) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM j JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
bi AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, bi.y FROM reach JOIN bi ON bi.x = reach.r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)""",
    "op4_quality_rules": _LEDGER + """SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, repeated::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f""",
    "quality_ablations": _LEDGER + """SELECT rule, count(*) AS rows, sum((failed & bit <> 0)::INT)::BIGINT AS failing, sum((failed = bit)::INT)::BIGINT AS only_failing, sum((failed = 0 OR failed = bit)::INT)::BIGINT AS kept_without
FROM f, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('exclamation', 8), ('capitals', 16), ('same_neighbours', 32), ('few_distinct', 64), ('repeated_lines', 128), ('word_length', 256), ('letters', 512)) AS v(rule, bit)
GROUP BY rule""",
    "op8_warc_derivatives": f"""
WITH r AS (
  SELECT page_id, {_urn("'response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')")} AS refers_to, coalesce(url, '') AS target_uri,
         coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS source_digest
  FROM pages),
d AS (
  SELECT page_id, refers_to, target_uri, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'source-digest: ' || source_digest || chr(13) || chr(10) || 'source-length: ' || strlen(payload) || chr(13) || chr(10)
         || 'source-header: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'source-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
         || 'source-header: Content-Length: ' || strlen(payload) || chr(13) || chr(10) AS block
  FROM r
  UNION ALL
  SELECT page_id, refers_to, target_uri, source_digest, 'conversion', 'text/plain; charset=utf-8', {_text()} FROM r)
SELECT page_id, record_type, {_urn("record_type || '|' || refers_to")} AS record_id, refers_to, target_uri, '1970-01-01T00:00:00Z' AS warc_date, content_type,
       source_digest, block, strlen(block)::BIGINT AS block_length, 'sha256:' || sha256(block) AS block_digest
FROM d""",
    # The tables' pages have one plain article each; general markup is tested on fixtures.
    "op10_html_extract": """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(replace(a, '<br>', ' '), '</?(p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS b FROM a),
c AS (SELECT page_id, url, list_transform(b, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&#(39|x27);', '''', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS b FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d""",
    # Equal words of a text at each lag, their unbroken stretches, the least lag of each stretch.
    "op11_periodic_runs": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w, {_CRC} AS h FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 END AS g FROM d),
v AS (SELECT doc_id, n, CASE WHEN g IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) END AS w FROM p),
pos AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM v),
eq AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isl AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM isl GROUP BY doc_id, s, l),
r AS (SELECT doc_id, count(*) AS n_runs, arg_max({{s: s, l: l, q: q}}, [l, -s, -q]) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
