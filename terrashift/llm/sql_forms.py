"""SQL of the queries that need more than a few lines of it."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CTEs with one row ``crc_table.l``: the 256 remainders of CRC-32, made from its polynomial.
_CRC_TABLE = """
    crc_steps(i, k, c) AS (
      SELECT i, 0, i FROM range(256) r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
    crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS l FROM crc_steps WHERE k = 8)"""


def _crc(text: str) -> str:
    """Unsigned CRC-32 of an expression's UTF-8 bytes; ``crc_table`` is among the joined tables."""
    hexed = f"hex(encode({text}))"
    octets = f"[('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT for i in range(length({hexed}) // 2)]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])), 4294967295)"


SUBSTRINGS = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    win AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
    firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN firsts USING (s) WHERE f < doc_id),
    all_words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM all_words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    lost AS (SELECT doc_id, COUNT(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

RESAMPLE = rf"""
    WITH RECURSIVE {_CRC_TABLE},
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    f AS (SELECT doc_id, w, COUNT(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
    g AS (SELECT w, COUNT(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY ALL),
    k AS MATERIALIZED (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g), crc_table),
    s AS (SELECT bucket, SUM(n)::BIGINT AS s FROM f JOIN k USING (w) GROUP BY 1),
    t AS (SELECT bucket, SUM(n)::BIGINT AS t FROM g JOIN k USING (w) GROUP BY 1),
    gain AS (
      SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT SUM(s) FROM s)::DOUBLE + 10000)
          / ((s + 1)::DOUBLE * (coalesce((SELECT SUM(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket)),
    weight AS (SELECT doc_id, SUM(n)::BIGINT AS m, floor(SUM(n * gain)::DOUBLE / SUM(n))::BIGINT AS weight FROM f JOIN k USING (w) JOIN gain USING (bucket) GROUP BY 1),
    scored AS (
      SELECT doc_id, len(ws) AS n_words, coalesce(m, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN weight USING (doc_id)),
    ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS r FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT COUNT(*) FROM scored WHERE n_words >= 20) * 10 // 100 THEN r END AS rank FROM ranked
"""

VARIANTS = rf"""
    WITH RECURSIVE {_CRC_TABLE},
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
    g AS (SELECT doc_id, r, COUNT(*) AS n FROM runs GROUP BY ALL),
    h AS MATERIALIZED (SELECT r, n, {_crc("doc_id || ':' || r")} AS h FROM g, crc_table),
    words AS MATERIALIZED (
      SELECT word, SUM(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h)
      WHERE length(word) >= 7 GROUP BY 1 HAVING SUM(n) >= 2),
    del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
      SELECT DISTINCT x.word AS a, y.word AS b, y.n AS b_n FROM del x JOIN del y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
      UNION SELECT DISTINCT x.word, y.word, y.n FROM del x JOIN words y ON x.d = y.word
      UNION SELECT DISTINCT y.word, x.word, x.n FROM del x JOIN words y ON x.d = y.word),
    best AS (SELECT a, COUNT(*) AS n_near, first(b ORDER BY b_n DESC, b) AS b, MAX(b_n) AS b_n FROM near GROUP BY a),
    named AS MATERIALIZED (
      SELECT word, CASE WHEN b_n >= 10 * n THEN b END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 10 * n THEN b_n END AS form_n
      FROM words LEFT JOIN best ON word = a),
    led(word, root) AS (SELECT word, word FROM named UNION ALL SELECT led.word, form FROM led JOIN named ON led.root = named.word WHERE form IS NOT NULL),
    ends AS (SELECT led.word, led.root FROM led JOIN named ON led.root = named.word WHERE form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM named JOIN ends USING (word)
"""
