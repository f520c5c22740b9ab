"""DuckDB SQL for the corpus queries that SQL can express."""

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

SQL = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NORM}) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
    "op4_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op7_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to
        FROM q""",
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM b WHERE len(w) > 0),
        s AS (SELECT DISTINCT n FROM g),
        x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM d, s WHERE len(w) >= n),
        h AS (SELECT x.doc_id, x.pos, x.n, g.item_id FROM x JOIN g ON x.n = g.n AND x.gram = g.gram),
        p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS at FROM h) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
        q AS (SELECT gram, any_value(n) AS n, string_split(gram, ' ') AS x FROM g GROUP BY gram),
        v AS (SELECT gram, unnest(x) AS word, unnest(range(1, n + 1)) AS j FROM q),
        c AS (SELECT word, count(*) AS f FROM t WHERE word IN (SELECT word FROM v) GROUP BY word),
        r AS (SELECT gram, arg_min(v.word, (f, j)) AS word, arg_min(j, (f, j)) AS j FROM v JOIN c USING (word) GROUP BY gram),
        a AS (SELECT DISTINCT gram, doc_id, p - j + k AS spot FROM r JOIN t USING (word), unnest(range(-2, 3)) AS u(k)),
        y AS (SELECT a.gram, a.doc_id, a.spot FROM a JOIN v ON v.gram = a.gram JOIN q ON q.gram = a.gram JOIN t ON t.doc_id = a.doc_id AND t.word = v.word WHERE t.p - a.spot - v.j BETWEEN -2 AND 2 GROUP BY a.gram, a.doc_id, a.spot, q.n HAVING count(DISTINCT v.j) = q.n),
        o AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT y.doc_id, CAST(g.item_id AS VARCHAR) AS item FROM y JOIN g USING (gram)) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(near_items, '') AS near_items
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
        w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM t),
        m AS (SELECT w.part, coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic,
                     MAP {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x),
                          'D': regexp_matches(x, '[#$%&*|]'), 'E': doc_id > min(doc_id) OVER (PARTITION BY x)} AS fails
              FROM w LEFT JOIN (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.id = w.doc_id),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM f p, f q, f r, f s, f u WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5),
        g AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
        e AS (SELECT part, filter_order, step, n, good, toxic, fails[filter_order[step]] AS fail, list_reduce(list_transform(range(1, step), lambda j: fails[filter_order[j]]), lambda a, b: a OR b, FALSE) AS gone,
                     list_reduce(map_values(fails), lambda a, b: a OR b) AND len(list_filter(map_values(fails), lambda z: z)) = 1 AS alone
              FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
        c AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, sum(n) FILTER (WHERE NOT gone AND NOT fail) AS kept, sum(n) FILTER (WHERE fail AND NOT gone) AS removed, sum(n) FILTER (WHERE fail AND gone) AS redundant,
                     sum(n) FILTER (WHERE fail AND alone) AS unique_fails, sum(n) FILTER (WHERE fail AND NOT gone AND good) AS good_lost, sum(n) FILTER (WHERE fail AND NOT gone AND toxic) AS toxic_lost
              FROM e GROUP BY ALL)
        SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
               CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0) AS BIGINT) AS shapley
        FROM c""",
}


# The three kinds of the contract, and three that the method adds: kind, pattern, group whose length counts, least length.
_SECRETS = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ('account', r"""([Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 3),
    ('mixed', r"""[A-Za-z0-9+/]{20,}""", 0, 20),
    ('endpoint', r"""https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+""", 0, 10),
]
_SCOPE = 200


def _secrets_sql() -> str:

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = []
    for o, (kind, pattern, group, least) in enumerate(_SECRETS):
        p = quoted(pattern)
        size = f"length(regexp_extract(m, {p}, {group}))" if group else "length(m)"
        keep = f"{size} >= {least}"
        if kind == "mixed":
            keep += " AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"
        parts.append(f"""
            SELECT doc_id, {o} AS ord, '{kind}' AS kind, stop - length(m) AS start, stop FROM (
                SELECT doc_id, m, sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
                    SELECT doc_id, unnest(x) AS m, unnest(y[1:len(x)]) AS piece, unnest(range(1, len(x) + 1)) AS i FROM (
                        SELECT doc_id, regexp_extract_all(t, {p}) AS x, string_split_regex(t, {p}) AS y FROM d)))
            WHERE {keep}""")
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({" UNION ALL ".join(parts)}),
        w AS (
            SELECT a.doc_id, a.ord, a.kind, a.start, a.stop FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.start <= a.stop + {_SCOPE} AND b.stop >= a.start - {_SCOPE} AND (b.start >= a.stop OR b.stop <= a.start)
            WHERE a.ord >= 3 GROUP BY ALL
            HAVING CASE a.kind WHEN 'account' THEN bool_or(b.kind IN ('assign', 'hex', 'mixed')) WHEN 'mixed' THEN bool_or(b.kind IN ('access', 'account'))
                   ELSE min(b.stop) FILTER (WHERE b.kind IN ('access', 'account')) <= max(b.start) FILTER (WHERE b.kind IN ('assign', 'hex', 'mixed'))
                     OR min(b.stop) FILTER (WHERE b.kind IN ('assign', 'hex', 'mixed')) <= max(b.start) FILTER (WHERE b.kind IN ('access', 'account')) END),
        u AS (SELECT * FROM s WHERE ord < 3 UNION ALL SELECT * FROM w),
        g AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
                     string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base,
                     string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) AS spans
              FROM u GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (doc_id)"""


SQL["op9_secrets"] = _secrets_sql()
