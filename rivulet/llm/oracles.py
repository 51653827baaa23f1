"""SQL that gives the rows of the corpus queries which SQL can express."""

from __future__ import annotations

import math

from . import licenses, rules

_RULES = r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
        l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
        lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
        g AS (SELECT row, i, list_slice(ws, i, i + 4) AS gram FROM (SELECT row, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
        twice AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, gram) AS n FROM g) WHERE n > 1),
        covered AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY row),
        stats AS (
            SELECT doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM d JOIN w USING (row) LEFT JOIN lines USING (row) LEFT JOIN covered USING (row)),
        judged AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / nullif(n_words, 0) AS symbols_per_word,
                n_dup_lines / nullif(n_lines, 0) AS dup_line_share, word_chars / nullif(n_words, 0) AS mean_word_chars FROM stats),
        m AS (
            SELECT lang, source, 'symbols_per_word' AS measure, symbols_per_word AS v FROM judged WHERE NOT base_failed
            UNION ALL SELECT lang, source, 'dup_line_share', dup_line_share FROM judged WHERE NOT base_failed
            UNION ALL SELECT lang, source, 'mean_word_chars', mean_word_chars FROM judged WHERE NOT base_failed),
        b AS (SELECT lang, source, measure, CASE WHEN v <= 0 THEN -1073741824 ELSE CAST(ceil(ln(v) / {log_gamma}) AS INT) END AS bucket, count(*) AS n FROM m GROUP BY ALL),
        levels AS (
            SELECT 1 AS level, lang, source, measure, bucket, n FROM b
            UNION ALL SELECT 2, lang, NULL, measure, bucket, sum(n) FROM b GROUP BY ALL
            UNION ALL SELECT 3, NULL, NULL, measure, bucket, sum(n) FROM b GROUP BY ALL),
        upto AS (
            SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY level, lang, source, measure) AS rows,
                CASE WHEN bucket = -1073741824 THEN 0 ELSE 2 * pow({gamma}, bucket) / ({gamma} + 1) END AS v FROM levels),
        q AS (SELECT level, lang, source, measure, max(rows) AS rows, min(v) FILTER (c >= 0.25 * rows) AS lo, min(v) FILTER (c >= 0.75 * rows) AS hi FROM upto GROUP BY level, lang, source, measure),
        used AS (
            SELECT o.lang, o.source, o.measure, CASE WHEN o.rows >= {least} THEN o.lo WHEN l.rows >= {least} THEN l.lo ELSE a.lo END AS lo, CASE WHEN o.rows >= {least} THEN o.hi WHEN l.rows >= {least} THEN l.hi ELSE a.hi END AS hi
            FROM q o JOIN q l ON o.level = 1 AND l.level = 2 AND l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure JOIN q a ON a.level = 3 AND a.measure = o.measure),
        cuts AS (
            SELECT lang, source, max(hi + {fence} * greatest(hi - lo, 0.1)) FILTER (measure = 'symbols_per_word') AS max_symbols_per_word, max(hi + {fence} * greatest(hi - lo, 0.1)) FILTER (measure = 'dup_line_share') AS max_dup_line_share,
                max(hi + {fence} * greatest(hi - lo, 1.0)) FILTER (measure = 'mean_word_chars') AS max_mean_word_chars, max(lo - {fence} * greatest(hi - lo, 1.0)) FILTER (measure = 'mean_word_chars') AS min_mean_word_chars
            FROM used GROUP BY lang, source)
        SELECT j.doc_id, j.lang, j.source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND coalesce(symbols_per_word <= max_symbols_per_word, true) AND coalesce(dup_line_share <= max_dup_line_share, true)
                AND coalesce(mean_word_chars <= max_mean_word_chars, true) AND coalesce(mean_word_chars >= min_mean_word_chars, true) AS kept
        FROM judged j LEFT JOIN cuts c ON c.lang IS NOT DISTINCT FROM j.lang AND c.source IS NOT DISTINCT FROM j.source
""".format(gamma=repr(rules._GAMMA), log_gamma=repr(math.log(rules._GAMMA)), least=rules.LEAST_ROWS, fence=rules.FENCE)


def _scan() -> str:
    quoted = ",\n            ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in licenses.TEMPLATES.items())
    return rf"""
        WITH t(template, text) AS (VALUES {quoted}),
        tw AS (SELECT template, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM t),
        ts AS (SELECT DISTINCT template, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle FROM (SELECT template, ws, unnest(range(1, len(ws) - 3)) AS i FROM tw)),
        size AS (SELECT template, count(*) AS n, pow(2, ceil(log2(count(*)))) AS scale FROM ts GROUP BY template),
        dw AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
        ds AS (SELECT row, doc_id, i - 1 AS pos, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle FROM (SELECT row, doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM dw)),
        held AS (SELECT row, doc_id, template, shingle, n, pos, coalesce(pos - lag(pos) OVER (PARTITION BY row, template ORDER BY pos) > 2 * scale, true) AS apart FROM ds JOIN ts USING (shingle) JOIN size USING (template)),
        parts AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY row, template ORDER BY pos) AS part FROM held),
        counted AS (SELECT row, template, part, count(DISTINCT shingle) AS size, min(pos) AS low, max(pos) AS high FROM parts GROUP BY ALL),
        fullest AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY row, template ORDER BY size DESC, low, high DESC) = 1),
        matched AS (SELECT row, doc_id, template, count(DISTINCT shingle) / n AS containment FROM held GROUP BY row, doc_id, template, n HAVING count(DISTINCT shingle) >= {licenses.CONTAINMENT} * n),
        placed AS (SELECT m.*, CAST(low AS INT) AS first_word, CAST(high + 4 AS INT) AS last_word FROM matched m JOIN fullest USING (row, template))
        SELECT doc_id, template, containment, first_word, last_word FROM placed m
        WHERE NOT EXISTS (SELECT 1 FROM placed n WHERE n.row = m.row AND n.containment > m.containment AND n.first_word <= m.last_word AND m.first_word <= n.last_word)
    """


_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op12_phrases": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_CAPITALS}) AS text FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        grams AS (SELECT lang, len(ws) AS size, k, unnest([array_to_string(list_slice(ws, i, i + k - 1), ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM ws, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(ws) >= k),
        f AS (SELECT lang, k AS m, phrase, count(*) AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
        candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
        cuts AS (SELECT *, array_to_string(list_slice(ws, 1, k), ' ') AS first, array_to_string(list_slice(ws, k + 1, m), ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
        priced AS (SELECT c.lang, c.phrase, a, c.m, k, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN total USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = first JOIN f y ON y.lang = c.lang AND y.phrase = rest),
        best AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        starts AS (SELECT *, unnest(range(1, m)) AS i FROM candidates),
        spans AS (SELECT lang, a, unnest([array_to_string(list_slice(ws, i, j), ' ') FOR j IN range(i + 1, m + 1) IF j - i + 1 < m]) AS phrase FROM starts),
        covered AS (SELECT DISTINCT s.lang, s.phrase FROM spans s JOIN candidates c USING (lang, phrase) WHERE 100 * s.a >= 100 * c.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM best ANTI JOIN covered USING (lang, phrase) QUALIFY rank <= 2000
    """,
    "op13_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_CAPITALS}) AS text FROM documents),
        words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
        v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
        counts AS (SELECT w.lang, source, term, count(*) AS c FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
        sums AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
        groups AS (SELECT g.*, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sums USING (lang, source)),
        shares AS (SELECT lang, source, term, coalesce(x.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(x.c, 0) + 5)) // (g.n + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.c + 5)) // (v.n + 5 * v)::HUGEINT AS q
            FROM groups g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN counts x USING (lang, source, term)),
        sides AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sides s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        found AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found
        QUALIFY part = 'pair' OR rank <= 50
    """,
    "op9_license_scan": _scan(),
    "op8_chat_quotes": r"""
        WITH RECURSIVE source AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text, row_number() OVER () AS row FROM conversations),
        cut AS (SELECT row, conv_id, turn, unnest(range(0, len(ls))) AS number, unnest(ls) AS raw FROM (SELECT *, string_split(text, chr(10)) AS ls FROM source)),
        marked AS (SELECT *, regexp_extract(raw, '^(?:[ \t]{0,3}>)+[ \t]?') AS mark FROM cut),
        lines AS (SELECT row, conv_id, turn, number, raw, mark, length(regexp_replace(mark, '[^>]', '', 'g')) AS level, trim(regexp_replace(lower(substr(raw, length(mark) + 1)), '[^\p{L}\p{N}]+', ' ', 'g')) AS line FROM marked),
        texts AS (SELECT row, regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY number) FILTER (mark = ''), ''), '^\s+|\s+$', '', 'g') AS own FROM lines GROUP BY row),
        filled AS (SELECT *, coalesce(lag(level) OVER w <> level OR lag(number) OVER w + 1 <> number, true) AS new FROM lines WHERE line <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL WINDOW w AS (PARTITION BY row ORDER BY number)),
        runs AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY row ORDER BY number) AS run FROM filled),
        passages AS (SELECT row, conv_id, turn, run, level, list(line ORDER BY number) AS ls FROM runs GROUP BY ALL),
        quoted AS (SELECT conv_id, turn, level, len(ls) AS m, array_to_string(ls, ' ') AS said FROM passages WHERE level > 0),
        said AS (
            SELECT conv_id, turn, array_to_string(ls, ' ') AS said FROM passages WHERE level = 0
            UNION ALL SELECT conv_id, turn, array_to_string(list_slice(ls, i, i + m - 1), ' ') FROM (SELECT p.*, m, unnest(range(1, len(ls) - m + 2)) AS i FROM passages p JOIN (SELECT DISTINCT conv_id, m FROM quoted) USING (conv_id) WHERE level = 0 AND m < len(ls))),
        firsts AS (SELECT conv_id, said, min(turn) AS original FROM said GROUP BY ALL),
        links AS (SELECT conv_id, turn, level, original FROM quoted JOIN firsts USING (conv_id, said) WHERE original < turn),
        parents AS (SELECT conv_id, turn, max(original) AS parent FROM links l WHERE level = (SELECT min(level) FROM links k WHERE k.conv_id = l.conv_id AND k.turn = l.turn) GROUP BY ALL),
        up AS (
            SELECT conv_id, turn, parent AS thread, 1 AS depth FROM parents
            UNION ALL SELECT u.conv_id, u.turn, p.parent, u.depth + 1 FROM up u JOIN parents p ON p.conv_id = u.conv_id AND p.turn = u.thread),
        traced AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM up GROUP BY ALL),
        messages AS (SELECT s.conv_id, s.turn, coalesce(t.thread, s.turn) AS thread, coalesce(t.depth, 0) AS depth FROM (SELECT DISTINCT conv_id, turn FROM source WHERE conv_id IS NOT NULL AND turn IS NOT NULL) s LEFT JOIN traced t USING (conv_id, turn)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) - 1 AS place FROM messages),
        n_quotes AS (SELECT conv_id, turn, count(*) AS n_quotes FROM quoted GROUP BY ALL),
        n_linked AS (SELECT conv_id, turn, count(*) AS n_linked FROM links GROUP BY ALL)
        SELECT s.conv_id, place, s.turn, role, own AS text, parent, coalesce(thread, s.turn) AS thread, coalesce(depth, 0) AS depth, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
            '<|' || coalesce(role, 'user') || '|>' || chr(10) || own || chr(10) || '<|end|>' || chr(10) AS formatted
        FROM source s JOIN texts USING (row) LEFT JOIN placed USING (conv_id, turn) LEFT JOIN parents USING (conv_id, turn) LEFT JOIN n_quotes USING (conv_id, turn) LEFT JOIN n_linked USING (conv_id, turn)
    """,
    "op3_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS place,
                first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM rows)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM ranked
    """,
    "op5_quality_rules": _RULES,
    "op7_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(list_slice(ws, i, i + 4), ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
            FROM w),
        n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)
            UNION ALL SELECT min(doc_id) OVER (), doc_id FROM n WHERE n = 0),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id)
        SELECT id AS doc_id, min(root) AS class_id, min(root) = id AS kept, max(n) AS n_shingles FROM reach JOIN n ON n.doc_id = id GROUP BY id
""",
}
