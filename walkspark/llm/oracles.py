"""DuckDB SQL of operators that SQL can express whole: texts made from the contract's constants."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"


def codebooks(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Rounds of assignment and floors of means, one pair of tables a round."""
    best = "min(CAST(list_dot_product(p.x, b.x) * -2 + p.xx + b.xx AS BIGINT) * 65536 + b.entry)"
    text = f"""WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS uid, list_transform(embedding, lambda c: floor({scale} * CAST(c AS DOUBLE))) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT uid, pos, x, list_dot_product(x, x) AS xx FROM (SELECT uid, pos, v[pos * (len(v) // {parts}) + 1 : (pos + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) AS r(pos))),
b0 AS MATERIALIZED (SELECT pos, uid - 1 AS entry, x, xx FROM p WHERE uid <= {entries})"""
    for i in range(rounds):
        text += f""",
a{i} AS MATERIALIZED (SELECT p.uid, p.pos, {best} AS best FROM p JOIN b{i} b ON b.pos = p.pos GROUP BY p.uid, p.pos),
m{i} AS (SELECT pos, entry, list(c ORDER BY j) AS x FROM (SELECT a.pos, a.best & 65535 AS entry, j, floor(sum(p.x[j]) / count(*)) AS c FROM a{i} a JOIN p ON p.uid = a.uid AND p.pos = a.pos, unnest(generate_series(1, len(p.x))) AS g(j) GROUP BY ALL) GROUP BY pos, entry),
b{i + 1} AS MATERIALIZED (SELECT pos, entry, x, list_dot_product(x, x) AS xx FROM (SELECT b.pos, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.pos = b.pos AND m.entry = b.entry))"""
    return text + f""",
f AS (SELECT p.uid, p.pos, {best} AS best FROM p JOIN b{rounds} b ON b.pos = p.pos GROUP BY p.uid, p.pos),
e AS (SELECT uid, string_agg(printf('%02x', best & 65535), '' ORDER BY pos) AS code, CAST(sum(best >> 16) AS BIGINT) AS error FROM f GROUP BY uid),
h AS (SELECT sha256(string_agg(CAST(CAST(x[j] AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, j)) AS codebooks_sha256 FROM b{rounds}, unnest(generate_series(1, len(x))) AS g(j))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e ON e.uid = k.uid, h"""


def _crc32(text: str) -> str:
    """CRC-32 of a text, by its table of 256 remainders."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: xor(a >> 8, CAST({table} AS BIGINT[])[(xor(a, b) & 255) + 1])))"


def conversations() -> str:
    """The cheapest path as strings of cost and labels, row by row from the end; least() compares both."""
    again = lambda state, cost, label: f"concat(lpad(CAST(CAST({state}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0'), '{label}', {state}[10:])"
    keeps, cut = "fault NOT IN ('blank', 'duplicate')", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"

    def row(q: int) -> str:
        to = "w3" if q == 2 else "w2"
        kept = {0: f"CASE i0 WHEN 's' THEN {again('w1', cut, 'K')} WHEN 'u' THEN {again('w2', cut, 'K')} END", 2: f"CASE WHEN i0 = 'a' THEN {again('w3', cut, 'K')} END"}.get(q, f"CASE WHEN i0 = 'u' THEN {again('w2', cut, 'K')} END")
        return f"least({again(f'w{q}', 4, 'D')}, CASE WHEN {keeps} THEN {again(to, f'3 + {cut}', 'R')} END, CASE WHEN {keeps} THEN {kept} END)"

    return f"""WITH RECURSIVE d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS how FROM conversations),
d AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS i, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS said FROM d),
f AS MATERIALIZED (SELECT conv_id, i, turn, role, text, role[1] AS i0, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i0) OVER (PARTITION BY conv_id ORDER BY i) || i0 AS pair FROM f) GROUP BY conv_id),
v(conv_id, i, w0, w1, w2, w3) AS (SELECT conv_id, n + 1, '000000000', '000000006II', '000000003I', '000000000' FROM g
UNION ALL SELECT conv_id, i, least(b0, {again('c2', 3, 'I')}), least(b1, {again('c2', 3, 'I')}), c2, c3 FROM (SELECT *, least(b2, {again('b3', 3, 'I')}) AS c2, least(b3, {again('b2', 3, 'I')}) AS c3
FROM (SELECT v.conv_id, f.i, {row(0)} AS b0, {row(1)} AS b1, {row(2)} AS b2, {row(3)} AS b3 FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i - 1))),
a AS (SELECT conv_id, CAST(w0[1:9] AS BIGINT) AS cost, w0[10:] AS audit FROM v WHERE i = 1),
t AS (SELECT conv_id, k, audit[k] AS x, len(replace(audit[1:k], 'I', '')) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS place FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM a) WHERE audit[k] <> 'D'),
u AS (SELECT t.*, f.role, f.text, (first_value(x = 'K' AND f.i0 = 's') OVER (PARTITION BY t.conv_id ORDER BY place))::INT AS s FROM t LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i AND t.x <> 'I'),
r AS (SELECT conv_id, string_agg(concat(CASE WHEN x = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN x <> 'I' THEN text ELSE '' END), chr(10) ORDER BY place) AS repaired FROM u GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""


def jaccard(words: int = 5, threshold: int = 80) -> str:
    """All pairs that share a shingle, their overlap, and the smallest id that is reached."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_WORD}+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i : i + {words - 1}], ' '))) END AS ss FROM w),
k AS MATERIALIZED (SELECT doc_id, md5_number(unnest(ss)) AS h FROM s),
shared AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
m AS MATERIALIZED (SELECT doc_id, h FROM k WHERE h IN (SELECT h FROM shared)),
n AS (SELECT doc_id, CAST(len(ss) AS BIGINT) AS n FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM m a JOIN m b ON b.h = a.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {threshold} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""
