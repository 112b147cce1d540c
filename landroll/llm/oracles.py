"""DuckDB SQL for the operators that SQL can express, written apart from the Spark jobs."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a)
SELECT vec_id, (SELECT count(*) FROM pair WHERE a = vec_id)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = vec_id
"""

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def _op3(rounds: int = 10) -> str:
    host = "translate(regexp_extract(rest, '^[^/?#]*'), '{0}', '{1}')".format(UPPER, LOWER)
    rules = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    )
    steps, last = "", "start"
    for k in range(rounds):
        steps += f"""
r{k} AS (SELECT good, host, sum(x) AS x FROM (
  SELECT * FROM start UNION ALL SELECT e.good, e.t, r.x * e.share * 0.85 FROM edges e JOIN {last} r ON r.good = e.good AND r.host = e.f) GROUP BY 1, 2),"""
        last = f"r{k}"
    return rf"""
WITH split AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
pg AS (SELECT page_id, html, {host} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM split),
judged AS (SELECT *, CASE {cases} END AS fit FROM pg),
seed AS (SELECT host, count(*) FILTER (fit LIKE 'allow %') AS good, count(*) FILTER (fit LIKE 'block %') AS bad FROM judged WHERE fit IS NOT NULL GROUP BY host),
link AS (SELECT s, t, count(*) AS n FROM (
  SELECT host AS s, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)), '{UPPER}', '{LOWER}') AS t
  FROM pg WHERE host <> '') WHERE s <> t GROUP BY 1, 2),
edges AS (
  SELECT TRUE AS good, s AS f, t, n / sum(n) OVER (PARTITION BY s) AS share FROM link
  UNION ALL SELECT FALSE, t, s, n / sum(n) OVER (PARTITION BY t) FROM link),
start AS (
  SELECT TRUE AS good, host, good / (SELECT greatest(sum(good), 1) FROM seed) * (1 - 0.85) AS x FROM seed WHERE good > 0
  UNION ALL SELECT FALSE, host, bad / (SELECT greatest(sum(bad), 1) FROM seed) * (1 - 0.85) FROM seed WHERE bad > 0),{steps}
ranks AS (SELECT host, coalesce(sum(x) FILTER (good), 0) AS trust, coalesce(sum(x) FILTER (NOT good), 0) AS distrust FROM {last} GROUP BY host)
SELECT page_id, j.host, path, substr(fit, 7) AS rule,
  coalesce(substr(fit, 1, 5), CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN ranks ON ranks.host = j.host
"""


OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
t AS (SELECT x, payload_bytes, max(page_id) AS top FROM d GROUP BY 1, 2)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, g * 5 + 1, 5))::BIGINT >> k) & 31) + 1)::BIGINT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d JOIN t USING (x, payload_bytes)
"""


def _op7() -> str:
    kinds = (
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
        ("mixed", "[A-Za-z0-9+/_-]{24,}", 0, 24),
    )  # fmt: skip
    parts = []
    for k, (_, pattern, group, least) in enumerate(kinds):
        pattern = f"'{pattern}'"
        parts.append(
            f"SELECT doc_id, source, lang, {k} AS kind, list_sum(list_transform(gap[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda y: length(y))), 0) AS start, whole[i] AS whole, val[i] AS val "
            f"FROM (SELECT doc_id, source, lang, whole, val, gap, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, source, lang, regexp_extract_all(t, {pattern}) AS whole, regexp_extract_all(t, {pattern}, {group}) AS val, string_split_regex(t, {pattern}) AS gap FROM d)) WHERE length(val[i]) >= {least}"
        )
    names = "['assign', 'access', 'hex', 'mixed'][kind + 1] || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, source, lang, kind, start::BIGINT AS start, (start + length(whole))::BIGINT AS stop, val FROM ({" UNION ALL ".join(parts)})),
base AS (SELECT * FROM found WHERE kind < 3),
mixed AS (SELECT * FROM found f WHERE kind = 3 AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.start < f.stop AND f.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM mixed),
owned AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) <= 2 AND count(DISTINCT concat_ws('/', source, lang)) <= 4 AS live FROM every GROUP BY val),
own AS (SELECT doc_id, string_agg({names}, ',' ORDER BY start, kind) AS line, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c FROM base GROUP BY doc_id),
total AS (SELECT doc_id, string_agg({names}, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS line, count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS copied FROM every JOIN owned USING (val) GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(own.line, '')) AS base_sha256,
  coalesce(total.line, '') AS spans, coalesce(live, 0)::BIGINT AS n_live, coalesce(copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN total ON total.doc_id = d.doc_id
"""


def _op11(rounds: int = 3) -> str:
    steps = ""
    for k in range(rounds + 1):
        steps += f"""
d{k} AS MATERIALIZED (SELECT r, cl, list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{k}),
a{k} AS MATERIALIZED (SELECT r, cl, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cl) = 1),"""
        if k < rounds:
            steps += f"""
s{k} AS (SELECT cl, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cl, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{k} JOIN v USING (r)) GROUP BY cl, i),
m{k} AS (SELECT cl, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY cl),
c{k + 1} AS MATERIALIZED (SELECT cl, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (cl)),"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cl, e AS c FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),{steps}
t AS (SELECT cl, sum(d)::BIGINT AS t FROM a{rounds} GROUP BY cl)
SELECT vec_id, cl::INTEGER AS cluster, d AS distance, t AS cluster_inertia, (SELECT sum(t)::BIGINT FROM t) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN t USING (cl) JOIN c{rounds} USING (cl)
"""


def _op12() -> str:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return f"""
WITH RECURSIVE run AS (
  SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS r FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  WHERE length(r) >= 7),
bytes AS (
  SELECT r, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 | (unicode(ch) >> 6), 128 | (unicode(ch) & 63)]::BIGINT[] END)) AS b FROM run),
hashed AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, ({table}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
del AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT a.word AS x, b.word AS y, b.n AS m FROM del a JOIN del b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM del a JOIN w b ON a.d = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM del a JOIN w b ON a.d = b.word)),
best AS (SELECT x, count(*) OVER (PARTITION BY x) AS n_near, y, m FROM near QUALIFY row_number() OVER (PARTITION BY x ORDER BY m DESC, y) = 1),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN y END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best ON x = word),
chain AS (SELECT word, word AS spot, 0 AS steps FROM formed UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON f.word = c.spot WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(spot, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN root USING (word)
"""


def _op13(rounds: int = 30) -> str:
    rules = {
        "100.0 * n_symbols / n_words": (None, 20.0),
        "100.0 * no_letter / n_words": (None, 20.0),
        "100.0 * n_repeat_words / n_words": (None, 35.0),
        "100.0 * n_dup_lines / n_lines": (None, 40.0),
        "100.0 * n_upper / n_letters": (None, 40.0),
        "abs(word_chars / n_words - 5.5)": (None, 6.0),
        "100.0 - 100.0 * n_letters / word_chars": (6.0, 30.0),
        "abs(100.0 * n_stops / n_words - 14)": (9.0, 45.0),
    }
    votes = ", ".join(
        f"CASE WHEN {value} >= {bad} THEN -1 {f'WHEN {value} <= {good} THEN 1' if good else ''} ELSE 0 END" for value, (good, bad) in rules.items()
    )
    posterior = "1 / (1 + exp(-(ln(any_value(prior) / (1 - any_value(prior))) + sum(CASE vote WHEN -1 THEN least(ln(g / b), 0) WHEN 1 THEN greatest(ln(g / b), 0) ELSE ln(g / b) END))))"
    steps = ""
    for k in range(rounds):
        steps += f"""
q{k} AS MATERIALIZED (SELECT votes, any_value(n) AS n, {posterior} AS p FROM each JOIN p{k} USING (rule, vote) GROUP BY votes),
t{k} AS (SELECT sum(n * p) AS g, sum(n * (1 - p)) AS b FROM q{k}),
p{k + 1} AS MATERIALIZED (
  SELECT rule, vote, (coalesce(sum(q.n * p), 0) + 1) / (any_value(t.g) + 3) AS g, (coalesce(sum(q.n * (1 - p)), 0) + 1) / (any_value(t.b) + 3) AS b, any_value((t.g + 1) / (t.g + t.b + 2)) AS prior
  FROM p0 LEFT JOIN each USING (rule, vote) LEFT JOIN q{k} q USING (votes) CROSS JOIN t{k} t GROUP BY rule, vote),"""
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
s AS MATERIALIZED (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters,
    length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper, len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS no_letter,
    length(regexp_replace(t, '[^.!?:;,]', '', 'g')) AS n_stops FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
voted AS MATERIALIZED (SELECT *, [{votes}] AS votes FROM s),
pattern AS MATERIALIZED (SELECT votes, count(*) AS n FROM voted GROUP BY votes),
each AS MATERIALIZED (SELECT votes, n, unnest(votes) AS vote, unnest(range(0, {len(rules)})) AS rule FROM pattern),
p0 AS MATERIALIZED (SELECT rule, vote, [0.02, 0.38, 0.6][vote + 2]::DOUBLE AS g, [0.3, 0.5, 0.2][vote + 2]::DOUBLE AS b, 0.5::DOUBLE AS prior
  FROM (SELECT unnest(range(0, {len(rules)})) AS rule), (SELECT unnest([-1, 0, 1]) AS vote)),{steps}
last AS (SELECT votes, {posterior} AS p FROM each JOIN p{rounds} USING (rule, vote) GROUP BY votes)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND p >= 0.5 AS kept, array_to_string(votes, ',') AS votes
FROM voted JOIN last USING (votes)
"""


ORACLES: dict[str, str] = {
    "op1_embedding_dups": OP1, "op2_minhash_dups": OP2, "op3_url_trust": _op3(), "op6_archives": OP6, "op7_secrets": _op7(),
    "op11_centroids": _op11(), "op12_spelling": _op12(), "op13_quality_rules": _op13(),
}  # fmt: skip
