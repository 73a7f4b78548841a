"""SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from . import quality_rules

#: All pairs of a label by double-precision cosine, and everything that links reach from each vector.
EMBED_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), low AS (SELECT a, min(least(a, b)) AS root FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id"""


def _rejects(cutoff: str) -> str:
    cases = []
    for r in quality_rules.RULES:
        sign = ">" if r.above else "<"
        cases.append(f"WHEN '{r.name}' THEN {r.numerator}::DOUBLE {sign} {r.denominator}::DOUBLE * {cutoff}")
    return f"CASE rule {' '.join(cases)} END"


def quality(max_false_rejection: float = 0.02, error: float = 0.05) -> str:
    """The counts, the base rule, and cutoffs by the binomial tail.

    A cutoff's upper bound is within the allowed rate p where so few rejections or
    fewer have a probability of at most the error at p itself.
    """
    space = r"\x20\x09-\x0D"
    n_rules = len(quality_rules.RULES)
    p, share = f"({max_false_rejection}::DOUBLE / {n_rules})", f"({error}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM good) * {n_rules}))"
    cutoffs = ", ".join(f"('{r.name}', {i}, {c}::DOUBLE)" for r in quality_rules.RULES for i, c in enumerate(r.cutoffs))
    without = lambda chars: f"length(text) - length(regexp_replace(text, '[{chars}]', '', 'g'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^{space}]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS lines FROM d),
t AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM s),
three AS (SELECT r, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM t WINDOW w AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM three WHERE c IS NOT NULL) WHERE k > 1),
again AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
k AS (SELECT r, doc_id, stratum, len(words) AS n_words, length(regexp_replace(text, '[{space}]', '', 'g')) AS word_chars, {without("#*$%&|<>")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
coalesce(n, 0) AS n_repeat_words, {without("A-Z")} AS n_upper, len(lines) AS n_lines FROM s LEFT JOIN again USING (r)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM k),
good AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
cuts(rule, i, cutoff) AS (VALUES {cutoffs}),
tests AS (SELECT stratum, rule, i, cutoff, count(*) AS n, count(*) FILTER ({_rejects("cutoff")}) AS failures FROM good CROSS JOIN cuts GROUP BY ALL),
tails AS (SELECT *, list_sum(list_transform(range(0, failures + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({p}) + (n - x) * ln(1 - {p})))) AS tail FROM tests WHERE failures <= {p} * n),
chosen AS (SELECT stratum, rule, arg_min(cutoff, i) AS cutoff FROM tails WHERE tail <= {share} GROUP BY ALL),
bad AS (SELECT DISTINCT r FROM m JOIN chosen USING (stratum) WHERE {_rejects("cutoff")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept, stratum FROM m"""


def centroids(k: int = 40, rounds: int = 5, salt: str = "2", dims: int = 64, scale: int = 256) -> str:
    """Every round in full: each vector against each centroid."""
    square = "list_sum(list_transform(generate_series(1, len(v)), lambda j: (v[j] - m[j]) * (v[j] - m[j])))"
    nearest = lambda i: f"a{i} AS MATERIALIZED (SELECT r, min({{'d': {square}, 'c': c}}) AS best FROM v CROSS JOIN c{i} GROUP BY r)"
    steps = []
    for i in range(rounds):
        steps.append(nearest(i))
        steps.append(f"""s{i} AS MATERIALIZED (SELECT best.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM v JOIN a{i} USING (r) CROSS JOIN generate_series(1, {dims}) AS g(j) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY j) AS m FROM s{i} GROUP BY c) w USING (c))""")
    steps.append(nearest(rounds))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id::VARCHAR), v) - 1 AS c, v AS m FROM v QUALIFY c < {k}),
{(","+chr(10)).join(steps)},
f AS (SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance FROM v JOIN a{rounds} USING (r))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM f JOIN c{rounds} ON c = cluster"""


def phrases(longest: int = 4, least: int = 30, top: int = 2000) -> str:
    """All phrases by counting, without passes by level."""
    words = [f"w{i}" for i in range(1, longest + 1)]
    join = lambda a, b: " || ' ' || ".join(words[a:b])
    grams = "\nUNION ALL ".join(f"SELECT lang, {k} AS k, {join(0, k)} AS phrase, {', '.join(words)}, count(*) AS f FROM (SELECT lang, {', '.join(w if i < k else f'NULL AS {w}' for i, w in enumerate(words))} FROM t WHERE w{k} IS NOT NULL) GROUP BY ALL HAVING count(*) >= {least}" for k in range(1, longest + 1))
    cuts = "\nUNION ALL ".join(f"SELECT lang, phrase, f, {c} AS cut, {join(0, c)} AS head, {join(c, k)} AS rest FROM g WHERE k = {k}" for k in range(2, longest + 1) for c in range(1, k))
    parts = "\nUNION ALL ".join(f"SELECT lang, f, {join(s, s + n)} AS phrase FROM g WHERE k = {k}" for k in range(3, longest + 1) for n in range(2, k) for s in range(k - n + 1))
    lead = ", ".join(f"lead(w1, {i}) OVER x AS w{i + 1}" for i in range(1, longest))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
l AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
u AS (SELECT lang, p, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM l),
t AS MATERIALIZED (SELECT lang, w1, {lead} FROM u WINDOW x AS (PARTITION BY p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
g AS MATERIALIZED ({grams}),
c AS ({cuts}),
s AS (SELECT c.lang, c.phrase, c.f AS a, a.f AS l, b.f AS r, cut, ((2000000::HUGEINT * c.f) // (a.f + b.f))::BIGINT AS score FROM c JOIN g a ON a.lang = c.lang AND a.phrase = head JOIN g b ON b.lang = c.lang AND b.phrase = rest),
m AS (SELECT lang, phrase, any_value(a) AS a, min({{'score': score, 'cut': cut, 'l': l, 'r': r}}) AS m FROM s GROUP BY lang, phrase),
longer AS (SELECT lang, phrase, max(f) AS f FROM ({parts}) GROUP BY lang, phrase),
k AS (SELECT m.lang, m.phrase, a, m.m.l AS l, m.m.r AS r, m.m.score AS score FROM m LEFT JOIN longer o ON o.lang = m.lang AND o.phrase = m.phrase WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) JOIN n USING (lang) WHERE rank <= {top}"""


#: What formatting and reading back comes to: turns in order, the assistant's texts, and the length of marks and escaped texts.
CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM conversations
UNION ALL SELECT -1, i, c, '<|im_end|><|im_start|>assistant ok', c, '' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, c)),
w AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) AS said,
coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM w"""

ORACLE_SQL = {"op4_embed_dedup": EMBED_DEDUP, "op8_quality_rules": quality(), "op11_centroids": centroids(), "op12_phrases": phrases(), "op13_chat": CHAT}
