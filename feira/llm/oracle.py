"""DuckDB SQL of the queries that SQL can express.

The limits are written out here on their own, not taken from the operators.
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
             (3 * source_size)::DOUBLE AS cap FROM s),
t AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
f AS (SELECT level AS share FROM l WHERE level <= cap / weight ORDER BY turn LIMIT 1),
g AS (SELECT source, source_size, least(cap, coalesce((SELECT share FROM f) * weight, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target + 1e-6)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digit,
             length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')) AS n_mark, length(t) AS n_all FROM d),
h AS (SELECT r, lang, unnest([(n_all - word_chars), n_upper, n_digit, n_mark, n_symbols,
                              n_all - (n_all - word_chars) - n_upper - n_digit - n_mark - n_symbols]) AS n,
             unnest(range(6)) AS class FROM c),
ct AS (SELECT lang, class, sum(n) AS n FROM h WHERE lang IS NOT NULL GROUP BY lang, class),
lw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+')) AS word
                                              FROM d WHERE lang IS NOT NULL) GROUP BY lang, word),
lt AS (SELECT lang, sum(n) AS n FROM lw GROUP BY lang),
refs AS (SELECT lang, n, n >= (SELECT sum(n) FROM lt) * 0.01 AS big FROM lt WHERE n >= 500 OR n >= (SELECT sum(n) FROM lt) * 0.01),
cq AS (SELECT lang, class, n / greatest(sum(n) OVER (PARTITION BY lang), 1) AS q FROM ct WHERE lang IN (SELECT lang FROM refs)),
wq AS (SELECT lang, word, n / (SELECT n FROM refs WHERE refs.lang = lw.lang) AS q FROM lw
       WHERE lang IN (SELECT lang FROM refs)
       QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 32),
wt AS (SELECT lang, sum(q) AS top FROM wq GROUP BY lang),
cp AS (SELECT r, lang AS own, class, n / greatest(sum(n) OVER (PARTITION BY r), 1) AS p FROM h),
cd AS (SELECT r, lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                         + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS dist
       FROM cp JOIN cq USING (class) JOIN refs USING (lang) WHERE refs.big OR cq.lang = cp.own GROUP BY r, lang),
cm AS (SELECT r, min(dist) AS char_dist FROM cd GROUP BY r),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, lower(unnest(ws)) AS word FROM c) GROUP BY r, word),
n AS (SELECT r, lang AS own, len(ws) AS n_words FROM c),
wp AS (SELECT n.r, wt.lang, wt.top, sum(dw.n / n.n_words) AS p, sum(wq.q) AS q,
              sum((dw.n / n.n_words) * log2(2 * (dw.n / n.n_words) / (dw.n / n.n_words + wq.q))
                  + wq.q * log2(2 * wq.q / (dw.n / n.n_words + wq.q))) AS terms
       FROM n JOIN (wt JOIN refs USING (lang)) ON refs.big OR wt.lang = n.own LEFT JOIN (dw JOIN wq USING (word)) ON dw.r = n.r AND wq.lang = wt.lang
       GROUP BY n.r, wt.lang, wt.top),
wo AS (SELECT r, coalesce(terms, 0) AS terms, coalesce(q, 0) AS q, top, greatest(1 - coalesce(p, 0), 0) AS po, 1 - top AS qo FROM wp),
wm AS (SELECT r, min(sqrt(greatest((terms + (top - q) + CASE WHEN po > 0 THEN po * log2(2 * po / (po + qo)) ELSE 0 END
                                    + CASE WHEN qo > 0 THEN qo * log2(2 * qo / (po + qo)) ELSE 0 END) / 2, 0))) AS word_dist
       FROM wo GROUP BY r),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM c WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
x AS (SELECT c.doc_id, n.n_words::BIGINT AS n_words, c.word_chars::BIGINT AS word_chars, c.n_symbols::BIGINT AS n_symbols,
             coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             n.n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n.n_words AS base_failed, cm.char_dist, wm.word_dist,
             c.lang IS NOT NULL AND c.lang NOT IN (SELECT lang FROM refs) AS strange
      FROM c JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r) LEFT JOIN cm USING (r) LEFT JOIN wm USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (strange OR (n_words < 20 OR coalesce(char_dist, 0) <= 0.30) AND (n_words < 50 OR coalesce(word_dist, 0) <= 0.45)) AS kept
FROM x
"""



def _op11(k: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid; one pair of subqueries a round."""
    parts = [f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS c, q FROM v
       WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id) LIMIT {k})"""]

    def assigned(i: int) -> str:
        return f"""
a{i} AS (SELECT v.r, min({{'d': list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT,
                        'c': c.c}}) AS best FROM v CROSS JOIN c{i} c GROUP BY v.r)"""

    for i in range(rounds):
        parts.append(assigned(i))
        parts.append(f"""
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM
         (SELECT a.best.c AS c, j, sum(v.q[j]) AS s, count(*) AS n FROM v JOIN a{i} a USING (r), range(1, 65) t(j) GROUP BY ALL)
         GROUP BY c)""")
        parts.append(f"""
c{i + 1} AS (SELECT c, coalesce(m.q, o.q) AS q FROM c{i} o LEFT JOIN m{i} m USING (c))""")
    parts.append(assigned(rounds))
    return ",".join(parts) + f"""
SELECT v.vec_id, a.best.c AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia,
       sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.best.c
"""


OP11 = _op11()


def _op12(fan: int = 16, depth: int = 5) -> str:
    """Two trees, written out level by level: up to fan^depth leaves a source and as many sources."""
    crc = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

    def fields(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
                                       for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS tree, {fields('text')} AS leaf,
                  CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {fields(lowered)} END AS other FROM documents),
l0 AS (SELECT r, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h,
              count(*) OVER (PARTITION BY tree) AS n FROM d)"""]

    def up(name: str, k: int) -> str:
        return f"""
{name}r{k} AS (SELECT tree, pos // {fan} AS run, list(h ORDER BY pos) AS hs FROM {name}{k} GROUP BY ALL),
{name}{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h,
                  (n + {fan - 1}) // {fan} AS n
           FROM {name}r{k} JOIN (SELECT DISTINCT tree, n FROM {name}{k}) USING (tree))"""

    def climb(name: str, k: int, rows: str) -> str:
        at = f"(x.pos // {fan ** k}) % {fan}"
        return f"""
{rows}{name}{k + 1} AS (SELECT x.* REPLACE (
    x.proof || array_to_string(q.hs[1:{at}] || q.hs[{at} + 2:], '') AS proof,
    CASE WHEN len(q.hs) = 1 AND q.run = 0 THEN x.cur ELSE sha256(array_to_string(q.hs[1:{at}] || [x.cur] || q.hs[{at} + 2:], '')) END AS cur)
  FROM {rows}{name}{k} x JOIN {name}r{k} q ON q.tree = x.tree AND q.run = x.pos // {fan ** (k + 1)})"""

    parts += [up("l", k) for k in range(depth)]
    parts.append(f"""
s0 AS (SELECT 'all' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n FROM l{depth})""")
    parts += [up("s", k) for k in range(depth)]
    parts.append("""
xl0 AS (SELECT d.r, d.doc_id, d.leaf, l0.tree, l0.pos, '' AS proof, coalesce(d.other, d.leaf) AS cur FROM d JOIN l0 USING (r))""")
    parts += [climb("l", k, "x") for k in range(depth)]
    parts.append(f"""
xs0 AS (SELECT x.r, x.doc_id, x.leaf, s.tree, s.pos, x.proof, x.cur, s.h AS subroot FROM xl{depth} x JOIN s0 s ON s.source = x.tree)""")
    parts += [climb("s", k, "x") for k in range(depth)]
    return ",".join(parts) + f"""
SELECT x.doc_id, x.leaf, x.subroot, t.h AS root, sha256(x.proof) AS proof_sha256, x.cur AS folded_root, x.cur = t.h AS verified
FROM xs{depth} x CROSS JOIN s{depth} t
"""


OP12 = _op12()

# documents with equal sets are compared once; a set is its shingles in order, words joined by a blank
OP13 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT r, doc_id, list_sort(list_distinct(
        CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END)) AS shingles FROM w),
n AS (SELECT shingles, row_number() OVER () AS node, len(shingles) AS size
      FROM (SELECT DISTINCT shingles FROM d WHERE len(shingles) > 0)),
s AS (SELECT node, size, unnest(shingles) AS s FROM n),
e AS (SELECT a.node AS a, b.node AS b FROM s a JOIN s b ON a.s = b.s AND a.node <> b.node
      AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)
      GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))),
reach AS (SELECT node AS a, node AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
least_id AS (SELECT node, min(doc_id) AS least FROM d JOIN n USING (shingles) GROUP BY node),
comp AS (SELECT reach.a AS node, min(least_id.least) AS component_id FROM reach JOIN least_id ON least_id.node = reach.b GROUP BY reach.a)
SELECT d.doc_id, len(d.shingles)::BIGINT AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (shingles) LEFT JOIN comp ON comp.node = n.node
"""

ORACLE: dict[str, str] = {"op5_mixing": OP5, "op6_quality": OP6, "op11_zone_clusters": OP11, "op12_merkle": OP12,
                          "op13_fragment_join": OP13}
