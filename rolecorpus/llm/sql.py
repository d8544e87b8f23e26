"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < 5 THEN [array_to_string({w}, ' ')] ELSE list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i+4], ' ')) END)"


def _shingles(table: str, key: str, name: str, where: str = "") -> str:
    return f"{name}_w AS (SELECT {key}, {_WORDS.format(t='text')} AS w FROM {table} {where}), {name} AS (SELECT {key}, {_SHINGLES.format(w='w')} AS s FROM {name}_w)"


OP8 = f"""
WITH RECURSIVE {_shingles('documents', 'doc_id', 'd')},
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter WHERE 100 * k >= 75 * (na + nb - k)),
sides AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sides.a, r.c FROM reach r JOIN sides ON sides.b = r.doc_id AND r.c < sides.a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM d JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id, len(d.s)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(1, len(arr) + 1)) AS n, unnest(arr) AS line FROM d),
s AS (SELECT *, lead(n) OVER (PARTITION BY doc_id ORDER BY n) AS nx FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, n AS a, n AS z, line AS content FROM s WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50 OR strlen(line) >= 300
  UNION ALL SELECT s.doc_id, s.n, s.nx, array_to_string(d.arr[s.n:s.nx], chr(10)) FROM s JOIN d USING (doc_id) WHERE s.nx IS NOT NULL),
f AS (SELECT content, min(row(doc_id, a, z)) AS first FROM u GROUP BY content),
g AS (SELECT u.doc_id, u.a, u.z FROM u JOIN f USING (content) WHERE row(u.doc_id, u.a, u.z) <> f.first),
x AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS n FROM g),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.n) FILTER (x.n IS NULL) AS text, count(x.n) AS lines_removed FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.n = l.n GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS chunks_removed FROM g GROUP BY doc_id)
SELECT o.doc_id, CASE WHEN o.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.lines_removed, 0)::BIGINT AS lines_removed, coalesce(c.chunks_removed, 0)::BIGINT AS chunks_removed
FROM documents o LEFT JOIN k ON k.doc_id = o.doc_id LEFT JOIN c ON c.doc_id = o.doc_id
"""

_MIX_SIZED = r"""
sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS h FROM {docs}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM totals),
ordered AS (SELECT *, 2.0 * source_size::DOUBLE AS cap, 2.0 * source_size::DOUBLE / weight AS full_at FROM weighed),
stepped AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM ordered),
leveled AS (SELECT *, max(CASE WHEN full_at > here THEN here END) OVER () AS level FROM stepped),
targets AS (SELECT source, source_size, CASE WHEN full_at <= level THEN cap ELSE coalesce(weight * level, cap) END AS target FROM leveled),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM targets),
sums AS (SELECT source, h, sum(size) AS s FROM sized GROUP BY source, h),
running AS (SELECT source, h, s, sum(s) OVER (PARTITION BY source ORDER BY h) AS through FROM sums),
past AS (SELECT r.source, r.h, r.s, r.through, p.target - p.base * p.source_size AS rest
  FROM running r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source WHERE p.target - p.base * p.source_size > 0 AND r.through > p.target - p.base * p.source_size),
edge AS (SELECT source, arg_min(h, h) AS h, arg_min(s, h) AS s, arg_min(through, h) AS through, arg_min(rest, h) AS rest FROM past GROUP BY source),
cuts AS (SELECT source, h + CASE WHEN through - rest < rest - (through - s) THEN 1 ELSE 0 END AS cut FROM edge)
SELECT d.doc_id, d.size, p.source_size, p.target, ((p.base + CASE WHEN d.h < coalesce(c.cut, 0) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""

OP9 = "WITH " + _MIX_SIZED.format(docs="documents")

OP10 = f"""
WITH {_shingles('documents', 'doc_id', 'd')}, {_shingles('benchmark', 'item_id', 'b')},
dg AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM d), bg AS (SELECT item_id, len(s) AS n_item, unnest(s) AS g FROM b)
SELECT dg.doc_id, bg.item_id, any_value(bg.n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / any_value(bg.n_item)::DOUBLE AS containment
FROM dg JOIN bg ON dg.g = bg.g GROUP BY dg.doc_id, bg.item_id HAVING count(*) >= 0.75 * any_value(bg.n_item)
"""


def _runs(leaves: str, name: str, levels: int) -> str:
    """The nodes of each level of 16-ary trees over ``leaves`` (k, i, h), and the runs of siblings."""
    parts = [f"{name}0 AS (SELECT k, i, h, count(*) OVER (PARTITION BY k) AS n FROM {leaves})"]
    for v in range(levels):
        parts.append(f"{name}r{v} AS (SELECT k, i // 16 AS i, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {name}{v} GROUP BY k, i // 16)")
        parts.append(f"{name}{v + 1} AS (SELECT k, i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, count(*) OVER (PARTITION BY k) AS n FROM {name}r{v})")
    return ", ".join(parts)


def _climb(rows: str, runs: str, name: str, levels: int) -> str:
    """From ``rows`` (doc_id, k, i, now, sib and more) up ``levels`` runs: what is folded and the siblings passed."""
    parts = []
    for v in range(levels):
        pre, post = "array_to_string(list_slice(r.hs, 1, (i.i % 16)::BIGINT), '')", "array_to_string(list_slice(r.hs, (i.i % 16 + 2)::BIGINT, len(r.hs)), '')"
        parts.append(f"{name}{v} AS (SELECT i.* EXCLUDE (i, now, sib), i.i // 16 AS i, CASE WHEN r.n = 1 THEN i.now ELSE sha256({pre} || i.now || {post}) END AS now, i.sib || {pre} || {post} AS sib FROM {rows if v == 0 else f'{name}{v - 1}'} i JOIN {runs}r{v} r ON r.k = i.k AND r.i = i.i // 16)")
    return ", ".join(parts)


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIRST = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS k, sha256({_FIRST} || {_field('text')}) AS leaf, sha256({_FIRST} || {_field(_LOWER)}) AS other, coalesce({_CRC32} % 5 = 0, false) AS wrong FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d),
{_runs('l', 'a', 6)},
s AS (SELECT k AS tree, h AS subroot, 1 AS k, row_number() OVER (ORDER BY k) - 1 AS i, h FROM a6),
{_runs('s', 'b', 5)},
g AS (SELECT doc_id, leaf, k, i, CASE WHEN wrong THEN other ELSE leaf END AS now, '' AS sib FROM l),
{_climb('g', 'a', 'c', 6)},
t AS (SELECT c.doc_id, c.leaf, s.subroot, s.k, s.i, c.now, c.sib FROM c5 c JOIN s ON s.tree = c.k),
{_climb('t', 'b', 'e', 5)}
SELECT e.doc_id, e.leaf, e.subroot, b5.h AS root, sha256(e.sib) AS proof_sha256, e.now AS folded_root, e.now = b5.h AS verified FROM e4 e CROSS JOIN b5
"""

OP12 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.a, r.c FROM reach r JOIN link ON link.b = r.vec_id AND r.c < link.a),
least AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id)
SELECT x.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.c AS component_id, x.vec_id = least.c AS kept
FROM embeddings x JOIN least USING (vec_id) LEFT JOIN n ON n.a = x.vec_id
"""

OP11 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
p AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM p, (VALUES (1), (2), (3), (4)) AS s(n) WHERE i + n - 1 <= len(w)),
f AS (SELECT lang, n, phrase, count(*) AS a FROM g GROUP BY lang, n, phrase),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE n >= 2 AND a >= 30),
often AS MATERIALIZED (SELECT lang, phrase, a FROM f WHERE a >= 30),
ways AS (SELECT c.lang, c.n, c.phrase, c.a, k.k, array_to_string(words[1:k.k], ' ') AS l, array_to_string(words[k.k + 1:c.n], ' ') AS r FROM c, (VALUES (1), (2), (3)) AS k(k) WHERE k.k < c.n),
cuts AS (SELECT w.lang, w.n, w.phrase, w.a, w.k, l.a AS l, r.a AS r, (2000000::HUGEINT * w.a) // (l.a + r.a) AS score
  FROM ways w JOIN often l ON l.lang = w.lang AND l.phrase = w.l JOIN often r ON r.lang = w.lang AND r.phrase = w.r),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, array_to_string(words[b.b:b.b + s.n - 1], ' ') AS phrase FROM c, (VALUES (2), (3)) AS s(n), (VALUES (1), (2), (3)) AS b(b) WHERE s.n < c.n AND b.b + s.n - 1 <= c.n),
longer AS (SELECT lang, phrase, max(a) AS a FROM parts GROUP BY lang, phrase),
kept AS (SELECT w.* FROM worst w LEFT JOIN longer x ON x.lang = w.lang AND x.phrase = w.phrase WHERE x.a IS NULL OR 100 * x.a < 80 * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score::BIGINT AS score
FROM kept k JOIN total USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {"op11_phrase_collocations": OP11, "op12_embedding_dedup": OP12, "op13_dataset_manifest": OP13, "op7_line_dedup": OP7, "op8_ngram_jaccard_join": OP8, "op9_source_mixing": OP9, "op10_decontamination": OP10}
