"""SQL for DuckDB that gives the rows of the queries by a plain way."""

from retail_lake.llm.licence_texts import TEMPLATES
from retail_lake.llm.licences import BLOCK, LEAST, LICENCE_FILE, PARAGRAPH, RESERVED

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), k AS (
    SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""

CONTAMINATION = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), i AS (
    SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), cut AS (
    SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
    FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
    )
), hit AS (
    SELECT doc_id, s, n, item_id FROM cut JOIN win USING (n, phrase)
), places AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hit) GROUP BY 1
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""

GROUPS = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), met AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
    SELECT a, b FROM met JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id
    WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM d
    UNION
    SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

REPEATS = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
    FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 49)) AS i FROM d WHERE strlen(h) >= 100)
), f AS (
    SELECT s, min(doc_id) AS first FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1
), c AS (
    SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE w.doc_id > first
), r AS (
    SELECT doc_id, i, sum(CASE WHEN before >= i - 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c
), span AS (
    SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run
), piece AS (
    SELECT d.doc_id, h, coalesce(list(a ORDER BY a) FILTER (a IS NOT NULL), []) AS a, coalesce(list(b ORDER BY a) FILTER (a IS NOT NULL), []) AS b
    FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id, h
), kept AS (
    SELECT doc_id, strlen(h) // 2 AS n, len(a) AS spans,
           array_to_string([substr(h, 2 * x[1] + 1, 2 * (x[2] - x[1])) FOR x IN list_zip([0] || b, a || [strlen(h) // 2])], '') AS k
    FROM piece
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - strlen(k) // 2 AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM kept
"""

VECTORS = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
    SELECT * FROM v
    WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
      AND len(list_filter(x, lambda e: e <> 0)) > 0
), link AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
    WHERE list_dot_product(p.x, q.x) / sqrt(list_dot_product(p.x, p.x)) / sqrt(list_dot_product(q.x, q.x)) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v
    UNION
    SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), n AS (
    SELECT a, count(*) AS n_links FROM link GROUP BY 1
), c AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept
FROM c LEFT JOIN n ON n.a = c.a
"""

def _field(expression: str) -> str:
    text = f"CAST({expression} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _crc32(text: str) -> str:
    """The checksum of an ASCII text, bit by bit."""
    of_byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    start = "[CAST(4294967295 AS BIGINT)]"
    return f"xor(4294967295, list_reduce(list_concat({start}, {codes}), lambda c, b: {of_byte}))"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs with the nodes of each level (grp, pos, node, n) and the neighbours of each node in its run."""
    parts = [
        f"{name}0 AS (SELECT grp, pos, node, count(*) OVER (PARTITION BY grp) AS n FROM {leaves})",
    ]
    run = "PARTITION BY grp, pos // 8 ORDER BY pos ROWS BETWEEN"
    for k in range(levels):
        parts.append(f"""{name}s{k} AS (
    SELECT grp, pos,
           coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}{k} WHERE n > 1
)""")
        parts.append(f"""{name}{k + 1} AS (
    SELECT grp, pos, node, count(*) OVER (PARTITION BY grp) AS n
    FROM (
        SELECT grp, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node
        FROM {name}{k} WHERE n > 1 GROUP BY 1, 2
    )
)""")
    roots = " UNION ALL ".join(f"SELECT grp, node FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    parts.append(f"{name}root AS ({roots})")
    return ",\n".join(parts)


def _merkle(levels: int = 8, group_levels: int = 4) -> str:
    """Up to 8 levels of documents in a language and 4 of languages; both sides of a step are joined by place."""
    names = ["doc_id", "source", "lang", "n_chars"]
    leaf = " || ".join(_field(c) for c in [*names, "text"])
    changed = " || ".join([*map(_field, names), _field(_LOWER.format("text"))])
    steps = [(f"ds{k}", "d.grp", f"d.pos // {8**k}") for k in range(levels)]
    steps += [(f"ts{k}", "0", f"g.pos // {8**k}") for k in range(group_levels)]
    joins, proof, folds = [], [], []
    for i, (table, grp, pos) in enumerate(steps):
        joins.append(f"LEFT JOIN {table} x{i} ON x{i}.grp = {grp} AND x{i}.pos = {pos}")
        proof.append(f"coalesce(x{i}.l || x{i}.r, '')")
    for i in range(len(steps)):
        before = "claimed" if i == 0 else f"f{i - 1}"
        folds.append(f"CASE WHEN l{i} IS NULL THEN {before} ELSE sha256(l{i} || {before} || r{i}) END AS f{i}")
    sides = ", ".join(f"x{i}.l AS l{i}, x{i}.r AS r{i}" for i in range(len(steps)))
    nested = "met"
    for fold in folds:
        nested = f"(SELECT *, {fold} FROM {nested})"
    return f"""
WITH docs AS (
    SELECT doc_id, lang, sha256({leaf}) AS leaf,
           CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({changed}) END AS other
    FROM documents
), g AS (
    SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM (SELECT DISTINCT lang FROM docs)
), placed AS (
    SELECT doc_id, leaf, coalesce(other, leaf) AS claimed, g.pos AS grp,
           row_number() OVER (PARTITION BY g.pos ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM docs JOIN g ON docs.lang IS NOT DISTINCT FROM g.lang
), leaves AS (
    SELECT grp, pos, leaf AS node FROM placed
), {_tree("d", "leaves", levels)},
subroots AS (
    SELECT 0 AS grp, grp AS pos, node FROM droot
), {_tree("t", "subroots", group_levels)},
met AS (
    SELECT d.doc_id, d.leaf, d.claimed, droot.node AS subroot, troot.node AS root, sha256({" || ".join(proof)}) AS proof_sha256, {sides}
    FROM placed d JOIN g ON d.grp = g.pos JOIN droot ON droot.grp = d.grp CROSS JOIN troot
    {" ".join(joins)}
)
SELECT doc_id, leaf, subroot, root, proof_sha256, f{len(steps) - 1} AS folded_root, f{len(steps) - 1} = root AS verified
FROM {nested}
"""



def _licences() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in row)) for i, row in enumerate(TEMPLATES))
    lower, words = _LOWER.format("text"), "list_distinct(regexp_extract_all({}, '[a-z0-9]+'))"
    return f"""
WITH t(number, licence, wording) AS (VALUES {rows}), tt AS (
    SELECT number, licence, unnest({words.format("lower(wording)")}) AS term FROM t
), k AS (
    SELECT count(DISTINCT licence) AS k FROM t
), w AS (
    SELECT term, power(ln((k + 1) / (count(DISTINCT licence) + 1)) + 1, 2) AS w FROM tt, k GROUP BY term, k
), tl AS (
    SELECT number, licence, sum(w) AS t_length FROM tt JOIN w USING (term) GROUP BY ALL
), f AS (
    SELECT doc_id, {lower} AS text, concat_ws('/', source, lang, 'part' || CAST(floor(doc_id / 1000) AS BIGINT),
        CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'LICENSE-' ELSE 'text-' END || doc_id) AS path
    FROM documents
), g AS (
    SELECT *, regexp_matches(path, '{LICENCE_FILE}') AS is_licence, coalesce(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS dir FROM f
), said AS (
    SELECT doc_id, unnest(string_split(text, chr(10)) || string_split_regex(text, '{PARAGRAPH}') || string_split_regex(text, '{BLOCK}')
        || CASE WHEN is_licence THEN [text] ELSE [] END) AS statement FROM g
), sets AS (
    SELECT DISTINCT doc_id, list_sort({words.format("statement")}) AS terms FROM said
), s AS (
    SELECT row_number() OVER () AS sid, terms FROM (SELECT DISTINCT terms FROM sets)
), x AS (
    SELECT sid, unnest(terms) AS term FROM s
), sl AS (
    SELECT sid, sum(coalesce(w, power(ln(k + 1) + 1, 2))) AS length FROM x LEFT JOIN w USING (term), k GROUP BY sid
), dots AS (
    SELECT sid, number, sum(w) AS dot FROM x JOIN w USING (term) JOIN tt USING (term) GROUP BY ALL
), scored AS (
    SELECT sid, number, licence, round(dot / sqrt(length * t_length), 6) AS score, t_length
    FROM dots JOIN sl USING (sid) JOIN tl USING (number)
), best AS (
    SELECT sid, licence, score, round(score * sqrt(t_length), 6) AS weight FROM scored WHERE score >= {LEAST}
    QUALIFY row_number() OVER (PARTITION BY sid ORDER BY score DESC, number) = 1
), own AS (
    SELECT doc_id, licence, score FROM sets JOIN s USING (terms) JOIN best USING (sid)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY licence <> '{RESERVED}' DESC, weight DESC, score DESC, licence DESC) = 1
), given AS (
    SELECT dir, licence FROM g JOIN own USING (doc_id) WHERE is_licence QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1
), near AS (
    SELECT d.dir, n.dir AS from_dir, n.licence FROM (SELECT DISTINCT dir FROM g) d
    JOIN given n ON n.dir = d.dir OR n.dir = '' OR starts_with(d.dir, n.dir || '/')
    QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(n.dir) DESC) = 1
)
SELECT doc_id, path, own.licence AS own_licence, own.score AS own_score, coalesce(own.licence, near.licence) AS licence,
       CASE WHEN own.licence IS NULL THEN from_dir END AS from_dir
FROM g LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)
"""


ALL = {
    "op3_cross_polytope": VECTORS,
    "op7_suffix_dedup": REPEATS,
    "op8_token_group_join": GROUPS,
    "op1_warc_capture_index": WARC,
    "op10_positional_decontamination": CONTAMINATION,
    "op12_merkle_manifest": _merkle(),
    "op9_licence_tfidf": _licences(),
}
