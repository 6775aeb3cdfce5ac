"""DuckDB SQL that gives the same results as the queries of the same name."""

from __future__ import annotations

from loomgraph.functions.names import ALIASES, TECHNOLOGIES
from loomgraph.functions.text import ABBREVIATIONS, MARKDOWN
from loomgraph.operators.dedup import PRIME, permutation

# Building blocks: the fixture tables in the engine's roles.
_PAIRS = """
m AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS key FROM lineitem),
pairs AS (SELECT a.key AS src, b.key AS dst, count(*) AS weight FROM m a JOIN m b ON a.chunk = b.chunk AND a.key < b.key GROUP BY 1, 2 HAVING count(*) >= 2),
near AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs)"""
_PREREQ = (
    _PAIRS
    + """,
deg AS (SELECT src AS key, count(*) AS n FROM near GROUP BY 1),
com AS (SELECT p.src AS a, p.dst AS b, count(*) AS c FROM pairs p JOIN near x ON x.src = p.src JOIN near y ON y.src = p.dst AND y.dst = x.dst GROUP BY 1, 2),
refd AS (SELECT p.src AS a, p.dst AS b, (y.n - x.n)::DOUBLE / (x.n + y.n - coalesce(c, 0)) AS d
         FROM pairs p JOIN deg x ON x.key = p.src JOIN deg y ON y.key = p.dst LEFT JOIN com ON com.a = p.src AND com.b = p.dst),
prereq AS (SELECT CASE WHEN d > 0 THEN a ELSE b END AS src, CASE WHEN d > 0 THEN b ELSE a END AS dst, abs(d) AS refd FROM refd WHERE abs(d) > 0.05)"""
)
_COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
_QUERY = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)"
_NODES = "nodes AS (SELECT p_partkey AS key, embedding FROM part LEFT JOIN embeddings ON vec_id = p_partkey % 500)"
_OUTBOX = """
ob AS (SELECT event_id AS id, ['document.uploaded', 'document.text_ready', 'document.chunked', 'document.deleted', 'document.indexed'][(event_id % 5 + 1)::INT] AS event_type,
  ['PENDING', 'PROCESSING', 'COMPLETED', 'FAILED'][(event_id % 4 + 1)::INT] AS status, (event_id % 6)::INT AS retry_count, 5 AS max_retries,
  CASE WHEN event_id % 4 = 1 THEN ts END AS locked_at, ts AS created_at FROM events)"""


def _pagerank(rounds: int) -> str:
    """Unrolled rounds ``r0 .. r<rounds>`` over ``near``."""
    parts = ["deg AS MATERIALIZED (SELECT src AS key, count(*) AS n FROM near GROUP BY 1)", "r0 AS MATERIALIZED (SELECT key, 1.0::DOUBLE AS pr FROM deg)"]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT d.key, 0.15 + 0.85 * coalesce(s.got, 0) AS pr FROM deg d LEFT JOIN "
            f"(SELECT near.dst AS key, sum(pr / n) AS got FROM near JOIN r{i} r ON r.key = near.src JOIN deg ON deg.key = near.src GROUP BY 1) s USING (key))"
        )
    return ", ".join(parts)


def _pagerank_weighted(rounds: int) -> str:
    """Unrolled rounds ``w0 .. w<rounds>`` over ``pairs``, weighted and with dangling mass shared."""
    parts = [
        "ns AS MATERIALIZED (SELECT src AS key FROM pairs UNION SELECT dst FROM pairs)",
        "tot AS MATERIALIZED (SELECT src AS key, sum(weight) AS t FROM pairs GROUP BY 1)",
        "w0 AS MATERIALIZED (SELECT key, 1.0::DOUBLE / count(*) OVER () AS pr FROM ns)",
    ]
    for i in range(rounds):
        parts.append(
            f"w{i + 1} AS MATERIALIZED (SELECT key, 0.15 / (SELECT count(*) FROM ns) + 0.85 * coalesce((SELECT sum(pr) FROM w{i} ANTI JOIN tot USING (key)), 0) / (SELECT count(*) FROM ns)"
            f" + 0.85 * coalesce(got, 0) AS pr FROM ns LEFT JOIN (SELECT p.dst AS key, sum(pr * p.weight / t) AS got FROM pairs p JOIN w{i} w ON w.key = p.src JOIN tot ON tot.key = p.src GROUP BY 1) s USING (key))"
        )
    return ", ".join(parts)


_STARTS = "starts AS (SELECT DISTINCT src AS key FROM pairs ORDER BY key LIMIT 5)"
_WALKS = """
und AS (SELECT src, dst, weight, src * 1000000 + dst AS edge FROM pairs UNION ALL SELECT dst, src, weight, src * 1000000 + dst FROM pairs),
p1 AS (SELECT s.key AS seed, u.dst AS key, u.edge, 0.7::DOUBLE * u.weight AS product FROM starts s JOIN und u ON u.src = s.key),
p2 AS (SELECT p1.seed, u.dst AS key, p1.edge AS e1, u.edge AS e2, p1.product * 0.7::DOUBLE * u.weight AS product FROM p1 JOIN und u ON u.src = p1.key AND u.edge <> p1.edge),
p3 AS (SELECT p2.seed, u.dst AS key, p2.product * 0.7::DOUBLE * u.weight AS product FROM p2 JOIN und u ON u.src = p2.key AND u.edge <> p2.e1 AND u.edge <> p2.e2)"""

_TOKENS = "regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\x0b]+')"
_HASHED = f"""
t AS (SELECT doc_id, {_TOKENS} AS ws FROM {{source}}),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t WHERE len(ws) >= 3)),
hs AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT % {PRIME} AS h FROM sh)"""


def _slots(n: int) -> str:
    return ", ".join(f"min((h * {a} + {b}) % {PRIME}) AS s{i}" for i, (a, b) in enumerate(map(permutation, range(n))))


_BANDS = " UNION ALL ".join(f"SELECT doc_id, {i} AS band, [{', '.join(f's{j}' for j in range(8 * i, 8 * i + 8))}] AS k FROM sig" for i in range(16))
_SIMILAR = f"""
sig AS MATERIALIZED (SELECT doc_id, {_slots(128)} FROM hs GROUP BY doc_id),
arr AS MATERIALIZED (SELECT doc_id, [{', '.join(f's{i}' for i in range(128))}] AS s FROM sig),
bands AS MATERIALIZED ({_BANDS}),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.k = y.k AND x.doc_id < y.doc_id),
sim AS MATERIALIZED (SELECT a, b, len(list_filter(list_zip(x.s, y.s), lambda z: z[1] = z[2])) / 128.0::DOUBLE AS jaccard FROM cand JOIN arr x ON x.doc_id = a JOIN arr y ON y.doc_id = b)"""
_HEADS = "heads AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"
_CLUSTERS = (
    "WITH RECURSIVE "
    + _HEADS
    + ","
    + _HASHED.format(source="heads")
    + ","
    + _SIMILAR
    + """,
e AS MATERIALIZED (SELECT a, b FROM sim WHERE jaccard >= 0.85 UNION SELECT b, a FROM sim WHERE jaccard >= 0.85),
c AS (SELECT doc_id AS node, doc_id AS reach FROM heads UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reach),
rep AS (SELECT node, min(reach) AS representative FROM c GROUP BY node),
mem AS (SELECT d.doc_id, h.doc_id AS head, r.representative, count(*) OVER (PARTITION BY r.representative) AS members
        FROM documents d JOIN heads h USING (text) JOIN rep r ON r.node = h.doc_id),
clus AS (SELECT mem.doc_id, representative, members, CASE WHEN head = representative THEN 1.0::DOUBLE
    ELSE len(list_filter(list_zip(x.s, y.s), lambda z: z[1] = z[2])) / 128.0::DOUBLE END AS jaccard
  FROM mem LEFT JOIN arr x ON x.doc_id = head LEFT JOIN arr y ON y.doc_id = representative WHERE members > 1)"""
)
_ABBREVIATED = "|".join(a.replace(".", "\\.") for a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({x}), '[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f]', '', 'g'), '[^\\S\\n]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_NATIONS = """
hops AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, ((n_nationkey * 7 + 3) % 11) / 10.0::DOUBLE AS refd, 0 AS o FROM nation
         UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 11) % 25, ((n_nationkey * 7 + 11) % 11) / 10.0::DOUBLE, 1 FROM nation)"""

# Simple cycles from their least node: ways over greater nodes that come back to it, with the weakest edge on the way.
_CYCLES = _NATIONS + """,
e AS MATERIALIZED (SELECT src, dst, arg_min(refd, o) AS refd FROM hops WHERE src <> dst GROUP BY 1, 2),
w AS (SELECT [src] AS way, dst AS tip, {'refd': refd, 'src': src, 'dst': dst} AS weak FROM e WHERE dst > src
      UNION ALL SELECT list_append(way, tip), e.dst, least(weak, {'refd': e.refd, 'src': e.src, 'dst': e.dst}) FROM w JOIN e ON e.src = w.tip
      WHERE w.tip <> way[1] AND e.dst >= way[1] AND (e.dst = way[1] OR NOT list_contains(way, e.dst))),
closed AS (SELECT way, weak FROM w WHERE tip = way[1])"""
_MARKDOWN = "x"
for _pattern, _to in MARKDOWN:
    _MARKDOWN = "regexp_replace({}, '{}', '{}', 'g')".format(_MARKDOWN, _pattern.replace("(?dm)", "(?m)"), _to.replace("$", chr(92)))
_TYPED = """
typed AS (SELECT src, dst, 'CO_OCCURS_WITH' AS type, weight::DOUBLE AS weight FROM pairs UNION ALL SELECT src, dst, 'PREREQUISITE_OF', 1.0::DOUBLE FROM prereq),
und AS (SELECT *, concat_ws(':', src, dst, type) AS edge FROM typed UNION ALL SELECT dst, src, type, weight, concat_ws(':', src, dst, type) FROM typed)"""
_SEARCHED = f"""
sig AS MATERIALIZED (SELECT key, {_COS.format(a='embedding', b='q.e')} AS sigma FROM nodes, q WHERE embedding IS NOT NULL),
sd AS MATERIALIZED (SELECT key FROM sig ORDER BY sigma DESC, key DESC LIMIT 5),
w1 AS (SELECT u.dst AS key, u.edge AS e1, 0.7::DOUBLE * u.weight AS product FROM sd JOIN und u ON u.src = sd.key),
w2 AS (SELECT u.dst AS key, w1.product * 0.7::DOUBLE * u.weight AS product FROM w1 JOIN und u ON u.src = w1.key AND u.edge <> w1.e1),
allways AS (SELECT key, product FROM w1 UNION ALL SELECT key, product FROM w2),
found AS MATERIALIZED (SELECT key, sum(product * sigma) AS activation FROM allways JOIN sig USING (key) WHERE sigma >= 0.25 GROUP BY key ORDER BY 2 DESC, key LIMIT 50)"""

ORACLES: dict[str, str] = {
    "semantic_search": f"WITH {_QUERY} SELECT v.vec_id AS chunk_id, v.vec_id AS document_id, coalesce(d.text[1:40], 'Unknown') AS document_title, "
    f"round(greatest(0, least(1, {_COS.format(a='v.embedding', b='q.e')})), 6) AS score, coalesce(d.text[1:240], '') AS preview, v.label AS category "
    "FROM embeddings v, q LEFT JOIN documents d ON d.doc_id = v.vec_id WHERE v.vec_id <> 0 AND v.vec_id % 20 = 0 ORDER BY "
    f"greatest(0, least(1, {_COS.format(a='v.embedding', b='q.e')})) DESC, v.vec_id LIMIT 10",
    "semantic_search_in_category": f"WITH {_QUERY} SELECT v.vec_id AS chunk_id, v.vec_id AS document_id, coalesce(d.text[1:40], 'Unknown') AS document_title, "
    f"round(greatest(0, least(1, {_COS.format(a='v.embedding', b='q.e')})), 6) AS score, coalesce(d.text[1:240], '') AS preview, v.label AS category "
    "FROM embeddings v, q LEFT JOIN documents d ON d.doc_id = v.vec_id WHERE v.vec_id <> 0 AND v.vec_id % 20 = 0 AND v.label = 5 ORDER BY "
    f"greatest(0, least(1, {_COS.format(a='v.embedding', b='q.e')})) DESC, v.vec_id LIMIT 5",
    "document_page": "SELECT doc_id AS id, source AS user_id, lang AS category, text[1:40] AS title, (SELECT count(*) FROM documents WHERE source = 'src3' AND lang = 'en') AS total "
    "FROM documents WHERE source = 'src3' AND lang = 'en' ORDER BY doc_id DESC OFFSET 10 LIMIT 10",
    "outbox_summary": f"WITH {_OUTBOX} SELECT s AS status, count(id) AS n FROM (SELECT unnest(['PENDING', 'PROCESSING', 'FAILED']) AS s) LEFT JOIN ob ON status = s GROUP BY s",
    "exact_duplicates": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative, count(*) OVER (PARTITION BY text) AS members FROM documents",
    "minhash_signatures": f"WITH {_HASHED.format(source='documents')}, sig AS (SELECT doc_id, {_slots(128)} FROM hs GROUP BY doc_id) "
    f"SELECT doc_id, concat_ws(',', {', '.join(f's{i}' for i in range(128))}) AS signature FROM sig",
    "lsh_pairs": None,
    "duplicate_clusters": _CLUSTERS + " SELECT * FROM clus",
    "duplicate_edges": _CLUSTERS + " SELECT doc_id AS src, representative AS dst, 'DUPLICATE_OF' AS type FROM clus WHERE doc_id <> representative",
    "shingle_counts": f"WITH {_HASHED.format(source='documents')} SELECT d.doc_id, count(s) AS n_shingles FROM documents d LEFT JOIN sh USING (doc_id) GROUP BY 1",
    "clean_texts": "WITH a AS (SELECT doc_id, " + _CLEAN.format(x="text") + " AS x FROM documents), "
    "b AS (SELECT doc_id, regexp_replace(x, '(\\b[A-Za-z]{2,})-\\n([A-Za-z]{2,}\\b)', '\\1\\2', 'g') AS x FROM a), "
    "c AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?m)^\\s*\\d{1,4}\\s*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS x FROM b) "
    "SELECT doc_id, sha256(" + _CLEAN.format(x="x") + ") AS clean_sha FROM c",
    "sentence_counts": f"WITH a AS (SELECT doc_id, regexp_replace(text, '(^|[^\\pL\\pN_])({_ABBREVIATED})\\.', '\\1\\2' || chr(1), 'gi') AS x FROM documents), "
    "b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(x, '([.!?])\\s+([A-Z\"])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13))), lambda s: s <> '') AS s FROM a) "
    "SELECT doc_id, len(s)::BIGINT AS n_sentences, list_max(list_transform(s, lambda x: length(x)))::BIGINT AS longest FROM b",
    "entity_keys": "SELECT p_partkey, 'concept:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS entity_key FROM part",
    "upload_kinds": "WITH a AS (SELECT doc_id, text, doc_id % 8 AS e, doc_id % 3 AS h FROM documents) SELECT doc_id, "
    "CASE WHEN h = 0 THEN 'pdf' WHEN h = 2 THEN 'image' WHEN e = 0 THEN 'pdf' WHEN e = 1 THEN 'docx' WHEN e = 2 THEN 'md' WHEN e = 3 THEN 'image' WHEN e = 7 THEN 'bookmark' ELSE 'txt' END AS kind, "
    "CASE WHEN h = 0 THEN 'application/pdf' WHEN e = 0 THEN 'application/pdf' WHEN e = 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' "
    "WHEN e = 2 THEN 'text/markdown' WHEN e = 3 THEN 'image/png' WHEN e = 7 THEN 'text/html' WHEN h = 2 THEN 'image/png' ELSE 'text/plain' END AS mime, "
    "sha256(['%PDF', 'plain', 'GIF8'][(h + 1)::INT] || text) AS content_sha256 FROM a",
    "conversation_texts": "SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS text_sha, count(*) AS n_parts FROM conversations GROUP BY 1",
    "chunk_boundaries": "WITH u AS (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), "
    "d AS (SELECT label, vec_id, 1 - list_dot_product(v, lead(v) OVER (PARTITION BY label ORDER BY vec_id)) AS distance FROM u), "
    "t AS (SELECT *, quantile_cont(distance, 0.85) OVER (PARTITION BY label) AS tau FROM d) "
    "SELECT label, vec_id, round(distance, 6) AS distance, round(tau, 6) AS tau, coalesce(sum((distance > tau)::INT) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp FROM t",
    "technology_cooccurrence": "WITH m AS (SELECT DISTINCT l_orderkey AS chunk, l_suppkey AS key FROM lineitem) "
    "SELECT a.key AS src, b.key AS dst, count(*) AS weight FROM m a JOIN m b ON a.chunk = b.chunk AND a.key < b.key GROUP BY 1, 2",
    "concept_neighbourhoods": f"WITH {_PAIRS} SELECT src AS key, count(*) AS neighbours, min(dst) AS first, max(dst) AS last FROM near GROUP BY 1",
    "prerequisite_edges": f"WITH {_PREREQ} SELECT src, dst, round(refd, 6) AS refd FROM prereq",
    "orphan_entities": f"WITH {_PAIRS} SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT src FROM near)",
    "alias_merges": "WITH a AS (SELECT 'n' || p_partkey AS key, coalesce(['k8s', 'kubernetes', 'kube', 'js', 'javascript', 'rust', 'postgres', 'pg', 'sklearn', NULL][(p_partkey % 10 + 1)::INT], trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_')) AS slug FROM part), "
    "n AS (SELECT key, 'technology:' || CASE WHEN slug IN ('k8s', 'kube') THEN 'kubernetes' WHEN slug = 'js' THEN 'javascript' WHEN slug IN ('postgres', 'pg') THEN 'postgresql' WHEN slug = 'sklearn' THEN 'scikit_learn' ELSE slug END AS to_ FROM a) "
    "SELECT key, to_ AS \"to\" FROM n QUALIFY count(*) OVER (PARTITION BY to_) > 1",
    "similar_entities": "WITH s AS (SELECT a.vec_id AS key, b.vec_id AS other, " + _COS.format(a="a.embedding", b="b.embedding") + " AS similarity "
    "FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, other) AS rn FROM s WHERE similarity >= 0.25) "
    "SELECT key, other, round(similarity, 6) AS similarity FROM r WHERE rn <= 5",
    "embedding_merges": "WITH RECURSIVE s AS (SELECT a.vec_id AS key, b.vec_id AS other, " + _COS.format(a="a.embedding", b="b.embedding") + " AS similarity "
    "FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, other) AS rn FROM s WHERE similarity >= 0.3), "
    "e AS MATERIALIZED (SELECT key, other FROM r WHERE rn <= 5 UNION SELECT other, key FROM r WHERE rn <= 5), "
    "c AS (SELECT key AS node, key AS reach FROM e UNION SELECT c.node, e.other FROM c JOIN e ON e.key = c.reach) "
    "SELECT node AS key, min(reach) AS \"to\" FROM c GROUP BY node HAVING min(reach) <> node",
    "merged_edges": f"WITH {_PAIRS}, w AS (SELECT CASE WHEN src % 10 = 3 THEN src - 1 ELSE src END AS src, CASE WHEN dst % 10 = 3 THEN dst - 1 ELSE dst END AS dst, weight FROM pairs) "
    "SELECT src, dst, max(weight) AS weight FROM w WHERE src <> dst GROUP BY 1, 2",
    "pagerank": f"WITH {_PAIRS}, {_pagerank(20)} SELECT key, round(pr, 6) AS pagerank FROM r20",
    "central_concepts": f"WITH {_PAIRS}, {_pagerank(20)} SELECT key, round(pr, 6) AS pagerank FROM r20 ORDER BY 2 DESC, 1 LIMIT 20",
    "pagerank_weighted": f"WITH {_PAIRS}, {_pagerank_weighted(40)} SELECT key, round(pr, 7) AS pagerank FROM w40",
    "learning_gaps": f"WITH {_PREREQ.replace('deg AS (', 'deg_ AS (').replace('JOIN deg ', 'JOIN deg_ ')}, {_pagerank(20)}, st AS (SELECT DISTINCT m.key FROM m JOIN orders ON o_orderkey = chunk WHERE o_custkey % 100 = 7) "
    "SELECT src AS concept_key, count(DISTINCT dst) AS dependents, coalesce(round(max(pr), 6), 0.0) AS pagerank FROM prereq LEFT JOIN r20 ON r20.key = src "
    "WHERE dst IN (FROM st) AND src NOT IN (FROM st) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10",
    "learning_path": f"WITH RECURSIVE {_PREREQ.replace('prereq AS (', 'prereq AS MATERIALIZED (')}, target AS (SELECT dst FROM prereq GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), "
    "anc AS (SELECT dst AS key FROM target UNION SELECT p.src FROM prereq p JOIN anc ON p.dst = anc.key), "
    "e AS MATERIALIZED (SELECT src, dst FROM prereq WHERE src IN (FROM anc) AND dst IN (FROM anc)), "
    "lv AS (SELECT key, 0 AS level FROM anc WHERE key NOT IN (SELECT dst FROM e) UNION SELECT e.dst, lv.level + 1 FROM lv JOIN e ON e.src = lv.key) "
    "SELECT key, max(level) AS level, false AS has_cycle FROM lv GROUP BY 1",
    "prerequisite_chains": f"WITH {_PREREQ.replace('prereq AS (', 'prereq AS MATERIALIZED (')} SELECT 1 AS length, count(*) AS chains FROM prereq "
    "UNION ALL SELECT 2, count(*) FROM prereq a JOIN prereq b ON b.src = a.dst HAVING count(*) > 0 "
    "UNION ALL SELECT 3, count(*) FROM prereq a JOIN prereq b ON b.src = a.dst JOIN prereq c ON c.src = b.dst HAVING count(*) > 0 "
    "UNION ALL SELECT 4, count(*) FROM prereq a JOIN prereq b ON b.src = a.dst JOIN prereq c ON c.src = b.dst JOIN prereq d ON d.src = c.dst HAVING count(*) > 0",
    "entity_neighbours": f"WITH {_PAIRS}, a AS (SELECT dst AS key, 1 AS hops FROM near WHERE src = 1 UNION ALL SELECT y.dst, 2 FROM near x JOIN near y ON y.src = x.dst WHERE x.src = 1) "
    "SELECT key, min(hops) AS hops FROM a WHERE key <> 1 GROUP BY 1 ORDER BY 2, 1 LIMIT 50",
    "graph_overview": f"WITH {_PAIRS} SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS documents, (SELECT count(*) FROM part) AS concepts, (SELECT count(*) FROM supplier) AS technologies, (SELECT count(*) FROM pairs) AS edges",
    "search_seeds": f"WITH {_QUERY}, {_NODES} SELECT key, round({_COS.format(a='embedding', b='q.e')}, 6) AS score FROM nodes, q WHERE embedding IS NOT NULL ORDER BY {_COS.format(a='embedding', b='q.e')} DESC, key DESC LIMIT 5",
    "graph_activation": f"WITH {_PAIRS}, {_QUERY}, {_NODES}, {_STARTS}, {_WALKS}, s AS (SELECT seed, key, sum(product) AS strength FROM (SELECT seed, key, product FROM p1 UNION ALL SELECT seed, key, product FROM p2 UNION ALL FROM p3) GROUP BY 1, 2), "
    f"g AS (SELECT key, {_COS.format(a='embedding', b='q.e')} AS sigma FROM nodes, q WHERE embedding IS NOT NULL) "
    "SELECT seed, key, round(strength * sigma, 6) AS activation FROM s JOIN g USING (key) WHERE sigma >= 0.25 ORDER BY strength * sigma DESC, seed, key LIMIT 50",
    "reach_activation": f"WITH {_PAIRS}, {_QUERY}, {_NODES}, {_STARTS}, n1 AS (SELECT DISTINCT dst AS key FROM near WHERE src IN (FROM starts)), n2 AS (SELECT key FROM n1 UNION SELECT dst FROM near WHERE src IN (FROM n1)), n3 AS (SELECT key FROM n2 UNION SELECT dst FROM near WHERE src IN (FROM n2)), "
    f"g AS (SELECT key, {_COS.format(a='embedding', b='q.e')} AS sigma FROM nodes, q WHERE embedding IS NOT NULL) "
    "SELECT key, round(sigma * 0.7, 6) AS activation FROM g WHERE sigma >= 0.25 AND key IN (FROM n3) ORDER BY sigma DESC, key LIMIT 50",
    "induced_edges": f"WITH {_PAIRS} SELECT src, dst, weight::DOUBLE AS weight FROM pairs WHERE src % 3 = 0 AND dst % 3 = 0",
    "retrieval_evaluation": "WITH s AS (SELECT a.vec_id AS q, b.vec_id AS id, a.label = b.label AS rel, round(" + _COS.format(a="b.embedding", b="a.embedding") + ", 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10), "
    "p AS (SELECT q, max((rel AND rank <= 1)::INT) AS h1, max((rel AND rank <= 5)::INT) AS h5, max(rel::INT) AS h10, max(CASE WHEN rel THEN 1.0::DOUBLE / rank ELSE 0 END) AS rr, "
    "sum(CASE WHEN rel THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg, sum(rel::INT) AS n FROM r GROUP BY q) "
    "SELECT round(avg(h1), 6) AS hit_at_1, round(avg(h5), 6) AS hit_at_5, round(avg(h10), 6) AS hit_at_10, round(avg(rr), 6) AS mrr, "
    "round(avg(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n::INT + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) ELSE 0 END), 6) AS ndcg_at_10 FROM p",
    "claimed_events": f"WITH {_OUTBOX} SELECT id, event_type FROM ob WHERE status = 'PENDING' ORDER BY created_at, id LIMIT 100",
    "reclaimed_events": f"WITH {_OUTBOX}, r AS (SELECT *, coalesce(status = 'PROCESSING' AND locked_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTES, false) AS stuck FROM ob) "
    "SELECT CASE WHEN stuck THEN 'PENDING' ELSE status END AS status, count(*) AS n, count(CASE WHEN NOT stuck THEN locked_at END) AS locked FROM r GROUP BY 1",
    "retried_events": f"WITH {_OUTBOX} SELECT id, CASE WHEN retry_count + 1 >= max_retries THEN 'FAILED' ELSE 'PENDING' END AS status, retry_count + 1 AS retry_count, 2000 AS error_chars FROM ob WHERE status = 'PROCESSING'",
    "routed_tasks": f"WITH {_OUTBOX}, r AS (SELECT 'document.uploaded' AS event_type, 'ingest_document' AS task UNION ALL SELECT 'document.text_ready', 'chunk_document' UNION ALL SELECT 'document.chunked', unnest(['classify_chunks', 'extract_triples', 'detect_duplicates']) "
    "UNION ALL SELECT 'document.deleted', 'purge_document') SELECT event_type, task, count(*) AS n FROM ob JOIN r USING (event_type) GROUP BY 1, 2",
    "latest_statuses": "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "windowed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "user_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), "
    "b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n FROM b GROUP BY user_id, s",
    "replay_items": "WITH a AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000) SELECT event_type AS label, count(*) AS n, min(event_id) AS first_id FROM a GROUP BY 1",
    "replay_draw": "SELECT event_id AS id, event_type AS label FROM events ORDER BY md5(event_id || ':0'), event_id LIMIT 64",
    "balanced_weights": "SELECT event_type, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM events GROUP BY 1",
    "upserted_users": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "replaced_chunks": "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber <= 2) "
    "OR (l_orderkey % 5 = 0 AND l_linenumber <= 2) GROUP BY 1",
    "updated_documents": "SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'xx' ELSE lang END AS lang, source FROM documents d LEFT JOIN labels USING (doc_id)",
    "merged_nodes": "SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)",
    "purged_orders": "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0) GROUP BY 1",
    "purged_graph": f"WITH {_PAIRS} SELECT src, dst, weight FROM pairs WHERE src % 4 <> 1 AND dst % 4 <> 1",
    "vector_rows": "SELECT doc_id AS chunk_id, CASE WHEN lang = 'fr' THEN '' ELSE lang END AS category, source AS user_id, text[1:240] AS preview, len(embedding)::BIGINT AS dimensions FROM documents JOIN embeddings ON vec_id = doc_id",
    "studied_concepts": "SELECT o_custkey AS user_id, count(DISTINCT l_partkey) AS concepts FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "events_in_pages": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 5",
    "graph_cycles": f"WITH RECURSIVE {_CYCLES} SELECT concat_ws('>', array_to_string(way, '>'), way[1]) AS cycle, weak.refd AS refd FROM closed",
    "broken_cycles": f"WITH RECURSIVE {_CYCLES} SELECT src, dst FROM e ANTI JOIN (SELECT DISTINCT weak.src AS src, weak.dst AS dst FROM closed) USING (src, dst)",
    "markdown_texts": "WITH a AS (SELECT doc_id, '# Head' || chr(10) || '**bold** ***very*** `code` [link](http://x) ![i](y) __u__ ```a' || chr(10) || 'b``` ' || text AS x FROM documents) "
    f"SELECT doc_id, sha256({_MARKDOWN}) AS text_sha FROM a",
    "entity_neighbourhood": f"WITH {_PREREQ}, {_TYPED}, n AS (SELECT dst AS key, type, weight, 1 AS hops FROM und WHERE src = 1 UNION ALL "
    "SELECT y.dst, y.type, y.weight, 2 FROM und x JOIN und y ON y.src = x.dst AND y.edge <> x.edge WHERE x.src = 1), "
    "g AS (SELECT key, type, weight, min(hops) AS hops FROM n GROUP BY 1, 2, 3) "
    "SELECT key, 'Concept' AS label, p_name AS name, p_retailprice AS pagerank, type AS relationship_type, weight AS relationship_weight, hops FROM g JOIN part ON p_partkey = key ORDER BY hops, key, type LIMIT 50",
    "graph_search_nodes": f"WITH {_PREREQ}, {_TYPED}, {_QUERY}, {_NODES}, {_SEARCHED} SELECT key, 'Concept' AS label, p_name AS name, round(activation, 6) AS activation, p_retailprice AS pagerank, false AS degraded FROM found JOIN part ON p_partkey = key",
    "graph_search_edges": f"WITH {_PREREQ}, {_TYPED}, {_QUERY}, {_NODES}, {_SEARCHED} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, type, max(weight) AS weight FROM typed "
    "WHERE src IN (SELECT key FROM found) AND dst IN (SELECT key FROM found) GROUP BY 1, 2, 3",
    "neighbour_f1": "WITH s AS (SELECT a.vec_id AS q, a.label AS w, b.label AS g, b.vec_id AS id, round(" + _COS.format(a="b.embedding", b="a.embedding") + ", 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), "
    "r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) = 1), c AS (SELECT w AS c FROM r UNION SELECT g FROM r), "
    "f AS (SELECT c, 2.0::DOUBLE * (SELECT count(*) FROM r WHERE w = c AND g = c) / ((SELECT count(*) FROM r WHERE w = c) + (SELECT count(*) FROM r WHERE g = c)) AS f1 FROM c) SELECT round(avg(f1), 6) AS classification_f1 FROM f",
    "received_uploads": "WITH a AS (SELECT doc_id, text, octet_length(encode(text))::BIGINT AS byte_size FROM documents) SELECT doc_id, byte_size, CASE WHEN byte_size = 0 THEN 400 WHEN byte_size > 3000 THEN 413 ELSE 201 END AS code, "
    "CASE WHEN byte_size BETWEEN 1 AND 3000 THEN sha256(text) END AS content_sha256 FROM a",
    "emitted_events": "SELECT substr(sha256('document.uploaded:' || doc_id), 1, 32) AS id, 'document.uploaded' AS event_type, doc_id::VARCHAR AS document_id, source AS user_id, 'PENDING' AS status, 0 AS retry_count, 5 AS max_retries FROM documents",
    "marked_events": f"WITH {_OUTBOX}, c AS (SELECT id FROM ob WHERE status = 'PENDING' ORDER BY created_at, id LIMIT 100), m AS (SELECT id, id IN (FROM c) AS taken, CASE WHEN id IN (FROM c) THEN 'PROCESSING' ELSE status END AS status FROM ob) "
    "SELECT status, count(*) AS n, count(*) FILTER (taken) AS locked_now, min(id) AS first_id FROM m GROUP BY 1",
    "completed_events": f"WITH {_OUTBOX} SELECT event_type, CASE WHEN status = 'PROCESSING' AND (id % 3 = 0 OR event_type = 'document.indexed') THEN 'COMPLETED' ELSE status END AS status, count(*) AS n FROM ob GROUP BY 1, 2",
    "task_retries": f"WITH {_OUTBOX}, r AS (SELECT 'document.uploaded' AS event_type, 'ingest_document' AS task UNION ALL SELECT 'document.text_ready', 'chunk_document' UNION ALL SELECT 'document.chunked', unnest(['classify_chunks', 'extract_triples', 'detect_duplicates']) "
    "UNION ALL SELECT 'document.deleted', 'purge_document'), t AS (SELECT task, retry_count AS retries, id % 2 = 1 AS bad FROM ob JOIN r USING (event_type) WHERE status = 'PROCESSING') "
    "SELECT task, CASE WHEN NOT bad THEN 'COMPLETED' WHEN retries < 5 THEN 'PENDING' ELSE 'FAILED' END AS status, retries, count(*) AS n, max(CASE WHEN bad AND retries < 5 THEN (2 ** retries)::BIGINT END) AS wait_s FROM t GROUP BY 1, 2, 3",
    "document_states": "WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS had, doc_id % 3 <> 0 AS tried, doc_id % 7 = 0 AS bad, [1, 2, 3, NULL][(doc_id % 4 + 1)::INT] AS reached, length(text)::INT AS chars FROM documents) "
    "SELECT doc_id AS id, CASE WHEN tried AND bad THEN 'FAILED' ELSE ['UPLOADED', 'EXTRACTED', 'CHUNKED', 'INDEXED'][greatest(had, CASE WHEN tried THEN coalesce(reached, 0) ELSE 0 END) + 1] END AS status, "
    "CASE WHEN tried AND bad THEN 'no text' END AS error_log, CASE WHEN tried AND NOT bad THEN chars END AS extracted_chars FROM a",
    "one_document": "SELECT doc_id AS id, source AS user_id, lang AS category, text[1:40] AS title FROM documents WHERE source = 'src3' AND doc_id = 3",
    "attached_clusters": "WITH RECURSIVE " + _HEADS + "," + _HASHED.format(source="heads") + "," + _SIMILAR + """,
e AS MATERIALIZED (SELECT a, b FROM sim WHERE jaccard >= 0.85 UNION SELECT b, a FROM sim WHERE jaccard >= 0.85),
c AS (SELECT a AS node, a AS reach FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reach),
r AS (SELECT node, min(reach) AS representative FROM c GROUP BY node) SELECT node AS doc_id, representative, count(*) OVER (PARTITION BY representative) AS members FROM r""",
}
ORACLES["lsh_pairs"] = f"WITH {_HEADS}, {_HASHED.format(source='heads')}, {_SIMILAR} SELECT a, b, jaccard FROM sim WHERE jaccard >= 0.85"

# The first line of an order is a verb, the second its subject; a phrase from the third line on takes the fourth too.
_PARSED = (
    "l AS (SELECT l_orderkey AS o, l_linenumber AS line, min((l_partkey, l_suppkey, l_returnflag)) AS x FROM lineitem GROUP BY 1, 2), "
    "t AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY line) AS n, 'Part ' || x[1] AS text, lower(x[3]) AS lemma, x[1] % 3 AS dep, "
    "CASE x[2] % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Project' ELSE 'Concept' END AS label FROM l), "
    "p AS (SELECT *, CASE WHEN n = 3 THEN concat_ws(' ', text, lead(text) OVER (PARTITION BY o ORDER BY n)) ELSE text END AS phrase FROM t)"
)
ORACLES["parsed_triples"] = (
    f"WITH {_PARSED} SELECT v.o AS sentence_id, s.phrase AS subject, v.lemma AS verb, x.phrase AS object, s.label AS subj_type, x.label AS obj_type "
    "FROM p v JOIN p s ON s.o = v.o AND s.n = 2 JOIN p x ON x.o = v.o AND x.n > 2 AND x.dep < 2 WHERE v.n = 1"
)
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LONG = r"'  ' || text || chr(10) || chr(10) || ' ' || chr(9) || text || chr(10)"
ORACLES["resolved_texts"] = (
    f"WITH a AS (SELECT doc_id, {_LONG} AS x FROM documents) SELECT doc_id, sha256(CASE WHEN length(x) > 8000 "
    f"THEN array_to_string(list_transform(string_split(x, chr(10) || chr(10)), lambda p: {_STRIP.format('p')}), chr(10) || chr(10)) ELSE {_STRIP.format('x')} END) AS resolved_sha FROM a"
)
ORACLES["structure_edges"] = (
    "SELECT 'document:' || l_orderkey AS src, 'chunk:' || l_orderkey || '-' || l_linenumber AS dst, 'HAS_CHUNK' AS type, l_linenumber AS chunk_index, 'Chunk' AS label FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"
)
ORACLES["self_training_rows"] = "SELECT doc_id, quality::VARCHAR AS category, (doc_id % 10)::DOUBLE / 10 AS category_conf FROM labels WHERE doc_id % 10 >= 6"
ORACLES["corrected_categories"] = (
    "SELECT doc_id, CASE WHEN toxic = 1 THEN 'Personal' ELSE lang END AS category, CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS category_conf FROM documents LEFT JOIN labels USING (doc_id)"
)
_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
ORACLES["resolved_aliases"] = (
    f"WITH al(n, alias, goes_by) AS (VALUES {_VALUES((i, a, b) for i, (a, b) in enumerate(ALIASES.items()))}), te(i, name) AS (VALUES {_VALUES(enumerate(TECHNOLOGIES))}), "
    f"k AS (SELECT {_SLUG.format('name')} AS slug, arg_max(name, i) AS name FROM te GROUP BY 1), s AS (SELECT n, alias, {_SLUG.format('goes_by')} AS slug FROM al) "
    f"SELECT p_partkey, alias, s.slug, k.name IS NOT NULL AS technology, coalesce(k.name, alias) AS display FROM part JOIN s ON n = p_partkey % {len(ALIASES)} LEFT JOIN k ON k.slug = s.slug"
)
ORACLES["account_fields"] = "SELECT c_custkey, lower(c_name || '@Mail.Example') AS email, c_name AS display_name FROM customer"
ORACLES["camel_rows"] = 'SELECT c_custkey AS "cCustkey", c_name AS "cName", c_nationkey AS "cNationkey", c_acctbal AS "cAcctbal" FROM customer'
ORACLES["packed_numbers"] = (
    "WITH a AS (SELECT l_orderkey, list_sort(list(-l_partkey::BIGINT * 1000003)) AS v FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey, array_to_string(list_transform(v, lambda x: lower(lpad(hex(x), 16, '0'))), '') AS packed_hex, array_to_string(v, ',') AS unpacked FROM a"
)
ORACLES["status_lines"] = (
    "SELECT o_orderkey, 'data: {\"document_id\":' || o_orderkey || ',\"status\":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || '}' || chr(10) || chr(10) AS line FROM orders"
)
ORACLES["merged_edges_by_type"] = (
    "WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, min(CASE WHEN l_linenumber = 1 THEN l_orderkey END) AS a, min(l_orderkey) AS b FROM lineitem GROUP BY 1, 2) SELECT src, dst, 'MENTIONS' AS type, coalesce(a, b) AS chunk FROM e"
)
ORACLES["sidecar_texts"] = (
    "SELECT doc_id AS id, lang, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS text_sha, CASE WHEN doc_id % 3 = 0 OR text IS NULL THEN 'no extracted text for ' || doc_id END AS error FROM documents"
)
