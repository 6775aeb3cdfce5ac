"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = r"[\x20\x09-\x0D]+"

OP9 = rf"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


def _apportion(name: str, children: str, parent: str, order: str, claim: str, seats: str) -> str:
    """Common table expressions that end in ``name``: ``children`` with the column ``quota``."""
    return f"""
{name}_a AS (SELECT *, (sum({claim}) OVER (PARTITION BY {parent}))::DOUBLE AS all_, {seats} AS seats_ FROM {children}),
{name}_b AS (SELECT *, CASE WHEN all_ > 0 THEN floor({claim}::DOUBLE * seats_ / all_ + 0.5)::BIGINT ELSE 0 END AS near_ FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN all_ > 0 THEN seats_ - sum(near_) OVER (PARTITION BY {parent}) ELSE 0 END AS short_ FROM {name}_b),
{name}_d AS (SELECT *, unnest(range(1, CASE WHEN short_ = 0 OR {claim} <= 0 THEN 1
               ELSE ceil({claim} / all_ * abs(short_))::INT + 2 END)) AS k_ FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN short_ > 0 THEN -({claim}::DOUBLE / (2 * (near_ + k_) - 1))
               WHEN k_ <= near_ THEN {claim}::DOUBLE / (2 * (near_ - k_) + 1) END AS q_ FROM {name}_d),
{name}_f AS (SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY q_, {order}, k_) AS r_ FROM {name}_e WHERE q_ IS NOT NULL),
{name}_g AS (SELECT {parent}, {order}, sum(sign(short_))::BIGINT AS moved_ FROM {name}_f WHERE r_ <= abs(short_) GROUP BY {parent}, {order}),
{name} AS (SELECT c.*, c.near_ + coalesce(g.moved_, 0) AS quota FROM {name}_c c LEFT JOIN {name}_g g USING ({parent}, {order}))"""


# Two levels of the shard tree, which is the whole tree up to 64 * 64 shards of a source.
OP7 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-shard:' || doc_id::VARCHAR), 1, 8))::BIGINT AS u,
         md5('mix-order:' || doc_id::VARCHAR) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM s),
w AS (SELECT *, [5, 2, 1][((source_no - 1) % 3 + 1)::INT]::BIGINT AS weight FROM r),
f AS (SELECT *, row_number() OVER o AS row_,
        (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::BIGINT AS words_,
        (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS weights_
      FROM w WINDOW o AS (ORDER BY source_size * 3 / weight, source_no),
        b AS (ORDER BY source_size * 3 / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(row_) AS open_, arg_min(words_, row_) AS lw, arg_min(weights_, row_) AS lv
      FROM f WHERE words_ * weight < 3 * source_size * weights_),
t AS (SELECT source, source_no, source_size,
        CASE WHEN open_ IS NULL OR row_ < open_ THEN (3 * source_size)::DOUBLE
             ELSE lw::DOUBLE * weight::DOUBLE / lv::DOUBLE END AS target,
        greatest(1, ceil(source_size / 16384), ceil(source_rows / 16384))::BIGINT AS shards, 1 AS one_,
        floor((sum(source_size) OVER ()) / 16 + 0.5)::BIGINT AS blocks FROM f, l),
{_apportion("ts", "t", "one_", "source_no", "target", "blocks")},
p AS (SELECT d.doc_id, d.size, d.o, ts.source_no, ts.source_size, ts.target, (d.u * ts.shards) >> 32 AS shard
      FROM d JOIN ts ON d.source IS NOT DISTINCT FROM ts.source),
h AS (SELECT source_no, shard, (shard // 64)::BIGINT AS top, sum(size)::BIGINT AS words FROM p GROUP BY 1, 2, 3),
h1 AS (SELECT h.source_no, h.top, any_value(ts.quota) AS seats, sum(h.words)::BIGINT AS words
       FROM h JOIN ts USING (source_no) GROUP BY 1, 2),
{_apportion("q1", "h1", "source_no", "top", "words", "seats")},
h2 AS (SELECT h.source_no, h.top, h.shard, h.words, q1.quota AS seats FROM h JOIN q1 USING (source_no, top)),
{_apportion("q2", "h2", "source_no, top", "shard", "words", "seats")},
e AS (SELECT p.*, q2.words, least(q2.quota * 16, 3 * q2.words) AS take,
        sum(p.size) OVER (PARTITION BY p.source_no, p.shard ORDER BY p.o, p.doc_id, p.size DESC ROWS UNBOUNDED PRECEDING) AS end_
      FROM p JOIN q2 USING (source_no, shard))
SELECT doc_id, size, source_size, target,
  (CASE WHEN words = 0 THEN 0 ELSE (take // words) * size
     + greatest(0, least(end_, take % words) - (end_ - size)) END)::BIGINT AS taken
FROM e
"""

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 3], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reach) AS component_id FROM c GROUP BY node) m USING (doc_id)
"""

OP6 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 18, 1))) AS s, ws FROM w),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS k FROM x),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE nth > 1),
a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP10 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
t AS (SELECT doc_id, n, i, x[2000 * i + 1:2000 * i + 2198] AS x FROM (SELECT *, unnest(range(0, greatest(n - 99, 0) // 1000 + 1)) AS i FROM b)),
h AS (SELECT doc_id, 1000 * i + j AS s, md5(x[2 * j + 1:2 * j + 200]) AS k
      FROM (SELECT doc_id, i, x, unnest(range(0, greatest(least(1000, n - 99 - 1000 * i), 0))) AS j FROM t)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM h),
d AS (SELECT doc_id, s, s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 AS joined FROM r WHERE nth > 1),
g AS (SELECT doc_id, s, count(*) FILTER (joined IS NOT TRUE) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM d),
c AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z FROM c UNION ALL SELECT doc_id, 0, 0 FROM b),
f AS (SELECT doc_id, a, z, lead(a, 1, 9223372036854775807) OVER (PARTITION BY doc_id ORDER BY a, z) AS until FROM e),
k AS (SELECT doc_id, sum(f.z - f.a)::BIGINT AS gone, count(*) FILTER (f.z > 0) AS spans,
        string_agg(x[2 * f.z + 1:2 * least(f.until, n)], '' ORDER BY f.a, f.z) AS kept FROM f JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, gone AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM b JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": OP1, "op6_substring_dedup": OP6, "op10_suffix_dedup": OP10, "op7_mix_sources": OP7, "op9_exact_dedup": OP9}
