"""Small cases of the engine's own operators, with results worked out by hand."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import records
from loomgraph.functions import names
from loomgraph.functions import text as T
from loomgraph.functions import vector as V
from loomgraph.operators import chunking, classify, dedup, graph, nearest, relational, search, triples
from loomgraph.operators.components import connected_components
from loomgraph.plans import queries
from loomgraph.sources import files, sinks
from loomgraph.storage import Scratch, dealt_by_rows, in_small_files, materialise, read_by_rows
from loomgraph.streaming import outbox


def values(spark, column, *rows, name="x"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[1] for r in df.select("i", column).orderBy("i").collect()]


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_slug(spark):
    got = values(spark, T.slug(F.col("x")), "K8s ", "K8s", "PostgreSQL", "Docker, Inc.", "C++", "日本", None)
    assert got == ["k8s", "k8s", "postgresql", "docker_inc", "c", "", None]
    assert values(spark, T.entity_key(F.lit("Technology"), F.col("x")), "Kubernetes") == ["technology:kubernetes"]


def test_normalise_is_idempotent(spark):
    raw = ["a​ b\t\tc\n\n\n\nd ", "ﬁne é", "", "\x01x y"]
    once = values(spark, T.normalise(F.col("x")), *raw)
    assert once == ["a b c\n\nd", "fine é", "", "x y"]
    assert values(spark, T.normalise(F.col("x")), *once) == once


def test_clean_text(spark):
    got = values(spark, T.clean_text(F.col("x")), "exam-\nple text", "one\n 12 \ntwo", "a\n\n\n\n\nb", "ab-\ncd-\nef")
    assert got == ["example text", "one\n\ntwo", "a\n\nb", "abcd-\nef"]


def test_sentences(spark):
    got = values(spark, T.sentences(F.col("x")), 'Dr. Who left. He ran! "Yes" she said? no.', "One no. Two", "Fin. Été", "", None)
    assert got == [["Dr. Who left.", "He ran!", '"Yes" she said? no.'], ["One no. Two"], ["Fin. Été"], [], None]


def test_packing(spark):
    assert values(spark, T.hard_split(F.col("x"), 10), "aa bb cc dd ee", "aaaaaaaaaaaaaaa b", "") == [["aa bb cc", "dd ee"], ["aaaaaaaaaaaaaaa", "b"], []]


def test_shingles(spark):
    got = values(spark, T.shingles(T.tokens(F.col("x"))), "A b c a b c", "a b", "", None)
    assert [sorted(g) for g in got] == [["a b c", "b c a", "c a b"], [], [], []]


def test_markdown(spark):
    md = "# Head\n```\ncode\n```\n**bold** and *it* [link](u) ![img](p) `x` _u_"
    assert values(spark, T.strip_markdown(F.col("x")), md) == ["Head\n\nbold and it link img  u"]


def test_aliases(spark):
    assert values(spark, names.resolve_alias(F.col("x")), "k8s", "rust", "node") == ["kubernetes", "rust", "node_js"]
    assert values(spark, names.is_technology(F.col("x")), "postgresql", "tea") == [True, False]


def test_detect_kind(spark):
    rows = [
        (b"%PDF-1", "a.txt", "pdf"), (b"PK\x03\x04", "a.docx", "docx"), (b"PK\x03\x04", "a.xlsx", "txt"), (b"\x89PNG", "a", "image"),
        (b"\xff\xd8\xff", "a.gif", "image"), (b"hello", "a.MD", "md"), (b"hello", "noext", "txt"), (b"x", "d.v1/a.html", "bookmark"),
    ]
    df = spark.createDataFrame(rows, "raw binary, name string, want string")
    got = df.select("want", files.detect_kind(F.col("raw"), F.col("name")).alias("k")).collect()
    assert all(r.want == r.k.kind for r in got)


def test_extract(spark):
    body = b'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    rows = [(1, raw.getvalue(), "docx"), (2, b"# T\nx", "md"), (3, b"<p>Hi</p><script>no</script>", "bookmark"), (4, b"%PDF", "pdf"), (5, b"\xffa", "txt")]
    got = {r.i: r for r in files.extract_text(spark.createDataFrame(rows, "i int, content binary, kind string")).collect()}
    assert [got[i].text for i in (1, 2, 3)] == ["one\n\ntwo", "T\nx", "Hi"]
    assert got[4].text is None and "unsupported" in got[4].error and got[5].text == "�a"


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("")
    rows = files.read_uploads(spark, str(tmp_path)).collect()
    assert [(r.byte_size, r.content_sha256[:8]) for r in rows] == [(5, "2cf24dba")]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "Only one sentence here"), (2, " ".join(f"Word number {i} goes on and on here." for i in range(40))), (3, ""), (4, "w " * 1200)], "id int, text string")
    rows = chunking.chunk_documents(docs, "id", "text").collect()
    by = {i: sorted((r.chunk_index, r.text) for r in rows if r.id == i) for i in (1, 2, 3, 4)}
    assert by[1] == [(0, "Only one sentence here")] and by[3] == []
    assert " ".join(t for _, t in by[2]).split() == docs.where("id = 2").first().text.split()
    assert len(by[4]) == 2 and all(len(t) <= 1500 for _, t in by[4])


def test_keyphrases():
    top = chunking.text_rank("graph engine and graph engine for the graph engine of data")
    assert top[0][0] == "graph engine" and top[0][2] == 3 and chunking.text_rank("") == []


def test_keyphrases_of_a_long_text():
    top = chunking.text_rank("of " * 20_000 + "graph engine")
    assert [(p, n) for p, _, n in top] == [("graph engine", 1)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(80)] + [(200, 201), (201, 200), (300, 300)]
    got = dict(pairs(connected_components(spark.createDataFrame(chain, "src int, dst int")), "node", "component"))
    assert got == {**dict.fromkeys(range(81), 0), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "x100 ")
    docs = spark.createDataFrame([(1, base), (2, base), (3, near), (4, "quite another text with words of its own"), (5, "a b")], "id int, text string")
    got = dedup.duplicate_clusters(docs.withColumn("sha", F.sha2("text", 256)), "id", "text", "sha")
    assert pairs(got, "id", "representative", "members") == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert pairs(dedup.duplicate_edges(got, "id"), "src", "dst") == [(2, 1), (3, 1)]


def mentions(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "c"), (3, "a"), (4, "a"), (4, "d"), (5, "a"), (5, "d")]
    return spark.createDataFrame(rows, "chunk int, key string")


def test_cooccurrence_and_prerequisites(spark):
    found = graph.cooccurrence(mentions(spark))
    assert pairs(found, "src", "dst", "weight") == [("a", "b", 2), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1)]
    edges = graph.prerequisites(found.where("weight >= 2"))
    # a star: each leaf has one neighbour, the hub three; (3 - 1) / 4
    assert pairs(edges, "src", "dst", "refd") == [("b", "a", 0.5), ("c", "a", 0.5), ("d", "a", 0.5)]
    before = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert pairs(graph.prerequisites(found.where("weight >= 2"), previous=before), "src") == [("c",), ("d",)]


def test_prerequisites_have_no_cycle(spark):
    rows = spark.range(60).selectExpr("id % 17 AS chunk", "id * id % 23 AS key")
    edges = graph.prerequisites(graph.cooccurrence(rows)).cache()
    assert graph.cycles(edges).count() == 0


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 0.3), (2, 3, 0.1), (3, 1, 0.2), (3, 4, 0.9), (4, 5, 0.5)], "src int, dst int, refd double")
    found = graph.cycles(edges)
    assert pairs(found, "cycle", "refd", "weakest_src", "weakest_dst") == [([1, 2, 3, 1], 0.1, 2, 3)]
    assert pairs(graph.break_cycles(edges, found), "src", "dst") == [(1, 2), (3, 1), (3, 4), (4, 5)]


def simple_cycles(edges):
    """By brute force: every simple cycle from its least node."""
    found, open_paths = [], [(s, d) for s, d in edges if s <= d]
    while open_paths:
        path = open_paths.pop()
        if path[-1] == path[0]:
            found.append(list(path))
        else:
            open_paths.extend((*path, d) for s, d in edges if s == path[-1] and d >= path[0] and d not in path[1:])
    return sorted(found)


def test_cycles_of_any_length(spark):
    ring = [(i, i % 14 + 1) for i in range(1, 15)]
    edges = [*ring, (14, 7), (3, 9), (20, 20), (30, 31), (31, 30), (14, 30), *[(i, j) for i in range(40, 60) for j in range(i + 1, 60)]]
    df = spark.createDataFrame([(s, d, float(s)) for s, d in edges], "src int, dst int, refd double")
    found = graph.cycles(df)
    want = simple_cycles([e for e in edges if e[0] < 40])
    assert sorted(r.cycle for r in found.collect()) == want and max(map(len, want)) == 15
    assert simple_cycles(pairs(graph.break_cycles(df, found).where("src < 40"), "src", "dst")) == []


def test_registered_cycles(spark, tmp_path):
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(f"{tmp_path}/nation.parquet")
    edges = {(n, (n * a + b) % 25) for n in range(25) for a, b in ((7, 3), (3, 11))}
    want = [">".join(map(str, c)) for c in simple_cycles([e for e in edges if e[0] != e[1]])]
    assert sorted(r.cycle for r in queries.QUERIES["graph_cycles"](spark, str(tmp_path)).collect()) == sorted(want)


def test_learning_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    rows = [tuple(r) for r in graph.learning_path(edges, "d").collect()]
    assert rows == [("a", 0, False), ("b", 1, False), ("c", 1, False), ("d", 2, False)]
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    assert [tuple(r) for r in graph.learning_path(loop, "c").collect()] == [("a", 0, True), ("b", None, True), ("c", None, True)]


def test_gaps(spark):
    studied = spark.createDataFrame([("b",), ("c",)], "key string")
    needs = spark.createDataFrame([("a", "b"), ("a", "c"), ("z", "c"), ("b", "c"), ("q", "w")], "src string, dst string")
    ranks = spark.createDataFrame([("z", 2.0)], "key string, pagerank double")
    assert [tuple(r) for r in graph.learning_gaps(studied, needs, ranks).collect()] == [("a", 2, 0.0), ("z", 1, 2.0)]


def test_pagerank(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src int, dst int")
    got = dict(pairs(graph.pagerank(edges, rounds=60), "key", "pagerank"))
    assert got[3] == pytest.approx(0.15) and got[1] > got[2] > got[3]
    weighted = edges.withColumn("weight", F.lit(1))
    assert sum(v for _, v in pairs(graph.pagerank_weighted(weighted), "key", "pagerank")) == pytest.approx(1.0)


def test_merging(spark):
    nodes = spark.createDataFrame([("t:k8s", "T", "k8s"), ("t:kube", "T", "kube"), ("t:rust", "T", "rust"), ("c:k8s", "C", "k8s")], "key string, label string, name string")
    canonical = graph.alias_canonical(nodes, names.resolve_alias(F.col("name")))
    assert pairs(canonical, "key", "to") == [("t:k8s", "t:kubernetes"), ("t:kube", "t:kubernetes")]
    edges = spark.createDataFrame([("t:k8s", "t:rust", 1), ("t:kube", "t:rust", 2), ("t:k8s", "t:kube", 3)], "src string, dst string, weight int")
    kept, left = graph.merge_entities(nodes, edges, canonical)
    assert pairs(kept, "key") == [("c:k8s",), ("t:kubernetes",), ("t:rust",)] and pairs(left, "src", "dst", "weight") == [("t:kubernetes", "t:rust", 2)]


def test_similar_entities(spark):
    rows = [(1, "A", [1.0, 0.0]), (2, "A", [0.99, 0.1]), (3, "A", [0.0, 1.0]), (4, "B", [1.0, 0.0]), (5, "A", None), (6, "A", [0.0, 0.0])]
    nodes = spark.createDataFrame(rows, "key int, label string, embedding array<double>")
    assert pairs(graph.embedding_canonical(nodes), "key", "to") == [(2, 1)]


def test_orphans_and_overview(spark):
    nodes = spark.createDataFrame([("a", "Concept"), ("b", "Concept"), ("d", "Document")], "key string, label string")
    edges = spark.createDataFrame([("a", "x")], "src string, dst string")
    assert pairs(graph.orphans(nodes, edges), "key") == [("b",)]
    docs = spark.createDataFrame([(1,)], "id int")
    assert tuple(graph.overview(docs, nodes, edges).first()) == (1, 2, 0, 1)
    assert tuple(graph.overview(docs.where("id = 0"), nodes, edges).first()) == (0, 0, 0, 0)


def test_maintenance(spark):
    nodes = spark.createDataFrame([("a", "Concept", "a", 0.0), ("b", "Concept", "b", 0.0), ("lone", "Concept", "l", 0.0)], "key string, label string, name string, pagerank double")
    edges = spark.createDataFrame([("a", "b", "PREREQUISITE_OF", None, 0.2), ("b", "a", "PREREQUISITE_OF", None, 0.1)], "src string, dst string, type string, weight double, refd double")
    m = spark.createDataFrame([(1, "a"), (1, "b")], "chunk int, key string")
    none = spark.createDataFrame([], "key string, to string")
    kept, left, counts = graph.maintain(nodes, edges, m, none)
    assert pairs(kept, "key") == [("a",), ("b",)] and pairs(left, "src", "dst", "type") == [("a", "b", "CO_OCCURS_WITH"), ("a", "b", "PREREQUISITE_OF")]
    assert counts.first().asDict() == {"merged": 0, "cooccurrences": 1, "orphans": 1, "cycles": 1}


def test_search(spark):
    vectors = spark.createDataFrame([(1, 1, 7, "x", [1.0, 0.0]), (2, 9, 7, "y", [0.6, 0.8]), (3, 1, 8, "x", [1.0, 0.0]), (4, 1, 7, "x", [0.0, 0.0])], "chunk_id int, document_id int, user_id int, category string, embedding array<double>")
    docs = spark.createDataFrame([(1, "T")], "id int, title string")
    rows = [(r.chunk_id, r.document_title, r.score) for r in search.semantic_search(vectors, [1.0, 0.0], docs, user=7).orderBy(F.desc("score")).collect()]
    assert rows[:2] == [(1, "T", 1.0), (2, "Unknown", pytest.approx(0.6))]
    assert [r.chunk_id for r in search.semantic_search(vectors, [1.0, 0.0], docs, user=7, category="y").collect()] == [2]


def test_activation(spark):
    nodes = spark.createDataFrame([(k, v) for k, v in (("s", [1.0, 0.0]), ("m", [1.0, 0.0]), ("n", [1.0, 0.0]), ("t", [1.0, 0.0]), ("z", [0.0, 1.0]))], "key string, embedding array<double>")
    edges = spark.createDataFrame([("s", "m", 2.0), ("s", "n", None), ("m", "t", 1.0), ("n", "t", 1.0), ("s", "z", 1.0)], "src string, dst string, weight double")
    start = spark.createDataFrame([("s",)], "key string")
    got = dict((r.key, r.activation) for r in search.activation(nodes, edges, [1.0, 0.0], start, hops=2, decay=0.5).collect())
    assert got == {"m": 1.0, "n": 0.5, "t": 0.5 + 0.25}
    reach = dict((r.key, r.activation) for r in search.activation_by_reach(nodes, edges, [1.0, 0.0], start, hops=1, decay=0.5).collect())
    assert reach == {"m": 0.5, "n": 0.5}
    assert pairs(search.induced_edges(edges.union(edges.select("dst", "src", "weight")), nodes.where("key IN ('s', 'm', 'n')")), "src", "dst", "weight") == [("m", "s", 2.0), ("n", "s", 1.0)]


def test_evaluation(spark):
    rows = [(1, r, r == 2) for r in range(1, 11)] + [(2, r, False) for r in range(1, 11)]
    got = search.evaluate(spark.createDataFrame(rows, "q int, rank int, rel boolean"), "q", "rank", "rel").first()
    assert (got.hit_at_1, got.hit_at_5, got.mrr) == (0.0, 0.5, 0.25) and got.ndcg_at_10 == pytest.approx(0.6309 / 2, abs=1e-4)


def test_tree_distance(spark):
    heads = [1, 1, 1, 2, 4]
    assert [triples.tree_distance(heads, a, b) for a, b in ((0, 0), (0, 1), (0, 3), (3, 2), (0, 4))] == [0, 1, 3, 1, 999]
    df = spark.createDataFrame([(heads, 0, 3), (None, 0, 1)], "h array<int>, a int, b int")
    assert [r[0] for r in df.select(triples.syntactic_distance("h", "a", "b")).collect()] == [3, None]


def test_triples(spark):
    chunks = spark.createDataFrame([(1, "FastSearch uses Redis. Nothing here."), (2, None)], "chunk_id int, text string")
    found = triples.extract_triples(chunks)
    assert pairs(found, "chunk_id", "subject", "verb", "object", "subj_type", "obj_type") == [(1, "FastSearch", "use", "Redis", "Project", "Technology")]
    nodes, men, uses = triples.graph_rows(found)
    assert pairs(nodes, "key", "label") == [("project:fastsearch", "Project"), ("technology:redis", "Technology")]
    assert pairs(uses, "src", "dst") == [("project:fastsearch", "technology:redis")] and men.count() == 2


def test_classifier(spark):
    docs = spark.createDataFrame([(1, "join tables in a database transaction with an index query"), (2, None)], "id int, text string")
    assert pairs(classify.classify(docs, None), "id", "category", "category_conf") == [(1, "Uncategorized", 0.0), (2, "Uncategorized", 0.0)]
    model = classify.train(spark.createDataFrame(list(classify.SEED), "text string, label string"), rounds=10, dimensions=1 << 12)
    got = {r.id: r for r in classify.classify(docs, model).collect()}
    assert got[1].category == "Databases" and 0 < got[1].category_conf <= 1 and len(got) == 2
    fixed = classify.correct(classify.classify(docs, None), spark.createDataFrame([(2, "Law")], "id int, label string"), "id")
    assert pairs(fixed, "id", "category") == [(1, "Uncategorized"), (2, "Law")]


def test_classifier_reads_whole_texts(spark):
    docs = spark.createDataFrame([(1, "the " * 10_000 + "join tables in a database transaction with an index query"), (2, "the")], "id int, text string")
    model = classify.train(spark.createDataFrame(list(classify.SEED), "text string, label string"), rounds=10, dimensions=1 << 12)
    got = {r.id: r for r in classify.classify(docs, model).collect()}
    assert got[1].category == "Databases" and got[1].category_conf > got[2].category_conf


def events(spark):
    rows = [(1, "document.chunked", "PENDING", 0, None), (2, "document.uploaded", "PROCESSING", 4, "2024-01-01 00:00:00"), (3, "other", "PROCESSING", 1, "2024-01-01 00:02:00"), (4, "document.indexed", "COMPLETED", 0, None)]
    df = spark.createDataFrame(rows, "id int, event_type string, status string, retry_count int, locked_at string")
    return df.withColumn("locked_at", F.col("locked_at").cast("timestamp")).withColumns({"max_retries": F.lit(5), "error_log": F.lit(None).cast("string"), "created_at": F.col("id")})


def test_queue(spark):
    e = events(spark)
    assert pairs(outbox.claim(e), "id") == [(1,)]
    assert pairs(outbox.reclaim(e, F.expr("timestamp'2024-01-01 00:11:00'")), "id", "status") == [(1, "PENDING"), (2, "PENDING"), (3, "PROCESSING"), (4, "COMPLETED")]
    assert pairs(outbox.retry(e.where("status = 'PROCESSING'"), F.lit("x")), "id", "status", "retry_count") == [(2, "FAILED", 5), (3, "PENDING", 2)]
    assert pairs(outbox.route(e), "id", "task") == [(1, "classify_chunks"), (1, "detect_duplicates"), (1, "extract_triples"), (2, "ingest_document")]
    assert pairs(relational.status_counts(e), "status", "n") == [("FAILED", 0), ("PENDING", 1), ("PROCESSING", 2)]


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    e.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = outbox.dispatch_stream(stream, lambda df, i: got.extend((r.id, r.task) for r in df.collect()), f"t-{tmp_path.name}-{id(got)}")
    run.awaitTermination()
    assert sorted(got) == pairs(outbox.route(e), "id", "task")


def test_sinks(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert pairs(sinks.upsert(old, new, ["k"], "v"), "k", "x") == [(1, "c"), (2, "b"), (3, "e")]
    assert pairs(sinks.replace_children(old, new.where("k = 1"), "k"), "k", "x") == [(1, "c"), (2, "b")]
    assert pairs(sinks.merge_nodes(old, new, "k"), "k", "x") == [(1, "a"), (2, "b"), (3, "e")]
    assert pairs(sinks.purge(old, "k", new.where("k = 1"), "k"), "k") == [(2,)]
    assert pairs(sinks.conditional_update(old, new.where("k = 2"), "k", ["x"]), "k", "x") == [(1, "a"), (2, "d")]


def test_paging_and_replay(spark):
    docs = spark.range(45).selectExpr("id", "'u' AS user_id", "'en' AS category", "'INDEXED' AS status", "id AS created_at")
    page = relational.list_documents(docs, "u", page=2, size=20)
    assert [r.id for r in page.collect()] == list(range(24, 4, -1)) and page.first().total == 45
    assert relational.list_documents(docs, "v").count() == 0
    assert pairs(relational.replay_buffer(docs, 2), "id") == [(43,), (44,)]
    assert pairs(relational.replay_sample(docs, 5), "id") == pairs(relational.replay_sample(docs.repartition(3), 5), "id")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows = df.select(V.unit(F.col("v")).alias("u"), V.cosine(F.col("v"), F.col("v")).alias("c")).collect()
    assert rows[0].u == [0.6, 0.8] and rows[0].c == pytest.approx(1.0) and rows[1].c is None
    sized = V.embed(spark.createDataFrame([("a b",), (None,)], "text string"), "text").select(V.norm(F.col("embedding")).alias("n")).collect()
    assert [round(r.n, 5) for r in sized] == [1.0, 0.0]


def test_search_order_and_empty_query(spark):
    vectors = spark.createDataFrame([(i, i, "u" if i % 2 else "v", "c", [float(i), 1.0]) for i in range(40)], "chunk_id long, document_id long, user_id string, category string, embedding array<double>")
    docs = spark.createDataFrame([(3, "three", "p3")], "id long, title string, preview string")
    rows = search.semantic_search(vectors, [1.0, 0.0], docs, user="u", k=25).collect()
    assert [r.chunk_id for r in rows] == sorted((i for i in range(40) if i % 2), reverse=True)
    assert next(r for r in rows if r.chunk_id == 3)[2:5:2] == ("three", "p3") and rows[0].document_title == "Unknown" and rows[0].preview == ""
    assert search.semantic_search(vectors, [], docs, user="u").count() == 0


def test_graph_search(spark):
    nodes = spark.createDataFrame([("a", "Concept", "A", 0.5, [1.0, 0.0]), ("b", "Concept", None, None, [0.9, 0.1]), ("c", "Technology", "C", 0.1, [0.0, 1.0])], "key string, label string, name string, pagerank double, embedding array<double>")
    edges = spark.createDataFrame([("a", "b", "CO_OCCURS_WITH", 2.0), ("b", "c", "USES_TECH", None), ("a", "b", "USES_TECH", 0.0)], "src string, dst string, type string, weight double")
    found = search.graph_search(spark, lambda: (nodes, edges), [1.0, 0.0], k=1, hops=1)
    assert [(r.key, r.label, r.name) for r in found.nodes.collect()] == [("b", "Concept", "b")] and not found.degraded
    wide = search.graph_search(spark, lambda: (nodes, edges), [1.0, 0.0], k=2, hops=1)
    assert [r.key for r in wide.nodes.collect()] == ["a", "b"]
    assert sorted(wide.edges.collect()) == [("a", "b", "CO_OCCURS_WITH", 2.0), ("a", "b", "USES_TECH", None)]
    assert search.graph_search(spark, lambda: (nodes, edges), []).nodes.count() == 0
    lost = search.graph_search(spark, lambda: (spark.read.parquet("/nowhere/nodes"), edges), [1.0, 0.0])
    assert lost.degraded and lost.nodes.count() == lost.edges.count() == 0


def test_neighbourhood_goes_through_documents(spark):
    nodes = spark.createDataFrame([("a", "Concept", "A", 0.5), ("d", "Document", "D", None), ("x", None, None, 0.2)], "key string, label string, name string, pagerank double")
    edges = spark.createDataFrame([("d", "a", "MENTIONS", None), ("d", "x", "MENTIONS", 3.0)], "src string, dst string, type string, weight double")
    assert graph.neighbourhood(nodes, edges, "a").count() == 0
    assert [tuple(r) for r in graph.neighbourhood(nodes, edges, "a", depth=3).collect()] == [("x", "Concept", "x", 0.2, "MENTIONS", 3.0, 2)]
    assert graph.neighbourhood(nodes, edges, "none", depth=2).count() == 0


def test_long_cycles_and_chains(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 12, float(i)) for i in range(12)], "src int, dst int, refd double")
    found = graph.cycles(ring).collect()
    assert len(found) == 1 and len(found[0].cycle) == 13 and (found[0].weakest_src, found[0].weakest_dst) == (0, 1)
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "src int, dst int")
    path = graph.learning_path(chain, 30).collect()
    assert [r.key for r in path] == list(range(31)) and not any(r.has_cycle for r in path)
    with pytest.raises(RuntimeError):
        graph.learning_path(chain, 30, max_rounds=5)
    with pytest.raises(RuntimeError):
        graph.closure(chain, chain.selectExpr("30 AS key"), max_rounds=5)


def test_large_chunks_are_paired_in_blocks(spark):
    before, graph.BLOCK = graph.BLOCK, 4
    try:
        pairs = graph.cooccurrence(spark.createDataFrame([(1, i) for i in range(30)] + [(2, 3), (2, 7)], "chunk int, key int")).collect()
    finally:
        graph.BLOCK = before
    assert len(pairs) == 30 * 29 // 2 and {tuple(r) for r in pairs if r.weight == 2} == {(3, 7, 2)}


def test_prerequisites_count_common_neighbours(spark):
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(rng.choice(25, 2, replace=False).tolist())) for _ in range(90)} | {(0, i) for i in range(1, 25)}
    near = {i: {a + b - i for a, b in pairs if i in (a, b)} for i in range(25)}
    want = {}
    for a, b in pairs:
        d = (len(near[b]) - len(near[a])) / len(near[a] | near[b])
        if abs(d) > 0.05:
            want[(a, b) if d > 0 else (b, a)] = round(abs(d), 9)
    rows = graph.prerequisites(spark.createDataFrame(sorted(pairs), "src int, dst int")).collect()
    assert {(r.src, r.dst): round(r.refd, 9) for r in rows} == want


def test_queue_rules(spark):
    now = F.expr("timestamp'2024-01-02 00:00:00'")
    docs = spark.createDataFrame([(1, "u"), (2, "v"), (1, "u")], "document_id long, user_id string")
    events = outbox.emit(docs, "document.indexed", now)
    assert events.count() == 2 and outbox.emit(docs, "document.indexed", now).join(events, "id").count() == 2
    claimed = outbox.mark_claimed(events, now, 1)
    assert sorted(r.status for r in claimed.collect()) == ["PENDING", "PROCESSING"] and claimed.columns == events.columns
    assert sorted(r.status for r in outbox.complete(claimed, events.select("id").limit(0)).collect()) == ["COMPLETED", "PENDING"]
    tries = spark.createDataFrame([(i, "x" if i < 6 else None) for i in range(8)], "retries int, error string")
    done = {r.retries: r for r in outbox.settle(tries, now).collect()}
    assert [done[i].status for i in range(8)] == ["PENDING"] * 5 + ["FAILED"] + ["COMPLETED"] * 2
    assert [(done[i].due - done[0].due).total_seconds() + 1 for i in range(5)] == [1, 2, 4, 8, 16] and done[6].due is None


def test_document_states(spark):
    docs = spark.createDataFrame([(1, "UPLOADED", None, None), (2, "INDEXED", None, 5), (3, "FAILED", "old", None), (4, "UPLOADED", None, None)], "id long, status string, error_log string, extracted_chars int")
    outcomes = spark.createDataFrame([(1, "ingest_document", None, 7), (1, "chunk_document", "broken", None), (2, "ingest_document", None, 9), (3, "ingest_document", None, 4)], "document_id long, task string, error string, chars int")
    assert [tuple(r) for r in outbox.advance(docs, outcomes).orderBy("id").collect()] == [(1, "FAILED", "broken", 7), (2, "INDEXED", None, 9), (3, "EXTRACTED", None, 4), (4, "UPLOADED", None, None)]


def test_received_files_tell_why(spark):
    rows = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray()), (3, None), (4, bytearray(b"x" * 20))], "n int, content binary")
    assert {r.n: (r.code, r.content_sha256 is None) for r in files.receive(rows, most=10).collect()} == {1: (201, False), 2: (400, True), 3: (400, True), 4: (413, True)}


def test_new_documents_join_clusters(spark):
    known = spark.createDataFrame([(1, 1), (2, 1), (8, 8), (9, 8)], "id long, representative long")
    links = spark.createDataFrame([(5, 2), (5, 9), (20, 21)], "a long, b long")
    rows = dedup.attach(known, links, "id").collect()
    assert {(r.id, r.representative, r.members) for r in rows} == {(i, 1, 5) for i in (1, 2, 5, 8, 9)} | {(20, 20, 2), (21, 20, 2)}


def test_scores_of_classes(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "w string, g string")
    assert search.macro_f1(rows, "w", "g").first()[0] == pytest.approx((2 / 3 + 2 / 4 + 0) / 3)


def test_scratch_tables_end_with_their_block(spark):
    with Scratch(spark) as scratch:
        gone, kept = materialise(spark.range(5), "gone"), scratch.keep(materialise(spark.range(7), "kept"))
        with Scratch(spark) as inner:
            deep = inner.keep(materialise(spark.range(3), "deep"))
        assert deep.count() == 3
    assert kept.count() == 7
    for table in (gone, deep):
        with pytest.raises(Exception):  # noqa: B017
            table.count()


def test_parsed_triples(spark):
    token = "struct<text:string,lemma:string,pos:string,dep:string,head:int,ent:string>"
    schema = f"id int, tokens array<{token}>, noun_chunks array<struct<first:int,stop:int,root:int>>"
    said = [("The", "the", "DET", "det", 1, None), ("team", "team", "NOUN", "nsubj", 2, "ORG"), ("Uses", "USE", "VERB", "ROOT", 2, None), ("Redis", "redis", "PROPN", "dobj", 2, None), ("Ada", "ada", "PROPN", "dative", 2, "PERSON")]
    rows = [(1, said, [(0, 2, 1)]), (2, said, None), (3, None, None), (4, [], []), (5, said[:2], []), (6, said * 41, [])]
    found = triples.parsed_triples(spark.createDataFrame(rows, schema), "id").where("id <> 6")
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "The team", "use", "Ada", "Project", "Person"), (1, "The team", "use", "Redis", "Project", "Technology"),
        (2, "team", "use", "Ada", "Project", "Person"), (2, "team", "use", "Redis", "Project", "Technology"),
    ]
    assert triples.parsed_triples(spark.createDataFrame(rows, schema), "id").where("id = 6").count() == 0
    assert triples.parsed_triples(spark.createDataFrame(rows, schema), "id", most=1).count() == 0


def test_references_are_resolved_by_paragraph(spark):
    df = spark.createDataFrame([(" he said \n\n he ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(triples.resolve_references(F.col("t"))).collect()] == ["he said \n\n he", "", None]
    by = lambda c: F.when(~c.startswith("x"), F.regexp_replace(c, "he", "Ann"))
    assert [r[0] for r in df.select(triples.resolve_references(F.col("t"), by, 5)).collect()] == ["Ann said\n\nAnn", "", None]


def test_records(spark):
    df = spark.createDataFrame([([1, -1, (1 << 63) - 1, -(1 << 63)],), ([],), (None,)], "v array<bigint>")
    packed = df.select("v", records.pack_uint64(F.col("v")).alias("p")).select("*", records.unpack_uint64(F.col("p")).alias("u")).collect()
    assert all(r.u == r.v for r in packed)
    assert bytes(packed[0].p) == b"".join((x % (1 << 64)).to_bytes(8, "big") for x in packed[0].v)
    nested = spark.createDataFrame([(1, [(2, "a")])], "doc_id int, all_rows array<struct<row_no:int,at_x:string>>")
    renamed = records.rename_keys(nested)
    assert renamed.schema.simpleString() == "struct<docId:int,allRows:array<struct<rowNo:int,atX:string>>>"
    assert records.rename_keys(renamed, records.snake).schema == nested.schema
    row = spark.range(1).select(records.status_lines(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")).alias("x"))
    assert row.first().x == 'data: {"a":1,"b":null}\n\n'


def test_paged_files_are_probed(spark):
    read = files.paged_extractor(lambda raw: raw.decode().split("|"), lambda raw: "seen")
    rows = [(1, b"a|b", "pdf"), (2, b"||| late", "pdf"), (3, b"\xff", "pdf"), (4, b"", "image"), (5, b"x", "txt"), (6, b"", "odd")]
    got = files.extract_text(spark.createDataFrame(rows, "n int, content binary, kind string"), extractors={"pdf": read, "image": files.recognised(lambda raw: "pic")})
    assert {r.n: (r.text, r.used_ocr, r.page_count) for r in got.collect()} == {
        1: ("a\n\nb", False, 2), 2: ("seen", True, None), 3: ("seen", True, None), 4: ("pic", True, None), 5: ("x", False, None), 6: (None, False, None),
    }
    blind = files.extract_text(spark.createDataFrame(rows[1:2], "n int, content binary, kind string"), extractors={"pdf": files.paged_extractor(lambda raw: [])})
    assert "no text layer" in blind.first().error


def test_classifier_life_cycle(spark, tmp_path):
    small = {"rounds": 3, "dimensions": 1 << 10}
    path = str(tmp_path / "engine")
    docs = spark.createDataFrame([(1, "A query joins tables by an index of the database", "CHUNKED"), (2, " ", "CHUNKED"), (3, None, "CHUNKED")], "id int, text string, status string")
    cold = classify.index_documents(docs, classify.Engine())
    assert pairs(cold, "id", "category", "category_conf", "status") == [(i, "Uncategorized", 0.0, "INDEXED") for i in (1, 2, 3)]
    engine = classify.load_or_seed(spark, path, second=False, **small)
    assert (engine.updates, engine.second) == (20, None)
    again = classify.load_or_seed(spark, path, **small)
    assert again.updates == 20
    got = {r.id: (r.category, r.category_conf) for r in classify.index_documents(docs, again).collect()}
    assert got[1][0] == "Databases" and got[2] == got[3] == ("Uncategorized", 0.0)
    assert classify.learn(again, spark.createDataFrame([], "text string, label string")) is again
    new = spark.createDataFrame([("bread, flour and yeast", "Cooking")], "text string, label string")
    grown = classify.learn(again, new, new, second=False, **small)
    assert grown.updates == 22
    sure = spark.createDataFrame([(1, 0.6), (2, 0.5), (3, None)], "id int, category_conf double")
    assert [r.id for r in classify.confident(sure, updates=20).collect()] == [1]
    assert classify.confident(sure, updates=0).count() == 0
    hinge = classify.learn(classify.Engine(), new, rounds=1, dimensions=1 << 6)
    hinge.save(spark, path)
    assert classify.load(spark, path).second is not None


def test_edges_and_sidecars_merge(spark):
    edge = "src int, dst int, type string, w int"
    old = spark.createDataFrame([(1, 2, "A", 5)], edge)
    new = spark.createDataFrame([(1, 2, "A", 1), (1, 2, "B", 3), (1, 2, "B", 2), (2, 1, "A", None)], edge)
    assert sorted(map(str, sinks.merge_edges(old, new).collect())) == sorted(map(str, spark.createDataFrame([(1, 2, "A", 5), (1, 2, "B", 2), (2, 1, "A", None)], edge).collect()))
    docs = spark.createDataFrame([(1,), (2,)], "id int")
    got = {r.id: (r.text, r.error) for r in sinks.with_sidecars(docs, spark.createDataFrame([(1, "x")], "document_id int, text string")).collect()}
    assert got == {1: ("x", None), 2: (None, "no extracted text for 2")}
    nodes, edges = triples.structure_rows(spark.createDataFrame([(1, 7, 0), (1, 8, 1), (1, 8, 1)], "document_id int, chunk_id int, chunk_index int"))
    assert pairs(nodes, "key", "label") == [("chunk:7", "Chunk"), ("chunk:8", "Chunk"), ("document:1", "Document")]
    assert pairs(edges, "src", "dst", "chunk_index") == [("document:1", "chunk:7", 0), ("document:1", "chunk:8", 1)]


def test_nearest_rows_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PACK", 16)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(70, 4))
    v[40:60] = v[3]  # copies, whose order is that of their ids
    v[7], v[8] = 0.0, v[9] * 2
    rows = [(f"k{i:02d}", x.tolist()) for i, x in enumerate(v)] + [("k98", None), ("k99", [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = vectors.where("id < 'k12' or id in ('k45', 'k98')").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))

    def score(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b) if a and b and len(a) == len(b) else 0
        return None if not size else round(float(np.dot(a, b) / size), 9)

    for k in (3, 71):
        want = set()
        for q in asked.collect():
            best = sorted((-9.0 if (s := score(q.query, x)) is None else s, i) for i, x in rows if i != q.query_id)
            best = sorted(best, key=lambda p: (-p[0], p[1]))[:k]
            want |= {(q.query_id, i, r + 1) for r, (_, i) in enumerate(best)}
        got = search.ranked_by_cosine(asked, vectors, k)
        assert {(r.query_id, r.id, r.rank) for r in got.collect()} == want


def test_nearest_rows_leave_a_task_and_not_pairs(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2000, 8))
    v[:1000] = v[0]
    nodes = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "key long, label int, embedding array<double>")
    rows = nodes.select(F.col("key").alias("n"), F.lit("").alias("label"), V.unit(F.col("embedding")).alias("vector"))
    assert nearest.nearest(rows, rows, 5, least=0.5, cosine=False).count() <= 5 * 2000
    got = {(r.key, r.other) for r in graph.top_similar(nodes, threshold=0.5).where("key < 4").collect()}
    assert {p for p in got if p[0] == 1} == {(1, i) for i in (3, 5, 7, 9, 11)} and {p for p in got if p[0] == 2} == {(2, i) for i in (0, 4, 6, 8, 10)}


def test_every_row_is_asked_for_its_neighbour(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, [0.1, 0.9], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.neighbour_f1(spark, str(tmp_path)).first()[0] == pytest.approx((2 * 2 / 6 + 0) / 2, abs=1e-6)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "dealt_by_rows", lambda spark, rows: dealt_by_rows(spark, rows, each=50))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    found = graph.cooccurrence(spark.createDataFrame([(i % 3, i) for i in range(60)], "chunk int, key int"))
    assert found.count() == 3 * 20 * 19 // 2 and len(found.inputFiles()) >= 10
    assert (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")) == before


def test_tables_are_read_by_their_rows(spark, tmp_path, monkeypatch):
    key, path = "spark.sql.files.maxPartitionBytes", str(tmp_path / "rows")
    spark.range(40_000).select((F.col("id") % 20_000).alias("chunk"), F.col("id").alias("key")).repartition(20).write.parquet(path)
    df = spark.read.parquet(path)
    before, size = spark.conf.get(key), sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet"))
    with read_by_rows(df, 40_000, each=1000):
        assert spark.read.parquet(path).rdd.getNumPartitions() >= 20
    with read_by_rows(spark.range(9), 9), read_by_rows(df, 40_000, each=10**12):
        assert int(spark.conf.get(key)[:-1]) <= 128 << 20
    bounds = {}

    def noting(df, label):
        bounds[label] = spark.conf.get(key)
        return materialise(df, label)

    monkeypatch.setattr(graph, "read_by_rows", lambda df, rows: read_by_rows(df, rows, each=1000))
    monkeypatch.setattr(graph, "materialise", noting)
    assert graph.cooccurrence(df).count() == 20_000
    assert bounds["mentions"] == f"{size // 40}b"
    assert all(int(bounds[label][:-1]) < size // 10 for label in ("groups", "sizes", "pairs"))
    assert spark.conf.get(key) == before


def test_large_row_groups_are_written_in_small_files(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path / "rows"), {}
    spark.range(6000).select((F.col("id") % 3000).alias("chunk"), F.col("id").alias("key")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)  # one row group, which no share in bytes divides

    def noting(df, label):
        if label == "mentions":
            inside = spark.read.parquet(*{f.rpartition("/")[0] for f in df.inputFiles()})
            read[label] = inside.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0], inside.count()
        return materialise(df, label)

    monkeypatch.setattr(graph, "read_by_rows", lambda df, rows: read_by_rows(df, rows, each=1000))
    monkeypatch.setattr(graph, "in_small_files", lambda df, label: in_small_files(df, label, each=1000), raising=False)
    monkeypatch.setattr(graph, "materialise", noting)
    with Scratch(spark):
        found = graph.cooccurrence(df)
        assert pairs(found, "src", "dst", "weight") == [(i, i + 3000, 1) for i in range(3000)]
        assert read["mentions"] == (1000, 6000)
    assert df.count() == 6000
    with read_by_rows(df, 6000, each=3000):
        assert in_small_files(df, "rows", each=3000) is df and in_small_files(df, "rows", each=2999) is not df


def test_mentions_without_chunk_or_key_are_not_counted_as_pairs(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(graph, "dealt_by_rows", lambda spark, rows: dealt.append(rows) or dealt_by_rows(spark, rows))
    rows = [(None, i) for i in range(3000)] + [(1, None), (1, 4), (1, 5)]
    assert [tuple(r) for r in graph.cooccurrence(spark.createDataFrame(rows, "chunk int, key int")).collect()] == [(4, 5, 1)]
    assert max(dealt) == 3
    assert graph.cooccurrence(spark.createDataFrame([], "chunk int, key int")).count() == 0


def test_prerequisites_are_dealt_by_their_wedges(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(graph, "dealt_by_rows", lambda spark, rows: dealt.append(rows) or dealt_by_rows(spark, rows, each=50))
    ends = [(i, j) for i in range(12) for j in range(i + 1, 12)] + [(i, 100 + i) for i in range(12)] + [(0, 200)]
    found = graph.prerequisites(spark.createDataFrame(ends + ends[:3], "src int, dst int"))
    near = {i: {b if a == i else a for a, b in ends if i in (a, b)} for i in {x for e in ends for x in e}}
    refd = {(a, b): (len(near[b]) - len(near[a])) / len(near[a] | near[b]) for a, b in ends}
    want = sorted(((a, b) if r > 0 else (b, a)) + (round(abs(r), 9),) for (a, b), r in refd.items() if abs(r) > 0.05)
    assert sorted((a, b, round(r, 9)) for a, b, r in found.collect()) == want
    wedges = sum(n * (n - 1) // 2 for n in range(12))  # from a node to two that are later by degree and key
    assert dealt == [2 * 79, wedges + 79] and len(found.inputFiles()) > 4
    assert graph.prerequisites(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_overview_counts_documents_by_their_rows(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(graph, "dealt_by_rows", lambda spark, rows: dealt.append(rows) or dealt_by_rows(spark, rows, each=10))
    nodes, edges = spark.createDataFrame([("Concept",), ("Concept",), ("Technology",), (None,)], "label string"), spark.range(7)
    some = graph.overview(spark.createDataFrame([(i % 40,) for i in range(60)] + [(None,)], "id int"), nodes, edges)
    none = graph.overview(spark.createDataFrame([], "id int"), nodes, edges)
    assert [tuple(x.first()) for x in (some, none)] == [(40, 2, 1, 7), (0, 0, 0, 0)] and dealt == [61, 0]


def test_deleted_nodes_are_not_broadcast(spark):
    nodes, edges = spark.createDataFrame([(i,) for i in range(6)], "key int"), spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 1)], "src int, dst int")
    kept, left = sinks.purge_graph(nodes, edges, nodes.where("key in (2, 5)"))
    assert pairs(kept, "key") == [(0,), (1,), (3,), (4,)] and pairs(left, "src", "dst") == [(3, 4)]
    for df in (kept, left):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_texts_reach_python_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "One sentence here. Another one there.")], "id int, text string")
    for made in (lambda: chunking.chunk_documents(docs, "id", "text"), lambda: chunking.keyphrases(docs), lambda: dedup.signatures(docs, "id", "text")):
        spark.conf.unset(key)
        made()
        assert spark.conf.get(key) == "4m"


def test_permutations_are_modulo_the_prime(spark):
    text = " ".join(f"w{i}" for i in range(400))
    from hashlib import md5

    heads = [int.from_bytes(md5(f"w{i} w{i + 1} w{i + 2}".encode()).digest()[:4]) % dedup.PRIME for i in range(398)]
    want = [min((h * a + b) % dedup.PRIME for h in heads) for a, b in map(dedup.permutation, range(128))]
    assert dedup.signatures(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").first().signature == want
