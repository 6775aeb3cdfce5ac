"""One query for each operator of the engine, over the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions import records
from loomgraph.functions import text as T
from loomgraph.functions import vector as V
from loomgraph.operators import chunking, classify, dedup, graph, relational, search, triples
from loomgraph.plans import roles as R
from loomgraph.sources import files, sinks
from loomgraph.storage import materialise
from loomgraph.streaming import outbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NOW = "timestamp'2024-01-20 00:00:00'"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query
def semantic_search(spark, d):
    vectors = R.chunk_vectors(spark, d).where("chunk_id <> 0")
    return rounded(search.semantic_search(vectors, R.query_vector(spark, d), R.documents(spark, d), user=0), "score")


@query
def semantic_search_in_category(spark, d):
    vectors = R.chunk_vectors(spark, d).where("chunk_id <> 0")
    return rounded(search.semantic_search(vectors, R.query_vector(spark, d), R.documents(spark, d), user=0, category=5, k=5), "score")


@query
def document_page(spark, d):
    return relational.list_documents(R.documents(spark, d), "src3", category="en", page=2, size=10).select("id", "user_id", "category", "title", "total")


@query
def outbox_summary(spark, d):
    return relational.status_counts(R.outbox(spark, d))


@query
def exact_duplicates(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return dedup.exact_groups(docs, "doc_id", "sha")


@query
def minhash_signatures(spark, d):
    signed = dedup.signatures(R.table(spark, d, "documents"), "doc_id", "text")
    return signed.select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query
def lsh_pairs(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    heads = docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    signed = materialise(dedup.signatures(docs.join(heads, ["sha", "doc_id"], "left_semi"), "doc_id", "text"), "signatures")
    return dedup.similar_pairs(signed, "doc_id").select("a", "b", "jaccard")


@query
def duplicate_clusters(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    return dedup.duplicate_clusters(docs, "doc_id", "text", "sha")


@query
def duplicate_edges(spark, d):
    return dedup.duplicate_edges(duplicate_clusters(spark, d), "doc_id")


@query
def shingle_counts(spark, d):
    docs = R.table(spark, d, "documents")
    return docs.select("doc_id", F.size(T.shingles(T.tokens(F.col("text")))).cast("long").alias("n_shingles"))


@query
def clean_texts(spark, d):
    docs = R.table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("clean_sha"))


@query
def sentence_counts(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query
def entity_keys(spark, d):
    parts = R.table(spark, d, "part")
    return parts.select("p_partkey", T.entity_key(F.lit("Concept"), F.col("p_name")).alias("entity_key"))


@query
def upload_kinds(spark, d):
    docs = R.table(spark, d, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".docx", ".md", ".PNG", ".xyz", ".xlsx", "", ".html")]), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    head = F.element_at(F.array(*[F.lit(x) for x in ("%PDF", "plain", "GIF8")]), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    raw = F.concat(head, F.col("text")).cast("binary")
    kind = files.detect_kind(raw, F.concat(F.lit("dir.v1/f"), F.col("doc_id").cast("string"), ext))
    return docs.select("doc_id", kind["kind"].alias("kind"), kind["mime"].alias("mime"), F.sha2(raw, 256).alias("content_sha256"))


@query
def page_texts(spark, d):
    pages = files.extract_pages(R.table(spark, d, "pages"))
    return pages.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha"), sinks.preview(F.col("text")).alias("preview"))


@query
def markdown_texts(spark, d):
    docs = R.table(spark, d, "documents")
    marked = F.concat(F.lit("# Head\n**bold** ***very*** `code` [link](http://x) ![i](y) __u__ ```a\nb``` "), F.col("text"))
    return docs.select("doc_id", F.sha2(T.strip_markdown(marked), 256).alias("text_sha"))


@query
def conversation_texts(spark, d):
    joined = relational.joined_texts(R.table(spark, d, "conversations"), "conv_id", "turn", "text")
    return joined.select("conv_id", F.sha2("text", 256).alias("text_sha"), "n_parts")


@query
def chunk_boundaries(spark, d):
    rows = R.table(spark, d, "embeddings").select("label", "vec_id", V.unit(F.col("embedding")).alias("embedding"))
    marked = chunking.boundaries(chunking.adjacent_distances(rows, "label", "vec_id"), "label", "vec_id")
    return rounded(marked.select("label", "vec_id", "distance", "tau", "grp"), "distance", "tau")


@query
def document_chunks(spark, d):
    return chunking.chunk_documents(R.table(spark, d, "documents"), "doc_id", "text")


@query
def chunk_keyphrases(spark, d):
    return chunking.keyphrases(R.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "keyphrases")


@query
def technology_cooccurrence(spark, d):
    return R.technology_pairs(spark, d)


@query
def concept_neighbourhoods(spark, d):
    near = graph.both_ways(R.concept_pairs(spark, d).select("src", "dst"))
    return near.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("neighbours"), F.min("dst").alias("first"), F.max("dst").alias("last"))


@query
def prerequisite_edges(spark, d):
    return rounded(R.concept_prerequisites(spark, d), "refd")


@query
def orphan_entities(spark, d):
    nodes = R.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit("Concept").alias("label"))
    return graph.orphans(nodes, R.concept_pairs(spark, d)).select("key")


@query
def alias_merges(spark, d):
    names = F.array(*[F.lit(x) for x in ("K8s", "Kubernetes", "kube", "JS", "JavaScript", "Rust", "Postgres", "pg", "sklearn", "Brand")])
    name = F.element_at(names, (F.pmod("p_partkey", F.lit(10)) + 1).cast("int"))
    name = F.when(name == "Brand", F.col("p_brand")).otherwise(name)
    nodes = R.table(spark, d, "part").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("key"), F.lit("Technology").alias("label"), name.alias("name"))
    return graph.alias_canonical(nodes, N.resolve_alias(T.ascii_slug(F.col("name"))))


@query
def similar_entities(spark, d):
    nodes = R.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("label"), "embedding")
    return rounded(graph.top_similar(nodes, threshold=0.25), "similarity")


@query
def embedding_merges(spark, d):
    nodes = R.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("label"), "embedding")
    return graph.embedding_canonical(nodes, threshold=0.3)


@query
def merged_edges(spark, d):
    canonical = R.table(spark, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") - 1).alias("to"))
    return graph.rewrite(R.concept_pairs(spark, d), canonical)


def _nation_edges(spark, d):
    nations = R.table(spark, d, "nation")
    n = F.col("n_nationkey")
    hop = lambda a, b: nations.select(n.alias("src"), F.pmod(n * a + b, F.lit(25)).alias("dst"), (F.pmod(n * 7 + b, F.lit(11)) / 10).alias("refd"))
    return hop(7, 3).union(hop(3, 11)).where("src <> dst").dropDuplicates(["src", "dst"])


@query
def graph_cycles(spark, d):
    found = graph.cycles(_nation_edges(spark, d))
    return found.select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"), "refd")


@query
def broken_cycles(spark, d):
    edges = _nation_edges(spark, d)
    return graph.break_cycles(edges, graph.cycles(edges)).select("src", "dst")


def _rank_edges(spark, d):
    return graph.both_ways(R.concept_pairs(spark, d).select("src", "dst"))


@query
def pagerank(spark, d):
    return rounded(graph.pagerank(_rank_edges(spark, d)), "pagerank")


@query
def pagerank_weighted(spark, d):
    return rounded(graph.pagerank_weighted(R.concept_pairs(spark, d), rounds=100, tolerance=1e-12), "pagerank", digits=7)


@query
def central_concepts(spark, d):
    ranks = rounded(graph.pagerank(_rank_edges(spark, d)), "pagerank")
    return ranks.orderBy(F.desc("pagerank"), "key").limit(20)


@query
def learning_gaps(spark, d):
    orders = R.table(spark, d, "orders").where("o_custkey % 100 = 7").select(F.col("o_orderkey").alias("chunk"))
    studied = R.concept_mentions(spark, d).join(orders, "chunk", "left_semi").select("key")
    ranks = rounded(graph.pagerank(_rank_edges(spark, d)), "pagerank")
    return graph.learning_gaps(studied, R.concept_prerequisites(spark, d), ranks)


def _path_target(edges: DataFrame):
    row = edges.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").first()
    return row[0] if row else 0


@query
def learning_path(spark, d):
    edges = materialise(R.concept_prerequisites(spark, d), "prerequisites")
    return graph.learning_path(edges, _path_target(edges))


@query
def prerequisite_chains(spark, d):
    edges = materialise(R.concept_prerequisites(spark, d).select("src", "dst"), "prerequisites")
    chain = edges.select("src", "dst", F.lit(1).alias("length"))
    found = chain
    for n in (2, 3, 4):
        chain = chain.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"), F.lit(n).alias("length"))
        found = found.union(chain)
    return found.groupBy("length").agg(F.count("*").alias("chains"))


@query
def entity_neighbours(spark, d):
    pairs = R.concept_pairs(spark, d)
    return graph.neighbours(materialise(pairs, "pairs"), 1, depth=2, limit=50)


@query
def entity_neighbourhood(spark, d):
    edges = materialise(R.typed_edges(spark, d), "edges")
    found = graph.neighbourhood(R.concept_nodes(spark, d), edges, 1, depth=2)
    return found.select("key", "label", "name", "pagerank", "relationship_type", "relationship_weight", "hops")


@query
def graph_search_nodes(spark, d):
    edges = materialise(R.typed_edges(spark, d), "edges")
    found = search.graph_search(spark, lambda: (R.concept_nodes(spark, d), edges), R.query_vector(spark, d), hops=2)
    return rounded(found.nodes.select("key", "label", "name", "activation", "pagerank", F.lit(found.degraded).alias("degraded")), "activation")


@query
def graph_search_edges(spark, d):
    edges = materialise(R.typed_edges(spark, d), "edges")
    found = search.graph_search(spark, lambda: (R.concept_nodes(spark, d), edges), R.query_vector(spark, d), hops=2)
    return found.edges.select("src", "dst", "type", "weight")


@query
def graph_overview(spark, d):
    docs = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    parts = R.table(spark, d, "part").select(F.lit("Concept").alias("label"))
    techs = R.table(spark, d, "supplier").select(F.lit("Technology").alias("label"))
    return graph.overview(docs, parts.union(techs), R.concept_pairs(spark, d))


@query
def search_seeds(spark, d):
    return rounded(search.seeds(R.concept_nodes(spark, d), R.query_vector(spark, d), k=5), "score")


@query
def graph_activation(spark, d):
    nodes, edges = R.concept_nodes(spark, d), materialise(R.concept_pairs(spark, d), "pairs")
    start = edges.select(F.col("src").alias("key")).distinct().orderBy("key").limit(5)
    return rounded(search.activation(nodes, edges, R.query_vector(spark, d), start), "activation")


@query
def reach_activation(spark, d):
    nodes, edges = R.concept_nodes(spark, d), materialise(R.concept_pairs(spark, d), "pairs")
    start = edges.select(F.col("src").alias("key")).distinct().orderBy("key").limit(5)
    return rounded(search.activation_by_reach(nodes, edges, R.query_vector(spark, d), start), "activation")


@query
def induced_edges(spark, d):
    keys = R.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"))
    return search.induced_edges(R.concept_pairs(spark, d), keys)


@query
def retrieval_evaluation(spark, d):
    rows = R.table(spark, d, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("wanted"))
    vectors = rows.select(F.col("vec_id").alias("id"), "embedding", "label")
    ranked = search.ranked_by_cosine(queries.drop("wanted"), vectors.drop("label"))
    judged = ranked.join(queries.drop("query"), "query_id").join(vectors.drop("embedding"), "id").withColumn("relevant", F.col("wanted") == F.col("label"))
    return rounded(search.evaluate(judged, "query_id", "rank", "relevant"), "hit_at_1", "hit_at_5", "hit_at_10", "mrr", "ndcg_at_10")


@query
def neighbour_f1(spark, d):
    rows = R.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    queries = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("wanted"))
    nearest = search.ranked_by_cosine(queries.drop("wanted"), rows.drop("label"), k=1)
    judged = nearest.join(queries.drop("query"), "query_id").join(rows.drop("embedding"), "id")
    return rounded(search.macro_f1(judged, "wanted", "label"), "classification_f1")


@query
def received_uploads(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.receive(docs, most=3000).select("doc_id", "byte_size", "code", "content_sha256")


@query
def emitted_events(spark, d):
    docs = R.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"))
    made = outbox.emit(docs, "document.uploaded", F.expr(NOW))
    return made.select("id", "event_type", "payload.document_id", "payload.user_id", "status", "retry_count", "max_retries")


@query
def marked_events(spark, d):
    marked = outbox.mark_claimed(R.outbox(spark, d), F.expr(NOW))
    return marked.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("locked_at") == F.expr(NOW)).alias("locked_now"), F.min("id").alias("first_id"))


@query
def completed_events(spark, d):
    events = R.outbox(spark, d)
    done = outbox.complete(events, events.where("status = 'PROCESSING' AND id % 3 = 0").select("id"))
    return done.groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query
def task_retries(spark, d):
    tasks = outbox.route(R.outbox(spark, d).where("status = 'PROCESSING'")).withColumn("retries", F.col("retry_count"))
    settled = outbox.settle(tasks.withColumn("error", F.when(F.col("id") % 2 == 1, F.lit("broken"))), F.expr(NOW))
    return settled.groupBy("task", "status", "retries").agg(F.count("*").alias("n"), F.max(F.unix_timestamp("due") - F.unix_timestamp(F.expr(NOW))).alias("wait_s"))


@query
def document_states(spark, d):
    docs = R.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "CHUNKED").otherwise("UPLOADED").alias("status"), F.lit(None).cast("string").alias("error_log"), F.lit(None).cast("int").alias("extracted_chars")
    )
    task = F.element_at(F.array(F.lit("ingest_document"), F.lit("chunk_document"), F.lit("classify_chunks"), F.lit("purge_document")), (F.col("doc_id") % 4 + 1).cast("int"))
    outcomes = R.table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("document_id"), task.alias("task"), F.when(F.col("doc_id") % 7 == 0, "no text").alias("error"), F.length("text").alias("chars"))
    return outbox.advance(docs, outcomes)


@query
def one_document(spark, d):
    return relational.get_document(R.documents(spark, d), "src3", 3).select("id", "user_id", "category", "title")


@query
def attached_clusters(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    heads = docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    signed = materialise(dedup.signatures(docs.join(heads, ["sha", "doc_id"], "left_semi"), "doc_id", "text"), "signatures")
    old, new = signed.where("doc_id % 2 = 0"), signed.where("doc_id % 2 = 1")
    known = dedup.attach(spark.createDataFrame([], "doc_id long, representative long"), dedup.similar_pairs(old, "doc_id"), "doc_id")
    return dedup.attach(known, materialise(dedup.links_to(new, old, "doc_id"), "links"), "doc_id")


@query
def claimed_events(spark, d):
    return outbox.claim(R.outbox(spark, d)).select("id", "event_type")


@query
def reclaimed_events(spark, d):
    done = outbox.reclaim(R.outbox(spark, d), F.expr(NOW))
    return done.groupBy("status").agg(F.count("*").alias("n"), F.count("locked_at").alias("locked"))


@query
def retried_events(spark, d):
    failed = R.outbox(spark, d).where("status = 'PROCESSING'")
    return outbox.retry(failed, F.repeat(F.lit("e"), 3000)).select("id", "status", "retry_count", F.length("error_log").alias("error_chars"))


@query
def routed_tasks(spark, d):
    return outbox.route(R.outbox(spark, d)).groupBy("event_type", "task").agg(F.count("*").alias("n"))


@query
def latest_statuses(spark, d):
    return outbox.latest_status(R.table(spark, d, "events"), "user_id", "event_type", "event_id")


@query
def windowed_events(spark, d):
    counted = outbox.windowed_counts(R.table(spark, d, "events"), "ts", "1 day")
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query
def user_sessions(spark, d):
    found = outbox.sessions(R.table(spark, d, "events"), "ts", "6 hours", "user_id")
    return found.select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


@query
def replay_items(spark, d):
    events = R.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("label"))
    return relational.replay_buffer(events).groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query
def replay_draw(spark, d):
    events = R.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"))
    return relational.replay_sample(events)


@query
def balanced_weights(spark, d):
    return rounded(relational.class_weights(R.table(spark, d, "events"), "event_type"), "weight")


@query
def classified_documents(spark, d):
    model = classify.train(classify.seed_rows(spark))
    return rounded(classify.classify(R.table(spark, d, "documents").select("doc_id", "text"), model).select("doc_id", "category", "category_conf"), "category_conf")


@query
def svo_triples(spark, d):
    return triples.extract_triples(R.table(spark, d, "documents"), "doc_id", "text")


@query
def triple_graph(spark, d):
    nodes, mentions, _ = triples.graph_rows(triples.extract_triples(R.table(spark, d, "documents"), "doc_id", "text"))
    return nodes.join(mentions.groupBy("key").agg(F.count("*").alias("chunks")), "key")


@query
def parsed_triples(spark, d):
    return triples.parsed_triples(R.parsed_orders(spark, d), "sentence_id")


@query
def resolved_texts(spark, d):
    long = F.concat(F.lit("  "), "text", F.lit("\n\n \t"), "text", F.lit("\n"))
    return R.table(spark, d, "documents").select("doc_id", F.sha2(triples.resolve_references(long), 256).alias("resolved_sha"))


@query
def structure_edges(spark, d):
    chunks = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_linenumber").alias("chunk_index"))
    nodes, edges = triples.structure_rows(chunks)
    return edges.join(nodes.select(F.col("key").alias("dst"), "label"), "dst")


@query
def self_training_rows(spark, d):
    rows = R.table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("category"), (F.pmod("doc_id", F.lit(10)) / 10).alias("category_conf"))
    return classify.confident(rows, updates=20)


@query
def corrected_categories(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"), F.lit(0.5).alias("category_conf"))
    return classify.correct(docs, R.table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("Personal").alias("label")), "doc_id")


@query
def resolved_aliases(spark, d):
    known = spark.createDataFrame(list(enumerate(N.ALIASES)), "n int, alias string")
    rows = R.table(spark, d, "part").select("p_partkey", F.pmod("p_partkey", F.lit(len(N.ALIASES))).cast("int").alias("n")).join(F.broadcast(known), "n")  # the aliases are a fixed list
    slugged = N.resolve_alias(T.ascii_slug(F.col("alias")))
    return rows.select("p_partkey", "alias", slugged.alias("slug"), N.is_technology(slugged).alias("technology"), records.display_name(slugged, F.col("alias")).alias("display"))


@query
def account_fields(spark, d):
    name = F.concat(F.lit(" \t"), "c_name", F.lit("\n"))
    return R.table(spark, d, "customer").select("c_custkey", records.account_email(F.concat("c_name", F.lit("@Mail.Example"))).alias("email"), records.account_name(name).alias("display_name"))


@query
def camel_rows(spark, d):
    return records.rename_keys(R.table(spark, d, "customer").select("c_custkey", "c_name", F.struct("c_nationkey", "c_acctbal").alias("c_home_data"))).select("cCustkey", "cName", "cHomeData.cNationkey", "cHomeData.cAcctbal")


@query
def packed_numbers(spark, d):
    numbers = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(-F.col("l_partkey").cast("bigint") * 1000003)).alias("numbers"))
    packed = numbers.withColumn("packed", records.pack_uint64(F.col("numbers")))
    return packed.select("l_orderkey", F.lower(F.hex("packed")).alias("packed_hex"), F.array_join(records.unpack_uint64(F.col("packed")).cast("array<string>"), ",").alias("unpacked"))


@query
def status_lines(spark, d):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return R.table(spark, d, "orders").select("o_orderkey", records.status_lines(F.col("o_orderkey").alias("document_id"), status.alias("status")).alias("line"))


@query
def merged_edges_by_type(spark, d):
    rows = R.table(spark, d, "lineitem")
    old = rows.where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("MENTIONS").alias("type")).agg(F.min("l_orderkey").alias("chunk"))
    new = rows.where("l_linenumber > 1").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("MENTIONS").alias("type"), F.col("l_orderkey").alias("chunk"))
    return sinks.merge_edges(old, new)


@query
def sidecar_texts(spark, d):
    docs = R.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    texts = R.table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("document_id"), "text")
    return sinks.with_sidecars(docs, texts).select("id", "lang", F.sha2("text", 256).alias("text_sha"), "error")


@query
def upserted_users(spark, d):
    events = R.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return sinks.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query
def replaced_chunks(spark, d):
    lines = R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = lines.where("l_orderkey % 5 = 0 AND l_linenumber <= 2")
    return sinks.replace_children(lines, new, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query
def updated_documents(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", "lang", "source")
    changes = R.table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("xx").alias("lang"))
    return sinks.conditional_update(docs, changes, "doc_id", ["lang"])


@query
def merged_nodes(spark, d):
    old = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    new = R.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return sinks.merge_nodes(old, new)


@query
def purged_orders(spark, d):
    gone = R.table(spark, d, "customer").where("c_custkey % 7 = 0").select("c_custkey")
    left = sinks.purge(R.table(spark, d, "orders"), "o_custkey", gone, "c_custkey")
    return left.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def purged_graph(spark, d):
    nodes = R.table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    kept, edges = sinks.purge_graph(nodes, R.concept_pairs(spark, d), nodes.where("key % 4 = 1"))
    return edges.join(kept.withColumnRenamed("key", "src").hint("merge"), "src", "left_semi").select("src", "dst", "weight")


@query
def vector_rows(spark, d):
    chunks = R.documents(spark, d).select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.nullif("category", F.lit("fr")).alias("category"), "user_id", "text")
    rows = sinks.chunk_vectors(chunks, R.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"))
    return rows.select("chunk_id", "category", "user_id", "preview", F.size("embedding").cast("long").alias("dimensions"))


@query
def studied_concepts(spark, d):
    orders = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("user_id"))
    return R.concept_mentions(spark, d).join(orders, "chunk").groupBy("user_id").agg(F.count_distinct("key").alias("concepts"))


@query
def events_in_pages(spark, d):
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return R.table(spark, d, "events").select("event_type", "event_id", rank.alias("rank")).where("rank <= 5")
