"""Subject-verb-object triples and what they add to the graph."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from loomgraph.config import DISCONNECTED, MAX_COREF_CHARS, MAX_SENTENCE_TOKENS, MAX_TREE_DISTANCE
from loomgraph.functions.names import TECHNOLOGY_SLUGS, is_technology, plain_slug
from loomgraph.functions.text import entity_key, slug

# The verbs that make a project use a technology.
USE_VERBS = ("use", "uses", "using", "employ", "adopt")
VERBS = {
    "use": "use", "uses": "use", "used": "use", "using": "use", "employ": "employ", "employs": "employ", "adopt": "adopt",
    "adopts": "adopt", "is": "be", "are": "be", "was": "be", "has": "have", "have": "have", "contains": "contain",
    "supports": "support", "runs": "run", "builds": "build", "built": "build", "writes": "write", "wrote": "write",
    "provides": "provide", "requires": "require", "extends": "extend", "manages": "manage", "stores": "store",
}
_BREAK = frozenset("and or but which that who with in on at by for from to of as".split())


def tree_distance(heads: list[int], a: int, b: int) -> int:
    """Edges between two tokens of a dependency tree given by each token's head; a root is its own."""

    def way(i: int) -> list[int]:
        up = [i]
        while heads[up[-1]] != up[-1] and len(up) <= len(heads):
            up.append(heads[up[-1]])
        return up

    left, right = way(a), way(b)
    depth = {node: d for d, node in reversed(list(enumerate(left)))}
    return next((d + depth[node] for d, node in enumerate(right) if node in depth), DISCONNECTED)


@F.udf(IntegerType())
def syntactic_distance(heads: list[int], a: int, b: int) -> int | None:
    return None if heads is None or a is None or b is None else tree_distance(heads, a, b)


def sentence_triples(sentence: str, most: int = MAX_TREE_DISTANCE) -> list[tuple[str, str, str]]:
    """Triples around known verbs: the run of words before is the subject, the one after the object.

    The rule-based default where no parser is installed: heads are read off word
    order, and a triple stands when its ends are near enough to the verb.
    """
    words = re.findall(r"[\w.+#-]*[\w+#]", sentence)
    found = []
    if len(words) > MAX_SENTENCE_TOKENS:
        return found
    for i, word in enumerate(words):
        verb = VERBS.get(word.lower())
        if not verb:
            continue
        before, after = [], []
        for w in reversed(words[max(0, i - most) : i]):
            if w.lower() in _BREAK or w.lower() in VERBS:
                break
            before.insert(0, w)
        for w in words[i + 1 : i + 1 + most]:
            if w.lower() in _BREAK or w.lower() in VERBS:
                break
            after.append(w)
        if before and after:
            found.append((" ".join(before), verb, " ".join(after)))
    return found


def entity_label(name: str) -> str:
    """Technology by the gazetteer, Person for two capitalised words, Project for one, else Concept."""
    if plain_slug(name) in TECHNOLOGY_SLUGS:
        return "Technology"
    parts = name.split()
    if len(parts) == 2 and all(p[:1].isupper() and p[1:].islower() for p in parts):
        return "Person"
    return "Project" if len(parts) == 1 and name[:1].isupper() and any(c.isupper() for c in name[1:]) else "Concept"


def extract_triples(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(chunk_id, subject, verb, object, subj_type, obj_type)``, one row for each object."""
    kind = chunks.schema[chunk_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sentence in re.split(r"(?<=[.!?])\s+", body or ""):
                    for s, v, o in sentence_triples(sentence):
                        for column, value in zip(rows, (key, s, v, o, entity_label(s), entity_label(o)), strict=True):
                            column.append(value)
            yield pa.record_batch([pa.array(rows[0], batch.schema.field(0).type), *[pa.array(r, pa.string()) for r in rows[1:]]], names=["chunk_id", "subject", "verb", "object", "subj_type", "obj_type"])

    schema = f"chunk_id {kind}, subject string, verb string, object string, subj_type string, obj_type string"
    return chunks.select(chunk_id, text).mapInArrow(run, schema)


# The dependencies that make a token a verb's subject or one of its objects.
SUBJECTS = ("nsubj", "nsubjpass")
OBJECTS = ("dobj", "pobj", "attr", "dative", "obj")


def parsed_triples(sentences: DataFrame, key: str, most: int = MAX_TREE_DISTANCE, longest: int = MAX_SENTENCE_TOKENS) -> DataFrame:
    """``(key, subject, verb, object, subj_type, obj_type)`` of parsed sentences, in one pass without a shuffle.

    ``tokens`` is an array of structs ``(text, lemma, pos, dep, head, ent)``, ``head`` a place in it
    from 0; ``noun_chunks`` one of ``(first, stop, root)``. A verb, an auxiliary or a root takes its first
    subject and each of its objects, a token as its noun chunk where it is the root of one.
    Subject and object hang on one verb, so they are two edges apart: with ``most`` under two
    nothing is found. Sentences of more than ``longest`` tokens, and null ones, give nothing.
    """
    verbs = sentences.where(F.size("tokens") <= longest).select(key, "tokens", "noun_chunks", F.posexplode("tokens").alias("__v", "__verb"))
    verbs = verbs.where(F.col("__verb.pos").isin("VERB", "AUX") | (F.col("__verb.dep") == "ROOT"))

    def hanging(kinds: tuple[str, ...]) -> Column:
        places = F.transform("tokens", lambda t, i: F.when((t["head"] == F.col("__v")) & (i != F.col("__v")) & t["dep"].isin(*kinds), i))
        return F.filter(places, lambda i: i.isNotNull())

    def phrase(place: Column) -> Column:
        chunk = F.get(F.filter("noun_chunks", lambda c: c["root"] == place), 0)
        words = F.transform(F.slice("tokens", chunk["first"] + 1, chunk["stop"] - chunk["first"]), lambda t: t["text"])
        return F.coalesce(F.array_join(words, " "), F.get(F.col("tokens"), place)["text"])

    ends = verbs.withColumn("__s", F.get(hanging(SUBJECTS), 0)).where(F.col("__s").isNotNull() & F.lit(most >= 2))
    ends = ends.withColumn("__o", F.explode(hanging(OBJECTS)))
    named = ends.select(
        key, phrase(F.col("__s")).alias("subject"), F.lower("__verb.lemma").alias("verb"), phrase(F.col("__o")).alias("object"),
        F.get(F.col("tokens"), F.col("__s"))["ent"].alias("__se"), F.get(F.col("tokens"), F.col("__o"))["ent"].alias("__oe"),
    )
    types = (assign_label(slug(F.col("subject")), F.col("__se")).alias("subj_type"), assign_label(slug(F.col("object")), F.col("__oe")).alias("obj_type"))
    return named.select(key, "subject", "verb", "object", *types)


def resolve_references(text: Column, resolver: Callable[[Column], Column] | None = None, longest: int = MAX_COREF_CHARS) -> Column:
    """Texts with pronouns resolved by ``resolver``, stripped and over ``longest`` characters paragraph by paragraph.

    Without a resolver, or where it gives null or nothing, a text stays as it is.
    """

    def one(part: Column) -> Column:
        bare = F.regexp_replace(part, r"^\s+|\s+$", "")
        return bare if resolver is None else F.coalesce(F.nullif(resolver(bare), F.lit("")), bare)

    return F.when(F.length(text) > longest, F.array_join(F.transform(F.split(text, "\n\n", -1), one), "\n\n")).otherwise(one(text))


def structure_rows(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of documents and chunks, and HAS_CHUNK edges, of ``(document_id, chunk_id, chunk_index)`` rows."""
    doc, chunk = F.concat(F.lit("document:"), F.col("document_id").cast("string")), F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))
    nodes = chunks.select(doc.alias("key"), F.lit("Document").alias("label")).distinct().union(chunks.select(chunk, F.lit("Chunk")).distinct())
    return nodes, chunks.select(doc.alias("src"), chunk.alias("dst"), F.lit("HAS_CHUNK").alias("type"), "chunk_index").distinct()


def assign_label(slugged: Column, entity_type: Column) -> Column:
    """A node label from the gazetteer and a recogniser's entity type."""
    return F.when(is_technology(slugged), "Technology").when(entity_type == "PERSON", "Person").when(entity_type.isin("ORG", "PRODUCT"), "Project").otherwise("Concept")


def graph_rows(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity nodes, mentions and USES_TECH edges of triples."""
    ends = triples.select("chunk_id", F.explode(F.array(*[F.struct(F.col(t).alias("label"), F.col(n).alias("name")) for t, n in (("subj_type", "subject"), ("obj_type", "object"))])).alias("e"))
    keyed = ends.select("chunk_id", entity_key(F.col("e.label"), F.col("e.name")).alias("key"), "e.label", "e.name")
    nodes = keyed.groupBy("key").agg(F.min("label").alias("label"), F.min("name").alias("name"))
    uses = triples.where((F.col("subj_type") == "Project") & (F.col("obj_type") == "Technology") & F.col("verb").isin(*USE_VERBS))
    edges = uses.select(entity_key(F.col("subj_type"), F.col("subject")).alias("src"), entity_key(F.col("obj_type"), F.col("object")).alias("dst"), F.lit("USES_TECH").alias("type")).distinct()
    return nodes, keyed.select("chunk_id", "key").distinct(), edges
