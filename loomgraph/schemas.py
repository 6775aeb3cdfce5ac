"""Schemas of the engine's tables, as Spark DDL. Column names and enumerations."""

DOCUMENT = (
    "id string, user_id string, title string, kind string, mime_type string, source_path string, byte_size bigint, "
    "content_sha256 string, status string, error_log string, extracted_chars int, category string, category_conf double, "
    "cluster_id string, created_at timestamp, updated_at timestamp"
)
CHUNK = (
    "id string, document_id string, chunk_index int, text string, char_count int, "
    "keyphrases array<struct<text:string,rank:double,count:int>>, embedded boolean, created_at timestamp"
)
CHUNK_VECTOR = "chunk_id string, embedding array<float>, document_id string, chunk_index int, category string, user_id string, preview string"
OUTBOX_EVENT = (
    "id string, event_type string, payload struct<document_id:string,user_id:string>, status string, retry_count int, "
    "max_retries int, locked_at timestamp, error_log string, created_at timestamp, updated_at timestamp"
)
SIGNATURE = "document_id string, num_perm smallint, signature array<bigint>"
DUPLICATE_CLUSTER = "id string, representative_document_id string, member_count int"
DUPLICATE_MEMBER = "cluster_id string, document_id string, jaccard_est double"
REPLAY_ITEM = "id string, label string, text_ref string, created_at timestamp"
GRAPH_NODE = "key string, label string, name string, pagerank double, embedding array<float>, user_id string"
GRAPH_EDGE = "src string, dst string, type string, weight double, refd double"
TRIPLE = "chunk_id string, subject string, verb string, object string, subj_type string, obj_type string"

DOCUMENT_STATUS = ("UPLOADED", "EXTRACTING", "EXTRACTED", "CHUNKED", "INDEXED", "FAILED")
DOCUMENT_KIND = ("pdf", "docx", "txt", "md", "image", "bookmark", "note")
OUTBOX_STATUS = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
NODE_LABELS = ("Document", "Chunk", "Concept", "Technology", "Project", "Person")
EDGE_TYPES = ("HAS_CHUNK", "MENTIONS", "USES_TECH", "CO_OCCURS_WITH", "PREREQUISITE_OF", "DUPLICATE_OF")
