"""Default parameters of the engine's operators."""

# Fixed values that results depend on.
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
CHUNK_PERCENTILE, CHUNK_MIN_CHARS, CHUNK_MAX_CHARS = 0.85, 100, 1500
SHINGLE_WORDS, NUM_PERMUTATIONS, NUM_BANDS, JACCARD_THRESHOLD = 3, 128, 16, 0.85
DAMPING, PAGERANK_ROUNDS, PAGERANK_FALLBACK_ROUNDS = 0.85, 20, 100
SEEDS, HOPS, DECAY, GATE, ACTIVATED_LIMIT, FALLBACK_NODES = 5, 3, 0.7, 0.25, 50, 500
PREREQ_THRESHOLD, MIN_COOCCURRENCE = 0.05, 2
MERGE_SIMILARITY, MERGE_TOP_K = 0.90, 5
REPLAY_CAPACITY, REPLAY_SAMPLE, SELF_TRAIN_CONFIDENCE = 2000, 64, 0.6
CLAIM_BATCH, STUCK_MINUTES, MAX_ERROR_CHARS, MAX_RETRIES = 100, 10, 2000, 5
PREVIEW_CHARS, REPLAY_CHARS = 240, 1000
MAX_TREE_DISTANCE, DISCONNECTED, MAX_SENTENCE_TOKENS, MAX_COREF_CHARS = 4, 999, 200, 8000
EMBEDDING_DIMENSIONS = 384

CATEGORIES = (
    "Programming", "Artificial Intelligence", "College", "Research", "Finance",
    "Personal", "Backend Development", "Frontend Development", "Networking", "Databases",
)

#: The state of a document after each task. Fixed values.
DONE = {"ingest_document": "EXTRACTED", "chunk_document": "CHUNKED", "classify_chunks": "INDEXED"}

#: Event type to the tasks it starts. Fixed values.
ROUTES = {
    "document.uploaded": ("ingest_document",),
    "document.text_ready": ("chunk_document",),
    "document.chunked": ("classify_chunks", "extract_triples", "detect_duplicates"),
    "document.deleted": ("purge_document",),
    "document.indexed": (),
}
