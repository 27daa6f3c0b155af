"""Schemas of the stored tables."""

PAPERS = "paper_id string, title string, abstract string"
CONTEXTS = "context_id string, masked_text string, citing_id string, refid string"
CORPUS = "context_id string, positive_ids array<string>"
CORPUS_WITH_CANDIDATES = f"{CORPUS}, prefetched_ids array<string>"
VOCABULARY = "word string, idx int"
WORD_VECTORS = "word string, vector array<float>"
EMBEDDINGS = "paper_id string, vec array<float>"
POSTINGS = "term string, paper_id string, tf int, doc_len int"
DOC_STATS = "paper_id string, doc_len int"
CANDIDATES = "query_id string, paper_id string, rank int, score double"
QUERIES = "query_id string, citing_title string, citing_abstract string, local_context string"
BLOCK_INDEX = (
    "part int, term string, docs array<int>, tfs array<int>, blocks array<int>, "
    "ends array<int>, most_tf array<int>, least_len array<int>, ids array<string>, lens array<int>"
)
