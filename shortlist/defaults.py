"""Default parameters.

Fixed values: they equal the defaults of the system whose results we match.
"""

# cut-offs at which metrics are reported
PREFETCH_K = (10, 20, 50, 100, 200, 500, 1000, 2000)
RERANK_K = (10, 20)

# candidate list lengths
TOP_K_HARD_NEGATIVES = 100
TOP_K_RERANK = 2000

# examples drawn per job (0 means all)
N_MINING_EXAMPLES = 50_000
N_RERANK_TRAIN = 10_000
N_RERANK_VALIDATION = 1_000

# documents sampled per query
MAX_POSITIVE = 1
MAX_HARD_NEGATIVE = 3
MAX_EASY_NEGATIVE = 1
ROWS_PER_BATCH = 100
N_DOCUMENT = 10

# losses
PREFETCH_MARGIN = 0.05
RERANK_MARGIN = 0.1
POSITIVE_LEVELS = (1, 2)
OTHER_QUERY_LEVEL = 4

# documents and vectors
EMBED_DIM = 200
MAX_SEQ_LEN = 512
MAX_DOC_LEN = 3
TITLE_LABEL = 0
ABSTRACT_LABEL = 1
BODY_LABEL = 2
CONTEXT_LABEL = 3
PADDING_LABEL = 10

# tokens with a meaning of their own
TARGET_MARK = "TARGETCIT"
CIT_TOKEN = "<cit>"
SEP_TOKEN = "<sep>"
EOS_TOKEN = "<eos>"
PAD_TOKEN = "<pad>"
UNK_TOKEN = "<unk>"
JACCARD_STOPWORDS = ("<num>", "<cit>")

# reranking input
MAX_INPUT_LENGTH = 512
QUERY_SHARE = 0.35

# lexical scoring
BM25_K = 1.2
BM25_B = 0.75

EPSILON = 1e-12
