"""Default parameter values shared by the operators."""

OUTLIER = -1

MIN_TEXT_LENGTH = 50
MIN_SENTENCE_LENGTH = 5

MIN_DOCS_PER_TOPIC = 5
MIN_TERM_SHARE = 0.01
MAX_TERM_SHARE = 0.95
NGRAMS = (1, 2)

SVD_DIMENSIONS = 100
SVD_OVERSAMPLE = 10
SVD_POWER_PASSES = 2
CLUSTER_DIMENSIONS = 5
NEIGHBOURS = 15
SEED = 42

ZERO_SHOT_THRESHOLD = 0.55
WORDS_PER_TOPIC = 10
LABEL_WORDS = 3
LABEL_SEPARATOR = ", "
REPRESENTATIVE_DOCS = 3
MMR_DIVERSITY = 0.5
MMR_CANDIDATES = 30

HIERARCHY_LEVELS = 10
HIERARCHY_NAME_WORDS = 5
DISPLAY_SAMPLE = 0.1
SAMPLE_ALL_BELOW = 100
BAR_TOPICS = 8
BAR_WORDS = 5

HOVER_WORDS = 300
HOVER_LINE = 20
LABEL_CHARS = 60
SHORT_LABEL_CHARS = 30

# Upper bounds for anything sent to every task or fetched to the driver.
# Each use checks the actual size first and takes a shuffle-based way beyond it.
SHIP_BYTES = 128 * 1024 * 1024
PAIR_TOPICS_LIMIT = 4_000

# Rows compared with each other in one task, trees of a neighbour search, and edges handled by one task.
FOREST_LEAF = 2_048
FOREST_TREES = 6
BLOCK_EDGES = 200_000
FENCE = 3.0  # quartile ranges over the third quartile from which a point is far from its topic
SVD_COLUMNS = 16_384  # rows of one block of the term-side matrix
