"""Default parameters of the registered plans (one place, shared by Spark code and SQL twins)."""

# --- fixed values -------------------------------------------------------------------------------
MIN_DF = 10               # minimum document frequency (count)
MAX_DF = 0.5              # maximum document frequency (share of all documents)
SEED = 2019               # permutation / draw seed
VALID_SIZE = 100          # fixed-size validation hold-out of the training subset
TEST_ID_OFFSET = 1_000_000_000
TRAIN_SHARE = 0.85        # lines-style split shares
TEST_SHARE = 0.10
NUM_TOPICS = 10           # fixture model: topics = embedding labels
HIDDEN = 8                # fixture encoder hidden width
EVAL_BATCH = 1000         # documents per evaluation batch
TRAIN_BATCH = 64          # documents per training batch of the batches query
TOP_WORDS = 10            # words per topic for coherence
DIVERSITY_WORDS = 25      # words per topic for diversity
NUM_WORDS = 50            # top words shown per topic (num_words - 1 are listed)
NEIGHBOURS = 20           # nearest words per query word
QUANT = 1_000_000         # embedding quantisation step (1e-6)
# -------------------------------------------------------------------------------------------------
