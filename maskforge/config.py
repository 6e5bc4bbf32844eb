"""Fixed values that define the dataset semantics.

These must equal the values of the study being reproduced; they are stated here
plainly and together.
"""

# --- fixed values -----------------------------------------------------------
LINE_MASK_CHANCE = 0.4          # share of eligible lines that receive a marker
NUM_MARKERS = 15                # max completion tasks per file (per variant)
SPLIT_WEIGHTS = (("train", 0.8), ("test", 0.1), ("dev", 0.1))
RANDOM_SEED = 42
MARKER_TEMPLATE = "/*<marker:{i}>*/"
MARKER_PATTERN = r"/\*<marker:\d+>\*/"

# comment classes (bit flags)
NONE = 0
SINGLE_LINE = 1
MULTI_LINE = 2
DOCBLOCK = 4
ALL = SINGLE_LINE | MULTI_LINE | DOCBLOCK

# output dataset grid: type variants x comment classes
TYPE_VARIANTS = ("normal", "explicit", "untyped")
COMMENT_CLASSES = (("all", ALL), ("none", NONE), ("single_line", SINGLE_LINE),
                   ("multi_line", MULTI_LINE), ("docblock", DOCBLOCK))
# dimension codes used in reports
TYPE_CODES = (("normal", "OT"), ("explicit", "AT"), ("untyped", "NT"))
COMMENT_CODES = (("all", "AC"), ("none", "NC"), ("single_line", "SL"),
                 ("multi_line", "ML"), ("docblock", "DB"))

# the twelve paired comparisons (population 1, population 2)
COMPARISONS = (
    ("untyped-none", "normal-none"),
    ("untyped-all", "normal-all"),
    ("normal-none", "explicit-none"),
    ("normal-all", "explicit-all"),
    ("untyped-none", "untyped-all"),
    ("untyped-none", "untyped-single_line"),
    ("untyped-none", "untyped-multi_line"),
    ("untyped-none", "untyped-docblock"),
    ("normal-none", "normal-all"),
    ("normal-none", "normal-single_line"),
    ("normal-none", "normal-multi_line"),
    ("normal-none", "normal-docblock"),
)
METRICS = ("exact_match", "levenshtein", "bleu", "rouge", "meteor")
SINGLE_TOKEN_METRICS = ("exact_match", "levenshtein")
METRIC_CODES = (("exact_match", "EM"), ("levenshtein", "ES"), ("bleu", "B4"),
                ("rouge", "RL"), ("meteor", "MT"))
SIGNIFICANCE = 0.05

# training-data preparation
SOURCE_LEN = 936                # source tokens per sample
TARGET_LEN = 64                 # target tokens per sample
BLOCK_SIZE = 1024               # packed block length
EVAL_MARGIN = 100               # inputs are cut at block - margin
# ---------------------------------------------------------------------------
