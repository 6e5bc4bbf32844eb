"""maskforge: a Spark-native engine for building and scoring line-completion datasets.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function built on
Spark's built-in expressions; Arrow-batched pandas UDFs are used only for the few
genuinely sequential per-row kernels (LCS, METEOR alignment, bracket folds).
"""

from maskforge.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
