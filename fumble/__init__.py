"""fumble — a Spark-native data engine for typo-correction corpora.

Every operator is a ``DataFrame -> DataFrame`` job or a ``Column`` builder;
the work runs inside Spark (Catalyst expressions first, Arrow-batched pandas
UDFs only where built-in functions cannot express the semantics).
"""

__version__ = "0.1.0"
