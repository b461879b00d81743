"""harrier: a retrieval, evaluation and document-processing engine on Spark DataFrames."""

__version__ = "0.1.0"
