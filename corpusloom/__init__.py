"""corpusloom: text-corpus and in-context-learning data jobs on PySpark DataFrames."""

__version__ = "0.1.0"
