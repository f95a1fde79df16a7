"""stemma: content identity, file-tree manifests and dataset comparison on Spark DataFrames."""

__version__ = "0.1.0"
