"""framewright: a Spark-first analytics engine for document-image pipelines."""

__version__ = "0.1.0"
