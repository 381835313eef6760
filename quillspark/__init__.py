"""quillspark: document ingestion, retrieval and tracker analytics on PySpark.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
starts a session on its own: callers pass one in (``quillspark.session``
builds a suitable one for scripts and tests).
"""

__version__ = "0.1.0"
