"""Training-data operators on Spark tables of documents, pages and vectors.

Nothing else in the library imports this subpackage.
"""
