"""Training-data operators: ten Spark jobs over documents and pages, and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only if it is there.
"""
