"""Training-data operators.

Ten operators over ``documents`` and ``embeddings``-shaped tables. Nothing outside this
subpackage imports it; ``__spark_entry__`` registers :func:`tallyspark.llm.queries.queries`
when it can be imported.
"""
