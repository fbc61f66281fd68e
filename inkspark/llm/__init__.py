"""Operations of a large-scale training-data pipeline, one module for each, over the engine's tables.

Nothing else in the library imports this subpackage. ``inkspark.llm.registry`` lists its queries and their SQL.
"""
