"""Training-data operators: ten text and vector operators and the corpus pipeline.

Nothing else in the library imports this subpackage.
"""
