"""Operators for training-data pipelines: documents in, decisions per document out."""
