"""Operators of a training-data pipeline: texts, URLs and conversations in, decisions and packed sequences out."""
