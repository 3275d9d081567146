"""Operators of a training-data pipeline: texts, near copies, repeats, leaks, mixes, archives."""
