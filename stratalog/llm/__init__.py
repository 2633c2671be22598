"""Operators of a training-data pipeline: near-duplicates, tokenisation, classifiers, scans and packing."""
