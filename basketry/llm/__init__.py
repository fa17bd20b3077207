"""Operators of a training-data pipeline: scoring, filters, duplicates, mixing, token files and chat samples."""
