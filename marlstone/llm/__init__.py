"""Operators of a training-data pipeline: quality, licences, extraction, duplicates, personal data, packing."""
