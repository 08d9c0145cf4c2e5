"""Operators for preparing text corpora on Spark (deduplication, packing, language, HTML, WARC)."""
