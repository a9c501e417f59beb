"""sievekit — Spark-native dataset curation, similarity and multi-label analytics.

Subpackages
-----------
sources    readers/writers for the driver tables and the reference's file formats
functions  Column-expression builders (similarity, keys, text, token arrays)
operators  DataFrame -> DataFrame operators (cleaning, joins, aggregates, ranking,
           splits, similarity joins, graphs, metrics, models, sequences)
plans      the named end-to-end queries (one per SURVEY §7.4 row) + DuckDB oracles
streaming  Structured Streaming variants of ingest, running metric and decontamination
"""

__version__ = "0.1.0"
