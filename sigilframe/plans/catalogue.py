"""The queries over the reference's operators, and their SQL."""

from . import audit_queries, dataset_queries, endless_queries, file_queries, model_queries, sequence_queries, stream_queries

PARTS = (dataset_queries, audit_queries, file_queries, sequence_queries, endless_queries, model_queries, stream_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
