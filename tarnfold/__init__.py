"""Tarnfold: document-corpus preparation, retrieval and ledgers as Spark DataFrame jobs."""
