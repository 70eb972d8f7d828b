"""Relational operators: chunking, lexical and dense search, fusion, evaluation, incremental indexing, jobs."""
