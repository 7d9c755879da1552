"""Readers and writers of recordings, catalogues, tables of results and model artifacts."""
