"""Readers: line corpora, whole files, paged text, file catalogs, routing."""
