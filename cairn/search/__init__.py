"""Retrieval: the search index, ranked questions, graph expansion, slices of source, rendering."""
