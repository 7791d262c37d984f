"""streaming of the citation-corpus engine."""
