"""sources of the citation-corpus engine."""
