"""operators of the citation-corpus engine."""
