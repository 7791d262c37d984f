"""functions of the citation-corpus engine."""
