"""plans of the citation-corpus engine."""
