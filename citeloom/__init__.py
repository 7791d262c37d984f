"""citeloom: a citation-corpus analytics engine made of PySpark DataFrame plans."""
