"""Explicit schemas of the engine's inputs. Ids are strings everywhere."""

TARGET = "doc_id string, words array<string>, sentences array<array<int>>, sections array<array<int>>, n_ary_relations array<map<string,string>>, citances array<int>"
METADATA = "paper_id string, doi string, arxiv_id string, title string, outbound_citations array<string>, inbound_citations array<string>"
FULL_TEXT = "paper_id string, _pdf_hash string, body_text array<struct<text: string, cite_spans: array<struct<start: int, end: int, ref_id: string>>>>, bib_entries map<string, struct<link: string>>"
EXTERNAL = "doc_id string, doc_hash string, title string, doi string, arxivId string, url string"
DATASETS = "name string, variants array<string>, full_name string"
