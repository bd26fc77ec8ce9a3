"""Schemas of the code-graph tables and the closed vocabularies of their columns."""

FILES = "file_id long, path string, language string, hash string, size_bytes long, loc long, last_indexed_at timestamp"
SYMBOLS = "symbol_id long, file_id long, path string, name string, kind string, start_line int, end_line int, signature string, visibility string, doc_comment string"
IMPORTS = "file_id long, source string, target string, is_relative boolean, imported_names array<string>, line int"
CALL_SITES = "file_id long, path string, caller string, callee string, line int, confidence double, resolution_strategy string"
NODES = "node string, kind string, name string, path string, language string, start_line int, end_line int, signature string, visibility string"
EDGES = "src string, dst string, kind string, weight double, confidence double, line int, strategy string"
VECTORS = "node string, kind string, backend string, dims int, vector array<float>"
GIT_CHANGES = "path string, status string, lines_added long, lines_deleted long"

EDGE_KINDS = ("contains", "imports", "calls")
SEVERITIES = ("error", "info", "warning")
