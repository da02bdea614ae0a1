"""Vocabulary and column types of the graph model."""

from __future__ import annotations

#: Label sets that name resolution distinguishes.
CALLABLE = ["Function", "Method"]
CONSTRUCTABLE = ["Class", "Struct", "Type", "Enum"]
TYPES = ["Class", "Interface", "Type", "Enum", "Struct", "Trait", "TypeAlias"]
DEFINITIONS = ["Function", "Method", "Class", "Interface", "Type", "Enum", "Struct", "Trait", "TypeAlias"]
IMPORTABLE = [x for x in DEFINITIONS if x != "Method"]
USABLE = [*DEFINITIONS, "Variable", "Field"]
#: Edge types that count as a reference, and those that are stored as USAGE.
REFERENCES = ["CALLS", "USAGE", "USES", "TYPE_REF", "IMPORTS"]
STORED_AS_USAGE = ["TYPE_REF", "USES", "USAGE"]
#: Limits on results, hops, cycles and neighbours of one node in traces and paths; reachability has none.
MAX_ROWS, MAX_HOPS, MAX_CYCLE = 10_000, 32, 16
TRACE_FANOUT, FANOUT = 1024, 10_000

NODES = "id bigint, project string, label string, name string, qualified_name string, file_path string, start_line bigint, end_line bigint, properties string"
EDGES = "id bigint, project string, source_id bigint, target_id bigint, edge_type string, properties string"
RAW_EDGES = "project string, file_path string, source_qname string, target_qname string, edge_type string, properties string"
CONTENT = "project string, rel_path string, line int, snippet string"
FILES = "rel_path string, size bigint, mtime_ns bigint, ctime_ns bigint, file_id bigint, sha256 string"
