"""Fact tables of a repository knowledge graph, as explicit schemas, with their natural keys.

Ids are longs, flags booleans, lists arrays. Audit columns are left out: no query reads them.
"""

from __future__ import annotations

#: Names of tables and columns. Fixed values.
_DDL = {
    "repositories": ("id long, root_path string, vcs_type string", ["root_path"]),
    "index_runs": ("id long, repository_id long, started_at string, finished_at string, status string, files_scanned long, files_changed long, files_deleted long, error_message string", ["id"]),
    "files": ("id long, repository_id long, path string, language string, content_hash string, line_count long", ["repository_id", "path"]),
    "symbols": ("id long, file_id long, name string, qualified_name string, kind string, start_line long, end_line long", ["file_id", "qualified_name"]),
    "edges": ("source_symbol_id long, target_symbol_id long, unresolved_target string, kind string, confidence double, ordering long", ["source_symbol_id", "target_symbol_id", "unresolved_target", "kind"]),
    "docs": ("id long, file_id long, symbol_id long, title string, body string, start_line long, end_line long, source_kind string", ["id"]),
    "tests": ("id long, file_id long, name string, qualified_name string, kind string, is_parametrized boolean, framework string", ["file_id", "qualified_name"]),
    "git_commits": ("id long, repository_id long, commit_hash string, author_name string, author_email string, authored_date string, message string", ["repository_id", "commit_hash"]),
    "git_commit_files": ("commit_id long, file_path string", ["commit_id", "file_path"]),
    "git_commit_symbols": ("commit_id long, symbol_qualified_name string", ["commit_id", "symbol_qualified_name"]),
    "routes": ("id long, file_id long, symbol_id long, handler_name string, qualified_name string, method string, path string, response_model string", ["file_id", "qualified_name", "method", "path"]),
    "models": ("id long, file_id long, symbol_id long, name string, qualified_name string, start_line long, end_line long", ["file_id", "qualified_name"]),
    "model_fields": ("model_id long, name string, type_annotation string, default_value string, is_required boolean", ["model_id", "name"]),
    "model_validators": ("model_id long, name string, kind string, fields array<string>", ["model_id", "name"]),
    "packages": ("id long, repository_id long, name string, manifest_path string, version string, is_workspace_member boolean", ["repository_id", "name", "manifest_path"]),
    "dependencies": ("package_id long, name string, version_requirement string, is_workspace_dependency boolean, features array<string>, is_dev boolean", ["package_id", "name"]),
    "line_coverage": ("file_id long, report_path string, test_suite string, line long, hits long, branches_valid long, branches_covered long", ["file_id", "report_path", "test_suite", "line"]),
    "spawns": ("file_id long, symbol_qualified_name string, kind string, line long", ["file_id", "line", "kind"]),
    "channels": ("scope string, kind string, identity string, role string, line long", ["scope", "identity", "role", "line"]),
    "unsafe_blocks": ("file_id long, symbol_qualified_name string, start_line long, end_line long, is_wrapped boolean", ["file_id", "start_line"]),
    "unsafe_functions": ("file_id long, symbol_qualified_name string, start_line long, end_line long", ["file_id", "start_line"]),
    "ffi_bindings": ("file_id long, symbol_qualified_name string, line long", ["file_id", "line"]),
    "android_components": ("file_id long, kind string, name string, intent_actions array<string>", ["file_id", "name"]),
    "android_resources": ("file_id long, type string, name string, qualified_name string", ["file_id", "qualified_name"]),
}
SCHEMAS = {k: v[0] for k, v in _DDL.items()}
KEYS = {k: v[1] for k, v in _DDL.items()}

SYMBOL_KINDS = ("Module", "Class", "Struct", "Enum", "Trait", "Interface", "Function", "Method", "TypeAlias", "Unknown")
EDGE_KINDS = ("Calls", "Imports", "ReferencesType", "ModifiedWith", "ConfiguredBy", "TestedBy", "Spawns", "SendsTo", "Extends", "Implements", "DocumentedBy", "Contains")
#: Functions that only combine others: they aren't steps of a pipeline, and their arguments are its calls. Fixed values.
COMBINATORS = ("map", "filter", "reduce", "pipe", "compose", "flow", "bind", "then", "flatMap", "apply")
#: Edges along which a change has an impact; those of the context neighbourhood are the first four.
IMPACT_KINDS = ("Calls", "Imports", "ReferencesType", "ModifiedWith", "Spawns", "SendsTo")
CONTEXT_KINDS = IMPACT_KINDS[:4]
