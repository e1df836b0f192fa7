"""Fixed schemas of the code index (no inference)."""

FILES = "path string, content_hash string, branch string, language string, last_indexed_at bigint"
SYMBOLS = "id bigint, name string, kind string, file_path string, start_line int, end_line int, hash string, language string, fqid string, module string, owner_symbol_id bigint"
RELATIONS = "id bigint, from_id bigint, relation string, to_name string, to_symbol_id bigint, confidence double, call_expression string"
MODULES = "id bigint, name string, path string"
ALIASES = "id bigint, file_path string, alias string, source_module string, source_name string, resolved_fqid string"
EVENTS = "kind string, path string, dest string, ts timestamp"
META = "key string, value string"

TABLES = {"files": FILES, "symbols": SYMBOLS, "relations": RELATIONS, "modules": MODULES, "import_aliases": ALIASES, "meta": META}
