"""Closed vocabularies and budgets (fixed values)."""

#: Keys of a tool call's arguments that name files.
PATH_KEYS = ("path", "file", "paths", "files", "filePath", "file_path")
#: Sections of the log report.
REPORT_SECTIONS = ("overview", "models", "cache", "tools", "files", "bash", "sessions")
TOP_ROWS = 12
BAR_WIDTH = 24

#: Kinds of graph nodes that are no symbols.
NON_SYMBOL_KINDS = ("file", "import", "export")
#: Kinds that hold members.
CONTAINER_KINDS = ("class", "interface", "struct", "trait", "protocol", "enum", "union", "module", "namespace", "component")
#: Kinds in order of preference; any other ranks behind them.
KIND_ORDER = (
    "interface", "class", "struct", "trait", "protocol", "enum", "type_alias", "component", "union",
    "function", "method", "property", "field", "variable", "constant", "parameter",
)
FORWARD_KINDS = ("calls", "references", "instantiates")
TYPE_KINDS = ("extends", "implements")
CALLER_KINDS = ("calls", "references", "imports", "instantiates")

BODY_LINES = 200
OUTPUT_CHARS = 40_000
NEIGHBORS = 8
MEMBERS_SHOWN = 50
DEPENDENTS_SHOWN = 8
PATHS = 20
EXPANSION_SHOWN = 60
MAX_DEPTH = 12
DEFAULT_DEPTH = 6
IMPACT_DEPTH = 2
HITS_PER_FILE = 100

#: Preference of subtitle formats.
FORMAT_SCORES = {"json3": 70, "srv3": 65, "ttml": 55, "srv2": 50, "srv1": 45, "vtt": 40, "srt": 35}
#: Types of knowledge pages.
PAGE_TYPES = ("entity", "concept", "source", "synthesis")
