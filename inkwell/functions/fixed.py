"""Texts, word lists and limits that results depend on. Nothing here is computed."""

# Limits and defaults.
MAX_LINES = 50
MAX_BUFFERS, MAX_LINES_PER_BUFFER = 3, 10
MAX_DIAGNOSTICS, DIAGNOSTIC_RANGE = 3, 10
MAX_DEFINITIONS, MAX_LINES_PER_DEFINITION = 5, 50
MAX_PARENTS, MAX_CONTEXT_SIZE = 3, 500
CONTEXT_TIMEOUT_MS, DEBOUNCE_MS, IDLE_MS = 500, 150, 1000
BUFFERED_EVENTS, FLUSH_SECONDS = 50, 30
CACHED_BUFFERS = 50
DEFAULT_PRIORITY = 10
DEFAULT_OVERLAP = "1+1"

# Severities, log levels, symbol kinds, formatter aliases.
SEVERITIES = {1: "ERROR", 2: "WARN", 3: "INFO", 4: "HINT"}
LOG_LEVELS = {"TRACE": 1, "DEBUG": 2, "INFO": 3, "WARN": 4, "ERROR": 5}
FUNCTION_KINDS = ("Function", "Method", "Constructor")
FORMATTERS = ("chat", "fim")
FORMATTER_ALIASES = {"general_ai": "chat", "ollama_code": "fim", "santacoder": "fim", "codestral": "fim"}

# Syntax node types that are identifiers.
IDENTIFIER_TYPES = (
    "identifier", "type_identifier", "field_identifier", "property_identifier", "shorthand_property_identifier",
    "shorthand_property_identifier_pattern", "jsx_identifier", "private_property_identifier", "namespace_identifier",
    "name", "qualified_name", "variable_name",
)

# Names never looked up, for all filetypes and by filetype.
SKIP_NAMES = ("true", "false", "null", "nil")
SKIP_NAMES_BY_FILETYPE = {
    "javascript": ("undefined", "this", "super"),
    "typescript": ("undefined", "this", "super"),
    "typescriptreact": ("undefined", "this", "super"),
    "javascriptreact": ("undefined", "this", "super"),
    "python": ("self", "cls", "True", "False", "None"),
    "java": ("this", "super"),
    "kotlin": ("this", "super"),
    "cs": ("this", "base"),
    "dart": ("this", "super"),
    "ruby": ("self",),
    "php": ("this", "self", "parent"),
    "c": ("NULL",),
    "cpp": ("this", "NULL", "nullptr"),
    "lua": ("self",),
    "swift": ("self", "Self", "super"),
    "rust": ("self", "Self"),
}

# Syntax node types that hold a whole definition.
CONTAINER_TYPES = (
    "function_declaration", "function_definition", "function_item", "function", "method_definition", "method_declaration",
    "class_declaration", "class_definition", "interface_declaration", "type_alias_declaration", "lexical_declaration",
    "variable_declaration", "const_declaration", "let_declaration", "export_statement", "decorated_definition", "assignment",
    "struct_item", "enum_item", "impl_item", "trait_item", "union_item", "const_item", "static_item", "type_item", "mod_item",
    "macro_definition", "type_declaration", "type_spec", "type_alias", "constructor_declaration", "field_declaration",
    "enum_declaration", "record_declaration", "struct_declaration", "property_declaration", "namespace_declaration",
    "namespace_definition", "delegate_declaration", "event_declaration", "operator_declaration", "declaration",
    "type_definition", "struct_specifier", "enum_specifier", "union_specifier", "class_specifier", "template_declaration",
    "alias_declaration", "using_declaration", "method", "module", "singleton_method", "object_declaration",
    "trait_declaration", "mixin_declaration", "extension_declaration",
)

# Prompt texts.
CHAT_SYSTEM_1 = """You are a coding companion.
You need to suggest code for the language """
CHAT_SYSTEM_2 = """

Given some code prefix and suffix for context, output code which should follow the prefix code.
You should only output valid code in the language """
CHAT_SYSTEM_3 = r"""
. to clearly define a code block, including white space, we will wrap the code block
with tags.
Make sure to respect the white space and indentation rules of the language.
Do not output anything in plain language, make sure you only use the relevant programming language verbatim.
For example, consider the following request:
<code_prefix>def print_hello():</code_prefix><code_suffix>\n    return</code_suffix><code_middle>
Your answer should be:

    print("Hello")</code_middle>
"""
CHAT_CONTEXT = "\nAdditional Context for the current code section (use this to provider better informed completions):\n"
PREFIX_OPEN, PREFIX_CLOSE = "<code_prefix>", "</code_prefix>"
SUFFIX_OPEN, SUFFIX_CLOSE = "<code_suffix>", "</code_suffix>"
MIDDLE_OPEN = "<code_middle>"
REJECTED_REPLY = "That completion was rejected. Please suggest a different completion for the same position."
FIM_SYSTEM = "You are a code completion assistant. Given a code prefix and suffix, output ONLY the code that should go between them. Do not include any explanation."
FIM_USER_1 = "Complete the code between the prefix and suffix.\n\nPrefix:\n"
FIM_USER_2 = "\n\nSuffix:\n"
END_OF_TEXT = "<EOT>"
DIAGNOSTICS_HEADER = "-- LSP Diagnostics:\n"
BUFFERS_HEADER = "-- Related buffer content:\n"
BUFFER_NAME = "-- From buffer: "
DEFINITIONS_HEADER = "-- LSP Definitions:"
TRUNCATED = "\n-- [truncated]"
