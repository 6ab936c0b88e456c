"""Values that fix results: word lists, maps and patterns."""

#: Fixed: file suffix to language, in the order in which suffixes are tried.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java",
    ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".h": "c", ".hpp": "cpp",
}

#: Fixed: suffix to language for the main language of a repository or diff; it differs from the map above.
MAIN_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java",
    ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".rb": "ruby", ".php": "php",
}

#: Fixed: substrings of lower-case paths that mark an interface file when an oversized group is split.
SPLIT_INTERFACES = (
    "/model/", "/models/", "/types/", "/interfaces/", "interface.go", "types.go", "model.go", "models.go",
    "_interface.py", "_types.py", "_model.py", ".d.ts",
)
#: Fixed: the same for grouping by layer.
GROUP_INTERFACES = (
    "/model/", "/models/", "/types/", "/interfaces/", "/dto/", "interface.go", "types.go", "model.go", "models.go",
    "_interface.py", "_types.py", "_model.py", "_models.py", ".d.ts", "types.ts", "interfaces.ts",
)
#: Fixed: the same for packing by layer, with result types.
PACK_INTERFACES = (*GROUP_INTERFACES, "result.go", "result.py")
#: Fixed: utilities, for both.
UTILITIES = (
    "/utils/", "/util/", "/helpers/", "/helper/", "/common/", "_utils.py", "_util.py", "_helper.py", "_helpers.py",
    "utils.go", "util.go", "helpers.go", "helper.go", "utils.ts", "util.ts", "helpers.ts", "helper.ts",
)
#: Fixed: controllers, for both.
CONTROLLERS = (
    "/controller/", "/controllers/", "/handler/", "/handlers/", "/api/", "/routes/", "/endpoints/", "_controller.py",
    "_handler.py", "_api.py", "controller.go", "handler.go", ".controller.ts", ".handler.ts",
)
#: Fixed: layers in the order in which they are tested and listed, with the cohesion of a group of each.
LAYERS = {"interface": 0.9, "util": 0.85, "controller": 0.8, "impl": 0.75}

#: Fixed: extension to the highlighter's language.
HIGHLIGHT = {
    "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "py": "python", "java": "java", "c": "c", "cpp": "cpp",
    "cc": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "go": "go", "rs": "rust", "php": "php", "rb": "ruby", "sh": "bash",
    "bash": "bash", "zsh": "bash", "json": "json", "xml": "xml", "html": "html", "css": "css", "scss": "scss", "sass": "sass",
    "less": "less", "sql": "sql", "md": "markdown", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "dockerfile": "docker",
}
#: Fixed: names shown for the highlighter's languages.
TYPE_NAMES = {
    "javascript": "JavaScript", "typescript": "TypeScript", "jsx": "React JSX", "tsx": "React TSX", "python": "Python", "java": "Java",
    "c": "C", "cpp": "C++", "go": "Go", "rust": "Rust", "php": "PHP", "ruby": "Ruby", "bash": "Shell Script", "json": "JSON", "xml": "XML",
    "html": "HTML", "css": "CSS", "scss": "SCSS", "markdown": "Markdown", "yaml": "YAML", "text": "Text",
}

#: Fixed: definitions by language as (pattern, type); the first group is the name.
DEFINITIONS = {
    "go": [
        (r"^\s*func\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function"),
        (r"^\s*func\s+\([^)]+\)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "method"),
        (r"^\s*type\s+([A-Za-z_][A-Za-z0-9_]*)\s+struct", "type"),
        (r"^\s*type\s+([A-Za-z_][A-Za-z0-9_]*)\s+interface", "interface"),
    ],
    "python": [
        (r"^\s*def\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"),
        (r"^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
    ],
    "javascript": [
        (r"^\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"),
        (r"^\s*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "function"),
        (r"^\s*(?:export\s+)?class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
    ],
    "typescript": [
        (r"^\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"),
        (r"^\s*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "function"),
        (r"^\s*(?:export\s+)?class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
        (r"^\s*(?:export\s+)?interface\s+([a-zA-Z_][a-zA-Z0-9_]*)", "interface"),
        (r"^\s*(?:export\s+)?type\s+([a-zA-Z_][a-zA-Z0-9_]*)", "type"),
    ],
    "java": [
        (r"^\s*(?:public\s+)?(?:abstract\s+)?(?:final\s+)?class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
        (r"^\s*(?:public\s+)?interface\s+([a-zA-Z_][a-zA-Z0-9_]*)", "interface"),
        (r"^\s*(?:public\s+)?enum\s+([a-zA-Z_][a-zA-Z0-9_]*)", "type"),
        (r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:[\w<>,\s]+)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "method"),
    ],
    "rust": [
        (r"^\s*fn\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"),
        (r"^\s*struct\s+([a-zA-Z_][a-zA-Z0-9_]*)", "type"),
        (r"^\s*enum\s+([a-zA-Z_][a-zA-Z0-9_]*)", "type"),
        (r"^\s*trait\s+([a-zA-Z_][a-zA-Z0-9_]*)", "interface"),
    ],
}
#: Fixed: words that the Java method pattern may match but are no methods.
JAVA_WORDS = ("if", "while", "for", "switch", "catch", "class", "interface", "enum")

#: Fixed: usages by language as (pattern, type); group 1 is the imported alias, group 2 the name. No type: function or class by case.
USAGES = {
    "go": [
        (r"\b([a-z][a-z0-9_]*)\s*\.\s*([A-Z][A-Za-z0-9_]*)", "type"),
        (r"\b([a-z][a-z0-9_]*)\s*\.\s*([A-Z][A-Za-z0-9_]*)\s*\(", "function"),
    ],
    "python": [(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\.\s*([a-zA-Z_][a-zA-Z0-9_]*)", None)],
    "javascript": [(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\.\s*([a-zA-Z_][a-zA-Z0-9_]*)", None)],
    "typescript": [(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\.\s*([a-zA-Z_][a-zA-Z0-9_]*)", None)],
    "java": [
        (r"\b([A-Z][a-zA-Z0-9_]*)\b()", "class"),
        (r"\b([A-Z][a-zA-Z0-9_]*)\s*\.\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "function"),
    ],
}

#: Fixed: messages of the suggestions, in order.
UNBALANCED = "Patches are unbalanced in size. Consider redistributing changes."
#: Fixed: lines from which a patch is large, and up to which it is small; hunks from which it has many.
LARGE_LINES, SMALL_LINES, MANY_HUNKS = 500, 20, 20
#: Fixed: lines up to which an atomic group stays whole, and the default size of a patch.
ATOMIC_LINES, TARGET_LINES = 500, 200
#: Fixed: symbols of a change that its patch's name may show.
SHOWN_SYMBOLS = 3

#: Fixed: definitions of the basic patterns by language, as (pattern, type); only the first line of a text can match.
BASIC = {
    "python": [
        (r"^\s*def\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"), (r"^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
        (r"^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*)", "import"), (r"^\s*from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import", "import"),
    ],
    "javascript": [
        (r"^\s*function\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"), (r"^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
        (r"^\s*const\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*function", "function"), (r"^\s*const\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*\(", "function"),
        (r"""^\s*import\s+.*from\s+['"]([^'"]+)['"]""", "import"),
    ],
    "typescript": [
        (r"^\s*function\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"), (r"^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
        (r"^\s*interface\s+([a-zA-Z_][a-zA-Z0-9_]*)", "interface"), (r"^\s*type\s+([a-zA-Z_][a-zA-Z0-9_]*)", "type"),
        (r"^\s*const\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=", "variable"), (r"""^\s*import\s+.*from\s+['"]([^'"]+)['"]""", "import"),
    ],
    "java": [
        (r"^\s*public\s+class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"), (r"^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
        (r"^\s*interface\s+([a-zA-Z_][a-zA-Z0-9_]*)", "interface"), (r"^\s*public\s+\w+\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "method"),
        (r"^\s*private\s+\w+\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "method"), (r"^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*)", "import"),
    ],
    "go": [
        (r"^\s*func\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"), (r"^\s*type\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+struct", "type"),
        (r"^\s*type\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+interface", "interface"), (r"""^\s*import\s+['"]([^'"]+)['"]""", "import"),
    ],
    "rust": [
        (r"^\s*fn\s+([a-zA-Z_][a-zA-Z0-9_]*)", "function"), (r"^\s*struct\s+([a-zA-Z_][a-zA-Z0-9_]*)", "type"), (r"^\s*enum\s+([a-zA-Z_][a-zA-Z0-9_]*)", "type"),
        (r"^\s*trait\s+([a-zA-Z_][a-zA-Z0-9_]*)", "interface"), (r"^\s*use\s+([a-zA-Z_][a-zA-Z0-9_:]*)", "import"),
    ],
}

#: Fixed: lines that are imports, by language, as patterns from the start of the line.
IMPORT_LINES = {
    "go": [
        r'^\s*"[a-z][a-z0-9_.-]*/[^"]+"\s*$', r'^\s*"[a-z][a-z0-9_]+"\s*$', r'^\s*\w+\s+"[a-z][a-z0-9_.-]*/[^"]+"\s*$',
        r'^\s*import\s+"[^"]+"', r'^\s*import\s+\w+\s+"[^"]+"', r"^\s*import\s+\(",
    ],
    "python": [r"^\s*import\s+\w+", r"^\s*from\s+\w+\s+import"],
    "java": [r"^\s*import\s+[\w\.]+;"],
    "javascript": [r"^\s*import\s+"],
    "typescript": [r"^\s*import\s+"],
    "rust": [r"^\s*use\s+[\w:]+"],
    "c": [r'^\s*#include\s*[<"][^>"]+[>"]'],
    "cpp": [r'^\s*#include\s*[<"][^>"]+[>"]'],
}

#: Fixed: strength and reason of a suggested dependency that gives none, and what a malformed repository is told.
SUGGESTED_STRENGTH, SUGGESTED_REASON, BAD_REPOSITORY = 0.8, "Identified by LLM", "Invalid repo format: "

#: Fixed: rows of a summary for a prompt, ids shown of an atomic group.
SUMMARY_ROWS, SUMMARY_IDS = 50, 5

#: Fixed: imports by language; of two groups the first is the name that stands for the path in code, of one it follows from the path.
IMPORTS = {
    "go plain": r'^\s*"([^"]+)"',
    "go alias": r'^\s*([a-z_][a-z0-9_]*)\s+"([^"]+)"',
    "python import": r"^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*)",
    "python from": r"^\s*from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import\s+(.+)",
    "script named": r"""^\s*import\s+\{([^}]+)\}\s+from\s+['"]([^'"]+)['"]""",
    "script default": r"""^\s*import\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+from\s+['"]([^'"]+)['"]""",
    "script space": r"""^\s*import\s+\*\s+as\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+from\s+['"]([^'"]+)['"]""",
    "java": r"^\s*import\s+(?:static\s+)?([a-zA-Z_][a-zA-Z0-9_.]*);",
}
