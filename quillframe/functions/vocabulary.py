"""Word lists, operators and file name tables that results depend on."""

# The lexer's operators of several characters, in matching order.
OPERATORS = [
    "...", "<<=", ">>=", "**=",
    "==", "!=", "<=", ">=", "->", "=>", "::", "&&", "||",
    "+=", "-=", "*=", "/=", "%=", "++", "--", "<<", ">>",
    "<-", ":=", "**", "&=", "|=", "^=", "??", "?.",
]

# Keywords by class.
KEYWORDS = {
    1: ["return", "raise", "yield", "throw"],
    2: ["if", "else", "elif", "switch", "case", "match", "when", "catch", "except", "finally", "default"],
    3: ["for", "while", "each", "loop", "repeat", "do", "until"],
    4: ["func", "function", "def", "fn", "class", "struct", "type", "interface", "enum", "impl", "trait", "record"],
    5: ["import", "package", "from", "use", "include", "require", "mod", "module"],
    6: ["var", "let", "const", "local", "new", "final", "static", "pub"],
    7: [
        "try", "in", "of", "go", "defer", "async", "await", "then", "end", "begin", "nil", "null", "none", "true", "false", "this",
        "self", "super", "and", "or", "not", "with", "as", "pass", "break", "continue", "void", "int", "string", "bool", "float",
    ],
}
KEYWORD_CLASS = {w: k for k, ws in KEYWORDS.items() for w in ws}

# Words that open a definition, and words that cannot be its name.
DEFINITIONS = {
    "func": "func", "def": "func", "fn": "func", "function": "func", "class": "type", "interface": "type", "struct": "type",
    "enum": "type", "trait": "type", "type": "type", "const": "var", "var": "var", "let": "var",
}
NOT_NAMES = [
    "func", "def", "fn", "function", "class", "interface", "struct", "enum", "trait", "type", "const", "var", "let", "if", "for",
    "while", "switch", "return", "else", "do", "in", "of", "new", "this", "true", "false", "nil", "null", "None", "impl", "pub",
    "private", "public", "static", "async", "await", "where", "package", "import",
]

# Languages by file name and extension.
LANGUAGE_NAMES = {"dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile"}
LANGUAGE_EXTENSIONS = {
    "go": ["go"], "python": ["py", "pyi"], "typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"],
    "rust": ["rs"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hh"], "java": ["java"], "kotlin": ["kt", "kts"],
    "ruby": ["rb"], "php": ["php"], "shell": ["sh", "bash", "zsh"], "lua": ["lua"], "vim": ["vim"], "json": ["json", "jsonc"],
    "yaml": ["yaml", "yml"], "toml": ["toml"], "markdown": ["md", "markdown"], "css": ["css", "scss", "less"],
    "html": ["html", "htm"], "xml": ["xml"], "sql": ["sql"], "vue": ["vue"], "svelte": ["svelte"], "elixir": ["ex", "exs"],
    "erlang": ["erl", "hrl"], "haskell": ["hs"], "ocaml": ["ml", "mli"], "scala": ["scala", "sc"], "swift": ["swift"], "r": ["r"],
    "perl": ["pl", "pm"], "proto": ["proto"], "terraform": ["tf", "tfvars"], "nix": ["nix"], "dart": ["dart"], "zig": ["zig"],
    "csharp": ["cs"], "fsharp": ["fs", "fsx"], "clojure": ["clj", "cljs"], "dockerfile": ["dockerfile"], "text": ["txt", "text"],
}
FENCES = {
    "go": "go", "golang": "go", "py": "python", "python": "python", "js": "javascript", "javascript": "javascript", "ts": "typescript",
    "typescript": "typescript", "rs": "rust", "rust": "rust", "sh": "shell", "bash": "shell", "shell": "shell", "c": "c", "cpp": "cpp",
    "c++": "cpp", "java": "java", "lua": "lua", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "html": "html", "css": "css", "nix": "nix",
}

# Names, suffixes, folders and marks of files that are not read.
SKIP_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", "out", "target", "bin", "__pycache__", ".venv", "venv", ".next",
    ".nuxt", ".cache", ".idea", ".vscode", "coverage", "testdata", "third_party", "external",
]
SKIP_SUFFIXES = [
    ".min.js", ".min.css", ".lock", ".sum", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".zip", ".tar", ".gz",
    ".xz", ".pdf", ".so", ".dll", ".exe", ".bin", ".wasm", ".map", ".snap", ".pb.go", ".gen.go", ".generated.go", ".g.dart",
    ".designer.cs", ".svg", ".mp3", ".mp4", ".webm", ".webp", ".jar", ".class", ".o",
]
SKIP_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock", "poetry.lock"]
GENERATED_MARKS = ["DO NOT EDIT", "auto-generated", "autogenerated", "Auto-generated", "Automatically generated", "@generated"]
MAX_FILE_BYTES, MAX_LINE_BYTES = 1 << 20, 500

# Tokens and substrings that cannot be in a language's lines.
FOREIGN_TOKENS = {
    "python": ["func", "defer", "chan"], "go": ["def", "elif", "None", "self."], "javascript": ["elif", "def", "func", "chan", "defer"],
    "typescript": ["elif", "def", "func", "chan", "defer"], "java": ["def", "elif", "self."], "c": ["def", "elif", "self."], "cpp": ["def", "elif"],
}
FOREIGN_SUBSTRINGS = {
    "python": [":=", "};"], "go": ["=>", "->"], "javascript": [":=", "<-"], "typescript": [":=", "<-"], "rust": [":="], "java": [":=", "<-"],
    "c": [":="], "cpp": [":="],
}
