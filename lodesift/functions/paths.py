"""What a path says about a file: language, tests, generated and vendored code. All are plain column predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by whole file name or extension.
LANGUAGE_OF = {
    ".go": "go",
    ".py": "python",
    ".pyw": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".java": "java",
    ".rb": "ruby",
    ".erb": "ruby",
    ".php": "php",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".groovy": "groovy",
    ".gvy": "groovy",
    ".gy": "groovy",
    ".gsh": "groovy",
    ".gsp": "groovy",
    "Jenkinsfile": "groovy",
    ".cs": "csharp",
    ".csx": "csharp",
    ".swift": "swift",
    ".rs": "rust",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".c++": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".hxx": "cpp",
    ".h++": "cpp",
    ".pl": "perl",
    ".pm": "perl",
    ".cgi": "perl",
    ".lua": "lua",
    ".zig": "zig",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".sql": "sql",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".json": "json",
    ".tf": "terraform",
    ".tfvars": "terraform",
    "Dockerfile": "dockerfile",
    ".dockerfile": "dockerfile",
}
# Extensions of files that hold no source text.
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".wav", ".avi", ".zip", ".tar", ".gz", ".bz2", ".exe", ".dll", ".so", ".dylib", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".doc", ".docx", ".lock")
# Parts of paths of generated files, and marks in their first 2,048 bytes.
GENERATED_PATHS = (".pb.go", ".pb.cc", ".pb.h", "_generated.go", "_gen.go", ".gen.go", ".gen.ts", ".generated.cs", "_generated.rs", "/node_modules/", "/vendor/", "/dist/", "/build/", "/__generated__/", "/generated/", ".min.js", ".min.css", ".bundle.js")
GENERATED_MARKS = ("// code generated", "// do not edit", "/* code generated", "/* do not edit", "# code generated", "# do not edit", "@generated", "auto-generated", "autogenerated", "this file is generated", "this file was generated", "generated by")
# Signs of test files.
TEST_DIRS = ("/test/", "/tests/", "/testdata/", "/fixtures/", "/fixture/", "/__tests__/", "/spec/", "/__mocks__/", "/__fixtures__/", "/testing/", "/test_data/", "/src/test/", "/src/it/")
TEST_SUFFIXES = ("_test.go", "_test.py", "_test.rb", "_test.rs", "_test.c", "_test.cpp", "_test.java", "_test.cs", ".test.js", ".test.jsx", ".test.ts", ".test.tsx", ".test.mjs", ".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx", ".spec.rb", "_spec.rb")
TEST_SUFFIXES_CASED = ("Test.java", "Tests.java", "IT.java", "ITCase.java", "Spec.java", "Test.kt", "Tests.kt", "IT.kt")
TEST_NAMES = ("conftest.py", "setup_test.go", "cypress.config.ts", "cypress.config.js", "playwright.config.ts", "playwright.config.js")
TEST_KEYWORDS = ("mock", "fake", "stub", "example")
# Signs of vendored libraries.
VENDORED_DIRS = ("/assets/private/", "/static/vendor/", "/third_party/", "/3rdparty/", "/external/", "/codefixes/", "/codefix/", "/snippets/challenge/")
VENDORED_SCRIPTS = ("jquery", "backbone", "underscore", "lodash", "moment", "angular.", "react.", "vue.", "bootstrap", "d3.", "three.", "ace.", "codemirror", "highlight", "prism", "wysihtml", "ckeditor", "tinymce", "quill", "popper", "chart.", "raphael", "ember", "knockout", "mootools", "prototype.", "dojo", "ext-all", "handlebars", "mustache", "require.", "modernizr", "socket.io")
# What a line that is only a comment starts with.
COMMENT_STARTS = r"^\s*(?://|#|--|;|%|/\*|\* |\*\t|\*/|<!--|REM |rem |\*\s*$)"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, or an empty text."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """The language of a path by its file name, then its extension; ``*`` if neither is known, null for null."""
    dim = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(dim, base_name(path)), F.try_element_at(dim, extension(path)), F.lit("*")))


def is_generated(path: Column, content: Column | None = None) -> Column:
    norm = F.concat(F.lit("/"), F.translate(path, "\\", "/"))
    tests = [F.contains(norm, F.lit(p)) for p in GENERATED_PATHS]
    if content is not None:
        head = F.lower(F.left(content, F.lit(2048)))
        tests += [F.contains(head, F.lit(m)) for m in GENERATED_MARKS]
    return F.coalesce(_any(tests), F.lit(False))


def is_scannable(path: Column) -> Column:
    return ~extension(path).isin(*BINARY_EXTENSIONS) & ~is_generated(path)


def is_vendored(path: Column) -> Column:
    norm = F.lower(F.concat(F.lit("/"), F.translate(path, "\\", "/")))
    script = (extension(path) == ".js") & _any([F.startswith(F.lower(base_name(path)), F.lit(p)) for p in VENDORED_SCRIPTS])
    return F.coalesce(_any([F.contains(norm, F.lit(d)) for d in VENDORED_DIRS]) | script, F.lit(False))


def is_test(path: Column) -> Column:
    norm = F.lower(F.concat(F.lit("/"), F.translate(path, "\\", "/")))
    base, low = base_name(path), F.lower(base_name(path))
    tests = [F.contains(norm, F.lit(d)) for d in TEST_DIRS] + [F.endswith(norm, F.lit(s)) for s in TEST_SUFFIXES]
    tests += [F.endswith(base, F.lit(s)) for s in TEST_SUFFIXES_CASED] + [low.isin(*TEST_NAMES)]
    tests += [F.startswith(low, F.lit("test_")) & F.endswith(low, F.lit(".py"))] + [F.contains(norm, F.lit(k)) for k in TEST_KEYWORDS]
    return F.coalesce(_any(tests), F.lit(False))


def is_comment(line: Column) -> Column:
    return line.rlike(COMMENT_STARTS)
