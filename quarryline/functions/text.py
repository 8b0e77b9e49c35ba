"""Scalar functions over text, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file ending, for indexing.
LANGUAGE_OF_ENDING = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".php": "php", ".rb": "ruby", ".go": "go", ".rs": "rust", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "bash", ".bash": "bash",
    ".zsh": "zsh", ".fish": "fish", ".ps1": "powershell", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".json": "json",
    ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".conf": "config", ".md": "markdown", ".txt": "text",
}
#: Display names of languages, for summaries.
DISPLAY_OF_ENDING = {
    ".js": "JavaScript", ".ts": "TypeScript", ".py": "Python", ".java": "Java", ".cpp": "C++", ".c": "C", ".cs": "C#", ".php": "PHP", ".rb": "Ruby", ".go": "Go", ".rs": "Rust", ".swift": "Swift", ".kt": "Kotlin",
    ".scala": "Scala", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".less": "LESS", ".json": "JSON", ".xml": "XML", ".yaml": "YAML", ".yml": "YAML", ".md": "Markdown", ".sh": "Shell", ".sql": "SQL",
}
#: MIME types of file endings.
MIME_OF_ENDING = {
    ".js": "application/javascript", ".ts": "application/typescript", ".jsx": "application/javascript", ".tsx": "application/typescript", ".py": "text/x-python", ".java": "text/x-java-source", ".cpp": "text/x-c++src",
    ".c": "text/x-csrc", ".h": "text/x-chdr", ".cs": "text/x-csharp", ".php": "application/x-httpd-php", ".rb": "application/x-ruby", ".go": "text/x-go", ".rs": "text/x-rust", ".md": "text/markdown", ".txt": "text/plain",
    ".json": "application/json", ".xml": "application/xml", ".html": "text/html", ".css": "text/css", ".scss": "text/x-scss", ".sass": "text/x-sass", ".less": "text/x-less", ".yml": "application/x-yaml",
    ".yaml": "application/x-yaml", ".toml": "application/toml", ".ini": "text/plain", ".cfg": "text/plain", ".conf": "text/plain",
}
#: Patterns of the kinds of code, tried in this order at the start of any line.
KIND_PATTERNS = {
    "function": r"(?m)^(function|def|async\s+function|const\s+\w+\s*=\s*\(|let\s+\w+\s*=\s*\(|var\s+\w+\s*=\s*\()",
    "class": r"(?m)^(class|interface|type\s+\w+\s*=)",
    "import": r"(?m)^(import|export|from|require\()",
    "comment": r"(?m)^(//|/\*|\*|#|<!--)",
}
#: Patterns of names; the first that matches gives the name.
FUNCTION_NAMES = (r"function\s+(\w+)", r"def\s+(\w+)", r"const\s+(\w+)\s*=", r"let\s+(\w+)\s*=", r"var\s+(\w+)\s*=", r"(\w+)\s*:\s*function", r"(\w+)\s*\(")
CLASS_NAMES = (r"class\s+(\w+)", r"interface\s+(\w+)", r"type\s+(\w+)\s*=")
#: Patterns of imported modules; all matches of all patterns count.
IMPORTS = (r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"import\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)", r"from\s+['\"]([^'\"]+)['\"]")
#: Branching words counted for cyclomatic complexity (signs between words never stand alone there).
BRANCHES = {"Python": "if|elif|else|while|for|try|except|and|or", "": "if|else|while|for|switch|case|catch"}
#: Patterns of functions and classes that are counted.
FUNCTION_COUNTS = {"Python": r"def\s+\w+", "": r"(?:function\s+\w+|const\s+\w+\s*=\s*\(|\w+\s*\(.*\)\s*=>)"}
CLASS_COUNTS = r"class\s+\w+"
#: A word border that only knows ASCII, as \b does in most engines but not in Java's.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def mapped(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """The value of a small fixed table; `default` for other keys."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def ending(path: Column) -> Column:
    """The ending of a path in lower case with its dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    return mapped(LANGUAGE_OF_ENDING, ending(path), "unknown")


def display_language(path: Column) -> Column:
    return mapped(DISPLAY_OF_ENDING, ending(path), "Unknown")


def mime_type(path: Column) -> Column:
    return mapped(MIME_OF_ENDING, ending(path))


def tokens_estimated(text: Column) -> Column:
    """A token for each four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")


def short_chunk_id(path: Column, index: Column, content: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws(":", path, index.cast("string"), F.substring(content, 1, 100))), 1, 12))


def chunk_id(alias: Column, path: Column, ordinal: Column, file_hash: Column) -> Column:
    """Hash over the chunk's place in its file; the ordinal counts over the whole file."""
    return F.sha2(F.concat_ws("∣", alias, path, ordinal.cast("string"), file_hash), 256)


def sanitized(alias: Column) -> Column:
    clean = F.substring(F.regexp_replace(alias, "[^A-Za-z0-9_-]", "-"), 1, 64)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("repo"))


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column) -> Column:
    """Rounded to an integer, halves up (also below zero)."""
    return F.floor(x + F.lit(0.5)).cast("int")


def first_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def code_kind(text: Column) -> Column:
    out = F.lit("code")
    bare = F.trim(text)
    for kind, p in reversed(KIND_PATTERNS.items()):
        out = F.when(bare.rlike(p), kind).otherwise(out)
    return F.when(text.isNull(), F.lit(None)).otherwise(out)


def imported_modules(text: Column) -> Column:
    """All captured modules, pattern after pattern; null if there is none."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in IMPORTS])
    return F.when(F.size(every) > 0, every)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor begin with // or #."""
    return F.size(F.filter(lines_of(text), lambda x: (F.length(_bare(x)) > 0) & ~_bare(x).startswith("//") & ~_bare(x).startswith("#")))


def strict_code_lines(text: Column) -> Column:
    """As code_lines, without lines of block comments."""
    return F.size(
        F.filter(lines_of(text), lambda x: (F.length(_bare(x)) > 0) & ~_bare(x).startswith("//") & ~_bare(x).startswith("#") & ~_bare(x).startswith("/*") & ~_bare(x).startswith("*"))
    )


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def cyclomatic(text: Column, lang: Column) -> Column:
    count = lambda w: F.regexp_count(text, F.lit(f"{LEFT}(?:{w}){RIGHT}"))
    return 1 + F.when(lang == "Python", count(BRANCHES["Python"])).otherwise(count(BRANCHES[""]))


def nesting_depth(text: Column) -> Column:
    """The greatest running difference of opening and closing brackets at the ends of lines, a fold in the JVM."""
    step = F.transform(lines_of(text), lambda x: F.regexp_count(x, F.lit(r"[{(]")) - F.regexp_count(x, F.lit(r"[})]")))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(step, zero, lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")), lambda a: a["most"])


def function_count(text: Column, lang: Column) -> Column:
    return F.when(lang == "Python", F.regexp_count(text, F.lit(LEFT + FUNCTION_COUNTS["Python"]))).otherwise(F.regexp_count(text, F.lit(LEFT + FUNCTION_COUNTS[""])))


def class_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LEFT + CLASS_COUNTS))


def file_score(cyclo: Column, depth: Column, functions: Column, classes: Column, loc: Column) -> Column:
    """Weighted complexity from 1 to 10."""
    part = lambda x, by, w: F.least(x / F.lit(float(by)), F.lit(10.0)) * F.lit(w)
    total = part(cyclo, 10, 0.3) + part(depth, 5, 0.2) + part(functions, 20, 0.2) + part(classes, 10, 0.1) + part(loc, 500, 0.2)
    return F.least(F.greatest(half_up(total), F.lit(1)), F.lit(10))


def fixed(value: Column, digits: int) -> Column:
    """A number as text with so many decimals, halves rounded up in the decimal digits; null for null, NaN and infinities."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
    return F.round(finite.cast("decimal(20,10)"), digits).cast("string")


def version_key(version: Column, parts: int = 4) -> Column:
    """A version's numbers, padded with zeros, for comparison as an array."""
    numbers = F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), parts)), 1, parts)


def line_changes(old: Column, new: Column) -> Column:
    """struct(added, removed, modified): positions whose lines differ, counted by place."""
    pairs = F.zip_with(lines_of(old), lines_of(new), lambda a, b: F.when(a.isNull(), "a").when(b.isNull(), "r").when(a != b, "m"))
    count = lambda k: F.size(F.filter(pairs, lambda x: x == k))
    return F.struct(count("a").alias("added"), count("r").alias("removed"), count("m").alias("modified"))


def printable_share(text: Column, size: int = 512) -> Column:
    """Share of printable ASCII, tab and line ends among the first bytes; null for an empty text."""
    pairs = F.substring(F.hex(F.encode(text, "UTF-8")), 1, 2 * size)
    good = F.size(F.filter(F.regexp_extract_all(pairs, F.lit("(09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])|.."), 1), lambda x: x != ""))
    return F.try_divide(good.cast("double"), F.length(pairs) / 2)


def looks_textual(text: Column, size: int = 512) -> Column:
    """Empty is text, any NUL byte is not, else more than 70 % must be printable."""
    head = F.substring(F.hex(F.encode(text, "UTF-8")), 1, 2 * size)
    nul = F.exists(F.regexp_extract_all(head, F.lit("(..)"), 1), lambda x: x == "00")
    return (F.length(head) == 0) | (~nul & (printable_share(text, size) > 0.7))


def bytes_formatted(n: Column) -> Column:
    """B, KB, MB or GB with one decimal above bytes."""
    k = lambda p, unit: F.format_string(f"%.1f{unit}", n / F.lit(float(1024**p)))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024**2, k(1, "KB")).when(n < 1024**3, k(2, "MB")).otherwise(k(3, "GB"))


def duration_formatted(seconds: Column) -> Column:
    """Seconds below a minute, minutes and seconds below an hour, else hours and minutes."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor((whole % 3600) / 60).cast("string"), F.lit("m")))
    )


def backoff_ms(attempt: Column, base: int = 1000, cap: int = 30_000, limited: Column | None = None) -> Column:
    """base * 2^attempt, doubled where the service said it was called too often, at most cap."""
    wait = F.lit(float(base)) * F.pow(F.lit(2.0), attempt)
    return F.least(F.when(limited, wait * 2).otherwise(wait) if limited is not None else wait, F.lit(float(cap)))


#: What a message has that says its class, tried in this order.
ERROR_CLASSES = (
    ("RATE_LIMIT_EXCEEDED", "rate limit|429"),
    ("AUTHENTICATION_FAILED", "unauthorized|401|api key"),
    ("NETWORK_ERROR", "network|timeout|connection"),
    ("CONFIGURATION_ERROR", "config"),
)


def error_class(message: Column) -> Column:
    out = F.lit("UNKNOWN_ERROR")
    for kind, p in reversed(ERROR_CLASSES):
        out = F.when(F.lower(message).rlike(p), kind).otherwise(out)
    return out
