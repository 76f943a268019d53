"""Scalar formulas of the analyses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders, file names and languages that the classifications go by.
TEST_FOLDERS = ["test", "tests", "spec", "specs", "__tests__"]
TEST_FILES = ["test.py", "tests.py", "spec.py", "spec.ts", "spec.js"]
GENERATED_FOLDERS = ["build", "coverage", "dist", "generated", "node_modules", "vendor"]
LANGUAGES = {
    ".c": "C", ".cpp": "C++", ".cs": "C#", ".css": "CSS", ".go": "Go", ".html": "HTML", ".java": "Java", ".js": "JavaScript", ".jsx": "JavaScript", ".kt": "Kotlin",
    ".php": "PHP", ".py": "Python", ".rb": "Ruby", ".rs": "Rust", ".scss": "SCSS", ".sql": "SQL", ".swift": "Swift", ".ts": "TypeScript", ".tsx": "TypeScript", ".vue": "Vue",
}
TEXT_SUFFIXES = [".env", ".json", ".md", ".toml", ".txt", ".yaml", ".yml"]
PARSED_SUFFIXES = [".py", ".js", ".jsx", ".ts", ".tsx"]


def code_scope(path: Column) -> Column:
    """test, generated or production; test wins."""
    low = F.lower(path)
    parts = F.filter(F.split(low, "/"), lambda p: p != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    lit = lambda values: F.array(*[F.lit(v) for v in values])
    test = F.arrays_overlap(parts, lit(TEST_FOLDERS)) | name.isin(TEST_FILES) | name.startswith("test_") | name.endswith("_test.py") | name.contains(".test.") | name.contains(".spec.")
    generated = F.arrays_overlap(parts, lit(GENERATED_FOLDERS)) | name.contains(".min.")
    return F.when(test, "test").when(generated, "generated").otherwise("production")


def language_of(suffix: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[suffix]


def text_lines(content: Column) -> Column:
    """Newlines plus one for an unterminated last line; an empty text has none."""
    ends = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return ends + F.when((content == "") | content.endswith("\n"), 0).otherwise(1)


def severity(metric: Column, threshold: Column | int, multiplier: int) -> Column:
    return F.when(metric > F.lit(threshold) * multiplier, "error").otherwise("warning")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def confidence_level(percent: Column) -> Column:
    return F.when(percent >= 90, "high").when(percent >= 70, "medium").otherwise("low")


def reference_points(actual: Column, reference: float, maximum: int) -> Column:
    """Bounded logarithmic points: 0 for nothing, then 1 up to ``maximum`` at ``reference``."""
    ratio = F.log1p(F.least(actual.cast("double"), F.lit(float(reference)))) / F.log1p(F.lit(float(reference)))
    return F.when(actual <= 0, 0).otherwise(F.greatest(F.lit(1), F.bround(ratio * maximum).cast("int")))


def repository_scale(files: Column, lines: Column) -> Column:
    return F.when((files >= 500) | (lines >= 100_000), "large").when((files >= 80) | (lines >= 15_000), "medium").otherwise("small")


def test_path(path: Column) -> Column:
    """The narrower test predicate of evidence retrieval."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    rooted = F.concat(F.lit("/"), low, F.lit("/"))
    return rooted.contains("/test/") | rooted.contains("/tests/") | low.contains("__tests__") | name.startswith("test_") | name.contains(".test.") | name.contains(".spec.")


def path_has_term(path: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), r"[/\\._-]+"), F.array(*[F.lit(t) for t in terms]))


def bm25(tf: Column, length: Column, average: Column, documents: Column, frequency: Column, *, k1: float = 1.5, b: float = 0.75) -> Column:
    idf = F.log(F.lit(1.0) + (documents - frequency + 0.5) / (frequency + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(average, F.lit(1.0))))


def unit_vector(vector: Column) -> Column:
    """L2-normalised; a zero vector becomes an empty array."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.array().cast("array<double>")).otherwise(F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def code_tokens(text: Column) -> Column:
    """Identifiers with their snake and camel parts, numbers, and Chinese runs with their bigrams, lower case."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*|\d+|[一-鿿]+)"), F.lit(1))

    def parts(token: Column) -> Column:
        low = F.lower(token)
        pieces = F.split(F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1_$2"), "_")
        words = F.filter(F.transform(pieces, F.lower), lambda p: (p != "") & (p != low))
        run = F.substring(low, 1, 512)
        bigrams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
        chinese = token.rlike("^[一-鿿]")
        return F.when(chinese & (F.length(token) > 1), F.concat(F.array(low), bigrams)).when(chinese, F.array(low)).otherwise(F.concat(F.array(low), words))

    return F.flatten(F.transform(found, parts))


def collapsed_first_line(snippet: Column) -> Column:
    """Preview: the first line that is not blank, white space collapsed, 157 characters and dots."""
    lines = F.filter(F.transform(F.split(snippet, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("No source"))
    return F.concat(F.substring(first, 1, 157), F.when(F.length(first) > 157, "...").otherwise(""))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
