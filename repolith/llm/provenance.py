"""Generated, minified or vendored source files (problem 4).

For every language a character trigram model of identifiers is trained on all
files of the corpus (distinct names of a file count once; the table is bounded by
the alphabet, not by the corpus). A file is then judged by

* its *names*: mangled names have a high cross-entropy under the model of their
  language; template-like names have a low diversity once digits are folded
  (``FIELD_0001``, ``FIELD_0002``, ...); foreign naming styles and names of a
  package that many projects hold speak for a copy;
* its *text*: long dense lines, line shapes that repeat, the share of characters
  inside literals, a statement of a tool in the leading comment;
* its *owners*: the same content, or files of the same package, in several
  projects.

``kind`` is ``generated``, ``minified``, ``vendored``, ``data`` or null for what
was written by hand. A path alone decides nothing, except that a package folder
below a dependency folder needs no second witness.

Defined results: files with null or empty content are hand-written; only paths
that end in one of ``SUFFIXES`` are judged; of several rows of a file the newest
counts; rows without file_id are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm.syntax_check import latest_files
from repolith.runtime import cpu_partitions, input_bytes, shared_table

SUFFIXES = {".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".go": "Go", ".java": "Java", ".sql": "SQL", ".css": "CSS"}
LANGUAGES = sorted(set(SUFFIXES.values()))
#: Letters of the model: 0 ends a name, 1-26 letters, 27-36 digits, 37 underscore, 38 hyphen or dollar, 39 others.
ALPHABET = 40

# How tools announce themselves, and folders that dependencies are kept in.
TOOL = re.compile(
    r"(?i)^[\W_]*(?:@generated\b|code\s+generated\b|<auto-?generated|auto-?generated\b|automatically\s+generated\b|machine[- ](?:written|generated|made)\b"
    r"|(?:this|the)\s+(?:file|code|module|source|class|script|stylesheet)\s+(?:was|is|has\s+been)\s+(?:automatically\s+|auto-?|machine[- ])?(?:generated|created\s+by\s+\w+\s+(?:compiler|generator))"
    r"|generated\s+(?:by|from|with|using|automatically|on)\b|produced\s+by\s+\S+\s+(?:v?\d|compiler|generator)|do\s+not\s+(?:edit|modify)[^a-z]*(?:$|[-:;,.]+\s*(?:this|generated)))"
)
FORMERLY = re.compile(r"(?i)\bonce\b|by\s+hand\s+since|no\s+longer\s+generated|maintained\s+by\s+hand|originally\s+generated|hand-?(?:written|maintained)")
PACKAGE_NOTICE = re.compile(
    r"(?i)(?:licensed\s+under\s+[\w.\- ]+;?\s*see\s+(?:the\s+)?licen[cs]e\s+(?:of|in)\s+(?P<a>[\w.@/\-]+)\s+v?\d"
    r"|^[\W_]*(?P<b>[\w.@/\-]+)\s+v?\d+\.\d+(?:\.\d+)?\S*\s*(?:\|.*)?(?:\(c\)|copyright|\|\s*(?:mit|isc|bsd|apache|mpl|gpl))"
    r"|copyright\s+\(c\)\s+\d{4}[^\n]*?\bthe\s+(?P<c>[\w.@/\-]+)\s+(?:project|authors|developers))"
)
DEPENDENCY_FOLDER = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|_vendor|third_party|third-party|thirdparty|external|site-packages|dist-packages|Pods)/(?P<package>(?:@[^/]+/)?[^/]+)/")
VERSIONED = re.compile(r"-v?\d+(?:\.\d+)+$")
BUILT_NAME = re.compile(r"(?i)(?:[.\-]min|\.bundle|[.\-][0-9a-f]{8,})\.(?:js|css)$|\.(?:gen|generated|g|pb)\.\w+$|_pb2(?:_grpc)?\.py$|(?:^|[_.])gen\.\w+$|_gen\.\w+$|OuterClass\.java$")
SOURCE_MAP = re.compile(r"(?m)^\s*(?://|/\*)[#@] sourceMappingURL=")

COMMENT_LINE = re.compile(r"^\s*(?://|#(?!\w*[{;])|--|/\*|\*|<!--|\"\"\"|''')")
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
LITERAL = re.compile(r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`|(?<![\w$.])[+\-]?(?:0x[0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][+\-]?\d+)?)")
_TRIPLE = r"\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''"
_REMARK = {".py": r"\#[^\n]*", ".sql": r"--[^\n]*|/\*(?s:.*?)\*/", ".css": r"/\*(?s:.*?)\*/"}
#: What holds no names of the program: literals (also those of many lines) and comments, by suffix.
NAMELESS = {suffix: re.compile("|".join([*([_TRIPLE] if suffix == ".py" else []), _REMARK.get(suffix, r"//[^\n]*|/\*(?s:.*?)\*/"), LITERAL.pattern])) for suffix in SUFFIXES}
_DIGEST = re.compile(r"(?=\w*\d)[0-9a-f]{24,}")
WORK = re.compile(r"\b(?:def|class|function|func|return|if|for|while|switch|case|try|import\s+\w+\s+from|select|create|update|delete|alter|throw|raise|new|interface|public|void)\b|=>", re.I)
INSERT = re.compile(r"(?is)^\s*(?:insert\s+into\s+[\w.\"`]+\s*(?:\([^()]*\)\s*)?values\s*\(.*\)\s*(?:,\s*\(.*\)\s*)*)$")
_FOLD_TEXT = re.compile(r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'")
_FOLD_NUMBER = re.compile(r"(?<![A-Za-z])[0-9a-f]{6,}(?![A-Za-z])|(?<=_)[0-9a-f]{6,}|\d+")
_ANY_DIGIT = re.compile(r"\d")
_PADDED = re.compile(r"(?<!\d)0\d{2,5}(?!\d)")
_QUOTED_NAME = re.compile(r"[\"'](\$?[A-Za-z_][\w.\-$]{0,60})[\"']")

_CODE = np.full(256, 39, dtype=np.int64)
for _i in range(26):
    _CODE[ord("a") + _i] = _CODE[ord("A") + _i] = 1 + _i
for _i in range(10):
    _CODE[ord("0") + _i] = 27 + _i
_CODE[ord("_")] = 37
_CODE[ord("-")] = _CODE[ord("$")] = 38
_CODE[0] = 0


def trigrams(names: bytes) -> np.ndarray:
    """Codes of all trigrams of names that end in a zero byte each (with two zero bytes before the first)."""
    c = _CODE[np.frombuffer(b"\0\0" + names, dtype=np.uint8)]
    codes = (c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:]
    # A name starts with an empty context: what reaches over the end of the one before is moved there.
    ends = c == 0
    over = ends[1:-1] & ~ends[2:]
    codes[over] = c[2:][over]
    tail = ends[:-2] & ~ends[1:-1]
    codes[tail] = (c[1:-1] * ALPHABET + c[2:])[tail]
    return codes[~(ends[1:-1] & ends[2:])]


_LINE = re.compile(r"[^\n]+")


def leading_comment(text: str) -> list[str]:
    """The lines of the comment that opens a file, before any code."""
    out, block = [], ""
    for match in _LINE.finditer(text.lstrip("﻿")):
        line = match.group()
        bare = line.strip()
        if block:
            out.append(bare)
            if block in bare:
                block = ""
            continue
        if not bare or bare.startswith("#!"):
            continue
        if not COMMENT_LINE.match(line):
            break
        if bare.startswith(('"""', "'''")):
            break  # a docstring is code that describes itself
        out.append(bare)
        if bare.startswith("/*") and "*/" not in bare:
            block = "*/"
    return out


_ASSIGNED_DATA = re.compile(r"(?s)(?:(?:export\s+)?(?:default\s+|(?:const|let|var)\s+\w+(?:\s*:[^=]+)?\s*=\s*)|module\.exports\s*=\s*|[A-Za-z_]\w*(?:\s*:[^=]+)?\s*=\s*)?(?P<data>[\[{].*[\]}])\s*;?\s*\Z")
_CONSTANTS = {"true", "false", "null", "True", "False", "None"}


def only_data(body: str) -> bool:
    """Whether the whole of a text is one collection of literals, perhaps with a name."""
    m = _ASSIGNED_DATA.match(body.strip())
    if m is None:
        return False
    bare = LITERAL.sub("0", m.group("data"))
    if "0" not in bare or not set(NAME.findall(bare)) <= _CONSTANTS:
        return False
    bare = NAME.sub("0", bare)
    if re.search(r"[^\s\[\]{}:,0]", bare):
        return False
    depth = 0
    for i, c in enumerate(bare := re.sub(r"[\s0:,]+", "", bare)):
        depth += (c in "[{") - (c in "]}")
        if depth == 0 and i < len(bare) - 1 or depth < 0:
            return False
    return depth == 0


#: Compound names a file, and the rest of its project, must have before their styles are compared.
STYLE_NAMES, PROJECT_NAMES = 12, 60
_SNAKE, _CAMEL = re.compile(r"_*[a-z][a-z0-9]*(?:_[a-z0-9]+)+_*"), re.compile(r"[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+")


def foreign(snake: int, camel: int, project_snake: int, project_camel: int) -> bool:
    """Whether the compound names of a file are written in a style that the rest of its project (in its language) does not use."""
    mine, rest_snake, rest_camel = snake + camel, project_snake - snake, project_camel - camel
    rest = rest_snake + rest_camel
    if mine < STYLE_NAMES or rest < PROJECT_NAMES:
        return False
    return snake >= 0.8 * mine and rest_snake <= 0.1 * rest or camel >= 0.8 * mine and rest_camel <= 0.1 * rest


def folded(name: str) -> str:
    return _FOLD_NUMBER.sub("0", name)


def features(path: str, suffix: str, text: str) -> dict:
    """Everything about one file that does not depend on other files."""
    lines = [s for line in text.split("\n") if (s := line.strip())]
    n_lines, n_chars = len(lines), len(text)
    opening = leading_comment(text)
    tool = any(TOOL.search(line) and not FORMERLY.search(line) for line in opening)
    notices = [m for line in opening if (m := PACKAGE_NOTICE.search(line))]
    # A licence of a named release is a notice; a copyright line alone may be the team's own.
    notice = next((m.group("a") or m.group("b") for m in notices if m.group("a") or m.group("b")), None)
    holder = next((m.group("c") for m in notices if m.group("c")), None)
    folder = DEPENDENCY_FOLDER.search(path)
    package = folder.group("package") if folder else None
    code = [line for line in lines if not COMMENT_LINE.match(line)]
    body = "\n".join(code)
    bare, literals = LITERAL.subn(" ", body)
    literal_chars = len(body) - len(bare) + literals
    distinct = {x for x in NAME.findall(NAMELESS[suffix].sub(" ", text)) if len(x) < 24 or not _DIGEST.fullmatch(x)}
    quoted = set(_QUOTED_NAME.findall(body))
    everything = distinct | quoted
    numbered = [x for x in everything if _ANY_DIGIT.search(x)]
    templates = Counter(folded("\n".join(numbered)).split("\n")) if numbered else Counter()
    in_series = sum(n for n in templates.values() if n >= 4)
    padded = sum(1 for x in numbered if _PADDED.search(x))
    shapes = Counter(_FOLD_NUMBER.sub("0", _FOLD_TEXT.sub("S", body)).split("\n")) if len(code) >= 8 else Counter()  # fewer lines do not repeat
    # Lines of a shape that at least five others share; brackets alone say nothing.
    repeated = sum(n for s, n in shapes.items() if n > 5 and NAME.search(s))
    weighty = sum(n for s, n in shapes.items() if NAME.search(s) or "S" in s or "0" in s)
    rows = sum(n for s, n in shapes.items() if n > 5 and ("S" in s or "0" in s))
    statements = [s for s in body.split(";") if s.strip()] if suffix == ".sql" else []
    inserts = sum(1 for s in statements if INSERT.match(s))
    blanks = sum(map(bare.count, " \t\r\n,[](){}:;="))
    return {
        "tool": tool,
        "notice": notice,
        "package": VERSIONED.sub("", package) if package else notice or holder,
        "in_folder": folder is not None,
        "versioned": bool(package and VERSIONED.search(package)),
        "built_name": BUILT_NAME.search(path) is not None,
        "source_map": SOURCE_MAP.search(text) is not None,
        "n_chars": n_chars,
        "n_lines": n_lines,
        "longest": max(map(len, code), default=0),
        "mean_line": len(body) / max(1, len(code)),
        "spaces": sum(map(body.count, " \n")) / max(1, len(body)),
        "names": len(distinct),
        "short_names": sum(1 for x in distinct if len(x) <= 3) / max(1, len(distinct)),
        "series": in_series / max(1, len(everything)),
        "padded": padded,
        "repeated": repeated / max(1, weighty),
        "rows": rows / max(1, weighty),
        "literals": literals,
        "literal_share": (literal_chars + min(blanks, literals * 4)) / max(1, len(body)),
        "work": int(WORK.search(bare) is not None),
        "only_data": suffix not in (".css", ".sql") and only_data(body),
        "inserts": inserts / len(statements) if statements else 0.0,
        "snake": sum(1 for x in distinct if "_" in x and x.islower() and _SNAKE.fullmatch(x)),
        "camel": sum(1 for x in distinct if x[0].islower() and not x.islower() and _CAMEL.fullmatch(x)),
        "identifiers": "\0".join(sorted(distinct)) + "\0" if distinct else "",
    }


_KINDS = {
    "tool": pa.bool_(), "notice": pa.string(), "package": pa.string(), "in_folder": pa.bool_(), "versioned": pa.bool_(), "built_name": pa.bool_(), "source_map": pa.bool_(), "n_chars": pa.int32(), "n_lines": pa.int32(),
    "longest": pa.int32(), "mean_line": pa.float64(), "spaces": pa.float64(), "names": pa.int32(), "short_names": pa.float64(), "series": pa.float64(), "padded": pa.int32(), "repeated": pa.float64(), "rows": pa.float64(), "literals": pa.int32(),
    "literal_share": pa.float64(), "work": pa.int32(), "only_data": pa.bool_(), "inserts": pa.float64(), "snake": pa.int32(), "camel": pa.int32(), "identifiers": pa.string(),
}
_SPARK = {pa.bool_(): "boolean", pa.string(): "string", pa.int32(): "int", pa.float64(): "double"}
_KEYS = ["project_id", "file_id", "relative_path", "suffix", "content_hash"]
_DDL = "project_id bigint, file_id bigint, relative_path string, suffix string, content_hash bigint, " + ", ".join(f"{n} {_SPARK[k]}" for n, k in _KINDS.items())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(p, s, c) for p, s, c in zip(*[batch.column(n).to_pylist() for n in ("relative_path", "suffix", "content")])]
        columns = [pa.array([r[n] for r in rows], k) for n, k in _KINDS.items()]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _KEYS), *columns], names=[*_KEYS, *_KINDS])


def file_features(files: DataFrame, sources: DataFrame) -> DataFrame:
    wanted = latest_files(files).where(F.col("suffix").isin(list(SUFFIXES))).select("project_id", "file_id", "relative_path", "suffix")
    texts = sources.where("file_id is not null and content is not null and content <> ''").select(F.col("file_id").cast("long").alias("file_id"), F.col("content").cast("string").alias("content"))
    n = cpu_partitions(files.sparkSession, input_bytes(sources))
    joined = wanted.repartition(n, "file_id").join(texts.repartition(n, "file_id").hint("merge"), "file_id").select("project_id", "file_id", "relative_path", "suffix", F.xxhash64("content").alias("content_hash"), "content")
    return joined.mapInArrow(_features, _DDL)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a partition: one row per language and code that occurs."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[str]] = {}
        for suffix, names in zip(batch.column("suffix").to_pylist(), batch.column("identifiers").to_pylist()):
            by.setdefault(SUFFIXES[suffix], []).append(names)
        for language, parts in by.items():
            codes = trigrams("".join(parts).encode("ascii", "replace"))
            counts = np.bincount(codes, minlength=ALPHABET**3)
            totals[language] = totals[language] + counts if language in totals else counts
    for language, counts in totals.items():
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(hit)), pa.array(hit.astype(np.int32)), pa.array(counts[hit].astype(np.int64))], names=["language", "code", "n"])


def train(table: DataFrame) -> dict[str, np.ndarray]:
    """language -> bits of the third letter of every trigram; at most 8 x 64,000 numbers."""
    counted = table.select("suffix", "identifiers").mapInArrow(_count, "language string, code int, n bigint")
    summed = counted.groupBy("language", "code").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for language in LANGUAGES:
        counts = np.full(ALPHABET**3, 0.05)
        part = summed[summed["language"] == language]
        counts[part["code"].to_numpy(dtype=np.int64)] += part["n"].to_numpy(dtype=np.float64)
        cube = counts.reshape(-1, ALPHABET)
        out[language] = -np.log2(cube / cube.sum(axis=1, keepdims=True)).reshape(-1)
    return out


def cross_entropy(names: str, models: dict[str, np.ndarray]) -> float:
    """Mean bits per letter of the names of a file, each name once, under the language that expects them most (a suffix may be wrong)."""
    if not names:
        return 0.0
    codes = trigrams(names.encode("ascii", "replace"))
    return min(float(bits[codes].sum()) for bits in models.values()) / max(1, int((codes % ALPHABET != 0).sum()))


def judge(f: dict, entropy: float, copies: int, package_owners: int) -> str | None:
    """The kind of a file from its features; null for hand-written.

    The names decide first: mangled by their cross-entropy, template-like by their
    low diversity. The text decides where names cannot (style sheets, statements,
    bundles that keep their names, a tool that says so), owners and foreign styles
    what is a copy.
    """
    css, sql = f["suffix"] == ".css", f["suffix"] == ".sql"
    literal_bound = f["literal_share"] > 0.8
    # Names: mangled.
    if not css and not sql and f["names"] >= MANGLED_NAMES and entropy > MANGLED_BITS and not literal_bound:
        return "minified"
    # Names: template-like. A name that only tools give makes fewer of them suffice.
    if not css and f["n_lines"] >= 4 and not f["only_data"] and not literal_bound:
        if f["padded"] >= (2 if f["built_name"] else 3) and (f["built_name"] or f["series"] >= 0.25) or f["series"] >= (0.35 if f["built_name"] else 0.5):
            return "generated"
    # Text: dense style sheets and bundles.
    dense = f["longest"] >= 400 and f["mean_line"] >= 150 and f["spaces"] < 0.1
    if dense and not literal_bound and (css or f["names"] < MANGLED_NAMES and entropy > MANGLED_BITS or f["built_name"] or f["source_map"]):
        return "minified"
    if f["built_name"] and f["source_map"] and f["mean_line"] > 100:
        return "minified"
    if f["tool"]:
        return "generated"
    if f["only_data"] or f["inserts"] == 1.0 or f["inserts"] >= 0.9 and f["literals"] >= 20 or (literal_bound and f["work"] == 0 and (f["literals"] >= 30 or f["n_chars"] >= 1500 and f["longest"] >= 800)) and not css and not sql:
        return "data"
    # Text: lines of few shapes, with names or values in series.
    if not css and f["n_lines"] >= 8 and f["repeated"] >= 0.75 and (f["series"] >= 0.2 or f["rows"] >= 0.75):
        return "generated"
    # Owners: a notice of a package, a folder of dependencies together with an owner elsewhere or a notice, or copies.
    if f["notice"] or f["in_folder"] and (f["versioned"] or f["package"] is not None):
        return "vendored"
    if f["work"] and (copies >= 3 or package_owners >= 2 and (copies >= 2 or f["package"] is not None)):
        return "vendored"
    if not css and not sql and foreign(f["snake"], f["camel"], f.get("project_snake") or 0, f.get("project_camel") or 0):
        return "vendored"
    return None


#: Bits per letter above which the names of a file (at least so many) count as mangled.
MANGLED_BITS, MANGLED_NAMES = 4.2, 20


def judged_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """project_id, file_id, relative_path, kind, entropy of every judged file."""
    table = shared_table(file_features(files, sources))
    bits = table.sparkSession.sparkContext.broadcast(train(table))  # bounded by the alphabet
    # Owners: one row per (value, project) first, so that a hot content is folded before it meets.
    owners = table.select("content_hash", "project_id").distinct().groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"))
    packages = table.where("package is not null").select("package", "project_id").distinct().groupBy("package").agg(F.count(F.lit(1)).alias("package_owners"))
    language = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), F.col("suffix")).alias("language")
    styled = table.select("*", language)
    styles = styled.groupBy("project_id", "language").agg(F.sum("snake").alias("project_snake"), F.sum("camel").alias("project_camel"))
    known = styled.join(owners, "content_hash").join(packages, "package", "left").join(styles, ["project_id", "language"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, entropies = [], []
            for f in batch.to_pylist():
                entropy = cross_entropy(f["identifiers"], bits.value)
                kinds.append(judge(f, entropy, f["copies"] or 0, f["package_owners"] or 0))
                entropies.append(entropy)
            yield pa.RecordBatch.from_arrays([batch.column("project_id"), batch.column("file_id"), batch.column("relative_path"), pa.array(kinds, pa.string()), pa.array(entropies, pa.float64())], names=["project_id", "file_id", "relative_path", "kind", "entropy"])

    judged = known.mapInArrow(run, "project_id bigint, file_id bigint, relative_path string, kind string, entropy double")
    return judged.groupBy("file_id").agg(F.first("project_id").alias("project_id"), F.first("relative_path").alias("relative_path"), F.max("kind").alias("kind"), F.max("entropy").alias("entropy"))


def flagged_files(judged: DataFrame) -> DataFrame:
    return judged.where("kind is not null").select("file_id")
