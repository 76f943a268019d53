"""Credentials embedded in source code (problem 2).

Four steps, each over the whole of ``chunks``:

1. *Index.* One pass in Arrow batches cuts every literal that stands in a
   credential position out of a text, whatever it looks like: values assigned to
   credential names, token formats, private keys, passwords in URLs,
   authorisation headers, signing calls, and values named in comments and prose.
   Literals joined with ``+`` are one value. Whether a place counts only in
   configuration or prose is noted with the literal and decided when the literals
   (not the texts) meet the paths of their files.
2. *Suppress.* Values are indexed corpus-wide with the number of their owners
   (projects). A value that more than ``max_owners`` projects hold and that
   has a word of placeholders in it is one, unless its token format is
   unmistakable; any other value stays, however many projects hold it.
3. *Confirm.* Every distinct (value, kind of place) that is left must be
   structured: no placeholder or mask, no name of a secret, no path, no label,
   no checksum.
4. *Re-scan.* Every text is scanned again for all confirmed values by an
   automaton (Aho-Corasick), so a value confirmed in one file is also found
   where it stands bare; values of fewer than ``BARE_CHARS`` characters must
   stand between quotes or blanks there. The confirmed values are written to the
   shared folder, and every task loads them in blocks of ``BLOCK_VALUES``: the
   memory of an automaton is bounded at any number of values, and the corpus is
   still read once, as a task holds ``GROUP_CHARS`` of its texts against all blocks.

Texts are never joined or shuffled: both passes run on the scan of ``chunks``; a
table of too few files is distributed and written once for both.

Redaction replaces exactly the characters of a value by ``*`` (as many), inside
its quotes, so that lines, columns and the surrounding code stand as they were.

Defined results: a null or empty content has no case; a chunk delivered twice
counts once (rows of one chunk_id with different contents are all scanned);
rows without project_id count as one owner; a chunk whose file is unknown is
scanned like prose. A private key is one case on its BEGIN line.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.runtime import blocks_for, is_wide_scan, shared_table, spread, write_shared

MAX_OWNERS = 4
BLOCK_VALUES = 200_000
#: Characters of text that a task holds while it goes through the blocks of values.
GROUP_CHARS = 64 << 20
#: Shorter values count outside their context only between quotes or blanks.
BARE_CHARS = 8

# Public formats of access tokens.
FORMAT_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "AIza", "_live_", "_test_", "sk-", "npm_", "hf_", "SG.", "ya29.", "eyJ")
FORMATS = re.compile(
    r"""(?<![A-Za-z0-9_\-/+.])(?:
      (?:AKIA|ASIA)[A-Z0-9]{16}
    | gh[pousr]_[A-Za-z0-9]{30,}
    | github_pat_[A-Za-z0-9_]{40,}
    | glpat-[A-Za-z0-9_\-]{20,}
    | xox[abeoprs]-[A-Za-z0-9\-]{20,}
    | AIza[A-Za-z0-9_\-]{35}
    | (?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}
    | sk-[A-Za-z0-9_\-]{20,}
    | npm_[A-Za-z0-9]{36}
    | hf_[A-Za-z0-9]{30,}
    | SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}
    | ya29\.[A-Za-z0-9_\-]{20,}
    | eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}
    )(?![A-Za-z0-9_])""",
    re.X,
)
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
# A credential name is one that *ends* with a credential noun (and perhaps a number).
_KEYED = r"(?:api|access|signing|private|encryption|master|auth|secret|account|service|shared|session)[_\-]?key"
_NOUN = rf"(?:pass(?:word|wd|phrase|code|wort)?|pwd|secret|token|{_KEYED}|key|credentials?|auth|bearer|jwt|session(?:[_\-]?(?:id|value))?|cookie(?:[_\-]?value)?|signing)"
NOUN = re.compile(rf"{_NOUN}|login|contrase\w+|mot de passe|密码|口令|令牌")
#: ``key`` alone names many things; its value must look like a key.
WEAK = {"key"}
_LITERAL = r"""(?:[rRbBuUfF]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))"""
_JOINED = rf"{_LITERAL}(?:\s*\+\s*{_LITERAL}|[ \t]*\\?\n[ \t]*{_LITERAL})*"
_TYPED = r"(?:\s*:\s*[A-Za-z_][\w.<>\[\]|? ]{0,40})?"
ASSIGNED = re.compile(rf"""[_\-]?\d*(?![A-Za-z0-9_\-])["'`]?\]?{_TYPED}\s*(?:=>|:=|[:=])\s*\(?\s*(?P<value>{_JOINED})""")
SET = re.compile(r"""[_\-]?\d*["']?[ \t]*[:=][ \t]*(?P<value>[^\s"'`#]\S*)(?:[ \t]+\#.*|[ \t]*)\r?(?:\n|\Z)""")
SET_NAME = re.compile(r"""[ \t]*(?:export[ \t]+|-[ \t]+)?["']?[\w.\-]*\Z""")
CONFIG_PATH = re.compile(r"(?i)(?:\.(?:env|ya?ml|toml|ini|cfg|conf|properties|json|txt|md|sh)|(?:^|/)\.env[^/]*)$")
PROSE_PATH = re.compile(r"(?i)\.(?:md|txt|rst|adoc)$")
FALLBACK = re.compile(rf"""(?i)env(?:iron)?(?:\.get)?(?:\s*[(\[]\s*["'](?P<env>[\w\-]+)["']\s*[)\]]?\s*(?:,|\bor\b|\|\||\?\?)|\.(?P<dot>\w+)\s*(?:\|\||\?\?))\s*(?P<value>{_JOINED})""")
SIGNED = re.compile(r"""(?i)(?:hmac(?:\.new|\.digest)?|jwt\.(?:sign|encode|verify|decode)|fernet|aes\.new|hmacsha\d+)\s*\((?P<args>[^\n]*)""")
URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]*://(?P<user>[^\s:/@"'`<>]*):(?P<value>[^\s/@"'`<>]+)@[A-Za-z0-9\[]""")
HEADER = re.compile(r"""(?i)\b(?P<scheme>bearer|basic|token)[ \t]+(?P<value>[A-Za-z0-9+/_\-.=~!*#$%]{6,})""")
USERPASS = re.compile(r"""(?:\s-u|--user)[ =]["']?(?P<user>[A-Za-z0-9_.\-]+):(?P<value>[^\s"'`]+)""")
SPOKEN = re.compile(r"""(?<=[\s:=/`"'(])[A-Za-z0-9+/_\-.=~!*\#$%@^&?]{8,}""")
_DIGIT = re.compile(r"\d")
COMMENT = re.compile(r"(?://|#|/\*|\*|--|<!--)")
PLACEHOLDER = re.compile(
    r"""(?ix)^(?:change[\-_ ]?(?:me|this|it)?.*|redacted|masked|hidden|none|null|nil|true|false|todo.*|tbd|fixme|dummy.*|placeholder.*|sample.*|example.*|secret|password|passwd|pass|pwd|token
      |your[\-_ .].*|my[\-_ ].*|insert[\-_ ].*|replace[\-_ ].*|enter[\-_ ].*|set[\-_ ]?me.*|test(?:ing|er)?|default|n/?a|undefined|unknown|string|foo(?:bar)?|bar|baz|admin|root|user|guest|demo
      |.*(?:example|placeholder|changeme|change-me|redacted|your[\-_]).*|\(.*\)|<.*>?|\$.*|%.*%?|\{.*|\[.*|!.*|@.*|&.*|vault:.*|enc\[.*|op://.*|arn:.*|env:.*|ref[+:].*|file:.*)$"""
)
#: Words that make a value a placeholder once many projects hold it (for Spark and Python alike).
SHARED_WORDS = r"(?:^|[^A-Za-z]|(?<=[a-z])(?=[A-Z]))(?i:sample|example|shared|demo|dummy|fake|mock|test(?:ing)?|default|placeholder|change|your|my|insert|replace|enter|todo|fixme|temp|tmp|local(?:host)?|dev|foo|bar|baz|secret|password|passwd|token|qwerty|admin|guest)(?:$|[^A-Za-z]|(?<=[a-z])(?=[A-Z]))"
HASH_WORDS = re.compile(r"(?i)checksum|sha-?\d|digest|integrity|revision|commit|md5|etag|request[_ \-]?id|trace[_ \-]?id|uuid|fingerprint|build|version|hash|image|pixel|public")
ENDS_AS_NAME = re.compile(rf"(?i)(?:^|[_\-./ ])(?:{_NOUN}|api[_\-]?key|password|tokens?|secrets?|header)$")
WORDS = re.compile(r"[A-Za-z]+")


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    counts: dict[str, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    return -sum(k / n * math.log2(k / n) for k in counts.values())


def masked(value: str) -> bool:
    return re.search(r"(.)\1{4,}", value) is not None or re.search(r"\*{3,}|\.{3,}|x{4,}|X{4,}", value) is not None or len(set(value)) < 4


def structured(value: str, *, spoken: bool = False) -> bool:
    """Whether a value found in a credential position could grant access."""
    if len(value) < 6 or masked(value) or PLACEHOLDER.match(value) or re.search(r"\s|\$\{|\{\{|%\(", value):
        return False
    if ENDS_AS_NAME.search(value) or re.match(r"(?i)(?:https?|s3|gs|file|ssh)://|data:|[./~]|prod/|dev/|/run/", value):
        return False
    if re.fullmatch(r"[a-z]+(?:/[a-z\-]+)+|[\w\-]+\.(?:py|js|ts|json|ya?ml|md|txt|pem|key|env|toml)", value):
        return False
    if re.search(r"[\[\](){}|\\^]", value) and re.search(r"\[[A-Za-z]-[A-Za-z]|\\[dws]|\(\?|\]\*|\]\+", value):
        return False  # a pattern, not a value
    digit, lower, upper = (re.search(p, value) is not None for p in (r"\d", r"[a-z]", r"[A-Z]"))
    symbol = re.search(r"[^A-Za-z0-9_\-.]", value) is not None
    if spoken:
        return digit and (lower or upper) and (len(value) >= 8) and entropy(value) >= 2.5 and not re.fullmatch(r"v?\d[\d.\-a-z]*|[a-z]+\d{1,3}|[A-Za-z]+-\d+|\d{4}-\d\d-\d\d.*", value)
    if digit and (lower or upper):
        return not re.fullmatch(r"v?\d+(?:\.\d+)+|[A-Za-z]{1,3}\d", value)
    if digit:
        return len(value) >= 8 and not re.fullmatch(r"[\d.\-:]+", value)
    camel = re.fullmatch(r"(?:[A-Z]?[a-z]+)(?:[A-Z][a-z]+)*", value) is not None
    if lower and upper and not camel:
        return not re.fullmatch(r"[A-Z][a-z]+(?:[\-_ ][A-Z]?[a-z]+)*|[A-Z]+(?:-[A-Za-z]+)+", value) or entropy(value) > 3.9
    return (symbol and len(value) >= 8) or value.count("-") >= 2 or len(value) >= 20 and entropy(value) > 3.6


_SENTENCE = re.compile(r"(?i)\b(?:the|an?|is|are|was|be|to|of|for|in|on|at|and|or|not|no|your|you|please|enter|must|should|can|cannot|invalid|missing|wrong|required|with|from|has|have|this|that|it|if|when|error|failed|expired|password|passphrase|secret|token|key|login|user)\b")
_PASS = re.compile(r"pass|pwd|secret|contrase|mot de passe|密码|口令")
_REFERENCE = re.compile(r"\$[A-Za-z_{(]\w*[})]?$|[!&@][A-Za-z_]+$|%\w*%$|%[sdr(]|[$%]?\{|\(.*\)$|\[.*\]$|!(?:vault|secret|ref|env)\b|@[\w.\-/]+(?:/|$)")


def granting(value: str, noun: str) -> bool:
    """Whether a quoted value under a strong noun could grant access although ``structured`` refuses its form."""
    if structured(value):
        return True
    if masked(value) or noun in WEAK and value[:1] != "/":
        return False
    password = _PASS.match(noun) is not None
    if " " in value:  # a passphrase of several words
        words = value.split(" ")
        return password and 3 <= len(words) <= 12 and all(re.fullmatch(r"[A-Za-z0-9\-]{2,}", w) for w in words) and value[1:] == value[1:].lower() and not _SENTENCE.search(value)
    if value.isdigit():
        return password and len(value) >= 6 and value not in "01234567890123456789" and value not in "98765432109876543210"
    if re.search(r"\s|\$\{|\{\{|%\(", value):
        return False
    digit, lower, upper = (re.search(p, value) is not None for p in (r"\d", r"[a-z]", r"[A-Z]"))
    if value[0] == "/":  # base64 text may begin so
        return len(value) >= 24 and digit and lower and upper and re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value) is not None and entropy(value) >= 4 and value.count("/") <= len(value) // 8
    if value[0] in "$!@&%([{~.":
        return len(value) >= 6 and digit and (lower or upper) and not _REFERENCE.match(value) and not re.match(r"[~.]{1,2}/|\.\w+$", value) and structured(value.lstrip("$!@&%([{~."))
    return password and 4 <= len(value) < 6 and digit and (lower or upper) and re.search(r"[^A-Za-z0-9_\-.]", value) is not None and not PLACEHOLDER.match(value)


_HASH_NEXT = re.compile(r"(?i)(?:checksum|sha-?\d*|digest|integrity|md5|etag|uuid|fingerprint|hash|public|pixel)[_\-. ]?$")


def _hash_named(before: str, value: str) -> bool:
    """Whether the words before a noun say that the value is no secret: the last of them does, or the value looks like a hash."""
    if _HASH_NEXT.search(before):
        return True
    return HASH_WORDS.search(before) is not None and re.fullmatch(r"(?i)(?:sha\d+[:\-].*|(?:0x)?[0-9a-f\-]{7,}|v?\d[\w.\-+]*|\S+:[\w.\-]+|\S+@sha\d+:\S+)", value) is not None


def _pieces(source: str, offset: int) -> tuple[str, int, tuple[int, ...]]:
    """Joined value, start of its first literal and the spans (start, end, ...) of its literals' insides."""
    value, spans, first = "", [], -1
    for m in re.finditer(_LITERAL, source):
        text = m.group()
        quote = min(i for i in (text.find(q) for q in "\"'`") if i >= 0)
        spans += [offset + m.start() + quote + 1, offset + m.end() - 1]
        first = offset + m.start() if first < 0 else first
        value += text[quote + 1 : -1]
    return value, first, tuple(spans)


class Literal(NamedTuple):
    """A literal in a credential position; of those of one anchor the confirmed one of the lowest rank counts."""

    value: str
    start: int
    spans: tuple[int, ...]
    kind: str
    noun: str = ""
    named: bool = False
    scope: str = ""
    anchor: int = -1
    rank: int = 0


def literals_of(content: str) -> list[Literal]:
    """Every literal that stands in a credential position of ``content``, confirmed or not."""
    low = content.lower()
    if len(low) != len(content):  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in content)
    found: list[Literal] = []
    keys: list[tuple[int, int]] = []
    if "PRIVATE KEY" in content:
        for m in PRIVATE_KEY.finditer(content):
            end = KEY_END.search(content, m.end())
            body = content[m.end() : end.start() if end else len(content)]
            if len(re.sub(r"\\n|\s", "", body)) >= 20 and not _masked_key(body):
                found.append(Literal("", m.start(), (m.end(), m.end() + len(body)), "private"))
                keys.append((m.end(), m.end() + len(body)))
    if any(x in content for x in FORMAT_STARTS):
        found += [Literal(m.group(), m.start(), m.span(), "format") for m in FORMATS.finditer(content)]
    hits = list(NOUN.finditer(low))
    for hit, after in zip(hits, [*hits[1:], None]):
        found += _at_noun(content, hit, after.start() if after else len(content))
    if "env" in low:
        for m in FALLBACK.finditer(content):
            if re.search(rf"(?i){_NOUN}\d*$", m.group("env") or m.group("dot") or ""):
                found.append(Literal(*_pieces(m.group("value"), m.start("value")), "plain"))
    if "hmac" in low or "jwt." in low or "fernet" in low or "aes.new" in low:
        for m in SIGNED.finditer(content):
            found += [Literal(*_pieces(lit.group(), m.start("args") + lit.start()), "signing") for lit in re.finditer(_LITERAL, m.group("args"))]
    if "://" in content and "@" in content:
        found += [Literal(m.group("value"), m.start(), m.span("value"), "url") for m in URL.finditer(content)]
    if "bearer" in low or "basic" in low:
        for m in HEADER.finditer(content):
            basic = m.group("scheme").lower() == "basic"
            value = m.group("value") if basic else m.group("value").rstrip(".")
            found.append(Literal(value, m.start("value"), (m.start("value"), m.start("value") + len(value)), "basic" if basic else "header"))
    if " -u" in content or "--user" in content:
        found += [Literal(m.group("value"), m.start("value"), m.span("value"), "plain") for m in USERPASS.finditer(content)]
    return [x for x in found if x.kind == "private" or x.value and not any(a <= x.spans[0] < b for a, b in keys)]


def _masked_key(body: str) -> bool:
    text = re.sub(r"\\n|\s", "", body)
    return "***" in text or "..." in text or "…" in text or len(set(text)) < 12 or max(text.count(c) for c in "*xX") > len(text) // 4


def _at_noun(content: str, hit: re.Match, until: int) -> list[Literal]:
    """The literals that a credential noun at ``hit`` may name; in prose, those up to the next noun or line end."""
    at, end, noun = hit.start(), hit.end(), hit.group()
    if end >= len(content):
        return []
    before = content[at - 1] if at else " "
    if before.isalpha():  # inside a word unless a hump starts here
        first = content[at]
        if not first.isupper() or before.isupper() and not content[at + 1 : at + 2].islower():
            return []
    follow = content[end]
    line_start = content.rfind("\n", 0, at) + 1
    out: list[Literal] = []
    if not (follow.isalpha() or noun == "login"):
        m = ASSIGNED.match(content, end)
        if m is not None:
            value, start, spans = _pieces(m.group("value"), m.start("value"))
            name = re.split(r"[^\w\-.]", content[max(line_start, at - 64) : at])[-1]
            return [Literal(value, start, spans, "named", noun, _hash_named(name, value), "", at)]
        if SET_NAME.match(content, line_start, at):
            m = SET.match(content, end)
            if m is not None:
                value = m.group("value").rstrip(",;")
                out.append(Literal(value, m.start("value"), (m.start("value"), m.start("value") + len(value)), "set", noun, _hash_named(content[line_start:at], value), "config", at))
    if follow.isalnum() or follow in "_-":
        return out
    scope = "" if COMMENT.search(content, line_start, at) else "prose"
    line_end = content.find("\n", end)
    line_end = min(until, len(content) if line_end < 0 else line_end)
    if "://" in content[line_start:end]:
        return out
    for rank, m in enumerate(SPOKEN.finditer(content, end, line_end), 1):
        raw = m.group()
        bare = raw.rstrip("=")
        value = bare.rpartition("=")[2] + raw[len(bare) :] if "=" in bare else raw
        at_value = m.start() + raw.find(value)
        value = value.rstrip(".,;:!`'\"")
        between = content[end:at_value]
        if "://" in between:
            break
        if value.isalpha() or not _DIGIT.search(value):
            continue  # a word, not a literal
        named = _hash_named(content[line_start:at], value) or HASH_WORDS.search(between) is not None
        out.append(Literal(value, at_value, (at_value, at_value + len(value)), "spoken", noun, named, scope, at, rank))
    return out


def _strong(noun: str, value: str) -> bool:
    if noun not in WEAK:
        return True
    return len(value) >= 16 and entropy(value) >= 3.3 and re.search(r"\d", value) is not None and re.search(r"[A-Za-z]", value) is not None


def _basic(value: str) -> bool:
    try:
        user, colon, password = base64.b64decode(value, validate=True).decode("utf-8").partition(":")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return bool(colon) and len(password) >= 4 and not PLACEHOLDER.match(password) and not masked(password)


def confirms(value: str, kind: str, noun: str, named: bool) -> bool:
    """Whether a value in a place of this kind would grant access."""
    if kind == "private":
        return True
    if not value or named:
        return False
    if kind == "format":
        return not masked(value) and "EXAMPLE" not in value
    if kind == "named":
        return granting(value, noun) and _strong(noun, value)
    if kind == "set":
        return structured(value) and _strong(noun, value)
    if kind == "spoken":
        return structured(value, spoken=True)
    if kind == "signing":
        return len(value) >= 12 and structured(value) and not re.match(r"(?i)sha|md5|hs\d|rs\d", value)
    if kind == "url":
        return not PLACEHOLDER.match(value) and not masked(value) and len(value) >= 4 and "{" not in value
    if kind == "basic":
        return _basic(value)
    if kind == "header":
        return structured(value) and re.search(r"\d|[a-z][A-Z]|[+/=]", value) is not None
    return structured(value)


def settled(found: list) -> list:
    """Of confirmed literals of one text: the first of each anchor, without those that lie inside another."""
    first: dict[int, int] = {}
    for x in found:
        if x.anchor >= 0:
            first[x.anchor] = min(x.rank, first.get(x.anchor, x.rank))
    kept = sorted((x for x in found if x.anchor < 0 or x.rank == first[x.anchor]), key=lambda x: (x.spans[0], -x.spans[-1], x.start))
    out: list = []
    for x in kept:
        if not out or x.spans[0] >= out[-1].spans[-1]:
            out.append(x)
    return out


def in_scope(scope: str, path: str | None) -> bool:
    if scope == "config":
        return path is not None and CONFIG_PATH.search(path) is not None
    return scope == "" or path is None or PROSE_PATH.search(path) is not None


def find_literals(content: str, path: str | None) -> list[Literal]:
    """What a single text gives, without the owners and the re-scan of the corpus."""
    return settled([x for x in literals_of(content) if in_scope(x.scope, path) and confirms(x.value, x.kind, x.noun, x.named)])


_ROW = "chunk_id bigint, content_hash bigint, project_id bigint, file_id bigint, line_no int, value string, start int, spans array<int>, kind string, noun string, named boolean, scope string, anchor int, rank int"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_KINDS = {n: _TYPES[t] for n, t in (c.split() for c in _ROW.split(", "))}
_HITS = "chunk_id bigint, content_hash bigint, line_no int, spans array<int>"
_FORM = ["value", "kind", "noun", "named"]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[n]) for c, n in zip(columns, names)], names=names)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for chunk_id, content_hash, project_id, file_id, content in zip(*[batch.column(n).to_pylist() for n in ("chunk_id", "content_hash", "project_id", "file_id", "content")]):
            for x in literals_of(content):
                rows.append((chunk_id, content_hash, project_id, file_id, content.count("\n", 0, x.start) + 1, *x))
        yield _batch(rows, list(_KINDS))


def indexed_texts(chunks: DataFrame) -> DataFrame:
    """chunk_id, content_hash, project_id, file_id, content of every non-empty chunk, in enough partitions for two passes."""
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("project_id").cast("long").alias("project_id"), F.col("file_id").cast("long").alias("file_id"), F.col("content").cast("string").alias("content")).where("content is not null and content <> ''")
    rows = rows.select("chunk_id", F.xxhash64("content").alias("content_hash"), "project_id", "file_id", "content")
    return rows if is_wide_scan(rows) else shared_table(spread(rows, "chunk_id"))


def index_literals(texts: DataFrame, files: DataFrame) -> DataFrame:
    """Every literal in a credential position that the path of its file admits."""
    found = shared_table(texts.mapInArrow(_index, _ROW))
    paths = files.where("file_id is not null").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.max(F.translate("relative_path", "\\", "/")).alias("path"))
    placed = found.where("scope <> ''").join(paths, "file_id", "left")
    admitted = F.when(F.col("scope") == "config", F.coalesce(F.col("path").rlike(CONFIG_PATH.pattern), F.lit(False))).otherwise(F.coalesce(F.col("path").rlike(PROSE_PATH.pattern), F.lit(True)))
    return found.where("scope = ''").unionByName(placed.where(admitted).select(*found.columns))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch.column(n).to_pylist() for n in _FORM])
        yield batch.filter(pa.array([confirms(*r) for r in rows], pa.bool_()))


def confirmed_forms(literals: DataFrame, *, max_owners: int = MAX_OWNERS) -> DataFrame:
    """The distinct (value, kind, noun, named) that are credentials; what many projects hold only if it does not read like a placeholder."""
    # One row per (value, project) first: a value that a third of all rows hold meets few rows per owner.
    owners = literals.groupBy("value", F.coalesce("project_id", F.lit(-1)).alias("owner")).agg(F.max(F.col("kind") == "format").alias("sure"))
    spread_out = owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.max("sure").alias("sure"))
    shared = spread_out.where((F.col("owners") > max_owners) & ~F.col("sure") & F.col("value").rlike(SHARED_WORDS)).select("value")
    forms = literals.select(*_FORM).distinct().join(shared, "value", "left_anti")
    return forms.mapInArrow(_confirm, "value string, kind string, noun string, named boolean")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for chunk_id, content_hash, found in zip(*[batch.column(n).to_pylist() for n in ("chunk_id", "content_hash", "found")]):
            lines = {(f["start"], *f["spans"]): f["line_no"] for f in found}
            for x in settled([Literal("", f["start"], tuple(f["spans"]), "", anchor=f["anchor"], rank=f["rank"]) for f in found]):
                rows.append((chunk_id, content_hash, lines[(x.start, *x.spans)], list(x.spans)))
        yield _batch(rows, ["chunk_id", "content_hash", "line_no", "spans"])


_MACHINE: dict[str, ahocorasick.Automaton] = {}  # the last one that this worker loaded


def _automaton(path: str) -> ahocorasick.Automaton:
    if path not in _MACHINE:
        _MACHINE.clear()
        system, folder = pafs.FileSystem.from_uri(path)
        machine = ahocorasick.Automaton()
        if system.get_file_info(folder).type != pafs.FileType.NotFound:
            for batch in ds.dataset(folder, filesystem=system, format="parquet", schema=pa.schema([("value", pa.string())])).to_batches():
                for value in batch.column(0).to_pylist():
                    machine.add_word(value, len(value))
        if len(machine):
            machine.make_automaton()
        _MACHINE[path] = machine
    return _MACHINE[path]


_DELIMITERS = frozenset(" \t\r\n\"'`")


def _stands_alone(content: str, start: int, end: int) -> bool:
    left, right = content[start - 1 : start] if start else "\n", content[end : end + 1] or "\n"
    if end - start < BARE_CHARS:
        return left in _DELIMITERS and right in _DELIMITERS and (left == right or left in " \t\n" and right in " \t\r\n") and not (content[start:end].isdigit() and left not in "\"'`")
    return not (left.isalnum() or left == "_" or right.isalnum() or right == "_")


def _scan(paths: list[str]):
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(paths) == 1 or size >= GROUP_CHARS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            for path in paths:
                machine = _automaton(path)
                if not len(machine):
                    continue
                for batch in group:
                    rows = []
                    for chunk_id, content_hash, content in zip(*[batch.column(n).to_pylist() for n in ("chunk_id", "content_hash", "content")]):
                        for last, size in machine.iter(content):
                            start = last - size + 1
                            if _stands_alone(content, start, last + 1):
                                rows.append((chunk_id, content_hash, content.count("\n", 0, start) + 1, [start, last + 1]))
                    yield _batch(rows, ["chunk_id", "content_hash", "line_no", "spans"])

    return run


def locate(texts: DataFrame, files: DataFrame, *, max_owners: int = MAX_OWNERS) -> DataFrame:
    """chunk_id, content_hash, line_no, spans (start, end, ...) of every credential; spans may repeat."""
    literals = index_literals(texts, files)
    forms = shared_table(confirmed_forms(literals, max_owners=max_owners))
    direct = literals.join(forms, _FORM, "left_semi").groupBy("chunk_id", "content_hash").agg(F.collect_set(F.struct("start", "spans", "anchor", "rank", "line_no")).alias("found")).mapInArrow(_settle, _HITS)  # bounded by one text
    values = shared_table(forms.where("value <> ''").select("value").distinct())
    blocks = blocks_for(values.count(), BLOCK_VALUES)
    path = write_shared(values.select("value", F.pmod(F.xxhash64("value"), F.lit(blocks)).alias("block")).repartition(blocks, "block"), partition_by="block")
    rescanned = texts.select("chunk_id", "content_hash", "content").mapInArrow(_scan([f"{path}/block={b}" for b in range(blocks)]), _HITS)
    return direct.unionByName(rescanned)


def credential_lines(chunks: DataFrame, files: DataFrame, *, max_owners: int = MAX_OWNERS) -> DataFrame:
    """chunk_id, line_no of every line on which a credential begins."""
    return locate(indexed_texts(chunks), files, max_owners=max_owners).select("chunk_id", "line_no").distinct()


def redact(content: str, spans: list[int]) -> str:
    """``content`` with the characters of ``spans`` starred; line ends and escapes of line ends stay."""
    out, at = [], 0
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        start = max(start, at)
        if end > start:
            out += [content[at:start], re.sub(r"\\[nr]|[\r\n]|(.)", lambda m: "*" if m.group(1) else m.group(), content[start:end])]
            at = end
    return "".join([*out, content[at:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [redact(c, s) if s else c for c, s in zip(batch.column("content").to_pylist(), batch.column("spans").to_pylist())]
        counts = [len(set(zip(s[::2], s[1::2]))) if s else 0 for s in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["chunk_id", "content", "redactions"])


def redacted_chunks(chunks: DataFrame, files: DataFrame, *, max_owners: int = MAX_OWNERS) -> DataFrame:
    """chunk_id, content, redactions of every chunk that holds a credential (one row per different content)."""
    texts = indexed_texts(chunks)
    spans = locate(texts, files, max_owners=max_owners).groupBy("chunk_id", "content_hash").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    rows = texts.select("chunk_id", "content_hash", "content").join(spans, ["chunk_id", "content_hash"]).dropDuplicates(["chunk_id", "content_hash"])
    return rows.mapInArrow(_redact, "chunk_id bigint, content string, redactions int")
