"""Python 3 for the generalised LL recogniser: lexer and grammar.

Lines are first looked up by their token kinds: what the recogniser has found
for a simple statement or a compound header once holds for every line of the
same kinds (the stack node of a nonterminal over equal input), so a file mostly
comes down to a short sequence of line kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from repolith.llm.gll import Grammar

# The keywords and operators of the language.
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type"
).split()
OPERATORS = "( ) [ ] { } , : . ; @ = -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= := + - * / // % ** | & ^ ~ << >> < > <= >= == != ...".split()
_NAMES = ["END", "NAME", "NUMBER", "STRING", "NEWLINE", "INDENT", "DEDENT", "ERROR", "LINE", "HEAD_IF", "HEAD_ELIF", "HEAD_ELSE", "HEAD_LOOP", "HEAD_TRY", "HEAD_EXCEPT", "HEAD_FINALLY", "HEAD_PLAIN", "DECORATOR"]
KINDS = {name: i for i, name in enumerate([*_NAMES, *KEYWORDS, *OPERATORS])}

GRAMMAR = """
File = FileItem* END
FileItem = NEWLINE | Statement
Statement~ = MatchStatement | OneLine | Compound
OneLine = LINE | Simple MoreSimple NEWLINE
MoreSimple = ';' NextSimple |
NextSimple = Simple MoreSimple |
Block = NEWLINE INDENT Statement+ DEDENT | OneLine
LineOnly = Simple MoreSimple NEWLINE END
Simple~ = TypeAlias | Plain
TypeAlias = 'type' Name TypeParams? '=' Expr
Plain = 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Expr ('from' Expr)?)? | ('global' | 'nonlocal') Name (',' Name)* | 'del' Stars | 'assert' Expr (',' Expr)? | 'import' Dotted ('as' Name)? (',' Dotted ('as' Name)?)* | 'from' From 'import' Imported | ExprStatement
From = ('.' | '...')+ Dotted? | Dotted
Imported = '*' | '(' ImportMore% ')' | Name ('as' Name)? (',' Name ('as' Name)?)*
ImportMore = Name ('as' Name)?
Dotted = Name ('.' Name)*
Name = NAME | 'match' | 'case' | 'type'
ExprStatement = Value ExprRest
ExprRest = Augment Value | ':' Expr ('=' Value)? | ('=' Value)+ |
Augment = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Value = Yield | Stars
Yield = 'yield' YieldRest
YieldRest = 'from' Expr | Stars |
Stars = Star%
Star = '*' Expr | Named
Named = Expr (':=' Expr)?
Expr = 'lambda' LambdaParams? ':' Expr | Binary ('if' Binary 'else' Expr)?
Binary = Unary (BinaryOp Unary)*
BinaryOp = 'or' | 'and' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
Unary = ('not' | '-' | '+' | '~' | 'await')* Primary
Primary = Atom Trailer*
Trailer = '.' Name | '(' Arg%? ')' | '[' Slice% ']'
Atom = Name | NUMBER | STRING+ | '...' | 'None' | 'True' | 'False' | '(' ParenBody ')' | '[' ListBody ']' | '{' Braced '}'
ParenBody = Yield | ListBody
ListBody = (Star ListRest)?
ListRest = CompFor | ListMore
ListMore = ',' ListNext |
ListNext = Star ListMore |
Braced = ('**' Expr DictMore | Star BracedRest)?
BracedRest = ':' Expr DictRest | CompFor | ListMore
DictRest = CompFor | DictMore
DictMore = ',' DictNext |
DictNext = DictItem DictMore |
DictItem = '**' Expr | Expr ':' Expr
CompFor = 'async'? 'for' Targets 'in' Binary CompNext*
CompNext = 'async'? 'for' Targets 'in' Binary | 'if' Condition
Condition = Binary (':=' Binary)?
Targets = Target%
Target = '*'? Primary
Arg = '*' Expr | '**' Expr | Expr ArgRest
ArgRest = '=' Expr | ':=' Expr | CompFor |
Slice = '*' Expr | ':' Expr? (':' Expr?)? | Named (':' Expr? (':' Expr?)?)?
LambdaParams = LambdaParam%
LambdaParam = '/' | '*' Name? | '**' Name | Name ('=' Expr)?
Params = Param%
Param = '/' | '*' (Name (':' Star)?)? | '**' Name (':' Expr)? | Name (':' Expr)? ('=' Expr)?
TypeParams = '[' TypeParam% ']'
TypeParam = ('*' | '**')? Name (':' Expr)? ('=' Star)?
Compound = If | Loop | Try | Plainly | Decorated
If = IfHead Block ElifPart* ElsePart?
IfHead = 'if' Named ':'
ElifPart = 'elif' Named ':' Block | HEAD_ELIF Body
ElsePart = 'else' ':' Block | HEAD_ELSE Body
Body = INDENT Statement+ DEDENT
Loop = LoopHead Block ElsePart? | HEAD_LOOP Body ElsePart?
LoopHead = 'while' Named ':' | 'for' Targets 'in' Stars ':'
Try = TryHead TryRest
TryHead = 'try' ':' Block | HEAD_TRY Body
TryRest = ExceptPart+ ElsePart? FinallyPart? | FinallyPart
ExceptPart = 'except' '*'? (Expr (',' Expr)* ('as' Name)?)? ':' Block | HEAD_EXCEPT Body
FinallyPart = 'finally' ':' Block | HEAD_FINALLY Body
Plainly = HEAD_PLAIN Body | PlainHead Block | HEAD_IF Body ElifPart* ElsePart? | 'async' AsyncRest
AsyncRest = PlainHead Block | LoopHead Block ElsePart? | HEAD_LOOP Body ElsePart?
PlainHead = 'def' Name TypeParams? '(' Params? ')' ('->' Expr)? ':' | 'class' Name TypeParams? ('(' Arg%? ')')? ':' | 'with' WithItems ':'
WithItems~ = '(' WithItem (',' WithItem)* ','? ')' | WithItem (',' WithItem)*
WithItem = Expr ('as' '*'? Primary)?
Decorated = DecoratorLine+ DecoratedRest
DecoratorLine = '@' Named NEWLINE | DECORATOR
DecoratedRest = PlainHead Block | HEAD_PLAIN Body | 'async' PlainHead Block
MatchStatement = 'match' Stars ':' NEWLINE INDENT CasePart+ DEDENT
CasePart = 'case' Pattern% ('if' Named)? ':' Block
Pattern = '*'? PatternOr ('as' Name)?
PatternOr = PatternAtom ('|' PatternAtom)*
PatternAtom = '-'? NUMBER (('+' | '-') NUMBER)? | STRING+ | 'None' | 'True' | 'False' | Dotted ('(' PatternArg%? ')')? | '(' Pattern%? ')' | '[' Pattern%? ']' | '{' PatternItem%? '}'
PatternArg = Pattern ('=' Pattern)?
PatternItem = '**' Name | Pattern ':' Pattern
HeadIf = 'if' Named ':' END
HeadElif = 'elif' Named ':' END
HeadElse = 'else' ':' END
HeadLoop = LoopHead END | 'async' LoopHead END
HeadTry = 'try' ':' END
HeadExcept = 'except' '*'? (Expr (',' Expr)* ('as' Name)?)? ':' END
HeadFinally = 'finally' ':' END
HeadPlain = PlainHead END | 'async' PlainHead END
HeadDecorator = '@' Named NEWLINE END
Field = Value END
"""

_STRING = r"""(?:[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|\"(?:[^\"\\\n]++|\\[\s\S])*+\"|'(?:[^'\\\n]++|\\[\s\S])*+'))"""
_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+\-]?\d(?:_?\d)*)?[jJ]?)"
# A replacement field may hold strings with the quotes of the formatted string around it, and fields of its own.
_INNER = r"""\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"""
_FIELD = r"[^{}\"'\n]"
for _ in range(4):
    _FIELD = rf"\{{(?!\{{)(?:[^{{}}\"'\n]|{_INNER}|{_FIELD})*\}}"
_FORMATTED = rf"""(?:[fFtT][rR]?|[rR][fFtT])(?:\"(?!\"\")(?>[^\"\\\n{{}}]|\\[\s\S]|\{{\{{|\}}\}}|{_FIELD})*\"|'(?!'')(?>[^'\\\n{{}}]|\\[\s\S]|\{{\{{|\}}\}}|{_FIELD})*')"""
TOKEN = re.compile(
    rf"(?:[ \t\f]++|\\\n)*+(\n[ \t\f]*|#[^\n]*|{_FORMATTED}|{_STRING}|[^\W\d]\w*|{_NUMBER}|\.\.\.|\*\*=|//=|>>=|<<=|->|:=|[+\-*/%@&|^=<>!]=|\*\*|//|<<|>>|[()\[\]{{}},:.;@=+\-*/%|&^~<>]|\Z|[\s\S])"
)
_BAD_NUMBER = re.compile(r"0\d*[1-9]\d*$|0_?\d*[1-9][\d_]*$")
_AFTER_NUMBER = re.compile(r"and|else|for|if|in|is|or|not")
_NAME, _NUMBER_KIND, _STRING_KIND, _NEWLINE, _INDENT, _DEDENT, _ERROR = (KINDS[k] for k in ("NAME", "NUMBER", "STRING", "NEWLINE", "INDENT", "DEDENT", "ERROR"))
_FIXED = {w: KINDS[w] for w in [*KEYWORDS, *OPERATORS]}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_HEADS = {
    "if": ("HeadIf", "HEAD_IF"), "elif": ("HeadElif", "HEAD_ELIF"), "else": ("HeadElse", "HEAD_ELSE"), "while": ("HeadLoop", "HEAD_LOOP"), "for": ("HeadLoop", "HEAD_LOOP"),
    "try": ("HeadTry", "HEAD_TRY"), "except": ("HeadExcept", "HEAD_EXCEPT"), "finally": ("HeadFinally", "HEAD_FINALLY"), "def": ("HeadPlain", "HEAD_PLAIN"), "class": ("HeadPlain", "HEAD_PLAIN"), "with": ("HeadPlain", "HEAD_PLAIN"),
}
_HEAD_BY_KIND = {KINDS[k]: (rule, KINDS[token]) for k, (rule, token) in _HEADS.items()}
_SOFT = {KINDS["match"], KINDS["case"]}
_ASYNC, _AT = KINDS["async"], KINDS["@"]
#: Lines remembered by a worker before it starts afresh.
MEMO_LINES = 200_000
_memo: dict[tuple[str, bytes], bool] = {}
_names: dict[str, int] = {}
_lines: dict[str, bytes] = {}  # kinds of lines that stand for themselves
_LINE_END = bytes([KINDS["NEWLINE"]])


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar(GRAMMAR, KINDS, [frozenset()])


class Broken(Exception):
    """Raised with the offset of a lexical error."""


def _derives(rule: str, kinds: bytes) -> bool:
    key = (rule, kinds)
    known = _memo.get(key)
    if known is None:
        if len(_memo) >= MEMO_LINES:
            _memo.clear()
        known = _memo[key] = (not rule or grammar().accepts(rule, kinds + b"\0")[0] > 0) and _well_placed(kinds)
    return known


_NAMELIKE = frozenset(KINDS[k] for k in ("NAME", "match", "case", "type"))
_LPAR, _LBRACKET, _COMMA, _COLON, _EQUALS, _STAR, _TWO_STARS, _SLASH, _DOT, _WALRUS = (KINDS[k] for k in "( [ , : = * ** / . :=".split())
_LAMBDA, _FOR, _IN, _DEF, _WITH, _AS, _DEL, _TYPE = (KINDS[k] for k in "lambda for in def with as del type".split())
_BRACKETS = {KINDS[a]: KINDS[b] for a, b in _OPEN.items()}
_AUGMENTED = frozenset(KINDS[k] for k in OPERATORS if len(k) > 1 and k[-1] == "=" and k not in (":=", "<=", ">=", "==", "!="))
_PRIMARY = _NAMELIKE | _BRACKETS.keys() | frozenset(KINDS[k] for k in ("NUMBER", "STRING", "...", "None", "True", "False", "."))
_NAMED_HEADS = frozenset(KINDS[k] for k in ("if", "elif", "while", "match", "case", "@"))
_BEFORE_NAMED = frozenset(KINDS[k] for k in "( [ { , if elif while match @".split())
#: Behind ``match`` or ``case`` these make the word a name.
_MAKES_NAME = _AUGMENTED | {KINDS[k] for k in ("=", ".", ",", ":", ";", "NEWLINE")}
_STOPS = frozenset(KINDS[k] for k in (";", "NEWLINE"))


def _at_level(line: bytes, pairs: dict[int, int], a: int, b: int) -> Iterator[int]:
    """Places between a and b outside of brackets, of the parameters of lambdas and of the targets of loops."""
    while a < b:
        yield a
        if line[a] == _LAMBDA:
            a = _lambda_end(line, pairs, a)
        elif line[a] == _FOR:
            while a + 1 < b and line[a + 1] != _IN:
                a = pairs.get(a + 1, a + 1)
        else:
            a = pairs.get(a, a)
        a += 1


def _lambda_end(line: bytes, pairs: dict[int, int], at: int) -> int:
    open_, i = 1, at + 1
    while i < len(line):
        open_ += (line[i] == _LAMBDA) - (line[i] == _COLON)
        if not open_:
            break
        i = pairs.get(i, i) + 1
    return i


def _pieces(line: bytes, pairs: dict[int, int], a: int, b: int) -> list[tuple[int, int]]:
    """Spans between the commas of a list; a comma at its end adds none."""
    out = []
    for i in _at_level(line, pairs, a, b):
        if line[i] == _COMMA:
            out.append((a, i))
            a = i + 1
    return [*out, (a, b)] if a < b else out


def _targets(line: bytes, pairs: dict[int, int], a: int, b: int, *, single: bool = False, stars: bool = True) -> bool:
    """Whether what stands between a and b can be assigned to (``single``: by an augmented or annotated assignment)."""
    pieces = _pieces(line, pairs, a, b)
    if single and (len(pieces) != 1 or pieces[0][1] != b):
        return False
    for p, q in pieces:
        if line[p] == _STAR:
            if not stars or single:
                return False
            p += 1
        if q - p == 1 and line[p] in _NAMELIKE:
            continue
        if p < q and pairs.get(p) == q - 1 and (line[p] == _LPAR or line[p] == _LBRACKET and not single):
            if not _targets(line, pairs, p + 1, q - 1, single=single, stars=stars):
                return False
            continue
        places = list(_at_level(line, pairs, p, q))
        if len(places) < 2 or any(line[i] not in _PRIMARY for i in places):
            return False
        last = places[-1]
        if not (line[last] == _LBRACKET or line[last] in _NAMELIKE and line[places[-2]] == _DOT):
            return False
    return True


def _arguments(line: bytes, pairs: dict[int, int], a: int, b: int) -> bool:
    pieces = _pieces(line, pairs, a, b)
    named = doubled = False
    for p, q in pieces:
        if line[p] == _TWO_STARS:
            doubled = True
        elif line[p] == _STAR:
            if doubled:
                return False
        else:
            level = list(_at_level(line, pairs, p, q))
            if any(line[i] == _EQUALS for i in level):
                if line[p] not in _NAMELIKE or line[p + 1] != _EQUALS:
                    return False
                named = True
            elif named or doubled or any(line[i] == _FOR for i in level) and q != b or len(pieces) > 1 and any(line[i] == _FOR for i in level):
                return False
    return True


def _parameters(line: bytes, pairs: dict[int, int], a: int, b: int) -> bool:
    slash = star = bare = default = last = False
    for k, (p, q) in enumerate(_pieces(line, pairs, a, b)):
        if last:
            return False
        if line[p] == _SLASH:
            if slash or star or not k:
                return False
            slash = True
        elif line[p] == _STAR:
            if star:
                return False
            star, bare = True, q - p == 1
        elif line[p] == _TWO_STARS:
            if bare:
                return False
            last = True
        else:
            has = any(line[i] == _EQUALS for i in _at_level(line, pairs, p, q))
            if default and not has and not star:
                return False
            default |= has
            bare = False
    return not bare


def _well_placed(line: bytes) -> bool:
    """What the grammar leaves open about a line: targets, and the order of arguments and parameters."""
    pairs: dict[int, int] = {}
    opened: list[int] = []
    for i, kind in enumerate(line):
        if kind in _BRACKETS:
            opened.append(i)
        elif opened and kind == _BRACKETS[line[opened[-1]]]:
            pairs[opened.pop()] = i
        elif kind == _WALRUS and (i < 2 or line[i - 1] not in _NAMELIKE or line[i - 2] not in _BEFORE_NAMED or not opened and line[0] not in _NAMED_HEADS):
            return False
    first = 1 if line[0] == _ASYNC and len(line) > 1 else 0
    parameters = -1
    if line[first] == _DEF:
        parameters = next((i for i in _at_level(line, pairs, first, len(line)) if line[i] == _LPAR), -1)
    for i, kind in enumerate(line):
        if kind == _LPAR:
            if not (_parameters if i == parameters else _arguments)(line, pairs, i + 1, pairs[i]):
                return False
        elif kind == _LAMBDA:
            if not _parameters(line, pairs, i + 1, _lambda_end(line, pairs, i)):
                return False
        elif kind == _FOR:
            end = next((j for j in _at_level(line, pairs, i + 1, len(line)) if line[j] == _IN), i)
            if not _targets(line, pairs, i + 1, end):
                return False
    start = first
    while start < len(line):
        kind = line[start]
        soft = kind in _SOFT and start + 1 < len(line) and line[start + 1] not in _MAKES_NAME
        if kind in _HEAD_BY_KIND or soft:
            colon = next((i for i in _at_level(line, pairs, start, len(line)) if line[i] == _COLON), len(line))
            if kind == _WITH and not _with_targets(line, pairs, start + 1, colon):
                return False
            if soft and (colon == len(line) or line[start + 1] in (_LPAR, _LBRACKET)):
                return True  # may be a call or a subscript of that name
            start = colon + 1
            continue
        end = next((i for i in _at_level(line, pairs, start, len(line)) if line[i] in _STOPS), len(line))
        if kind == _DEL:
            if not _targets(line, pairs, start + 1, end, stars=False):
                return False
        elif not (kind == _TYPE and start + 1 < end and line[start + 1] in _NAMELIKE):
            a = start
            for i in _at_level(line, pairs, start, end):
                if line[i] == _EQUALS:
                    if not _targets(line, pairs, a, i):
                        return False
                    a = i + 1
                elif line[i] in _AUGMENTED or line[i] == _COLON and not any(line[j] == _LAMBDA for j in _at_level(line, pairs, a, i)):
                    if not _targets(line, pairs, a, i, single=True):
                        return False
                    break
        start = end + 1
    return True


def _with_targets(line: bytes, pairs: dict[int, int], a: int, b: int) -> bool:
    if pairs.get(a) == b - 1 and line[a] == _LPAR:
        a, b = a + 1, b - 1
    for p, q in _pieces(line, pairs, a, b):
        at = next((i for i in _at_level(line, pairs, p, q) if line[i] == _AS), None)
        if at is not None and not _targets(line, pairs, at + 1, q):
            return False
    return True


def _kind_of(token: str) -> int:
    """Kind of a token that is no keyword, operator or name seen before."""
    c = token[0]
    if c.isalpha() or c == "_" or c > "\x7f":
        if token[-1] in "\"'":
            _check_prefix(token)
            return _STRING_KIND
        if token.isidentifier():
            if len(_names) < MEMO_LINES:
                _names[token] = _NAME
            return _NAME
    elif c in "\"'" and len(token) > 1:
        return _STRING_KIND
    elif (c.isdigit() or c == "." and len(token) > 1) and not (c == "0" and _BAD_NUMBER.match(token)):
        return _NUMBER_KIND
    raise Broken


def _read_line(tokens, closers: list[str]) -> bytearray:
    """Kinds of ``tokens`` up to the end of the logical line; what is still open is left in ``closers``."""
    fixed, named = _FIXED.get, _names.get
    out = bytearray()
    for token in tokens:
        kind = fixed(token) or named(token)
        if kind is None:
            if not token:
                break
            if token[0] == "\n":
                if closers:
                    continue
                break
            if token[0] == "#":
                continue
            kind = _kind_of(token)
        elif token in _OPEN:
            closers.append(_OPEN[token])
        elif token in _CLOSE and (not closers or closers.pop() != token):
            raise Broken
        out.append(kind)
    return out


def _logical_line(text: str, at: int, end: int) -> tuple[bytes, int]:
    """(kinds, where the next line begins) of the logical line that begins at ``at``, whose first line ends at ``end``."""
    if text[end - 1] != "\\":
        line = text[at:end]
        if '"""' not in line and "'''" not in line:
            closers: list[str] = []
            kinds = _read_line(TOKEN.findall(line), closers)
            if not closers:
                kinds = bytes(kinds)
                if len(line) <= 120 and len(_lines) < MEMO_LINES:
                    _lines[line] = kinds
                return kinds, end + 1
    closers, stop = [], [len(text) + 1]

    def tokens() -> Iterator[str]:
        for m in TOKEN.finditer(text, at):
            if text[m.start(1) : m.start(1) + 1] == "\n":
                stop[0] = m.start(1) + 1
            else:
                stop[0] = len(text) + 1
            yield m.group(1)

    kinds = _read_line(tokens(), closers)
    if closers:
        raise Broken
    return bytes(kinds), stop[0]


_BLANKS = re.compile(r"[ \t\f]*")


def lines_of(text: str) -> tuple[list, list[bytes]]:
    """Layout entries (INDENT / DEDENT kinds as int, lines as index) and the lines' kinds."""
    layout: list = []
    lines: list[bytes] = []
    indents, alternate = [0], [0]
    known = _lines.get
    at, size = 0, len(text)
    while at < size:
        first = _BLANKS.match(text, at).end()
        end = text.find("\n", first)
        if end < 0:
            end = size
        if end == first:
            at = end + 1
            continue
        blanks = text[at:first]
        kinds = known(text[first:end])
        if kinds is None:
            kinds, at = _logical_line(text, first, end)
        else:
            at = end + 1
        if not kinds:
            continue
        column, alt = _measure(blanks)
        if column > indents[-1]:
            if alt <= alternate[-1]:
                raise Broken
            indents.append(column)
            alternate.append(alt)
            layout.append(-_INDENT)
        elif column != indents[-1] or alt != alternate[-1]:
            while column < indents[-1]:
                indents.pop()
                alternate.pop()
                layout.append(-_DEDENT)
            if column != indents[-1] or alt != alternate[-1]:
                raise Broken
        layout.append(len(lines))
        lines.append(kinds + _LINE_END)
    layout += [-_DEDENT] * (len(indents) - 1)
    return layout, lines


def _measure(blanks: str) -> tuple[int, int]:
    if "\t" not in blanks and "\f" not in blanks:
        return len(blanks), len(blanks)
    column = alt = 0
    for c in blanks:
        if c == "\f":
            column = alt = 0
        elif c == "\t":
            column, alt = (column // 8 + 1) * 8, alt + 1
        else:
            column, alt = column + 1, alt + 1
    return column, alt


_PREFIXES = {"r", "b", "u", "f", "t", "br", "rb", "fr", "rf", "tr", "rt"}


def _check_prefix(token: str) -> None:
    prefix = re.match(r"[A-Za-z]*", token).group().lower()
    if prefix not in _PREFIXES:
        raise Broken
    if ("f" in prefix or "t" in prefix) and ("{" in token or "}" in token):
        body = token[len(prefix) :]
        quotes = 3 if body[:3] in ('"""', "'''") else 1
        _fields(body[quotes:-quotes], "r" in prefix)


def _fields(body: str, raw: bool) -> None:
    """Checks the replacement fields of a formatted string."""
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "\\":
            if not raw and body[i + 1 : i + 3] == "N{" and "}" in body[i:]:
                i = body.index("}", i) + 1
            else:
                i += 1 if raw or body[i + 1 : i + 2] in "{}" else 2
            continue
        if body[i : i + 2] in ("{{", "}}"):
            i += 2
        elif c == "}":
            raise Broken
        elif c == "{":
            i = _field(body, i + 1)
        else:
            i += 1


def _field(body: str, start: int) -> int:
    depth, i, n = [], start, len(body)
    while i < n:
        c = body[i]
        if c in "\"'":
            m = re.compile(_STRING).match(body, i)
            if m is None:
                raise Broken
            i = m.end()
            continue
        if c in "([{":
            depth.append(_OPEN[c])
        elif depth and c in ")]}":
            if depth.pop() != c:
                raise Broken
        elif not depth and (c in "}:" or c == "!" and body[i : i + 2] != "!="):
            break
        i += 1
    else:
        raise Broken
    source = body[start:i].rstrip()
    if source.endswith("=") and not source.endswith(("==", "!=", "<=", ">=")):
        source = source[:-1]
    if not source.strip():
        raise Broken
    _, lines = lines_of(f"({source})")
    if len(lines) != 1 or not _derives("Field", lines[0][:-1]):
        raise Broken
    if body[i] == "!":
        m = re.compile(r"![rsa]\s*").match(body, i)
        if m is None:
            raise Broken
        i = m.end()
    if body[i : i + 1] == ":":
        i += 1
        while i < n and body[i] != "}":
            i = _field(body, i + 1) if body[i] == "{" else i + 1
    if body[i : i + 1] != "}":
        raise Broken
    return i + 1


def parses(text: str) -> bool:
    """Whether ``text`` is a Python 3 file (a byte-order mark at the start is none of it)."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        return False
    try:
        layout, lines = lines_of(text)
    except (Broken, RecursionError):
        return False
    stream = bytearray()
    for k, entry in enumerate(layout):
        if entry < 0:
            stream.append(-entry)
            continue
        line = lines[entry]
        kind = line[0]
        if kind == _ASYNC and len(line) > 1 and line[1] in _HEAD_BY_KIND:
            kind = line[1]
        if kind in _SOFT:
            if not _derives("", line):
                return False
            stream += line
            continue
        head = _HEAD_BY_KIND.get(kind)
        if head is not None:
            if k + 1 < len(layout) and layout[k + 1] == -_INDENT:
                if not _derives(head[0], line[:-1]):
                    return False
                stream.append(head[1])
            else:
                if not _derives("", line):
                    return False
                stream += line
        elif kind == _AT:
            if not _derives("HeadDecorator", line):
                return False
            stream.append(KINDS["DECORATOR"])
        else:
            if not _derives("LineOnly", line):
                return False
            stream.append(KINDS["LINE"])
    stream.append(0)
    return bool(grammar().accepts("File", bytes(stream))[0]) and _numbers_end(text)


_STRING_OR_COMMENT = re.compile(rf"{_STRING}|#[^\n]*")
_GLUED = re.compile(rf"(?<![\w.])(?>{_NUMBER})(?=\w)")


def _numbers_end(text: str) -> bool:
    """No letter stands right behind a number, but for a keyword."""
    if not _GLUED.search(text):
        return True
    bare = _STRING_OR_COMMENT.sub(" ", text)
    return all(_AFTER_NUMBER.match(bare, m.end()) for m in _GLUED.finditer(bare))
