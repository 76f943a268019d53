"""JavaScript, JSX, TypeScript and TSX for the generalised LL recogniser.

One grammar holds all four dialects; productions of one dialect carry its mark.
The lexer settles what only needs a look at its neighbours (regular expression or
division, template parts, markup text, whether a parenthesis opens the parameters
of an arrow function, contextual words); what needs more stays doubtful and runs
as several descriptors (type arguments or comparison, return type or conditional,
assertion or generic function).

Simple statements are looked up by their token kinds, as in ``python_syntax``.
"""

from __future__ import annotations

import re
from functools import lru_cache

from repolith.llm.gll import Grammar

# Reserved words, contextual words and punctuators of the languages.
RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let yield await"
).split()
CONTEXTUAL = "async get set static public private protected readonly abstract declare override accessor type interface namespace module of from as satisfies is keyof unique infer asserts implements".split()
PUNCTUATORS = (
    "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #"
).split()
_NAMES = (
    "END IDENT NUM STR TEMPLATE THEAD TMID TTAIL REGEX PRIVATE STATEMENT "
    "LPARROW LPMAYBE IDARROW ASYNCFN ASYNCARROW ASYNCMAYBE LABEL GETTER SETTER MOD STATICBLOCK TYPE INTERFACE NAMESPACE DECLARE ABSTRACT OF FROM AS SATISFIES IS TYPEOP IMPLEMENTS IMPORTEXPR CONSTENUM WITHATTR ASSERTS "
    "JOPEN JCLOSE JNAME JGT JSELF JTEXT JEQ JSTR BANGEQ"
).split()
KINDS = {name: i for i, name in enumerate([*_NAMES, *RESERVED, *PUNCTUATORS])}

GRAMMAR = """
Program = Statement* END
StatementOnly = Statement END
Statement! = STATEMENT | Block | 'var' Declarators SEMI | 'let' Declarators SEMI | 'const' ConstDeclarators SEMI | NamedFunction | ASYNCFN NamedFunction | NamedClass | 'if' '(' Expr Close Statement ('else' Statement)? | 'for' 'await'? Paren ForHead Close Statement | 'while' '(' Expr Close Statement | 'do' Statement 'while' '(' Expr Close ';'? | 'return' Expr? SEMI | 'break' Id? SEMI | 'continue' Id? SEMI | 'throw' Expr SEMI | 'try' Block TryRest | 'switch' '(' Expr Close '{' CaseClause* '}' | 'debugger' SEMI | Import | Export | LABEL ':' Statement | ';' | Decorated | @ts Typed | ExprStatement
Close = ')'
Paren = '(' | LPMAYBE
Block = '{' Statement* '}'
ExprStatement = Expr SEMI
Typed = INTERFACE Id TypeParams? ('extends' TypeList)? ObjectType | TYPE Id TypeParams? '=' Type SEMI | Enum | NAMESPACE ModuleName ModuleBody | DECLARE Ambient | ABSTRACT Class
Enum = ('enum' | CONSTENUM 'enum') Id '{' EnumItem%? '}'
EnumItem = PropName ('=' Assign)?
ModuleName = STR | Id ('.' AnyName)*
ModuleBody! = Block | SEMI
Ambient = ('var' | 'let' | 'const') AmbientVar (',' AmbientVar)* SEMI | Function | ASYNCFN Function | Class | ABSTRACT Class | Typed | 'import' ImportRest
AmbientVar = Binding TypeNote? ('=' Assign)?
Decorated = Decorator+ (ABSTRACT? Class | Export)
Decorator = '@' ('(' Expr ')' | Id DecoratorTail*)
DecoratorTail = '.' AnyName | Args
CaseClause = ('case' Expr ':' | 'default' ':') Statement*
TryRest = 'catch' CatchParam? Block ('finally' Block)? | 'finally' Block
CatchParam = Paren Binding TypeNote? ')'
Declarators = Declarator (',' Declarator)*
Declarator = Id Bang? TypeNote? ('=' Assign)? | Pattern TypeNote? '=' Assign
Bang = @ts '!'
ConstDeclarators = ConstDeclarator (',' ConstDeclarator)*
ConstDeclarator = Binding ConstValue
ConstValue~ = '=' Assign | @ts ':' Type ('=' Assign)?
ForHead = ('var' | 'let' | 'const') Binding TypeNote? ForRest | ';' Expr? ';' Expr? | Expr ForExprRest
ForRest = OF Assign | 'in' Expr | ('=' Assign)? (',' Declarator)* ';' Expr? ';' Expr?
ForExprRest = ';' Expr? ';' Expr? | OF Assign |
Import = 'import' ImportRest
ImportRest = STR Attributes? SEMI | TYPE? ImportClause ImportFrom
ImportFrom = FROM STR Attributes? SEMI | @ts '=' Assign SEMI
ImportClause = Id (',' (Named | '*' AS Id))? | Named | '*' AS Id
Attributes = WITHATTR Object
Named = '{' Specifier%? '}'
Specifier = TYPE? ModName (AS ModName)?
ModName = AnyName | STR
Export = 'export' ExportRest
ExportRest = 'default' ExportDefault | '*' (AS ModName)? FROM STR Attributes? SEMI | Named (FROM STR Attributes?)? SEMI | 'var' Declarators SEMI | 'let' Declarators SEMI | 'const' ConstDeclarators SEMI | Function | ASYNCFN Function | Class | Decorated | @ts TYPE ExportTyped | @ts ExportOther
ExportTyped = Named (FROM STR)? SEMI | '*' (AS ModName)? FROM STR SEMI | Id TypeParams? '=' Type SEMI
ExportOther = INTERFACE Id TypeParams? ('extends' TypeList)? ObjectType | Enum | NAMESPACE ModuleName ModuleBody | DECLARE Ambient | ABSTRACT Class | '=' Expr SEMI | AS NAMESPACE Id SEMI | 'import' ImportRest
ExportDefault! = Function | ASYNCFN Function | Class | Decorated | @ts ABSTRACT Class | @ts INTERFACE Id TypeParams? ('extends' TypeList)? ObjectType | Assign SEMI
Function = 'function' '*'? Id? TypeParams? Params ReturnType? FunctionBody
NamedFunction = 'function' '*'? Id TypeParams? Params ReturnType? FunctionBody
FunctionBody! = Block | @ts SEMI
Params = ParamOpen Param%? ')'
ParamOpen = '(' | LPMAYBE
Param = Decorator* ParamMod* '...'? ParamTarget Optional? TypeNote? ('=' Assign)?
ParamMod = @ts MOD
ParamTarget = Binding | @ts 'this'
Optional = @ts '?'
Binding = Id | Pattern
Pattern = '[' ArrayTargets ']' | '{' BindProp%? '}'
ArrayTargets = ',' ArrayTargets | ArrayTarget MoreTargets |
MoreTargets = ',' ArrayTargets |
ArrayTarget = '...'? Binding ('=' Assign)?
BindProp = '...' Binding | Id BindRest | BindName ':' Binding ('=' Assign)?
BindRest = ':' Binding ('=' Assign)? | ('=' Assign)?
BindName = Keyword | STR | NUM | '[' Assign ']'
TypeNote = @ts ':' Type
ReturnType = @ts ':' TypeOrPredicate
Class = 'class' Id? TypeParams? ('extends' Postfix)? Implements? '{' ClassMember* '}'
NamedClass = 'class' Id TypeParams? ('extends' Postfix)? Implements? '{' ClassMember* '}'
Implements = @ts IMPLEMENTS TypeList
TypeList = TypeRef (',' TypeRef)*
ClassMember = ';' | STATICBLOCK Block | Decorator* MOD* Member
Member~ = IndexSignature SEMI | MemberBody
MemberBody = GETTER MemberName Params ReturnType? FunctionBody | SETTER MemberName Params ReturnType? FunctionBody | '*' MemberName TypeParams? Params ReturnType? FunctionBody | MemberName MemberMark? MemberRest
MemberName = PropName | PRIVATE
MemberMark = @ts '?' | @ts '!'
MemberRest = TypeParams? Params ReturnType? FunctionBody | TypeNote? ('=' Assign)? SEMI
IndexSignature = @ts '[' Id ':' Type ']' TypeNote
PropName = AnyName | STR | NUM | '[' Assign ']'
Expr = Assign (',' Assign)*
Assign! = Arrow | Yield | Doubtful
Doubtful~ = @ts TypedArrow | Operation
Yield = 'yield' YieldRest
YieldRest = '*' Assign | Assign |
Arrow = IDARROW '=>' ArrowBody | LPARROW ParamList ReturnType? '=>' ArrowBody | ASYNCARROW (IDARROW | LPARROW ParamList ReturnType?) '=>' ArrowBody | @ts ASYNCARROW TypeParams (LPARROW | LPMAYBE) ParamList ReturnType? '=>' ArrowBody
TypedArrow = LPMAYBE ParamList ReturnType '=>' ArrowBody | ASYNCMAYBE LPMAYBE ParamList ReturnType '=>' ArrowBody | TypeParams (LPARROW | LPMAYBE) ParamList ReturnType? '=>' ArrowBody 
ParamList = Param%? ')'
ArrowBody! = Block | Assign
Operation = Unit OperationRest
OperationRest = AssignOp Assign | OperationTail* ('?' Assign ':' Assign)?
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
OperationTail = BinaryOp Unit | @ts AS (Type | 'const') | @ts SATISFIES Type
BinaryOp = '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '<' | '>' ('>' '>'?)? | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | '&&' | '||' | '??' | 'instanceof' | 'in'
Unit~ = Prefix Unit | 'new' NewRest | Postfix | @ts @-jsx '<' (Type | 'const') '>' Unit
Prefix = '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | '++' | '--' | 'await'
NewRest = '.' AnyName Tails | Unit
Postfix = Primary Tails
Tails! = Tail Tails | MaybeTyped |
MaybeTyped~ = @ts TypeArgs Tails |
Tail = '.' (AnyName | PRIVATE) | '?.' ChainRest | '[' Expr ']' | Args | Template | '++' | '--' | @ts '!'
ChainRest = AnyName | PRIVATE | '[' Expr ']' | Args | Template | @ts TypeArgs Args
Args = ('(' | LPMAYBE) Element%? ')'
Element = '...'? Assign
Primary = Id | NUM | STR | REGEX | Template | 'this' | 'super' | 'null' | 'true' | 'false' | PRIVATE | ('(' | LPMAYBE) Expr ')' | Array | Object | Function | ASYNCFN Function | Decorator* Class | IMPORTEXPR ImportCall | @jsx Markup
ImportCall = ('(' | LPMAYBE) Assign% ')' | '.' AnyName
Template = TEMPLATE | THEAD Expr (TMID Expr)* TTAIL
Array = '[' Elements ']'
Elements = ',' Elements | Element MoreElements |
MoreElements = ',' Elements |
Object = '{' Property%? '}'
Property = '...' Assign | GETTER PropName Params ReturnType? Block | SETTER PropName Params ReturnType? Block | MOD '*'? PropName Method | '*' PropName Method | Id IdProperty | LiteralName LiteralProperty
LiteralName = Keyword | STR | NUM | '[' Assign ']'
IdProperty = LiteralProperty | ('=' Assign)?
LiteralProperty = ':' Assign | Method
Method = TypeParams? Params ReturnType? Block
Id = IDENT | IDARROW | OF | FROM | AS | SATISFIES | IS | TYPEOP | TYPE | INTERFACE | NAMESPACE | DECLARE | ABSTRACT | GETTER | SETTER | ASYNCMAYBE | IMPLEMENTS | ASSERTS | LABEL
AnyName = Id | Keyword | MOD
Keyword = 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'let' | 'yield' | 'await' | IMPORTEXPR | WITHATTR
Markup = JOPEN MarkupRest
MarkupRest = JGT MarkupChild* JCLOSE JGT | JNAME Attribute* MarkupEnd
MarkupEnd = JSELF | JGT MarkupChild* JCLOSE JNAME JGT
Attribute = JNAME (JEQ AttributeValue)? | '{' '...' Assign '}'
AttributeValue = JSTR | '{' Assign '}' | Markup
MarkupChild = JTEXT | Markup | '{' ('...'? Expr)? '}'
TypeParams = @ts '<' TypeParam% '>'
TypeParam = ('const' | MOD)* TypeParamName ('extends' Type)? ('=' Type)?
TypeParamName = Id | 'in' Id | 'in'
TypeArgs = '<' Type (',' Type)* '>'
TypeOrPredicate~ = Predicate | Type
Predicate = ASSERTS (Id | 'this') (IS Type)? | (Id | 'this') IS Type
Type = FunctionType | 'new' FunctionType | ABSTRACT 'new' FunctionType | UnionType ('extends' UnionType '?' Type ':' Type)?
FunctionType = TypeParams? LPARROW ParamList '=>' TypeOrPredicate
UnionType = ('|' | '&')? TypeUnit (('|' | '&') TypeUnit)*
TypeUnit = (TYPEOP | MOD)* TypePrimary TypeTail*
TypeTail = '[' Type? ']'
TypePrimary = TypeRef | 'void' | 'null' | 'this' | 'true' | 'false' | STR | NUM | '-' NUM | TypeTemplate | ObjectType | '[' TupleItem%? ']' | ('(' | LPMAYBE) Type ')' | 'typeof' TypeQuery | IMPORTEXPR ('(' | LPMAYBE) Type (',' Object)? ')' ('.' AnyName)* TypeArgs?
TypeTemplate = TEMPLATE | THEAD Type (TMID Type)* TTAIL
TypeQuery = (Id | 'this') ('.' (AnyName | PRIVATE))* TypeArgs? | IMPORTEXPR '(' Type ')' ('.' AnyName)*
TypeRef = Id ('.' AnyName)* TypeArgs?
TupleItem~ = '...'? AnyName '?'? ':' Type | '...'? Type '?'?
ObjectType = '{' TypeMember* '}'
TypeMember = MOD* TypeMemberBody
TypeMemberBody~ = Mapped | TypeIndex | TypeCall | GETTER PropName Params ReturnType? SEP | SETTER PropName Params SEP | PropName '?'? PropertyType SEP
PropertyType = TypeParams? Params ReturnType? | TypeNote?
TypeCall = 'new'? TypeParams? Params ReturnType? SEP
TypeIndex = '[' Id ':' Type ']' TypeNote SEP
Mapped = (('+' | '-') MOD)? '[' Id 'in' Type (AS Type)? ']' (('+' | '-')? '?')? (':' Type)? SEP
"""

DIALECTS = {"js": frozenset(), "jsx": frozenset({"jsx"}), "ts": frozenset({"ts"}), "tsx": frozenset({"ts", "jsx"})}
_BIT = {d: 1 << i for i, d in enumerate(DIALECTS)}
_MARKUP, _TYPED = _BIT["jsx"] | _BIT["tsx"], _BIT["ts"] | _BIT["tsx"]

_BLANK = r"(?:[\s﻿]++|//[^\n\r  ]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*"
_IDENT = r"(?:[A-Za-z_$]|[^\x00-\x7f]|\\u)(?:[A-Za-z0-9_$]++|[^\x00-\x7f\s]|\\u)*+"
_NUM = r"(?:0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:(?:0|[1-9][0-9_]*)n(?![\w.])|(?:(?:0|[1-9][0-9_]*)(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+\-]?[0-9_]+)?))(?![A-Za-z0-9_$])"
_STR = r"(?:\"(?:[^\"\\\n\r]++|\\(?:\r\n|[\s\S]))*+\"|'(?:[^'\\\n\r]++|\\(?:\r\n|[\s\S]))*+')"
_PUNCT = r"(?:\.\.\.|=>|===|!==|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
_REGEX = r"(?:/(?![*/])(?:[^/\\\[\n\r]++|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*)"
OPERATOR_NEXT = re.compile(rf"({_BLANK})(?:({_IDENT})|([{{}}()\[\];,:~@])|({_NUM})|({_STR})|({_PUNCT})|(`)|(#{_IDENT}))")
OPERAND_NEXT = re.compile(rf"({_BLANK})(?:({_IDENT})|([{{}}()\[\];,:~@])|({_NUM})|({_STR})|({_REGEX})|({_PUNCT})|(`)|(#{_IDENT}))")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_TAG = re.compile(rf"{_BLANK}(?:([A-Za-z_$][\w$.\-:]*)|(=)|(\"[^\"]*\"|'[^']*')|(/\s*>)|(>)|(\{{)|(<))")
_TEXT = re.compile(r"[^<>{}]+")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\s|=(?!=))")

_K = KINDS
_PUNCT_KIND = {p: KINDS[p] for p in PUNCTUATORS}
_WORD_KIND = {w: KINDS[w] for w in RESERVED}
#: Punctuators that need no look at their neighbours.
_PLAIN = {p: KINDS[p] for p in PUNCTUATORS if p not in ("(", ")", "[", "]", "{", "}", "<", "++", "--", "!", ";")}
_CONTEXT = frozenset(CONTEXTUAL)
#: After these words an operand is to come.
_BEFORE_OPERAND = frozenset("break case continue delete do else extends in instanceof new return throw typeof void default await yield const let var export import".split())
_NO_LINE_BREAK = frozenset(("return", "break", "continue", "yield"))
_STATEMENT_PAREN = frozenset(("if", "while", "for", "with"))
_BLOCK_WORDS = frozenset(("else", "try", "finally", "do"))
#: Longer statements are parsed in place.
MEMO_TOKENS, MEMO_ENTRIES = 48, 200_000
_memo: dict[tuple, int] = {}  # token kinds -> dialects


class Broken(Exception):
    """Raised with the offset of a lexical error."""


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar(GRAMMAR, KINDS, list(DIALECTS.values()))


def lex(text: str, dialect: str) -> tuple[list[int], list[bool], list[tuple[int, int]], list[int], int]:
    """(kinds, line break before, spans that look like simple statements, offsets, the dialects whose tokens are the same)."""
    alike = 15  # loses the dialects that would have read some token otherwise
    markup = dialect.endswith("x")
    typed = dialect.startswith("ts")
    kinds: list[int] = []
    words: list[str] = []
    breaks: list[bool] = []
    offsets: list[int] = []
    opens: list[tuple] = []  # (closing text, what it opened, index, extra)
    pairs: dict[int, int] = {}
    spans: list[tuple[int, int]] = []
    names: list[str] = []
    mode: list[str] = []  # markup modes: tag, end tag, children
    operand = False  # whether an operand has just ended
    start = 0  # first token of the current statement
    body_next = False  # a class, interface or enum body comes next
    at = len(text) - len(text.lstrip("﻿")) if text.startswith("﻿") else 0
    if text.startswith("#!", at):
        at = text.find("\n", at) if "\n" in text else len(text)
    n = len(text)
    put_kind, put_word, put_break, put_offset = kinds.append, words.append, breaks.append, offsets.append
    plain, reserved = _PLAIN.get, _WORD_KIND.get

    def put(kind: int, word: str, line_break: bool, where: int) -> None:
        put_kind(kind)
        put_word(word)
        put_break(line_break)
        put_offset(where)

    while True:
        if mode and mode[-1] != "code":
            if mode[-1] == "children":
                m = _TEXT.match(text, at)
                if m is not None:
                    put(_K["JTEXT"], "", False, at)
                    at = m.end()
                if at >= n:
                    raise Broken(at)
                c = text[at]
                if c == "{":
                    opens.append(("}", "markup", len(kinds), None))
                    put(_K["{"], "{", False, at)
                    mode.append("code")
                    operand = False
                    at += 1
                elif c == "<":
                    m = re.compile(rf"<{_BLANK}/").match(text, at)
                    if m is not None:
                        put(_K["JCLOSE"], "", False, at)
                        mode[-1] = "end tag"
                        at = m.end()
                        continue
                    put(_K["JOPEN"], "", False, at)
                    mode.append("tag")
                    names.append("")
                    at += 1
                else:
                    raise Broken(at)
                continue
            m = _TAG.match(text, at)
            if m is None:
                raise Broken(at)
            at = m.end()
            k = m.lastindex
            fresh = kinds[-1] in (_K["JOPEN"], _K["JCLOSE"])
            if k == 1:
                put(_K["JNAME"], m.group(1), False, m.start(1))
                if fresh:
                    if mode[-1] == "tag":
                        names[-1] = m.group(1)
                    elif names[-1] != m.group(1):
                        raise Broken(m.start(1))
            elif k == 2:
                put(_K["JEQ"], "=", False, m.start(2))
            elif k == 3:
                put(_K["JSTR"], "", False, m.start(3))
            elif k == 4:
                put(_K["JSELF"], "", False, m.start(4))
                names.pop()
                mode.pop()
                if not mode or mode[-1] == "code":
                    operand = True
            elif k == 5:
                if mode[-1] == "end tag":
                    if fresh and names[-1]:
                        raise Broken(at)
                    put(_K["JGT"], ">", False, m.start(5))
                    names.pop()
                    mode.pop()
                    if not mode or mode[-1] == "code":
                        operand = True
                else:
                    put(_K["JGT"], ">", False, m.start(5))
                    mode[-1] = "children"
            elif k == 6:
                opens.append(("}", "markup", len(kinds), None))
                put(_K["{"], "{", False, m.start(6))
                mode.append("code")
                operand = False
            else:
                put(_K["JOPEN"], "", False, m.start(7))
                mode.append("tag")
                names.append("")
            continue
        m = (OPERATOR_NEXT if operand else OPERAND_NEXT).match(text, at)
        if m is None:
            rest = re.compile(_BLANK).match(text, at).end()
            if rest >= n:
                break
            raise Broken(rest)
        k = m.lastindex
        where, end = m.span(k)
        line_break = where > at and ("\n" in (blank := text[at:where]) or "\r" in blank or "\u2028" in blank)
        at = end
        token = text[where:end]
        if k == 2:
            kind = reserved(token)
            dotted = kinds and words[-1] in (".", "?.")
            if kind is None:
                kind = 1
                operand = True
                if token not in _SEEN and not _seen(token) and not re.fullmatch(r"(?:[^\\]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})+", token):
                    raise Broken(where)
            elif dotted:
                operand = True
            else:
                operand = token not in _BEFORE_OPERAND
                if token == "class" or token == "enum":
                    body_next = True
            if not dotted and token == "interface":
                alike &= _TYPED if typed else ~_TYPED
            if not dotted and (token == "interface") and typed:
                body_next = _word_follows(text, at) or body_next
            if line_break and words and words[-1] in _NO_LINE_BREAK and not _after_dot(kinds):
                put(_K[";"], ";", False, where)
            put_kind(kind)
            put_word(token)
            put_break(line_break)
            put_offset(where)
            continue
        if k == 3:  # a punctuator that begins no longer one
            k = 6
        elif not operand or k < 6:
            k -= 1
        # 2 word, 3 number, 4 string, 5 regular expression, 6 punctuator, 7 template, 8 private name
        if (k == 6 or k == 5 and token[0] != "/") and (kind := plain(token)) is not None:
            operand = False
            put_kind(kind)
            put_word(token)
            put_break(line_break)
            put_offset(where)
            if line_break and words[-2:-1] and words[-2] in _NO_LINE_BREAK:
                _break_before(kinds, words, breaks, offsets)
            continue
        elif k == 6 or k == 5 and token[0] != "/":
            if token == "(":
                previous = words[-1] if words else ""
                opens.append((")", previous in _STATEMENT_PAREN and not _after_dot(kinds) or previous == "await" and len(words) > 1 and words[-2] == "for", len(kinds), body_next))
                body_next = False
                kind = _PUNCT_KIND[token]
                operand = False
            elif token == "[":
                opens.append(("]", False, len(kinds), body_next))
                body_next = False
                kind = _PUNCT_KIND[token]
                operand = False
            elif token == "{":
                what = "body" if body_next else _brace(kinds, words, operand)
                body_next = False
                opens.append(("}", what, len(kinds), start))
                kind = _PUNCT_KIND[token]
                operand = False
                start = len(kinds) + 1
            elif token == ")" or token == "]":
                if not opens or opens[-1][0] != token:
                    raise Broken(where)
                _, statement, opened, body_next = opens.pop()
                pairs[opened] = len(kinds)
                kind = _PUNCT_KIND[token]
                operand = not statement
            elif token == "}":
                if not opens or opens[-1][0] != "}":
                    raise Broken(where)
                _, what, opened, extra = opens.pop()
                pairs[opened] = len(kinds)
                if what == "template":
                    m = _TEMPLATE.match(text, at)
                    if m is None:
                        raise Broken(where)
                    at = m.end()
                    if m.group(1) == "`":
                        put(_K["TTAIL"], "`", line_break, where)
                        operand = True
                    else:
                        put(_K["TMID"], "", line_break, where)
                        opens.append(("}", "template", len(kinds) - 1, None))
                        operand = False
                    continue
                put(_K["}"], "}", line_break, where)
                if what == "markup":
                    mode.pop()
                    continue
                operand = what == "object"
                start = len(kinds) if what != "object" else extra
                continue
            elif token == "<" and not operand and (alike := alike & _as_markup(text, where, dialect)) and markup and (not typed or not _GENERIC.match(text, where)):
                put(_K["JOPEN"], "<", line_break, where)
                mode.append("tag")
                names.append("")
                continue
            elif token == "++" or token == "--" or token == "!":
                if operand and line_break:
                    put(_K[";"], ";", False, where)
                    line_break = operand = False
                kind = _PUNCT_KIND[token]
                if operand and token == "!":
                    alike &= _TYPED if typed else ~_TYPED
                operand = operand and (token != "!" or typed)
            else:
                kind = _PUNCT_KIND[token]
                operand = False
                if token == ";":
                    put(kind, token, line_break, where)
                    if (not opens or opens[-1][1] in ("block", "body")) and len(kinds) - start <= MEMO_TOKENS:
                        if (not opens or opens[-1][1] == "block") and len(kinds) - start > 1:
                            spans.append((start, len(kinds)))
                    start = len(kinds)
                    continue
        elif k == 7:
            m = _TEMPLATE.match(text, at)
            if m is None:
                raise Broken(where)
            at = m.end()
            if m.group(1) == "`":
                kind = _K["TEMPLATE"]
                operand = True
            else:
                kind = _K["THEAD"]
                opens.append(("}", "template", len(kinds), None))
                operand = False
        else:
            kind = _K[("", "", "", "NUM", "STR", "REGEX", "", "", "PRIVATE")[k]]
            operand = True
        if line_break and words and words[-1] in _NO_LINE_BREAK and not _after_dot(kinds):
            put(_K[";"], ";", False, where)
        put_kind(kind)
        put_word(token if k != 4 else "")
        put_break(line_break)
        put_offset(where)
    if opens or mode:
        raise Broken(n)
    put(0, "", True, n)
    if _contextual(kinds, words, breaks, pairs, typed):
        alike &= _TYPED if typed else ~_TYPED
    return kinds, breaks, spans, offsets, alike


def _as_markup(text: str, at: int, dialect: str) -> int:
    """The dialects that read the ``<`` where an operand is to come as ``dialect`` does."""
    if _GENERIC.match(text, at):
        return _BIT[dialect] if dialect == "jsx" else ~_BIT["jsx"]
    return _MARKUP if dialect.endswith("x") else ~_MARKUP


def _break_before(kinds: list[int], words: list[str], breaks: list[bool], offsets: list[int]) -> None:
    """Ends the statement before the last token, which stands behind a line end that ``return`` and its like do not reach over."""
    if len(kinds) > 2 and kinds[-3] in (_K["."], _K["?."]):
        return
    kinds.insert(-1, _K[";"])
    words.insert(-1, ";")
    breaks.insert(-1, False)
    offsets.insert(-1, offsets[-1])


_SEEN: set[str] = set()  # names without escapes, up to a bound


def _seen(name: str) -> bool:
    if "\\" in name:
        return False
    if len(_SEEN) < MEMO_ENTRIES:
        _SEEN.add(name)
    return True


def _after_dot(kinds: list[int]) -> bool:
    return len(kinds) > 1 and kinds[-2] in (_K["."], _K["?."])


_WORD_NEXT = re.compile(r"\s+[A-Za-z_$]")


def _word_follows(text: str, at: int) -> bool:
    return _WORD_NEXT.match(text, at) is not None


_OBJECT_AFTER = frozenset(KINDS[p] for p in "( [ , = ? : && || ?? | & += -= *= /= ??= ||= &&= + - * % ! ~ < > == === != !== ... return typeof new in instanceof void delete throw default yield await case extends import export".split()) | {KINDS["THEAD"], KINDS["TMID"]}


def _brace(kinds: list[int], words: list[str], operand: bool) -> str:
    """What a brace opens, from the token before it."""
    if not kinds:
        return "block"
    if words[-1] in ("import", "export", "type") or words[-1] == "default" and len(words) > 1 and words[-2] == "export":
        return "object"
    return "object" if kinds[-1] in _OBJECT_AFTER else "block"


_NAME_START = frozenset([KINDS[w] for w in RESERVED] + [KINDS["IDENT"], KINDS["STR"], KINDS["NUM"], KINDS["["], KINDS["PRIVATE"]])
_MODIFIERS = frozenset("static public private protected readonly abstract declare override accessor async".split())
_ENDS_OPERAND = frozenset(KINDS[k] for k in ("IDENT", "NUM", "STR", "TEMPLATE", "TTAIL", "REGEX", ")", "]", "}", "this", "null", "true", "false", "super", "IDARROW"))


_BEFORE_LABEL = frozenset((-1, KINDS[";"], KINDS["{"], KINDS["}"], KINDS[":"]))


def _contextual(kinds: list[int], words: list[str], breaks: list[bool], pairs: dict[int, int], typed: bool) -> bool:
    """Second pass: contextual words and arrow parentheses, from their neighbours."""
    K = _K
    arrow, colon, ident = K["=>"], K[":"], K["IDENT"]
    original = kinds[:]
    decided = False  # whether types or their absence decided something
    for opened, closed in pairs.items():
        if original[opened] == K["("]:
            follow = original[closed + 1]
            if follow == arrow and not breaks[closed + 1]:
                kinds[opened] = K["LPARROW"]
            elif follow == colon:
                decided = True
                if typed:
                    kinds[opened] = K["LPMAYBE"]
    for i, word in enumerate(words):
        kind = original[i]
        if kind == ident:
            follow = original[i + 1]
            previous = original[i - 1] if i else -1
            if previous == K["."] or previous == K["?."]:
                continue
            if follow == arrow:
                kinds[i] = K["IDARROW"]
                if i and words[i - 1] == "async" and original[i - 1] == ident and not breaks[i]:
                    kinds[i - 1] = K["ASYNCARROW"]
                continue
            if word not in _CONTEXT:
                if follow == colon and (previous in _BEFORE_LABEL or breaks[i]):
                    kinds[i] = K["LABEL"]
                continue
            starts_name = follow in _NAME_START
            if word == "async":
                if follow == K["function"] and not breaks[i + 1]:
                    kinds[i] = K["ASYNCFN"]
                elif follow == K["("] and kinds[i + 1] == K["LPARROW"]:
                    kinds[i] = K["ASYNCARROW"]
                elif follow == K["("] and kinds[i + 1] == K["LPMAYBE"]:
                    kinds[i] = K["ASYNCMAYBE"]
                elif follow == K["<"] and previous not in (K["{"], K[","], K[";"]):
                    decided = True
                    if typed:
                        kinds[i] = K["ASYNCARROW"]
                elif (starts_name or follow == K["*"]) and not breaks[i + 1]:
                    kinds[i] = K["MOD"]
            elif word == "get" or word == "set":
                if starts_name and follow not in (K["in"], K["instanceof"]):
                    kinds[i] = K["GETTER"] if word == "get" else K["SETTER"]
            elif word == "static" and follow == K["{"]:
                kinds[i] = K["STATICBLOCK"]
            elif word == "static":
                if starts_name or follow == K["*"]:
                    kinds[i] = K["MOD"]
            elif word == "of":
                if previous in _ENDS_OPERAND:
                    kinds[i] = K["OF"]
            elif word == "from":
                if follow == K["STR"]:
                    kinds[i] = K["FROM"]
            elif word == "as":
                if (previous in _ENDS_OPERAND or previous in (K["*"], K["default"])) and follow not in (K[","], K[")"], K[";"], K["="]) or words[i - 1] == "as" and follow != K["}"]:
                    kinds[i] = K["AS"]
            elif (decided := True) and not typed:
                continue
            elif word in _MODIFIERS:
                if word == "declare" and previous in (K[";"], K["}"], -1, K["export"], K["{"], K[")"]) and follow in (K["const"], K["let"], K["var"], K["function"], K["class"], K["enum"], ident) and not (follow == ident and original[i + 2] in (colon, K["?"], K["="], K["("], K[";"])):
                    kinds[i] = K["DECLARE"]
                elif word == "abstract" and follow in (K["class"], K["new"]):
                    kinds[i] = K["ABSTRACT"]
                elif starts_name or follow == K["{"] or follow == K["*"]:
                    kinds[i] = K["MOD"]
            elif word == "type":
                if (follow == ident or follow in (K["{"], K["*"])) and not breaks[i + 1] and not (follow == ident and words[i + 1] in ("from", "as") and original[i + 2] in (K["STR"], ident)):
                    kinds[i] = K["TYPE"]
            elif word == "interface":
                if follow == ident:
                    kinds[i] = K["INTERFACE"]
            elif word == "namespace" or word == "module":
                if follow in (ident, K["STR"]) and not breaks[i + 1] and (previous in (-1, K[";"], K["}"], K["{"], K["export"]) or words[i - 1] in ("declare", "as") or breaks[i]):
                    kinds[i] = K["NAMESPACE"]
            elif word == "satisfies":
                if previous in _ENDS_OPERAND:
                    kinds[i] = K["SATISFIES"]
            elif word == "is":
                if previous in (ident, K["this"]) and (starts_name or follow in (K["{"], K["("])):
                    kinds[i] = K["IS"]
            elif word in ("keyof", "unique", "infer"):
                if follow in (ident, K["typeof"], K["("], K["this"]) and previous not in _ENDS_OPERAND:
                    kinds[i] = K["TYPEOP"]
            elif word == "asserts":
                if follow in (ident, K["this"]):
                    kinds[i] = K["ASSERTS"]
            elif word == "implements":
                if follow == ident:
                    kinds[i] = K["IMPLEMENTS"]
        elif kind == K["import"]:
            if original[i + 1] in (K["("], K["."]):
                kinds[i] = K["IMPORTEXPR"]
        elif kind == K["const"]:
            if original[i + 1] == K["enum"]:
                kinds[i] = K["CONSTENUM"]
        elif kind == K["with"]:
            if i and original[i - 1] == K["STR"]:
                kinds[i] = K["WITHATTR"]
    return decided


def _reduce(kinds: list[int], breaks: list[bool], spans: list[tuple[int, int]], mask: int) -> tuple[list[int], list[bool], list[int]]:
    """Replaces statements whose kinds are known to form a statement, in all dialects of ``mask``, by one token."""
    out: list[int] = []
    lines: list[bool] = []
    origin: list[int] = []
    at = 0
    for start, end in spans:
        if kinds[end] == _K["else"]:
            continue  # the end of a branch, not of the statement
        part = tuple(kinds[start:end])
        good = _memo.get(part)
        if good is None:
            if len(_memo) >= MEMO_ENTRIES:
                _memo.clear()
            good = _memo[part] = grammar().accepts("StatementOnly", [*part, 0], mask=15)[0]
        if good & mask == mask:
            out += kinds[at:start]
            lines += breaks[at:start]
            origin += range(at, start)
            out.append(_K["STATEMENT"])
            lines.append(breaks[start])
            origin.append(start)
            at = end
    out += kinds[at:]
    lines += breaks[at:]
    origin += range(at, len(kinds))
    return out, lines, origin


def read(text: str, dialect: str, *, all_of_them: bool = False) -> tuple[list[str], int, int | None]:
    """(dialects that accept ``text``, bits of those that were asked, offset of the first token that no reading in ``dialect`` gets past).

    Asked are all dialects that read the same tokens as ``dialect``, in one pass;
    once ``dialect`` itself accepts, the others are left undecided unless ``all_of_them`` are wanted.
    """
    own = _BIT[dialect]
    try:
        kinds, breaks, spans, offsets, alike = lex(text, dialect)
    except Broken as broken:
        return [], own, broken.args[0] if broken.args else 0
    short, lines, origin = _reduce(kinds, breaks, spans, alike)
    good, furthest = grammar().accepts("Program", short, lines.__getitem__, mask=alike, wanted=alike if all_of_them else own)
    return [d for d, bit in _BIT.items() if good & bit], alike, None if good & own else offsets[origin[furthest]]


def accepted_by(text: str, dialect: str) -> tuple[list[str], int | None]:
    """(``dialect`` and those found with it, or, if it refuses ``text``, all that accept it; offset as in ``read``)."""
    good, asked, offset = read(text, dialect)
    return good if offset is None else good + accepting(text, asked), offset


def accepting(text: str, asked: int = 0) -> list[str]:
    """All dialects that accept ``text``, without those ``asked`` already."""
    out: list[str] = []
    for dialect, bit in _BIT.items():
        if not asked & bit:
            good, group, _ = read(text, dialect, all_of_them=True)
            out += [d for d in good if not asked & _BIT[d]]
            asked |= group
    return out


def parses(text: str, dialect: str) -> bool:
    """Whether ``text`` is a module in ``dialect`` (js, jsx, ts or tsx)."""
    return read(text, dialect)[2] is None


def error_offset(text: str, dialect: str) -> int | None:
    """Offset of the first token that no reading of ``text`` gets past; None if it parses."""
    return read(text, dialect)[2]
