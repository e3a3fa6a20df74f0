"""Token kinds of source texts. A lexer gives one or several readings of a text, each a list of kinds that ends with EOF; a
text that can't be cut into tokens gives none. Conditional directives are kinds that begin with a control character."""

from __future__ import annotations

import re
from collections.abc import Iterator

BAD = "BAD"
_SKIP = "SKIP"


class Lexer:
    """A regular expression whose single group is a token, and a rule that gives a token's kind; kinds are remembered."""

    MOST = 200_000

    def __init__(self, pattern: str, words: dict[str, str], number: str, operators: dict[str, str], quotes) -> None:
        self.find = re.compile(pattern, re.S | re.M).findall
        self.words, self.operators, self.quotes = words, operators, quotes
        self.number = re.compile(number).fullmatch
        self.known: dict[str, str] = {}

    def kind(self, token: str) -> str:
        if len(self.known) > self.MOST:
            self.known.clear()
        kind = self.known[token] = self._kind(token)
        return kind

    def _kind(self, token: str) -> str:
        c = token[0]
        if (k := self.words.get(token)) is not None:
            return k
        if (k := self.operators.get(token)) is not None:
            return k
        if (k := self.quotes(token)) is not None:
            return k
        if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
            return "NUM" if self.number(token) else BAD
        if c.isalpha() or c in "_$" or ord(c) > 127 and c.isidentifier():
            return "ID"
        return BAD

    def kinds(self, text: str) -> list[str]:
        known, kind = self.known, self.kind
        return [k for k in [known.get(t) or kind(t) for t in self.find(text)] if k != _SKIP]


def _ops(**kinds: str) -> dict[str, str]:
    out = {}
    for kind, ops in kinds.items():
        out |= dict.fromkeys(ops.split(), kind)
    return out


def _self(*tokens: str) -> dict[str, str]:
    return {t: t for x in tokens for t in x.split()}


_WORD = r"[^\W\d]\w*"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
_DQ = r'"(?:[^"\\\n]|\\.)*"'
_SQ = r"'(?:[^'\\\n]|\\.)*'"

# ---------------------------------------------------------------- C and C++

# Keywords, types and operators of the language, by kind.
_C_NUM = r"(?:0[xX][\da-fA-F']*\.?[\da-fA-F']*(?:[pP][+-]?\d+)?|0[bB][01']+|\d[\d']*\.?[\d']*(?:[eE][+-]?\d+)?|\.\d[\d']*(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]|i)*(?:_\w+)?"
_C_STR = rf"(?:u8|[uUL])?{_DQ}"
_C_CHR = rf"(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'"
_C_OPS = r"<<=|>>=|\.\.\.|->\*?|\+\+|--|&&|\|\||<<|[-+*/%&|^=!<>]=|::|[-+*/%&|^=!<>~?:;,.(){}\[\]]"
_C_BASE = "void char short int long float double signed unsigned bool _Bool _Complex _Imaginary __int128 _Float128 _Decimal64 wchar_t"
_C_QUAL = "const volatile restrict __restrict __restrict__ register auto static extern typedef inline __inline __inline__ _Noreturn _Thread_local __thread thread_local _Atomic __extension__ __const __volatile__ volatile__ constexpr"
_C_WORDS = (
    _ops(BASE=_C_BASE, QUAL=_C_QUAL, STRUCT="struct union", ATTR="__attribute__ __attribute __declspec", TYPEOF="typeof __typeof__ __typeof", ALIGNOF="_Alignof alignof __alignof__", GENERIC="_Generic", OFFSETOF="__builtin_offsetof")
    | _self("if else while do for switch case default break continue return goto sizeof enum")
    | {"asm": "asm", "__asm__": "asm", "_Static_assert": "static_assert", "static_assert": "static_assert"}
    | {"static": "static"}
)
_C_OPERATORS = _ops(BINOP="/ % << <= >= == != ^ | || ", ASSIGN="+= -= *= /= %= &= |= ^= <<= >>=", SIGN="+ -", NOT="! ~", INC="++ --") | _self("... -> && :: < > = * & ? : ; , . ( ) { } [ ]")


def _c_quotes(token: str) -> str | None:
    if token.startswith(("/*", "//")):
        return _SKIP if token[1] == "/" or token.endswith("*/") and len(token) > 3 else BAD
    if token[-1] == '"' and len(token) > 1:
        return "STR"
    if token[-1] == "'" and len(token) > 2:
        return "CHAR"
    if token[0] == "\x01":
        return token
    return None


_C_PATTERN = rf"""\s*((?:u8|[uUL])?R"([^()\\\s]{{0,16}})\(.*?\)\2"|{_BLOCK}|//[^\n]*(?:(?<=\\)\n[^\n]*)*|{_C_STR}|{_C_CHR}|\.?\d(?:[eEpP][+-]|'?\w|\.)*|{_WORD}|\x01\w+|{_C_OPS}|/\*|\S)"""


class _CLexer(Lexer):
    def kinds(self, text: str) -> list[str]:
        known, kind = self.known, self.kind
        return [k for k in [known.get(t) or kind(t) for t, _ in self.find(text)] if k != _SKIP]


_C = _CLexer(_C_PATTERN.replace(r"""(?:u8|[uUL])?R"([^()\\\s]{0,16})\(.*?\)\2"|""", r"(?!)(x)|"), _C_WORDS, _C_NUM, _C_OPERATORS, _c_quotes)
_CPP_WORDS = (
    {k: v for k, v in _C_WORDS.items() if k not in ("restrict", "auto", "inline", "extern", "_Noreturn", "static")}
    | _ops(BASE="char8_t char16_t char32_t", QUAL="static mutable constinit consteval", ACCESS="public private protected", LIT="true false nullptr", CASTOP="static_cast dynamic_cast reinterpret_cast const_cast", WORDOP="and or xor bitand bitor not_eq and_eq or_eq xor_eq", CO="co_await co_yield", ENUMCLASS="")
    | _self("class template typename namespace using operator new delete try catch throw virtual explicit friend inline extern auto decltype noexcept typeid co_return requires alignas this default")
    | {"not": "NOT", "compl": "NOT", "this": "LIT"}
)
_CPP = _CLexer(_C_PATTERN.replace("|<<=|", "|<=>|<<=|"), _CPP_WORDS, _C_NUM, _C_OPERATORS | {"<=>": "BINOP", "->*": "MEMBERPTR", ".*": "MEMBERPTR", "~": "~"}, _c_quotes)
_DIRECTIVE = re.compile(rf"({_BLOCK}|//[^\n]*|{_DQ}|{_C_CHR})|^[ \t]*#[ \t]*(\w*)(?:[^\n\\/]|\\.|/(?!\*)|{_BLOCK})*", re.S | re.M)


def _directives(text: str) -> str:
    def put(m: re.Match) -> str:
        if m[1]:
            return m[1]
        word = m[2]
        return f"\n\x01{'if' if word.startswith('if') else 'elif' if word.startswith('eli') else word if word in ('else', 'endif') else 'line'}\n"

    return _DIRECTIVE.sub(put, text)


def _range_for(kinds: list[str]) -> list[str]:
    """``for`` becomes RANGEFOR where a colon comes before a semicolon in its parentheses."""
    out = kinds[:]
    for i, k in enumerate(kinds):
        if k == "for":
            depth = 0
            for j in range(i + 1, len(kinds)):
                c = kinds[j]
                if c in ("(", "[", "{"):
                    depth += 1
                elif c in (")", "]", "}"):
                    depth -= 1
                    if depth <= 0:
                        break
                elif c == ";" and depth == 1:
                    break
                elif c == ":" and depth == 1:
                    out[i] = "RANGEFOR"
                    break
                elif c == "?":
                    break
    return out


def c(text: str) -> list[list[str]]:
    kinds = _C.kinds(_directives(text) if "#" in text else text)
    if BAD in kinds:
        return []
    kinds.append("EOF")
    return [kinds]


def cpp(text: str) -> list[list[str]]:
    kinds = _CPP.kinds(_directives(text) if "#" in text else text)
    if BAD in kinds:
        return []
    kinds.append("EOF")
    if "for" in kinds:
        kinds = _range_for(kinds)
    if "if" in kinds:
        kinds = [("IFMOD" if i and kinds[i - 1] == "if" and k == "QUAL" else k) for i, k in enumerate(kinds)]
    if "enum" in kinds:
        kinds = [("ENUMCLASS" if i and kinds[i - 1] == "enum" and k in ("class", "STRUCT") else k) for i, k in enumerate(kinds)]
    return [kinds]


# ---------------------------------------------------------------- Java

# Keywords, types and operators of the language, by kind.
_JAVA_WORDS = (
    _ops(PRIM="int long double float boolean char byte short", MOD="public private protected abstract native strictfp transient volatile sealed non-sealed", LIT="true false null")
    | _self("static final synchronized default void throws if else while do for break continue return throw try catch finally switch case new class interface enum extends implements this super instanceof assert package import record var yield permits when")
)
_JAVA_WORDS["sealed"] = "sealed"
_JAVA_OPERATORS = _ops(BINOP="/ % << <= >= == != ^ && ||", ASSIGN="+= -= *= /= %= &= |= ^= <<= >>= >>>=", SIGN="+ -", NOT="! ~", INC="++ --") | _self(":: -> ... < > = * & | ? : ; , . ( ) { } [ ] @")


def _java_quotes(token: str) -> str | None:
    if token.startswith(("/*", "//")):
        return _SKIP if token[1] == "/" or token.endswith("*/") and len(token) > 3 else BAD
    if token[0] == '"':
        return "STR" if len(token) > 1 and token[-1] == '"' else BAD
    if token[0] == "'":
        return "CHAR" if len(token) > 2 and token[-1] == "'" else BAD
    return None


_JAVA = Lexer(
    rf"""\s*(\"\"\"[ \t]*\r?\n(?:[^"\\]|\\.|"(?!""))*\"\"\"|{_BLOCK}|//[^\n]*|{_DQ}|'(?:[^'\\\n]|\\u+[\da-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)'|\.?\d(?:[eEpP][+-](?=\d)|\w|\.(?!\.))*|non-sealed\b|[^\W\d$][\w$]*|\$[\w$]*|>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||<<|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~?:;,.(){{}}\[\]@]|/\*|\S)""",
    _JAVA_WORDS,
    r"(?:0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?",
    _JAVA_OPERATORS,
    _java_quotes,
)


def java(text: str) -> list[list[str]]:
    kinds = _JAVA.kinds(text)
    return [] if BAD in kinds else [[*kinds, "EOF"]]


# ---------------------------------------------------------------- Go

# Keywords, types and operators of the language, by kind.
_GO_WORDS = _self("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
_GO_OPERATORS = _ops(BINOP="/ % << >> <= >= == != < > && || & &^", ASSIGN="+= -= *= /= %= &= |= ^= <<= >>= &^=", SIGN="+ -", NOT="!", INC="++ --", CHANOP="<-") | _self("... := = * | ~ : ; , . ( ) { } [ ]") | {"&": "SIGN", "^": "SIGN"}
_GO_ENDS = frozenset({"ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "INC", ")", "]", "}"})


def _go_quotes(token: str) -> str | None:
    c = token[0]
    if token.startswith("//"):
        return _SKIP
    if token.startswith("/*"):
        return ("LINE" if "\n" in token else _SKIP) if token.endswith("*/") and len(token) > 3 else BAD
    if c == "\n":
        return "LINE"
    if c in '"`':
        return "STR" if len(token) > 1 and token[-1] == c else BAD
    if c == "'":
        return "CHAR" if len(token) > 2 and token[-1] == c else BAD
    return None


_GO = Lexer(
    rf"""[ \t\r\f]*(\n|{_BLOCK}|//[^\n]*|{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[abfnrtv\\']|\\[0-7]{{3}}|\\x[\da-fA-F]{{2}}|\\u[\da-fA-F]{{4}}|\\U[\da-fA-F]{{8}})'|\.?\d(?:[eEpP][+-]|\w|\.)*|{_WORD}|<<=|>>=|&\^=|\.\.\.|&\^|<-|:=|\+\+|--|&&|\|\||<<|>>|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~:;,.(){{}}\[\]]|/\*|\S)""",
    _GO_WORDS,
    r"(?:0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?",
    _GO_OPERATORS,
    _go_quotes,
)


def go(text: str) -> list[list[str]]:
    out, last = [], ""
    for k in _GO.kinds(text):
        if k == "LINE":
            if last in _GO_ENDS:
                out.append(";")
                last = ";"
        else:
            out.append(k)
            last = k
    if BAD in out:
        return []
    if last in _GO_ENDS:
        out.append(";")
    out.append("EOF")
    return [out]


# ---------------------------------------------------------------- JavaScript

# Keywords, types and operators of the language, by kind.
_JS_WORDS = (
    _ops(UNARYWORD="typeof void delete", LITERALWORD="null true false", KEYWORD="enum")
    | _self("let of get set async static from as await yield function return if else for while do switch case default break continue throw try catch finally var const new in instanceof class extends import export this super debugger with")
)
_JS_OPERATORS = _ops(BINOP="% ** << >> >>> <= >= == != === !== < > && || ?? & | ^", ASSIGN="+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=", UNARY="! ~", INC="++ --") | {"/": "SLASH"} | _self("=> ?. ... + - * = ? : ; , . ( ) { } [ ]")
_JS_VALUE_ENDS = frozenset({"ID", "NUM", "STR", "REGEX", "TPL", "TPLTAIL", "LITERALWORD", "this", "super", ")", "]", "}", "let", "of", "get", "set", "async", "static", "from", "as", "INC", "PRIVATE"})
_JS_ENDS = _JS_VALUE_ENDS | {"break", "continue", "return", "debugger", "yield", "await"}
_JS_STARTS = frozenset(set(_JS_WORDS.values()) - {"in", "instanceof", "catch", "finally"} | {"ID", "NUM", "STR", "UNARY", "INC", "PRIVATE", "{"})
_JS_TOKEN = re.compile(
    rf"""[ \t\r\f\v\u00a0\ufeff]*(\n|{_BLOCK}|//[^\n]*|{_DQ}|{_SQ}|`|\.?\d(?:[eE][+-](?=\d)|\w|\.)*|[^\W\d$][\w$]*|\$[\w$]*|\#[^\W\d]\w*|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|>>|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~?:;,.(){{}}\[\]]|/\*|\S|\Z)""",
    re.S,
)
_JS_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_JS_NUM = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO]?[0-7_]+n?|(?:\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?")


def _js_kind(t: str) -> str:
    c = t[0]
    if c.isalpha() or c in "_$" or ord(c) > 127 and t.isidentifier():
        return _JS_WORDS.get(t, "ID")
    if (k := _JS_OPERATORS.get(t)) is not None:
        return k
    if c in "\"'":
        return "STR" if len(t) > 1 and t[-1] == c else BAD
    if c.isdigit() or c == ".":
        return "NUM" if _JS_NUM.fullmatch(t) else BAD
    if c == "#" and len(t) > 1:
        return "PRIVATE"
    return BAD


def javascript(text: str) -> list[list[str]]:
    out: list[str] = []
    at, line, last, braces = 0, False, "", []  # braces: "{" or "`" for what a closing brace ends
    known: dict[str, str] = {}
    size = len(text)
    while at < size:
        m = _JS_TOKEN.match(text, at)
        t = m[1]
        at = m.end()
        if t == "\n":
            line = True
            continue
        if not t:
            break
        if t[0] == "/" and len(t) > 1 and t[1] in "/*":
            if t == "/*":
                return []
            line = line or "\n" in t
            continue
        if t[0] == "/" and last not in _JS_VALUE_ENDS:
            m = _JS_REGEX.match(text, at - len(t))
            if not m:
                return []
            at, k = m.end(), "REGEX"
        elif t == "`" or t == "}" and braces and braces[-1] == "`":
            m = _JS_TEMPLATE.match(text, at)
            if not m:
                return []
            at = m.end()
            whole = m[1] == "`"
            if t == "`":
                k = "TPL" if whole else "TPLHEAD"
                if not whole:
                    braces.append("`")
            else:
                k = "TPLTAIL" if whole else "TPLMID"
                if whole:
                    braces.pop()
        else:
            k = known.get(t)
            if k is None:
                k = known[t] = _js_kind(t)
            if k == BAD:
                return []
            if k == "{":
                braces.append("{")
            elif k == "}":
                if braces:
                    braces.pop()
        if (line and last in _JS_ENDS and (k in _JS_STARTS or k == "REGEX")) or (k == "}" and last in _JS_ENDS) or (line and last in ("return", "break", "continue", "throw") and k != "}" and k != ";"):
            if not (line and last == ")" and k == "{") :
                out.append("NL")
        out.append(k)
        line, last = False, k
    if last in _JS_ENDS:
        out.append("NL")
    out.append("EOF")
    return [out]


# ---------------------------------------------------------------- PHP

# Keywords, types and operators of the language, by kind.
_PHP_WORDS = (
    _ops(MOD="public private protected var", LIT="true false null", INCLUDE="", WORDOP="and or xor")
    | _self("function fn static abstract final class new use as if else elseif while do for foreach switch case default match return echo print global try catch finally throw const interface trait enum extends implements instanceof namespace break continue isset empty unset list array clone yield from goto exit declare readonly endif endwhile endfor endforeach endswitch")
    | {"die": "exit", "include": "include", "include_once": "include", "require": "include", "require_once": "include"}
    | _ops(CASTID="int integer bool boolean float double string object callable iterable mixed void never self parent")
)
_PHP_OPERATORS = _ops(BINOP="/ % * ** . << >> <= >= == != === !== <> <=> < > && || ?? ^ |>", ASSIGN="+= -= *= **= /= .= %= &= |= ^= <<= >>= ??=", SIGN="+ -", UNARY="! ~ @", INC="++ --", ATTR="#[", DOLLAR="$") | _self("=> -> :: ... = & | ? : ; , ( ) { } [ ]") | {"?->": "->", "<?php": "OPEN", "<?=": "OPEN", "?>": "CLOSE"}


def _php_quotes(token: str) -> str | None:
    c = token[0]
    if token.startswith("<<<") and len(token) > 6:
        return "HEREDOC"
    if token.startswith("#["):
        return "ATTR"
    if c == "#" or token.startswith("//"):
        return _SKIP
    if token.startswith("/*"):
        return _SKIP if token.endswith("*/") and len(token) > 3 else BAD
    if c in "\"'`":
        return "STR" if len(token) > 1 and token[-1] == c else BAD
    if c == "$" and len(token) > 1:
        return "VAR"
    if c == "\\" and len(token) > 1:
        return "NSNAME"
    if c == "(":
        return "CAST"
    if "\\" in token and (c.isalpha() or c == "_"):
        return "NSNAME"
    return None


class _PhpLexer(Lexer):
    def _kind(self, token: str) -> str:
        if (k := self.words.get(token.lower())) is not None:
            return k
        return super()._kind(token)

    def kinds(self, text: str) -> list[str]:
        known, kind = self.known, self.kind
        return [k for k in [known.get(t) or kind(t) for t, *_ in self.find(text)] if k != _SKIP]


_PHP = _PhpLexer(
    r"""\s*(<<<[ \t]*(["']?)([A-Za-z_]\w*)\2\r?\n(?:.*?\n)??[ \t]*\3\b|"""
    + _BLOCK
    + r"""|//(?:(?!\?>)[^\n])*|\#(?!\[)(?:(?!\?>)[^\n])*|\#\[|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|<\?php|<\?=|\?>|\$[A-Za-z_\x80-\U0010ffff]\w*|\.?\d(?:[eE][+-](?=\d)|\w|\.(?=\d))*|\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*|\([ \t]*(?i:int|integer|bool|boolean|float|double|string|array|object|unset|binary)[ \t]*\)|<=>|\*\*=|\.\.\.|===|!==|<<=|>>=|\?\?=|\?->|->|=>|::|\+\+|--|&&|\|\||\?\?|\*\*|<<|>>|<>|[-+*/%.&|^=!<>]=|[-+*/%.&|^=!<>~?:;,(){}\[\]@$]|/\*|\S)""",
    _PHP_WORDS,
    r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|(?:\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)",
    _PHP_OPERATORS,
    _php_quotes,
)


#: From a closing tag to the next opening one; the first ends a statement, ``<?=`` begins an echo.
_PHP_OUTSIDE = re.compile(r"\?>(?:(?!<\?(?:php\b|=)).)*(?:<\?(php\b|=)|\Z)", re.S)


def php(text: str) -> list[list[str]]:
    if "?>" in text:
        text = _PHP_OUTSIDE.sub(lambda m: "; echo " if m[1] == "=" else "; ", text)
    kinds = _PHP.kinds(text)
    return [] if BAD in kinds else [[*kinds, "EOF"]]


# ---------------------------------------------------------------- Python

# Keywords, types and operators of the language, by kind.
_PY_WORDS = _self("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _")
_PY_OPERATORS = _ops(BINOP="% // << >> & ^ < > <= >= == !=", AUG="+= -= *= /= //= %= @= &= |= ^= >>= <<= **=", SIGN="+ -") | {"/": "SLASH"} | _self("~ | * ** @ -> := = ... . , : ; ( ) [ ] { }")
_PY_PREFIX = r"(?:[rR]?[bB]|[bB][rR]|[rR]?[fF]|[fF][rR]|[rR]|[uU])?"
_PY = re.compile(
    rf"""[ \t\f]*(\r?\n|\r|\\\r?\n|\#[^\n]*|{_PY_PREFIX}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|{_WORD}|\.?\d(?:[eE][+-](?=\d)|\w|\.)*|\*\*=?|//=?|>>=?|<<=?|->|:=|!=|\.\.\.|[<>=+\-*/%&|^@]=?|[~.,;:()\[\]{{}}]|[^ \t\f]|\Z)""",
    re.S,
)
_PY_HEAD = re.compile(r"(?:def|async|class)\b|@")
_PY_INDENT = re.compile(r"[ \t\f]*")
_PY_NUM = re.compile(r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?")


def _py_kind(t: str) -> str:
    c = t[0]
    if t[-1] in "\"'":
        return "STR" if len(t) > 1 else BAD
    if (k := _PY_WORDS.get(t) or _PY_OPERATORS.get(t)) is not None:
        return k
    if c.isdigit() or c == ".":
        return "NUM" if _PY_NUM.fullmatch(t) and not re.fullmatch(r"0\d*[1-9]\d*", t) else BAD
    return "ID" if t.isidentifier() else BAD


_py_known: dict[str, str] = {}


_PY_F = re.compile(r"(?:[rR]?[fF]|[fF][rR])(\"\"\"|'''|\"|')")
_PY_STRING = re.compile(rf"""{_PY_PREFIX}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""", re.S)


def _f_string_end(text: str, at: int, quote: str) -> int:
    """Where a formatted string ends whose fields may hold strings with the same quotes; -1 if it doesn't. ``at`` is behind its opening quote."""
    open_: list[str] = [quote]  # the quote of the string one is in, or a bracket
    while at < len(text):
        c, top = text[at], open_[-1]
        if top[0] in "\"'":
            if c == "\\":
                at += 2
            elif text.startswith(top, at):
                at += len(top)
                open_.pop()
                if not open_:
                    return at
            elif c == "\n" and len(top) == 1:
                return -1
            elif text.startswith(("{{", "}}"), at):
                at += 2
            else:
                if c == "{":
                    open_.append(c)
                at += 1
        elif m := _PY_F.match(text, at):
            open_.append(m[1])
            at = m.end()
        elif c in "\"'" and (m := _PY_STRING.match(text, at)):
            at = m.end()
        elif top == "{" and c == ":":  # a format, which may hold fields
            depth = 0
            at += 1
            while at < len(text) and (text[at] != "}" or depth):
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            if c in "([{":
                open_.append(c)
            elif c in ")]}":
                open_.pop()
            at += 1
    return -1


def python(text: str) -> Iterator[list[str]]:
    """Strings that end at the first quote of their own; then, if there are formatted ones, their fields read as code."""
    yield from _python(text, False)
    if _PY_F.search(text):
        yield from _python(text, True)


def _python(text: str, fields: bool) -> list[list[str]]:
    """Kinds with NEWLINE, INDENT and DEDENT; the first line's indentation is that of the whole text."""
    out: list[str] = []
    depth, fresh = 0, True
    indents: list[str] = []
    at, size = 0, len(text)
    if len(_py_known) > Lexer.MOST:
        _py_known.clear()
    if text.startswith("\ufeff"):
        at = 1
    while at < size:
        if fresh and depth == 0:
            m = _PY_INDENT.match(text, at)
            indent, end = m[0], m.end()
            if end >= size:
                break
            if text[end] in "#\r\n":
                at = text.find("\n", end) + 1
                if not at:
                    break
                continue
            indent = indent.rpartition("\f")[2]
            if not indents:
                if indent and not _PY_HEAD.match(text, end):  # the body of a function without its head
                    return []
                indents.append(indent)
            elif indent != indents[-1]:
                if indent.startswith(indents[-1]):
                    indents.append(indent)
                    out.append("INDENT")
                else:
                    while len(indents) > 1 and indents[-1] != indent:
                        indents.pop()
                        out.append("DEDENT")
                    if indents[-1] != indent:
                        return []
            fresh, at = False, end
        if fields and (m := _PY_F.match(text, _PY_INDENT.match(text, at).end())):
            at = _f_string_end(text, m.end(), m[1])
            if at < 0:
                return []
            out.append("STR")
            continue
        m = _PY.match(text, at)
        t, at = m[1], m.end()
        if not t:
            break
        c = t[0]
        if c in "\r\n":
            if depth == 0:
                out.append("NEWLINE")
                fresh = True
            continue
        if c == "#" or c == "\\" and len(t) > 1:
            continue
        k = _py_known.get(t)
        if k is None:
            k = _py_known[t] = _py_kind(t)
        if k in ("(", "[", "{"):
            depth += 1
        elif k in (")", "]", "}"):
            depth -= 1
            if depth < 0:
                return []
        elif k == BAD:
            return []
        out.append(k)
    if depth:
        return []
    if out and out[-1] != "NEWLINE" and not fresh:
        out.append("NEWLINE")
    if "return" in out and "def" not in out:
        return []
    out += ["DEDENT"] * (len(indents) - 1)
    out.append("EOF")
    return [out]


#: Extensions and the language that each claims.
LANGUAGES = {"c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "java": "java", "py": "python", "js": "javascript", "mjs": "javascript", "go": "go", "php": "php"}
