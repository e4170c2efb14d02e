"""A reader of TypeScript and JavaScript source texts: tokens with JSX, and what modules, functions and components they hold.

It is no compiler: brackets, strings, templates, comments, patterns and JSX are told apart exactly, statements and types
as far as the facts below need. Broken text is read as far as it goes; nothing raises.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import cached_property

WORD, NUMBER, STRING, TEMPLATE, PATTERN, MARK, TAG, TEXT = range(8)

#: Hooks that are known by name, where their list of dependencies stands, and those that have none.
HOOKS = frozenset(
    "use useState useEffect useContext useReducer useCallback useMemo useRef useLayoutEffect useInsertionEffect useImperativeHandle useDebugValue useDeferredValue useTransition useId"
    " useSyncExternalStore useOptimistic useActionState useFormStatus".split()
)
DEPENDENCY_AT = {"useEffect": 1, "useLayoutEffect": 1, "useInsertionEffect": 1, "useMemo": 1, "useCallback": 1, "useImperativeHandle": 2}
WITHOUT_DEPENDENCIES = frozenset(
    "use useState useRef useContext useReducer useId useTransition useDeferredValue useDebugValue useSyncExternalStore useOptimistic useActionState useFormStatus".split()
)
COMPONENT_TYPES = frozenset("FC FunctionComponent VFC VoidFunctionComponent ComponentType".split())
COMPONENT_BASES = frozenset(("Component", "PureComponent"))
LIST_METHODS = frozenset(("map", "filter", "reduce", "forEach"))
TEXT_ATTRIBUTES = frozenset("placeholder title alt aria-label aria-description aria-placeholder label description helpertext emptytext".split())

_SPACE = re.compile(r"[\s﻿]+")
_WORD = re.compile(r"#?[^\W\d][\w$]*|\$[\w$]*|[_$][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*(?:[eE][+-]?\d+)?n?|\.\d[\w]*")
_MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\?\?|&&|\|\||==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
#: White space and a word, a number, a mark or a plain string (their kinds are the groups' numbers), of what needs no look at what stands before.
_TOKEN = re.compile(rf"[\s\ufeff]*+(?:({_WORD.pattern})|({_NUMBER.pattern})|((?![/<])(?:{_MARK.pattern}))|(\"[^\"\\\n]*\"|'[^'\\\n]*'))")
_KINDS = (None, WORD, NUMBER, MARK, STRING)
_PATTERN = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TAG_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$:.-]*")
_NO_VALUE_BEFORE = frozenset(")]}")
_VALUE_WORDS = frozenset("this super null true false undefined".split())
_EXPRESSION_WORDS = frozenset("return typeof case delete void in of instanceof new throw else do yield await default extends".split())
_BRANCHING = frozenset("if for while do switch case try".split())
_CONTROL = frozenset("if for while switch catch with".split())


@dataclass(slots=True)
class Token:
    kind: int
    text: str
    at: int
    end: int
    line: int = 0
    pair: int = -1  #: number of the matching bracket


def _value_ends(tokens: list[Token]) -> bool:
    """Whether a value ends before the next token, so that < and / are operators."""
    if not tokens:
        return False
    t = tokens[-1]
    if t.kind == WORD:
        return t.text not in _EXPRESSION_WORDS
    if t.kind == MARK:
        return t.text in _NO_VALUE_BEFORE or t.text in ("++", "--")
    return t.kind != TAG or t.text.startswith(("</", "/>"))


def _ends_value(tokens: list[Token], i: int) -> bool:
    """Whether a value ends before token i."""
    return i > 0 and _value_ends(tokens[i - 1 : i])


class Reader:
    def __init__(self, code: str, jsx: bool = True) -> None:
        self.code, self.jsx, self.tokens = code, jsx, []
        self.n, self.at = len(code), 0
        self.comments: list[tuple[int, str]] = []

    def add(self, kind: int, end: int, text: str | None = None) -> None:
        self.tokens.append(Token(kind, self.code[self.at : end] if text is None else text, self.at, end))
        self.at = end

    def read(self) -> list[Token]:
        self._plain(None)
        line, after = 1, self.code.find("\n") + 1  # where the next line begins, 0 for none
        stack = []
        for i, t in enumerate(self.tokens):
            while after and after <= t.at:
                line, after = line + 1, self.code.find("\n", after) + 1
            t.line = line
            if t.kind == MARK:
                if t.text in "([{":
                    stack.append(i)
                elif t.text in ")]}":
                    opener = {")": "(", "]": "[", "}": "{"}[t.text]
                    while stack and self.tokens[stack[-1]].text != opener:
                        stack.pop()
                    if stack:
                        t.pair = stack.pop()
                        self.tokens[t.pair].pair = i
        return self.tokens

    def _plain(self, until: str | None) -> None:
        """Code up to the bracket that closes the current one (until), which is read too, or to the end."""
        code, depth = self.code, 0
        add, match, end = self.tokens.append, _TOKEN.match, self.at
        while self.at < self.n:
            while m := match(code, end):
                nth, end = m.lastindex, m.end()
                text = m[nth]
                add(Token(_KINDS[nth], text if nth != 4 else text[1:-1], end - len(text), end))
                if until and (text == "{" or text == "}"):
                    depth += 1 if text == "{" else -1
                    if depth < 0:
                        self.at = end
                        return
            self.at = end
            if end < self.n:
                self._rare(code)
                end = self.at

    def _rare(self, code: str) -> None:
        """What is no plain token: white space before it or at the end, comments, strings cut or with escapes, templates, patterns, elements, < and /."""
        if m := _SPACE.match(code, self.at):
            self.at = m.end()
            return
        c = code[self.at]
        if c == "/" and code.startswith("//", self.at):
            end = code.find("\n", self.at)
            end = self.n if end < 0 else end
            self.comments.append((self.at, code[self.at : end]))
            self.at = end
        elif c == "/" and code.startswith("/*", self.at):
            end = code.find("*/", self.at + 2)
            end = self.n if end < 0 else end + 2
            self.comments.append((self.at, code[self.at : end]))
            self.at = end
        elif c in "\"'":
            self._string(c)
        elif c == "`":
            self._template()
        elif c == "/" and not _value_ends(self.tokens) and (m := _PATTERN.match(code, self.at)):
            self.add(PATTERN, m.end())
        elif c == "<" and self.jsx and not _value_ends(self.tokens) and self._starts_element():
            self._element()
        elif m := _MARK.match(code, self.at):
            self.add(MARK, m.end())
        else:
            self.at += 1

    def _string(self, quote: str) -> None:
        end = self.at + 1
        while end < self.n and self.code[end] not in (quote, "\n"):
            end += 2 if self.code[end] == "\\" else 1
        end = min(end, self.n)
        self.add(STRING, min(end + 1, self.n), self.code[self.at + 1 : end])

    def _template(self) -> None:
        """A template: its text parts are one token each, what it embeds is code between marks ${ and }."""
        self.at += 1
        begin, first = self.at, True
        while self.at < self.n:
            c = self.code[self.at]
            if c == "\\":
                self.at += 2
            elif c == "`":
                end, self.at = self.at, begin
                self.tokens.append(Token(TEMPLATE if not first else STRING, self.code[begin:end], begin - 1, end + 1))
                self.at = end + 1
                return
            elif c == "$" and self.code.startswith("${", self.at):
                first = False
                self.tokens.append(Token(TEMPLATE, self.code[begin : self.at], begin - 1, self.at))
                self.tokens.append(Token(MARK, "{", self.at, self.at + 2))
                self.at += 2
                self._plain("}")
                begin = self.at
            else:
                self.at += 1

    def _starts_element(self) -> bool:
        rest = self.code[self.at + 1 : self.at + 80]
        if rest.startswith(">"):
            return True
        m = _TAG_NAME.match(rest)
        if not m:
            return False
        after = rest[m.end() :].lstrip()
        return not (after.startswith(",") or re.match(r"extends\b", after))

    def _element(self) -> None:
        """An element with its children. Tags are TAG tokens (<name, </name, />, >), texts TEXT; attribute names WORD."""
        code = self.code
        m = _TAG_NAME.match(code, self.at + 1)
        name = m[0] if m else ""
        self.add(TAG, self.at + 1 + len(name))
        while self.at < self.n:
            if m := _SPACE.match(code, self.at):
                self.at = m.end()
            elif code.startswith("/>", self.at):
                self.add(TAG, self.at + 2)
                return
            elif code[self.at] == ">":
                self.add(TAG, self.at + 1)
                break
            elif code.startswith("/*", self.at) or code.startswith("//", self.at):
                end = code.find("*/" if code[self.at + 1] == "*" else "\n", self.at)
                self.at = self.n if end < 0 else end + 2 - (code[self.at + 1] == "/")
            elif code[self.at] == "{":
                self.add(MARK, self.at + 1)
                self._plain("}")
            elif code[self.at] in "\"'":
                end = code.find(code[self.at], self.at + 1)
                end = self.n if end < 0 else end
                self.add(STRING, min(end + 1, self.n), code[self.at + 1 : end])
            elif code[self.at] == "<":
                self._element()
            elif m := _ATTRIBUTE.match(code, self.at):
                self.add(WORD, m.end())
            else:
                self.add(MARK, self.at + 1)
        while self.at < self.n:  # children
            if code.startswith("</", self.at):
                end = code.find(">", self.at)
                end = self.n if end < 0 else end + 1
                self.add(TAG, end)
                return
            if code[self.at] == "<":
                self._element()
            elif code[self.at] == "{":
                self.add(MARK, self.at + 1)
                self._plain("}")
            else:
                stops = [x for x in (code.find("<", self.at), code.find("{", self.at)) if x >= 0]
                end = min(stops) if stops else self.n
                self.add(TEXT, end)


@dataclass
class Function:
    name: str
    start: int  #: first token of the whole function
    body: int
    end: int  #: token after its last
    line: int
    end_line: int
    is_async: bool = False
    cc: int = 1
    nesting: int = 0
    branches: int = 0
    loops: int = 0
    ternaries: int = 0
    logical: int = 0


@dataclass
class Component:
    name: str
    line: int
    end_line: int
    jsx: int
    hooks: list[tuple]
    render: int
    has_children: bool
    uses_ref: bool
    forwards_ref: bool


@dataclass
class Facts:
    imports: list[dict] = field(default_factory=list)
    functions: list[Function] = field(default_factory=list)
    components: list[Component] = field(default_factory=list)
    hooks: list[tuple] = field(default_factory=list)
    types: dict[str, int] = field(default_factory=dict)
    tests: bool = False
    rendered: list[str] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)
    raw_html: list[int] = field(default_factory=list)


class Source:
    """The tokens of one file and the questions asked of them."""

    def __init__(self, code: str, path: str = "", test_calls: tuple[str, ...] = ("test", "it", "describe", "specify")) -> None:
        reader = Reader(code, jsx=not path.endswith((".ts", ".mts", ".cts")) or path.endswith(".tsx"))
        self.code, self.path, self.t = code, path, reader.read()
        self.comments, self.test_calls = reader.comments, {c.lower() for c in test_calls}
        self.marks = [t.text if t.kind == WORD or t.kind == MARK else "" for t in self.t]
        self.size = len(self.t)

    @cached_property
    def functions(self) -> list[Function]:
        return self._functions()

    @cached_property
    def starts(self) -> dict[int, Function]:
        return {f.start: f for f in self.functions}

    @cached_property
    def hook_words(self) -> list[int]:
        """The tokens that may call a hook, by their name."""
        return [i for i, t in enumerate(self.t) if t.kind == WORD and t.text.startswith("use")]

    def text(self, i: int) -> str:
        return self.marks[i] if 0 <= i < self.size else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == WORD

    def close(self, i: int) -> int:
        """The bracket that closes the one at i, or the end."""
        return self.t[i].pair if self.t[i].pair > i else len(self.t) - 1

    def angle(self, i: int) -> int:
        """The token after the type arguments that open at i, or i if they are none."""
        depth, j = 0, i
        while j < len(self.t):
            text = self.text(j)
            if text == "<":
                depth += 1
            elif text in (">", ">=") or (text and set(text) == {">"}):
                depth -= len(text.rstrip("="))
                if depth <= 0:
                    return j + 1
            elif text in ("(", "[", "{"):
                j = self.close(j)
            elif text in (";", "&&", "||", "=>") and text != "=>":
                return i
            j += 1
        return i

    # Modules

    def imports(self) -> list[dict]:
        """Statements that name a module: type, module, whether types only, names, and where they stand."""
        out, i = [], 0
        while i < len(self.t):
            if self.marks[i] in ("import", "export") and self.text(i - 1) not in (".", "?."):
                found, i = self._module(i)
                out += found
                continue
            i += 1
        return out

    def _row(self, kind: str, first: int, module: int, types: bool, names: list[tuple]) -> dict:
        t = self.t[first]
        column = t.at - (self.code.rfind("\n", 0, t.at) + 1) + 1
        return {"type": kind, "module": self.t[module].text, "is_type_only": types, "names": names, "line": t.line, "column": column, "start": t.at}

    def _module(self, i: int) -> tuple[list[dict], int]:
        t = self.t
        if self.text(i) == "import" and self.text(i + 1) == "(":
            j = i + 2
            if j < len(t) and t[j].kind == STRING:
                return [self._row("dynamic-import", i, j, False, [])], j + 1
            return [], i + 2
        if self.text(i) == "import" and i + 1 < len(t) and t[i + 1].kind == STRING:
            return [self._row("side-effect-import", i, i + 1, False, [])], i + 2
        kind, j = self.text(i), i + 1
        whole = self.text(j) == "type" and self.text(j + 1) in ("{", "*") or (self.text(j) == "type" and self.word(j + 1) and self.text(j + 1) != "from")
        if kind == "export" and not (self.text(j) in ("{", "*") or (whole and self.text(j + 1) in ("{", "*"))):
            return [], i + 1
        j += whole
        names: list[tuple] = []
        only = False
        while j < len(t):
            text = self.text(j)
            if text == "from" and j + 1 < len(t) and t[j + 1].kind == STRING:
                return [self._row(kind, i, j + 1, whole or only, names)], j + 2
            if text == "{":
                inner, j = self._names(j, kind)
                only = bool(inner) and all(n[3] for n in inner) and not names
                names += [n[:3] for n in inner]
            elif text == "*":
                alias = self.text(j + 2) if self.text(j + 1) == "as" else ""
                names.append(("*", alias or "*", "namespace" if kind == "import" else "all"))
                only = False
                j += 2 if alias else 0
            elif self.word(j) and text not in ("from",):
                names.append(("default", text, "default"))
                only = False
            elif text == "=" or t[j].kind not in (WORD, MARK) or text in (";", "(", "=>"):
                return [], i + 1
            j += 1
        return [], i + 1

    def _names(self, i: int, kind: str) -> tuple[list[tuple], int]:
        """Names in braces as (name, alias, kind, types only), and the closing brace."""
        end, out, j = self.close(i), [], i + 1
        while j < end:
            types = self.text(j) == "type" and self.word(j + 1) and not (self.text(j + 1) == "as" and not self.word(j + 3))
            j += types
            name = self.t[j].text
            alias = self.t[j + 2].text if self.text(j + 1) == "as" else name
            out.append((name, alias, "named", types))
            while j < end and self.text(j) != ",":
                j += 1
            j += 1
        return out, end

    # Functions

    def _functions(self) -> list[Function]:
        out: list[Function] = []
        for i, t in enumerate(self.t):
            if t.kind == WORD and t.text == "function" and self.text(i - 1) not in (".", "?."):
                f = self._function_word(i)
            elif t.kind == MARK and t.text == "=>":
                f = self._arrow(i)
            elif t.kind == MARK and t.text == "(":
                f = self._method(i)
            else:
                f = None
            if f:
                out.append(f)
        return sorted(out, key=lambda f: (f.start, -f.end))

    def _body(self, i: int) -> int:
        """The brace of a body after a parameter list that closes at i, past a return type; -1 if there is none."""
        j = i + 1
        if self.text(j) == ":":
            j += 1
            while j < len(self.t):
                text = self.text(j)
                if text == "{":
                    after = self.text(self.close(j) + 1)
                    before = self.text(j - 1)
                    if before in (":", "|", "&", "=>", "<", ",") or after in ("{", "|", "&", "[", "=>"):
                        j = self.close(j) + 1
                        continue
                    return j
                if text in ("(", "["):
                    j = self.close(j)
                elif text == "<":
                    k = self.angle(j)
                    j = k - 1 if k > j else j
                elif text in (";", "=", ")", "]", "}", ",") or self.t[j].kind in (TAG, TEXT):
                    return -1
                j += 1
            return -1
        return j if self.text(j) == "{" else -1

    def _make(self, name: str, start: int, body: int, end: int, is_async: bool) -> Function:
        last = self.t[min(end, len(self.t)) - 1]
        end_line = last.line + self.code.count("\n", last.at, last.end)
        f = Function(name, start, body, end, self.t[start].line, end_line, is_async)
        return f

    def _function_word(self, i: int) -> Function | None:
        j = i + 1 + (self.text(i + 1) == "*")
        name = self.text(j) if self.word(j) else ""
        j += bool(name)
        if self.text(j) == "<":
            j = self.angle(j)
        if self.text(j) != "(":
            return None
        body = self._body(self.close(j))
        if body < 0:
            return None
        is_async = self.text(i - 1) == "async"
        start = i - is_async
        declared = self.text(start - 1) in ("default", "export", "", ";", "{", "}", ")") or start == 0
        if not name:
            name = "default" if self.text(start - 1) == "default" else self._bound(start) if not declared or self.text(start - 1) == ")" else "anonymous"
        if self.text(start - 1) == "default":
            start -= 2
        elif self.text(start - 1) == "export":
            start -= 1
        return self._make(name, max(start, 0), body, self.close(body) + 1, is_async)

    def _arrow(self, i: int) -> Function | None:
        j = i - 1
        if self.text(j) != ")" and not (self.word(j) and self.text(j - 1) not in (":", ".", "|", "&")):
            k = self._typed_params(i)
            if k < 0:
                return None
            j = k
        if self.text(j) == ")":
            start = self.t[j].pair
            if start < 0:
                return None
            if self.text(start - 1) == ":" and self._is_type_colon(start - 1):
                return None
        else:
            start = j
        body = i + 1
        if body >= len(self.t):
            return None
        if self._in_type(start):
            return None
        if self.text(start - 1) == ">":
            k = start - 2
            depth = 1
            while k >= 0 and depth:
                depth += (self.text(k) == ">") - (self.text(k) == "<")
                k -= 1
            start = k + 1
        is_async = self.text(start - 1) == "async"
        start -= is_async
        end = self.close(body) + 1 if self.text(body) == "{" else self._expression_end(body)
        return self._make(self._bound(start), start, body, end, is_async)

    def _typed_params(self, i: int) -> int:
        """The closing bracket of parameters before a return type that ends before the arrow at i, or -1."""
        k = i - 1
        while k >= 0:
            text = self.text(k)
            if text in (")", "]", "}"):
                opener = self.t[k].pair
                if opener < 0:
                    return -1
                if text == ")" and self.text(k + 1) == ":":
                    return k
                k = opener - 1
                continue
            if text in (";", "=", ",", "(", "[", "{", "=>") or self.t[k].kind in (TAG, TEXT):
                return -1
            k -= 1
        return -1

    def _is_type_colon(self, i: int) -> bool:
        """Whether a colon at i begins a type annotation rather than an object's or a condition's value."""
        k, depth = i - 1, 0
        if self.text(k) == ")":
            return True
        while k >= 0:
            text = self.text(k)
            if text in (")", "]", "}"):
                if self.t[k].pair < 0:
                    return False
                k = self.t[k].pair
            elif text in ("const", "let", "var"):
                return True
            elif text == "?":
                return self.text(k + 1) == ":" and k + 1 == i
            elif text in ("(", "{", "[", ",", ";", "=", "=>"):
                return False
            k -= 1
            depth += 1
            if depth > 60:
                return False
        return False

    def _in_type(self, start: int) -> bool:
        """Whether what begins at start belongs to a type: after a type annotation's colon, in type arguments or a type alias."""
        text = self.text(start - 1)
        if text == ":":
            return self._is_type_colon(start - 1)
        if text in ("|", "&") or text == "<" and not _ends_value(self.t, start - 1):
            return True
        if text == "=":
            k = start - 2
            if self.text(k) == ">":
                while k >= 0 and self.text(k) != "<":
                    k -= 1
                k -= 1
            return self.word(k) and self.text(k - 1) == "type"
        return False

    def _method(self, i: int) -> Function | None:
        k = i - 1
        if self.text(k) == ">":
            depth, k = 1, k - 1
            while k >= 0 and depth:
                depth += (self.text(k) == ">") - (self.text(k) == "<")
                k -= 1
        named = 0 <= k < len(self.t) and (self.t[k].kind in (WORD, STRING, NUMBER) or self.text(k) == "]")
        if not named or (self.word(k) and self.t[k].text in _CONTROL | {"function", "return", "await", "typeof", "new", "super", "import"}):
            return None
        first = self.t[k].pair if self.text(k) == "]" else k
        if first < 0:
            return None
        name = self.code[self.t[first].at : self.t[k].end]
        before = first - 1
        is_async = False
        while self.text(before) in ("async", "static", "public", "private", "protected", "override", "readonly", "get", "set", "*", "abstract"):
            is_async |= self.text(before) == "async"
            before -= 1
        if self.text(before) not in ("{", "}", ";", ",") or (0 <= before < len(self.t) and self.t[before].kind != MARK):
            return None
        body = self._body(self.close(i))
        if body < 0 or not self._holds_members(before):
            return None
        return self._make("constructor" if name == "constructor" else name, before + 1, body, self.close(body) + 1, is_async)

    def _holds_members(self, i: int) -> bool:
        """Whether the braces around i are those of a class or an object, not of a block."""
        k = i if self.text(i) == "{" else i - 1
        while k >= 0 and not (self.text(k) == "{" and self.t[k].pair > i):
            k = self.t[k].pair - 1 if self.text(k) in (")", "]", "}") and self.t[k].pair >= 0 else k - 1
        if k < 0:
            return False
        before = self.text(k - 1)
        if before in ("=", "(", ",", "[", ":", "?", "return", "=>", "&&", "||", "??", "default", "satisfies"):
            return before != "=>"
        j = k - 1
        while j >= 0 and self.text(j) not in (";", "{", "}", ")", "=", "("):
            if self.text(j) == "class":
                return True
            j = j - 1
        return False

    def _bound(self, start: int) -> str:
        """The name that a function without one is given to: of a variable, a property or a class field."""
        k = start - 1
        while self.text(k) == "(" and not (self.word(k - 1) or self.text(k - 1) in (")", "]", ">")):
            k -= 1
        if self.text(k) == "default":
            return "default"
        if self.text(k) == ":":
            return self.t[k - 1].text if self.word(k - 1) or (k > 0 and self.t[k - 1].kind == STRING) else "anonymous"
        if self.text(k) == "=":
            j = k - 1
            while j >= 0:  # past a type annotation
                if self.text(j) in (")", "]", "}") and self.t[j].pair >= 0:
                    j = self.t[j].pair - 1
                    continue
                if self.text(j) == ":" or self.text(j) in ("const", "let", "var", ";", "{", "}", ",", "("):
                    break
                j -= 1
            at = j - 1 if self.text(j) == ":" else k - 1
            while self.text(at) in ("?", "!"):
                at -= 1
            return self.t[at].text if self.word(at) and self.text(at - 1) not in (".", "?.") else "anonymous"
        return "anonymous"

    def _expression_end(self, i: int) -> int:
        """The token after the expression that begins at i."""
        j = i
        while j < len(self.t):
            text = self.text(j)
            if text in ("(", "[", "{"):
                j = self.close(j) + 1
                continue
            if text in (")", "]", "}", ",", ";"):
                return j
            if self.t[j].kind == TAG and not self.t[j].text.startswith("</") and self.t[j].text not in (">", "/>"):
                j = self._element_end(j)
                continue
            if self.t[j].kind in (TAG, TEXT):
                return j
            if j > i and self.t[j].line > self.t[j - 1].line and self.t[j].kind == WORD and _ends_value(self.t, j) and text not in ("in", "of", "instanceof", "as", "satisfies"):
                return j
            j += 1
        return len(self.t)

    def _element_end(self, i: int) -> int:
        """The token after the element whose tag opens at i."""
        depth, j = 0, i
        while j < len(self.t):
            t = self.t[j]
            if t.kind == TAG:
                if t.text == "/>" or t.text.startswith("</"):
                    depth -= 1
                    if depth == 0:
                        return j + 1
                elif t.text != ">":
                    depth += 1
            elif t.kind == MARK and t.text == "{":
                j = self.close(j)
            j += 1
        return len(self.t)

    def measure(self, f: Function) -> Function:
        """Count what branches in a function, without the functions inside it."""
        self._f, begin = f, f.body + (self.text(f.body) == "{")
        end = f.end - (self.text(f.body) == "{")
        self._walk(begin, end, 0)
        return f

    def _deeper(self, depth: int) -> None:
        self._f.nesting = max(self._f.nesting, depth)

    def _walk(self, i: int, end: int, depth: int) -> int:
        f, seen_do = self._f, set()
        tokens, starts, text_of = self.t, self.starts, self.text
        while i < end:
            inner = starts.get(i)
            if inner is not None and inner is not f and inner.end <= max(end, inner.end) and inner.body > f.body:
                i = max(inner.end, i + 1)
                continue
            t = tokens[i]
            if depth > f.nesting:
                f.nesting = depth
            text = text_of(i)
            if t.kind == WORD and text not in _BRANCHING:
                i += 1
                continue
            after_dot = text_of(i - 1) in (".", "?.")
            key = t.kind == WORD and not after_dot and text_of(i + 1) != ":"
            if key and text == "if":
                f.cc, f.branches = f.cc + 1, f.branches + 1
                i = self._header(i + 1, end, depth + 1)
                i = self._statement(i, end, depth + 1)
                if self.text(i) == "else":
                    i = self._statement(i + 1, end, depth + 1)
                continue
            if key and text in ("for", "while") and not (text == "while" and i in seen_do):
                f.cc, f.loops = f.cc + 1, f.loops + 1
                i = self._statement(self._header(i + 1 + (self.text(i + 1) == "await"), end, depth + 1), end, depth + 1)
                continue
            if key and text == "do" and self.text(i + 1) == "{":
                f.cc, f.loops = f.cc + 1, f.loops + 1
                i = self._statement(i + 1, end, depth + 1)
                seen_do.add(i)
                if self.text(i) == "while":
                    i = self._header(i + 1, end, depth + 1)
                continue
            if key and text == "switch":
                i = self._statement(self._header(i + 1, end, depth + 1), end, depth + 1)
                continue
            if t.kind == WORD and text == "case" and not after_dot:
                f.cc, f.branches = f.cc + 1, f.branches + 1
                self._deeper(depth + 1)
                i = self._walk_case(i + 1, end, depth + 1)
                continue
            if key and text == "try" and self.text(i + 1) == "{":
                self._deeper(depth + 1)
                i = self._statement(i + 1, end, depth + 1)
                if self.text(i) == "catch":
                    f.cc, f.branches = f.cc + 1, f.branches + 1
                    i += 1
                    i = self._header(i, end, depth + 2) if self.text(i) == "(" else i
                    i = self._statement(i, end, depth + 2)
                if self.text(i) == "finally":
                    i = self._statement(i + 1, end, depth + 1)
                continue
            if t.kind == MARK:
                if text in ("&&", "||", "??"):
                    f.cc, f.logical = f.cc + 1, f.logical + 1
                elif text == "?." and self._chain_start(i):
                    f.cc, f.branches = f.cc + 1, f.branches + 1
                elif text == "?" and self._is_ternary(i):
                    f.cc, f.branches, f.ternaries = f.cc + 1, f.branches + 1, f.ternaries + 1
                    stop = min(end, self._expression_end(i + 1))
                    self._walk(i + 1, stop, depth + 1)
                    i = max(stop, i + 1)
                    continue
            i += 1
        return i

    def _walk_case(self, i: int, end: int, depth: int) -> int:
        """A case up to the next one of its switch."""
        j = i
        while j < end and not (self.word(j) and self.t[j].text in ("case", "default") and self.text(j - 1) != "."):
            j = self.close(j) + 1 if self.text(j) in ("(", "[", "{") else j + 1
        self._walk(i, min(j, end), depth)
        return max(j, i)

    def _header(self, i: int, end: int, depth: int) -> int:
        if self.text(i) != "(":
            return i
        stop = self.close(i)
        self._deeper(depth)
        self._walk(i + 1, min(stop, end), depth)
        return stop + 1

    def _statement(self, i: int, end: int, depth: int) -> int:
        """The statement that begins at i; returns the token after it."""
        if i >= end:
            return i
        self._deeper(depth)
        if self.text(i) == "{":
            stop = self.close(i)
            self._walk(i + 1, min(stop, end), depth)
            return stop + 1
        if self.word(i) and self.t[i].text in ("if", "for", "while", "do", "switch", "try"):
            return self._one(i, end, depth)
        stop = i
        while stop < end and self.text(stop) != ";":
            if self.text(stop) in ("(", "[", "{"):
                stop = self.close(stop)
            elif self.text(stop) in (")", "]", "}"):
                break
            elif stop > i and self.t[stop].line > self.t[stop - 1].line and self.t[stop].kind == WORD and _ends_value(self.t, stop):
                break
            stop += 1
        stop = min(stop, end)
        self._walk(i, stop, depth)
        return stop + (self.text(stop) == ";")

    def _one(self, i: int, end: int, depth: int) -> int:
        """One control statement: where it ends is found first, then it is walked alone."""
        word, j = self.t[i].text, i + 1
        if word == "do" or word == "try":
            j = self._skip(j, end)
            while self.text(j) in ("catch", "finally", "while"):
                j += 1
                j = self.close(j) + 1 if self.text(j) == "(" else j
                j = self._skip(j, end) if self.text(j) == "{" else j
        else:
            j += self.text(j) == "await"
            j = self.close(j) + 1 if self.text(j) == "(" else j
            j = self._skip(j, end)
            if word == "if" and self.text(j) == "else":
                j = self._skip(j + 1, end)
        self._walk(i, min(j, end), depth)
        return j

    def _skip(self, i: int, end: int) -> int:
        if self.text(i) == "{":
            return self.close(i) + 1
        if self.word(i) and self.t[i].text in ("if", "for", "while", "switch"):
            j = i + 1 + (self.text(i + 1) == "await")
            j = self._skip(self.close(j) + 1 if self.text(j) == "(" else j, end)
            return self._skip(j + 1, end) if self.t[i].text == "if" and self.text(j) == "else" else j
        while i < end and self.text(i) != ";":
            if self.text(i) in (")", "]", "}"):
                return i
            i = self.close(i) + 1 if self.text(i) in ("(", "[", "{") else i + 1
        return i + 1

    def _chain_start(self, i: int) -> bool:
        """Whether the ?. at i is the first of its chain of members, calls and indexes."""
        k = i - 1
        while k >= 0:
            text = self.text(k)
            if text in (")", "]") and self.t[k].pair >= 0:
                k = self.t[k].pair - 1
                if self.text(k) in ("?.",):
                    return False
                if not (self.word(k) or self.text(k) in (")", "]", "!")):
                    return True
                continue
            if text == "!":
                k -= 1
                continue
            if self.word(k):
                if self.text(k - 1) == "?.":
                    return False
                if self.text(k - 1) == ".":
                    k -= 2
                    continue
            return True
        return True

    def _is_ternary(self, i: int) -> bool:
        after = self.text(i + 1)
        if after in (":", ",", ")", "=", ";", "]", "}"):
            return False
        depth, j = 0, i + 1
        while j < len(self.t):
            text = self.text(j)
            if text in ("(", "[", "{"):
                j = self.close(j)
            elif text == "?" and self.text(j + 1) not in (":", ",", ")", "="):
                depth += 1
            elif text == ":":
                if depth == 0:
                    return True
                depth -= 1
            elif text in (")", "]", "}", ";"):
                return False
            j += 1
        return False

    # Hooks and components

    def hook(self, i: int) -> tuple[str, int, int, bool] | None:
        """A hook called at token i: (name, line, arguments, whether it has a list of dependencies)."""
        if not self.word(i):
            return None
        name = self.t[i].text
        member = self.text(i - 1) in (".", "?.")
        if name == "use":
            if member and not (self.text(i - 2) == "React" and self.text(i - 3) not in (".", "?.")):
                return None
        elif name not in HOOKS and not re.match(r"use[A-Z0-9]", name):
            return None
        j = i + 1
        if self.text(j) == "<":
            j = self.angle(j)
        if self.text(j) != "(" or self.text(i - 1) in ("function", "=>") and self.text(i - 1) == "function":
            return None
        if any(f.name == name and f.start <= i < f.body and self.text(f.body) == "{" and self.close(j) < f.body for f in self.functions if f.start <= i <= f.body):
            return None
        parts = self.arguments(j)
        first = i - 2 if member else i
        return name, self.t[max(first, 0)].line, len(parts), self._has_list(name, parts)

    def arguments(self, i: int) -> list[tuple[int, int]]:
        """The arguments in the parentheses that open at i, as ranges of tokens."""
        end, out, j, first = self.close(i), [], i + 1, i + 1
        while j < end:
            text = self.text(j)
            if text in ("(", "[", "{"):
                j = self.close(j) + 1
                continue
            if self.t[j].kind == TAG and self.t[j].text not in (">", "/>") and not self.t[j].text.startswith("</"):
                j = self._element_end(j)
                continue
            if text == "<" and self.angle(j) > j and self.angle(j) <= end:
                j = self.angle(j)
                continue
            if text == ",":
                out.append((first, j))
                first = j + 1
            j += 1
        if first < end:
            out.append((first, end))
        return out

    def _unwrapped(self, part: tuple[int, int]) -> tuple[int, int]:
        a, b = part
        while True:
            if self.text(a) == "(" and self.close(a) == b - 1:
                a, b = a + 1, b - 1
                continue
            k = a
            while k < b:
                if self.text(k) in ("as", "satisfies") and k > a:
                    b = k
                    break
                k = self.close(k) + 1 if self.text(k) in ("(", "[", "{") else k + 1
            else:
                if self.text(b - 1) == "!" and b - 1 > a:
                    b -= 1
                    continue
                return a, b

    def _has_list(self, name: str, parts: list[tuple[int, int]]) -> bool:
        if name in WITHOUT_DEPENDENCIES:
            return False
        known = DEPENDENCY_AT.get(name)
        if known is None and len(parts) < 2:
            return False
        at = known if known is not None else len(parts) - 1
        if at >= len(parts):
            return False
        a, b = self._unwrapped(parts[at])
        is_list = self.text(a) == "[" and self.close(a) == b - 1
        return is_list or (known is not None and b - a == 1 and self.word(a))

    def hooks(self, a: int = 0, b: int | None = None) -> list[tuple]:
        words = self.hook_words
        found = (self.hook(i) for i in words[bisect_left(words, a) : None if b is None else bisect_left(words, b)])
        return [h for h in found if h]

    def elements(self, a: int, b: int) -> int:
        """Elements and fragments between tokens a and b."""
        return sum(t.kind == TAG and t.text not in (">", "/>") and not t.text.startswith("</") for t in self.t[a:b])

    def components(self) -> list[Component]:
        out = []
        for f in self.functions:
            if self.text(f.start) == "export" or self.text(f.start) in ("function", "async"):
                declared = any(self.text(k) == "function" for k in range(f.start, min(f.start + 4, len(self.t))))
                if declared and self.text(f.start - 1) in ("", ";", "{", "}", ")") or (declared and f.start == 0) or self.text(f.start) == "export":
                    default = self.text(f.start + 1) == "default"
                    if self.elements(f.body, f.end) and ((f.name not in ("default", "anonymous") and re.fullmatch(r"[A-Z][A-Za-z0-9]*", f.name)) or (default and f.name == "default")):
                        out.append(self._component(f.name if f.name != "default" else self._stem(), f.start, f.end))
        for i, t in enumerate(self.t):
            if t.kind != WORD:
                continue
            if t.text in ("const", "let", "var") and self.word(i + 1) and re.fullmatch(r"[A-Z][A-Za-z0-9]*", self.t[i + 1].text):
                out += self._variable(i + 1)
            elif t.text == "class" and self.text(i - 1) not in (".", "?."):
                out += self._class(i)
            elif t.text == "default" and self.text(i - 1) == "export" and self.text(i + 1) not in ("function", "class", "async") or (t.text == "default" and self.text(i + 1) == "async" and self.text(i + 2) != "function"):
                out += self._default(i + 1)
        return sorted(out, key=lambda c: c.line)

    def _initial(self, i: int, typed: bool) -> tuple[int, int] | None:
        """The value that begins at i, if a component: a function with elements (or of a component's type), or a call around one."""
        a, b = self._unwrapped((i, self._expression_end(i)))
        f = self.starts.get(a)
        if f and f.end >= b:
            return (a, b) if self.elements(f.body, f.end) or typed else None
        if self.text(b - 1) == ")" and self.t[b - 1].pair > a and (self.word(self.t[b - 1].pair - 1) or self.text(self.t[b - 1].pair - 1) == ">"):
            g = self._wrapped(self.t[b - 1].pair, 0)
            if g and self.elements(g.body, g.end):
                return a, b
        return None

    def _wrapped(self, call: int, depth: int) -> Function | None:
        if depth > 4:
            return None
        for part in self.arguments(call):
            a, b = self._unwrapped(part)
            f = self.starts.get(a)
            if f and f.end >= b:
                return f
            if self.text(b - 1) == ")" and self.t[b - 1].pair > a and (self.word(self.t[b - 1].pair - 1) or self.text(self.t[b - 1].pair - 1) == ">"):
                found = self._wrapped(self.t[b - 1].pair, depth + 1)
                if found:
                    return found
        return None

    def _variable(self, i: int) -> list[Component]:
        j, typed = i + 1, False
        if self.text(j) == ":":
            k = j + 1
            while k < len(self.t) and self.text(k) not in ("=", ";"):
                if self.text(k) == "<":
                    typed = typed or self.text(k - 1) in COMPONENT_TYPES
                    k = max(self.angle(k), k + 1)
                    continue
                k = self.close(k) + 1 if self.text(k) in ("(", "[", "{") else k + 1
            typed = typed or self.text(k - 1) in COMPONENT_TYPES
            j = k
        if self.text(j) != "=":
            return []
        found = self._initial(j + 1, typed)
        return [self._component(self.t[i].text, i, found[1])] if found else []

    def _class(self, i: int) -> list[Component]:
        j = i + 1
        name = self.text(j) if self.word(j) and self.text(j) != "extends" else ""
        while j < len(self.t) and self.text(j) not in ("extends", "{"):
            j = max(self.angle(j), j + 1) if self.text(j) == "<" else j + 1
        if self.text(j) != "extends":
            return []
        j += 1
        while self.text(j + 1) == ".":
            j += 2
        base = self.text(j)
        while j < len(self.t) and self.text(j) != "{":
            j = max(self.angle(j), j + 1) if self.text(j) == "<" else j + 1
        if base not in COMPONENT_BASES or j >= len(self.t):
            return []
        end = self.close(j) + 1
        if not any(f.name == "render" and j < f.start < end for f in self.functions):
            return []
        start = i
        while self.text(start - 1) in ("export", "default", "abstract"):
            start -= 1
        return [self._component(name or self._stem(), start, end)]

    def _default(self, i: int) -> list[Component]:
        found = self._initial(i, False)
        if not found:
            return []
        a, b = found
        f = self.starts.get(a) or self._wrapped(self.t[b - 1].pair, 0)
        own = f.name if f and re.fullmatch(r"[A-Z][A-Za-z0-9]*", f.name) and self.text(f.start + (f.is_async)) == "function" else self._stem()
        return [self._component(own, i - 2, b)]

    def _stem(self) -> str:
        """What an unnamed default export is called: the file's name up to its first dot, if that is a name."""
        first = re.split(r"[/\\]", self.path)[-1].split(".")[0]
        return first if first and first != "index" and re.fullmatch(r"[A-Za-z_$][\w$]*", first) else "default"

    def _component(self, name: str, a: int, b: int) -> Component:
        hooks, seen = [], set()
        for h in self.hooks(a, b):
            if (h[0], h[1]) not in seen:
                seen.add((h[0], h[1]))
                hooks.append(h)
        words = [(self.t[i].text, self.text(i - 1) in (".", "?.")) for i in range(a, b) if self.t[i].kind == WORD]
        has_children = any(w == "children" for w, _ in words)
        uses_ref = any(w in ("ref", "useRef") or (w == "current" and dotted) for w, dotted in words)
        last = self.t[b - 1]
        return Component(
            name, self.t[a].line, last.line + self.code.count("\n", last.at, last.end), self.elements(a, b), hooks, self._render(a, b), has_children, uses_ref, any(w == "forwardRef" for w, _ in words)
        )

    def _render(self, a: int, b: int) -> int:
        marks = [self.text(i) for i in range(a, b)]
        some = any(m in ("if", "&&", "||") or (m == "?" and self._is_ternary(a + k)) for k, m in enumerate(marks))
        lists = any(self.word(i) and self.t[i].text in LIST_METHODS and self.text(i - 1) in (".", "?.") and self.text(i + 1) == "(" for i in range(a, b))
        fragments = sum(self.t[i].kind == TAG and self.t[i].text == "<" for i in range(a, b))
        return int(some) + int(lists) + fragments

    # Types and findings

    def type_counts(self) -> dict[str, int]:
        """any, unknown, assertions by class, non-null assertions and directives."""
        out = dict.fromkeys(("any_count", "unknown_count", "assertion", "unsafe", "double", "const", "non_null", "ts_ignore", "ts_expect", "ts_nocheck"), 0)
        for _, comment in self.comments:
            for name, key in (("@ts-ignore", "ts_ignore"), ("@ts-expect-error", "ts_expect"), ("@ts-nocheck", "ts_nocheck")):
                out[key] += len(re.findall(rf"{name}\b", comment))
        types = {":", "<", "|", "&", "as", "=", "(", ",", "=>", "[", "extends", "keyof", "readonly", "is", "satisfies", "?"}
        for i, t in enumerate(self.t):
            if t.kind == WORD and t.text in ("any", "unknown") and self.text(i - 1) in types and self.text(i + 1) not in (":", "(", ".", "?."):
                out["any_count" if t.text == "any" else "unknown_count"] += 1
            elif t.kind == WORD and t.text == "as" and self._is_assertion(i):
                kind = self._assertion(i)
                for key in kind:
                    out[key] += 1
            elif t.kind == MARK and t.text == "!" and i and self.t[i - 1].line == t.line and _ends_value(self.t, i) and self.t[i - 1].end == t.at:
                follower = self.t[i + 1] if i + 1 < len(self.t) else None
                if not (follower and follower.kind in (WORD, STRING, NUMBER) and follower.line == t.line and follower.text not in ("as", "in", "of", "instanceof", "satisfies")):
                    out["non_null"] += 1
        return out

    def _is_assertion(self, i: int) -> bool:
        after_value = _ends_value(self.t, i) or (self.text(i - 1) == "!" and _ends_value(self.t, i - 1))
        if not after_value or self.text(i + 1) in (",", "}", ")", ":", "=", ";", ""):
            return False
        k = i - 1
        depth = 0
        while k >= 0 and depth < 400:  # names with an alias stand in the braces of an import or export
            text = self.text(k)
            if text in (")", "]", "}") and self.t[k].pair >= 0:
                k = self.t[k].pair
            elif text == "{":
                return self.text(k - 1) not in ("import", "export", "type") and not (self.text(k - 1) == "," and self.text(k - 3) == "import")
            elif text == "*" and self.text(k - 1) in ("import", "export", "type", ","):
                return False
            elif text in (";", "(", "[", "=", "=>"):
                return True
            k -= 1
            depth += 1
        return True

    def _type_of(self, i: int) -> str:
        """The word of the type asserted by the as at i, without parentheses; empty for a longer type."""
        j, k = i + 1, i + 1
        while self.text(j) == "(":
            j += 1
        if not self.word(j):
            return ""
        k = j + 1
        while self.text(k) == ")":
            k += 1
        return "" if self.text(j + 1) in ("<", "[", ".", "|", "&") else self.t[j].text

    def _inner_as(self, i: int) -> int:
        """The assertion that the as at i is applied to: directly before it, or in parentheses; -1 if none."""
        k = i - 1
        if self.text(k) == ")" and self.t[k].pair >= 0:
            a, j = self.t[k].pair + 1, k - 1
            while j > a:
                if self.text(j) in (")", "]", "}") and self.t[j].pair >= 0:
                    j = self.t[j].pair - 1
                    continue
                if self.text(j) == "as" and self._is_assertion(j):
                    return j
                j -= 1
            if self.text(self.t[k].pair - 1) != "as":
                return -1
            k = self.t[k].pair
        while k >= 0 and (self.t[k].kind in (WORD, STRING, NUMBER) or self.text(k) in (".", "<", ">", "[", "]", "|", "&", ",", "}")):
            if self.text(k) == "as":
                return k
            if self.text(k) in ("]", "}") and self.t[k].pair >= 0:
                k = self.t[k].pair
            if self.text(k) == ",":
                return -1
            k -= 1
        return -1

    def _assertion(self, i: int) -> list[str]:
        own = self._type_of(i)
        if own == "const":
            return ["const"]
        out, inner = ["assertion"], self._inner_as(i)
        if inner >= 0 and self._type_of(inner) == "const":
            inner = -1
        if inner >= 0:
            out.append("double")
        if own == "any" or (inner >= 0 and self._type_of(inner) in ("any", "unknown")):
            out.append("unsafe")
        return out

    def has_tests(self) -> bool:
        """Whether a known test function is called, by the first or the last name of a call."""
        for i, t in enumerate(self.t):
            if t.kind != WORD or t.text.lower() not in self.test_calls:
                continue
            if self.text(i + 1) == "(":
                return True
            j = i + 1
            while self.text(j) in (".", "?.") and self.word(j + 1):
                j += 2
            if self.text(j) == "(" and self.text(i - 1) not in (".", "?."):
                return True
        return False

    def rendered(self) -> list[str]:
        """Names whose elements are rendered: the first part of each tag's name."""
        names = {t.text[1:].split(".")[0] for t in self.t if t.kind == TAG and len(t.text) > 1 and t.text[0] == "<" and t.text[1] != "/"}
        return sorted(names - {""})

    def raw_html(self) -> list[int]:
        return [t.line for i, t in enumerate(self.t) if t.kind == WORD and t.text == "dangerouslySetInnerHTML" and self.text(i + 1) == "=" and self._in_tag(i)]

    def _in_tag(self, i: int) -> bool:
        k = i - 1
        while k >= 0:
            if self.text(k) == "}" and self.t[k].pair >= 0:
                k = self.t[k].pair - 1
                continue
            if self.t[k].kind == TAG:
                return self.t[k].text.startswith("<") and not self.t[k].text.startswith("</")
            if self.t[k].kind == MARK and self.t[k].text not in ("=", "{", "}", "."):
                return False
            k -= 1
        return False

    def texts(self) -> list[tuple[int, str]]:
        """(line, text) shown to users: texts of elements, of attributes that are read, and of strings in braces, also through constants."""
        known: dict[str, str] = {}
        for i, t in enumerate(self.t):
            if t.kind == WORD and t.text in ("const", "let", "var") and self.word(i + 1):
                j = i + 2
                while j < len(self.t) and self.text(j) not in ("=", ";", ",", "of", "in"):
                    j = max(self.angle(j), j + 1) if self.text(j) == "<" else self.close(j) + 1 if self.text(j) in ("(", "[", "{") else j + 1
                if self.text(j) == "=":
                    value = self._static(j + 1, self._expression_end(j + 1), known)
                    if value:
                        known[self.t[i + 1].text] = value
        out = []
        for i, t in enumerate(self.t):
            if t.kind == TEXT:
                text = " ".join(t.text.split())
                if any(c.isalpha() for c in text):
                    lead = len(t.text) - len(t.text.lstrip())
                    out.append((t.line + t.text[:lead].count("\n"), text))
            elif t.kind == MARK and t.text == "{" and i and self._opens_expression(i):
                name = self.t[i - 2].text if self.text(i - 1) == "=" else ""
                value = self._static(i + 1, self.close(i), known)
                text = " ".join((value or "").split())
                if any(c.isalpha() for c in text) and (not name or name in TEXT_ATTRIBUTES):
                    out.append((t.line if not name else self.t[i - 2].line, f"{name}={{{text}}}" if name else f"{{{text}}}"))
            elif t.kind == STRING and self.text(i - 1) == "=" and self.word(i - 2) and self.t[i - 2].text in TEXT_ATTRIBUTES and self._in_tag(i - 2) and any(c.isalpha() for c in t.text):
                out.append((self.t[i - 2].line, f'{self.t[i - 2].text}="{t.text}"'))
        return out

    def _opens_expression(self, i: int) -> bool:
        """Whether the brace at i opens an expression among an element's children or as an attribute's value."""
        before = self.t[i - 1]
        if before.kind in (TEXT, TAG):
            return before.kind == TEXT or before.text in (">", "/>") or before.text.startswith("</")
        if before.kind == MARK and before.text == "=":
            return self.word(i - 2) and self._in_tag(i - 2)
        return before.kind == MARK and before.text == "}" and before.pair > 0 and self._opens_expression(before.pair)

    def _static(self, a: int, b: int, known: dict[str, str]) -> str | None:
        """The text of an expression of strings, constants, templates and plus signs, or None."""
        while self.text(a) == "(" and self.close(a) == b - 1:
            a, b = a + 1, b - 1
        out, j = "", a
        while j < b:
            t = self.t[j]
            if t.kind == STRING:
                out += t.text
            elif t.kind == TEMPLATE:
                out += t.text
                j += 1
                while j < b and self.text(j) == "{":
                    inner = self._static(j + 1, self.close(j), known)
                    if inner is None:
                        return None
                    out += inner
                    j = self.close(j) + 1
                    if j < b and self.t[j].kind == TEMPLATE:
                        out += self.t[j].text
                        j += 1
                if j < b and self.text(j) != "+":
                    return None
                j += 1
                continue
            elif t.kind == WORD and t.text in known:
                out += known[t.text]
            elif self.text(j) == "(":
                inner = self._static(j + 1, self.close(j), known)
                if inner is None:
                    return None
                out, j = out + inner, self.close(j)
            else:
                return None
            j += 1
            if j < b:
                if self.text(j) != "+":
                    return None
                j += 1
        return out if b > a else None

    def measured(self) -> list[Function]:
        for f in self.functions:
            self.measure(f)
        return self.functions

    def facts(self, *wanted: str) -> Facts:
        """The wanted facts, all by default; those that are not wanted are not looked for and stay empty."""
        how = {
            "imports": self.imports, "functions": self.measured, "components": self.components, "hooks": self.hooks, "types": self.type_counts,
            "tests": self.has_tests, "rendered": self.rendered, "texts": self.texts, "raw_html": self.raw_html,
        }
        return Facts(**{name: how[name]() for name in wanted or how})
