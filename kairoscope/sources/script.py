"""Functions, classes, imports and calls of one JavaScript or TypeScript file.

Text is cut into tokens, so that nothing in a comment, string, template or regular expression counts;
code within ``${}`` of a template does. Brackets are paired, and every function, method, arrow and
class is a range of tokens. A call belongs to the innermost function that has a name; what lies in a
nameless one inside belongs to nothing. Text that ends within a bracket is read up to its end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

#: Words that are no names, what a value can end with, and words before a class or method.
KEYWORDS = set("if for while switch catch return function typeof await super import with new do else case in of instanceof void delete throw yield class extends const let var".split())
MODIFIERS = set("async static get set public private protected readonly override abstract declare export default".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}
_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|\s+|(?P<name>[#A-Za-z_$\u0080-￿][\w$]*)|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<number>\d[\w.]*)|(?P<mark>=>|===?|!==?|[<>]=|\?\.|\.\.\.|.)""", re.S)
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


class Token(NamedTuple):
    kind: str
    text: str
    at: int
    #: Whether a line ends before it.
    fresh: bool


def _ends_value(token: Token | None) -> bool:
    return token is not None and (token.kind in ("string", "number", "template") or token.text in _CLOSE or (token.kind == "name" and token.text not in KEYWORDS))


def tokens_of(text: str) -> list[Token]:
    out: list[Token] = []
    braces: list[bool] = []  # of each open brace whether a template goes on behind it
    at, fresh = 0, True

    def template() -> None:
        nonlocal at
        m = _TEMPLATE.match(text, at)
        out.append(Token("template", m[0], at, False))
        at = m.end()
        if m[1] == "${":
            braces.append(True)
            out.append(Token("mark", "${", at - 2, False))

    while at < len(text):
        if text[at] == "/" and not _ends_value(out[-1] if out else None) and (m := _REGEX.match(text, at)) and not text.startswith(("//", "/*"), at):
            out.append(Token("string", m[0], at, fresh))
            at, fresh = m.end(), False
            continue
        m = _TOKEN.match(text, at)
        at = m.end()
        if m.lastgroup is None:
            fresh = fresh or "\n" in m[0]
            continue
        if m[0] == "`":
            template()
        else:
            out.append(Token(m.lastgroup, m[0], m.start(), fresh))
            if m[0] == "{":
                braces.append(False)
            elif m[0] == "}" and braces and braces.pop():
                template()
        fresh = False
    return out


def pairs_of(tokens: list[Token]) -> list[int]:
    """For each token the place of the bracket that closes it; the last place for one that is never closed, its own for others."""
    pair, stack = list(range(len(tokens))), []
    for i, t in enumerate(tokens):
        if t.kind == "mark" and t.text in _OPEN:
            stack.append(i)
            pair[i] = len(tokens) - 1
        elif t.kind == "mark" and t.text in _CLOSE:
            while stack:
                j = stack.pop()
                if _OPEN[tokens[j].text] == t.text:
                    pair[j] = i
                    break
    return pair


class Script:
    def __init__(self, text: str):
        self.text, self.tokens = text, tokens_of(text)
        self.pair = pairs_of(self.tokens)
        self.lines = [m.end() for m in re.finditer("\n", text)]
        #: Ranges of tokens with the row that their calls belong to (-1: none), in order of their begin.
        self.ranges: list[tuple[int, int, int]] = []
        self.rows: list[list] = []
        self._read()

    def word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name" and self.tokens[i].text not in KEYWORDS

    def _add(self, kind: str, i: int, parent: str = "", name: str | None = None) -> int:
        name, at = self.word(i) if name is None else name, self.tokens[i].at
        line = bisect_right(self.lines, at)
        self.rows.append([kind, name, f"{parent}.{name}" if parent else name, parent, line + 1, at - (self.lines[line - 1] if line else 0), []])
        return len(self.rows) - 1

    def _until(self, i: int, *stops: str) -> int:
        """The first of some marks from i on, outside brackets; the end of the tokens without one."""
        while i < len(self.tokens) and self.word(i) not in stops and not (self.tokens[i].kind == "mark" and self.word(i) in _CLOSE):
            i = self.pair[i] + 1
        return i

    def _body(self, i: int) -> int:
        """The last token of a body that begins at i: a block, or an expression up to its end."""
        if self.word(i) == "{":
            return self.pair[i]
        while i < len(self.tokens) and self.word(i) not in (",", ";") and not (self.tokens[i].kind == "mark" and self.word(i) in _CLOSE):
            i = self.pair[i] + 1
            if i < len(self.tokens) and self.tokens[i].fresh and self.tokens[i].kind == "name" and _ends_value(self.tokens[i - 1]):
                break
        return i - 1

    def _block_after(self, i: int) -> int | None:
        """The block of a function whose parameters begin at i, behind a type if it has one."""
        i = self.pair[i] + 1
        if self.word(i) == ":":
            i += 1
            while i < len(self.tokens) and self.word(i) not in (";", "=") and not (self.word(i) == "{" and self.word(i - 1) not in (":", "|", "&", "<", ",", "=>")):
                i = self.pair[i] + 1
        return i if self.word(i) == "{" else None

    def _function_value(self, i: int) -> int | None:
        """The last token of a function or arrow that begins at i."""
        if self.word(i) == "async" and self.word(i + 1) != "=>":
            i += 1
        if self.word(i) == "function":
            i = self._until(i, "(")
            block = self._block_after(i)
            return None if block is None else self.pair[block]
        if self.word(i) == "<":
            i = self._until(i, "(")
        if self.is_name(i) and self.word(i + 1) == "=>":
            return self._body(i + 2)
        if self.word(i) == "(":
            j = self.pair[i] + 1
            if self.word(j) == ":":
                while j < len(self.tokens) and self.word(j) not in (";", "=>"):
                    j = self.pair[j] + 1
            if self.word(j) == "=>":
                return self._body(j + 1)
        return None

    def _declared(self, i: int) -> None:
        """Variables of a declaration whose value is a function."""
        while self.is_name(i):
            at = i + 1
            if self.word(at) == ":":
                at = self._until(at, "=", ";")
            if self.word(at) == "=":
                end = self._function_value(at + 1)
                if end is not None and at not in self._known:  # a line may end without a mark
                    self._known.add(at)
                    self.ranges.append((at + 1, end, self._add("function", i)))
            i = self._until(at, ",", ";")
            if self.word(i) != ",":
                return
            i += 1

    def _method(self, i: int, owners: list[tuple[int, int, str]]) -> bool:
        """A method at the name i, of the class around it or of an object."""
        before = i - 1
        while self.word(before) in MODIFIERS or self.word(before) == "*":
            before -= 1
        parent = next((name for a, b, name in reversed(owners) if a < i < b), None)
        in_class = parent is not None and self._enclosing(i) in {a for a, _, _ in owners}
        opened = self._until(i + 1, "(", "{", ";", "=", ",") if self.word(i + 1) == "<" else i + 1  # behind type parameters
        if self.word(opened) != "(" or self.word(before) not in ("{", ",", "}", ";") or (self.word(before) in ("}", ";") and not in_class):
            return False
        block = self._block_after(opened)
        if block is None or (not in_class and self.word(before) == "{" and block != self.pair[opened] + 1):
            return False
        self.ranges.append((opened, self.pair[block], self._add("function", i, parent if in_class else "")))
        return True

    def _enclosing(self, i: int) -> int:
        """The brace around a token."""
        return self._around[i]

    def _read(self) -> None:
        self._around, stack = [-1] * len(self.tokens), []
        for i in range(len(self.tokens)):
            while stack and self.pair[stack[-1]] <= i:
                stack.pop()
            self._around[i] = stack[-1] if stack else -1
            if self.pair[i] > i:
                stack.append(i)
        self._known: set[int] = set()
        classes: list[tuple[int, int, str]] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "mark":
                if t.text == "=>":
                    self.ranges.append((i, self._body(i + 1), -1))  # its owner's range, if it has a name, begins before
                continue
            if t.kind != "name" or self.word(i - 1) in (".", "?."):
                continue
            if t.text in ("import", "export"):
                self._import(i)
            elif t.text == "require" and self.word(i + 1) == "(" and self.word(i + 2)[:1] in ("'", '"'):
                self._add("import", i + 2, name=self.word(i + 2)[1:-1])
            elif t.text == "class":
                brace = self._until(i, "{")
                if brace < len(self.tokens):
                    name = self.word(i + 1) if self.is_name(i + 1) else ""
                    classes.append((brace, self.pair[brace], name))
                    self.ranges.append((i, self.pair[brace], -1))
                    if name and not (_operator(self.tokens[i - 1]) if i else False):
                        self._add("class", i + 1)
            elif t.text == "function":
                at = i + 1 + (self.word(i + 1) == "*")
                opened = self._until(at, "(")
                block = self._block_after(opened) if opened < len(self.tokens) else None
                if block is not None:
                    first = i - (self.word(i - 1) == "async")
                    declared = self.is_name(at) and not (_operator(self.tokens[first - 1]) if first else False)
                    self.ranges.append((i, self.pair[block], self._add("function", at) if declared else -1))
            elif t.text in ("const", "let", "var"):
                self._declared(i + 1)
            elif t.text not in KEYWORDS:
                self._method(i, classes)
        self._calls()

    def _import(self, i: int) -> None:
        """The source of an import, a re-export or an import call."""
        if self.word(i + 1) == "(":
            if self.word(i + 2)[:1] in ("'", '"'):
                self._add("import", i + 2, name=self.word(i + 2)[1:-1])
            return
        at = i + 1
        if self.word(i) == "export" and self.word(at) not in ("{", "*", "type"):
            return
        while at < len(self.tokens) and self.word(at) not in (";", "="):
            if self.tokens[at].kind == "string" and (self.word(at - 1) == "from" or at == i + 1):
                self._add("import", at, name=self.word(at)[1:-1])
                return
            at = self.pair[at] + 1
            if at < len(self.tokens) and self.tokens[at].fresh and self.word(at) in ("import", "export", "const", "function", "class"):
                return

    def _calls(self) -> None:
        """Gives each call to the innermost range around it."""
        # The arrow of a function with a name is that function.
        first: dict[int, int] = {}
        for a, b, r in self.ranges:
            if r >= 0:
                first[b] = min(a, first.get(b, a))
        spans = sorted((a, -b, r) for a, b, r in self.ranges if r >= 0 or self.word(a) != "=>" or first.get(b, a + 1) > a)
        heads = {a for a, _, r in self.ranges if r >= 0}
        stack: list[tuple[int, int]] = []
        n = 0
        for i, t in enumerate(self.tokens):
            while stack and stack[-1][0] < i:
                stack.pop()
            while n < len(spans) and spans[n][0] <= i:
                if -spans[n][1] >= i:
                    stack.append((-spans[n][1], spans[n][2]))
                n += 1
            called = self.is_name(i) and self.word(i + 1) == "(" and self.word(i - 1) not in ("function", "new", "*") and i + 1 not in heads and not (t.text == "async" and self.word(self.pair[i + 1] + 1) in ("=>", ":"))
            if called and stack and stack[-1][1] >= 0 and t.text not in self.rows[stack[-1][1]][6]:
                self.rows[stack[-1][1]][6].append(t.text)


def _operator(token: Token) -> bool:
    """Whether what follows a token is an expression."""
    return token.text in ("=", "(", ",", ":", "?", "=>", "[", "return", "new", "&", "|", "!", "+", "extends", "await", "typeof", "throw", "yield")


def parse_script(content: str) -> list[tuple]:
    """kind, name, qualified name, parent, line, column and calls of every import, class and function, in order; a function name counts once."""
    rows, seen = [], set()
    for row in sorted(Script(content).rows, key=lambda r: (r[4], r[5])):
        if row[0] != "function" or row[2] not in seen:
            rows.append(tuple(row))
        if row[0] == "function":
            seen.add(row[2])
    return rows
