"""Evidence in TypeScript sources by a stack scanner: nested scopes, template literals and regular expressions, without a grammar.

A text becomes tokens with their brackets matched; what a bracket that isn't matched, or an unfinished string, comment or template, leaves is an error and so a diagnostic. Evidence is read off the tokens:
functions (declarations, expressions, arrows, methods), calls with their whole callee and arguments, conditions, throws, declarators, type aliases and interfaces. Types aren't checked, and
JSX is read as tokens, so its text may hide calls. Positions are characters; the caller turns them into lines and byte columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<name>[A-Za-z_$#\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)"
    r"|(?P<string>\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<mark>=>|\?\.(?!\d)|\.\.\.|[-+*/%&|^!=<>?]+=|\+\+|--|&&|\|\||\?\?|\*\*|[\s\S])"
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Fixed values of the language: words after which an operand comes, words that are no callee, and modifiers of members.
_BEFORE_OPERAND = frozenset("return typeof case in of instanceof new delete void throw await yield else do extends default".split())
_NO_CALLEE = frozenset("if for while switch catch with function return typeof await yield throw new delete void in of instanceof case do else".split())
_STATEMENTS = frozenset("type interface const let var function class export import if for while return throw switch enum declare".split())
_MODIFIERS = frozenset("async get set static public private protected readonly override abstract declare".split())
_CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}


@dataclass(slots=True)
class Token:
    kind: str
    start: int
    end: int
    text: str
    mate: int = -1


@dataclass(frozen=True)
class Found:
    """A piece of evidence: kind, node type, where it stands, and its fields."""

    kind: str
    node_type: str
    start: int
    end: int
    fields: dict


def tokens(text: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """Tokens with matched brackets, and the places of comments. A template literal is a bracket whose substitutions are tokens like others."""
    out: list[Token] = []
    comments: list[tuple[int, int]] = []
    stack: list[int] = []
    at = 0
    jsx = "/>" in text or "</" in text  # there, quotes may be text

    def add(kind: str, end: int) -> None:
        nonlocal at
        out.append(Token(kind, at, end, text[at:end]))
        at = end

    def template() -> None:
        """Goes on in a template literal until it ends or a substitution starts."""
        nonlocal at
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                opening = stack.pop()
                add("mark", at + 1)
                out[opening].mate, out[-1].mate = len(out) - 1, opening
                return
            elif text.startswith("${", at):
                add("mark", at + 2)
                stack.append(len(out) - 1)
                return
            else:
                at += 1
        raise ValueError("invalid TypeScript syntax: unfinished template")

    while at < len(text):
        if text[at] == "`":
            add("mark", at + 1)
            stack.append(len(out) - 1)
            template()
            continue
        if text[at] == "/" and not text.startswith(("//", "/*"), at) and _operand_next(out) and (m := _REGEX.match(text, at)):
            add("regex", m.end())
            continue
        m = _TOKEN.match(text, at)
        kind = m.lastgroup
        if kind == "space":
            at = m.end()
        elif kind == "comment":
            comments.append((at, m.end()))
            at = m.end()
        elif text.startswith("/*", at):
            raise ValueError("invalid TypeScript syntax: unfinished comment")
        else:
            add(kind, m.end())
            mark = out[-1].text
            if kind == "mark" and mark in "\"'" and not jsx:
                raise ValueError("invalid TypeScript syntax: unfinished string")
            if kind == "mark" and mark in _CLOSES:
                stack.append(len(out) - 1)
            elif kind == "mark" and mark in ")]}":
                if not stack or _CLOSES.get(out[stack[-1]].text) != mark:
                    raise ValueError(f"invalid TypeScript syntax: {mark} without its opening")
                opening = stack.pop()
                out[opening].mate, out[-1].mate = len(out) - 1, opening
                if out[opening].text == "${":
                    template()
    if stack:
        raise ValueError(f"invalid TypeScript syntax: {out[stack[-1]].text} is never closed")
    return out, comments


def _operand_next(out: list[Token]) -> bool:
    """Whether an operand may follow, so that a slash starts a regular expression."""
    if not out:
        return True
    t = out[-1]
    if t.kind == "name":
        return t.text in _BEFORE_OPERAND
    return t.kind == "mark" and t.text not in (")", "]", "}", "`", "++", "--")


class Scan:
    """The evidence of one text."""

    def __init__(self, text: str):
        self.text = text
        self.t, self.comments = tokens(text)
        #: the innermost bracket around each token
        self.around: list[int] = []
        stack = [-1]
        for k, t in enumerate(self.t):
            if t.mate >= 0 and t.mate < k:
                stack.pop()
            self.around.append(stack[-1])
            if t.mate > k:
                stack.append(k)

    def _is(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind not in ("string", "regex") and self.t[k].text in texts

    def _name(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "name"

    def _slice(self, a: int, b: int) -> str:
        """Text from token a to token b, both included."""
        return self.text[self.t[a].start : self.t[b].end]

    def _new_line(self, k: int) -> bool:
        return "\n" in self.text[self.t[k - 1].end : self.t[k].start]

    def _next_statement(self, k: int) -> bool:
        """Whether a statement ends before token k, at a line end that the next line can't go on over."""
        if not self._new_line(k):
            return False
        t = self.t[k]
        if t.kind == "name" and t.text in _STATEMENTS and not self._is(k - 1, "=", "=>", "(", ",", "return", "|", "&"):
            return True
        goes_on = t.kind == "mark" and t.text not in ("{", "`", "++", "--", "!") or self._is(k, "as", "in", "of", "instanceof", "satisfies")
        return not goes_on and not _operand_next([self.t[k - 1]])

    def _expression_end(self, k: int) -> int:
        """The last token of the expression that starts at k."""
        first, last = k, k - 1
        while k < len(self.t):
            t = self.t[k]
            if self._is(k, ",", ";", ")", "]", "}"):
                break
            if last >= first and self._next_statement(k):
                break
            last = t.mate if t.mate > k else k
            k = last + 1
        return last

    def _statement_end(self, k: int) -> int:
        """The last token of the statement that starts at k."""
        if self._is(k, "{"):
            return self.t[k].mate
        if self._is(k, "if"):
            return self._if_end(k)
        if self._is(k, "for", "while", "with") and self._is(k + 1, "("):
            return self._statement_end(self.t[k + 1].mate + 1)
        end = self._expression_end(k)
        return end + 1 if self._is(end + 1, ";") else max(end, k)

    def _if_end(self, k: int) -> int:
        end = self._statement_end(self.t[k + 1].mate + 1)
        return self._statement_end(end + 2) if self._is(end + 1, "else") else end

    def _body(self, k: int) -> int | None:
        """The brace that opens the body of a function whose parameters end before token k, after a return type."""
        if self._is(k, ":"):
            k += 1
            while k < len(self.t) and not self._is(k, ";", ",", "=", "=>", ")", "]", "}"):
                if self._is(k, "{") and not self._is(k - 1, ":", "|", "&", "<", "=>"):
                    return k
                k = (self.t[k].mate if self.t[k].mate > k else k) + 1
            return None
        return k if self._is(k, "{") else None

    def _after_types(self, k: int) -> int:
        """The token after type parameters in angle brackets at k, if there are any."""
        if not self._is(k, "<"):
            return k
        depth = 0
        while k < len(self.t):
            depth += self.t[k].text.count("<") - (0 if self._is(k, "=>") else self.t[k].text.count(">")) if self.t[k].kind == "mark" else 0
            k = (self.t[k].mate if self.t[k].mate > k else k) + 1
            if depth <= 0:
                return k
        return k

    def _before_types(self, k: int) -> int:
        """The token before type arguments in angle brackets that end at k; k if there are none."""
        if not self._is(k, ">", ">>"):
            return k
        depth, j = 0, k
        while j >= 0:
            t = self.t[j]
            if t.kind == "mark" and t.text in ("<", ">", ">>"):
                depth += t.text.count(">") - t.text.count("<")
                if depth == 0:
                    return j - 1 if self._name(j - 1) else k
            elif not (t.kind in ("name", "string") or self._is(j, ".", ",", "|", "&", "[", "]")):
                return k
            j -= 1
        return k

    def found(self) -> list[Found]:
        """All evidence, outer before inner."""
        #: braces of interfaces, in which there are no calls
        self.bodies: set[int] = set()
        out = [*self._functions(), *self._statements(), *self._calls()]
        return sorted(out, key=lambda f: (f.start, -f.end, f.kind))

    def _make(self, kind: str, node_type: str, a: int, b: int, **fields) -> Found:
        return Found(kind, node_type, self.t[a].start, self.t[b].end, fields)

    def _functions(self) -> Iterator[Found]:
        self.parameters: set[int] = set()  # brackets of parameters, which aren't calls
        for k, t in enumerate(self.t):
            if t.kind == "name" and t.text == "function" and not self._is(k - 1, ".", "?."):
                j = k + 1 + self._is(k + 1, "*")
                name = self.t[j].text if self._name(j) else None
                j = self._after_types(j + (name is not None))
                if self._is(j, "(") and (body := self._body(self.t[j].mate + 1)) is not None:
                    self.parameters.add(j)
                    a = k - 1 if self._is(k - 1, "async") else k
                    stands = a == 0 or self._is(a - 1, ";", "}", "{", "export", "default", ")") or (self._new_line(a) and not _operand_next([self.t[a - 1]]))
                    yield self._make("function", "function_declaration" if stands and name else "function_expression", a, self.t[body].mate, name=name)
            elif t.kind == "mark" and t.text == "=>":
                if (a := self._arrow_start(k)) is not None:
                    b = self.t[k + 1].mate if self._is(k + 1, "{") else self._expression_end(k + 1)
                    yield self._make("function", "arrow_function", a, b, name=None)
            elif t.kind in ("name", "string") and not (t.kind == "name" and t.text in _NO_CALLEE) and self._is(self.around[k], "{"):
                j = self._after_types(k + 1)
                if not self._is(j, "(") or not self._member_place(k) or (body := self._body(self.t[j].mate + 1)) is None:
                    continue
                self.parameters.add(j)
                a = k
                while self._is(a - 1, "*") or (self._name(a - 1) and self.t[a - 1].text in _MODIFIERS):
                    a -= 1
                yield self._make("function", "method_definition", a, self.t[body].mate, name=t.text)

    def _member_place(self, k: int) -> bool:
        while self._is(k - 1, "*") or (self._name(k - 1) and self.t[k - 1].text in _MODIFIERS):
            k -= 1
        return self._is(k - 1, "{", "}", ";", ",", ")") or (k > 0 and self._new_line(k))

    def _arrow_start(self, k: int) -> int | None:
        """The first token of an arrow function's parameters."""
        j = k - 1
        if self._is(j, ")"):
            a = self.t[j].mate
        elif self._name(j) and not self._is(j - 1, ".", "|", "&", ">") and not (self._is(j - 1, ":") and self._is(j - 2, ")")):
            a = j
        else:  # a return type: back to the bracket that a colon follows
            while j >= 0 and self.around[j] == self.around[k] and not self._is(j, ";", "=", ",", "=>"):
                j = self.t[j].mate if 0 <= self.t[j].mate < j else j
                if self._is(j, ":") and self._is(j - 1, ")"):
                    break
                j -= 1
            if not (self._is(j, ":") and self._is(j - 1, ")")):
                return None
            a = self.t[j - 1].mate
        # types of functions have arrows too: after a colon or in an alias they have no body of their own
        if self._is(a, "("):
            self.parameters.add(a)
            if self._is(a - 1, ">"):
                depth, j = 1, a - 2
                while j >= 0 and depth:
                    depth += self._is(j, ">") - self._is(j, "<")
                    j -= 1
                a = j + 1
        if self._is(a - 1, "async"):
            a -= 1
        return None if self._in_type(a) else a

    def _in_type(self, a: int) -> bool:
        """Whether an arrow that starts at token a is the type of a function."""
        if self._is(a - 1, ":"):
            # a property of an object literal has a value after its colon, everything else a type
            opening, j = self.around[a], a - 2
            if self._is(opening, "{") and (self._name(j) or self.t[j].kind in ("string", "number") or self._is(j, "]")) and self._is(j - 1, "{", ","):
                return self._is(opening - 1, ":", "|", "&") or self._name(opening - 1) and self._is(opening - 2, "interface") or self._type_statement(opening)
            return True
        return self._is(a - 1, "|", "&") or self._type_statement(a)

    def _type_statement(self, k: int) -> bool:
        """Whether token k stands in a type alias."""
        j = k - 1
        while j >= 0 and not self._is(j, ";", "{", "}"):
            if self._is(j, "type") and self._name(j + 1) and (self._is(j + 2, "=", "<")):
                return True
            j -= 1
        return False

    def _callee_start(self, k: int) -> int | None:
        """The first token of the callee whose argument list opens at k; None if nothing is called."""
        j = self._before_types(k - 1)
        if self._is(j, "?."):
            j -= 1
        first = True
        while True:
            t = self.t[j] if j >= 0 else None
            if t is None:
                return None
            if self._is(j, ")", "]", "`"):
                a = t.mate
                if a < 0:
                    return None
                # a bracket goes on with what stands before it, unless an operand can't
                before = self._before_types(a - 1)
                if before >= 0 and ((self._name(before) and self.t[before].text not in _NO_CALLEE) or self._is(before, ")", "]", "`", "!") or self._is(before, "?.")):
                    j = before - 1 if self._is(before, "?.", "!") else before
                    first = False
                    continue
                if self._is(j, "]"):
                    return None
                j = a
            elif t.kind == "name":
                if t.text in _NO_CALLEE or (first and t.text in ("constructor",) and self.t[k].mate > 0 and self._is(self.t[k].mate + 1, "{")):
                    return None
            elif self._is(j, "!"):
                j -= 1
                first = False
                continue
            elif not first and t.kind in ("string", "number", "regex"):
                pass
            else:
                return None
            if self._is(j - 1, ".", "?."):
                j -= 2
                first = False
                continue
            return j

    def _calls(self) -> Iterator[Found]:
        for k, t in enumerate(self.t):
            if not (t.kind == "mark" and t.text == "(") or k in self.parameters or k == 0:
                continue
            a = self._callee_start(k)
            if a is None or self._signature(a, k):
                continue
            if self._is(a - 1, "new"):
                inner = next((j for j in range(a, k) if self._is(j, "(") and self.around[j] == self.around[k]), None)
                if inner is None:
                    continue  # the arguments are the constructor's
                a -= 1
            elif self._is(a - 1, "function", "class", "interface"):
                continue
            upto = self._before_types(k - 1)
            upto = upto - 1 if self._is(upto, "?.") else upto
            yield self._make("call", "call_expression", a, t.mate, callee=self._slice(a, upto), arguments=self._parts(k))

    def _signature(self, a: int, k: int) -> bool:
        """Whether what starts at token a and has its bracket at k declares a member without a body."""
        if self.around[k] in self.bodies or self._type_statement(a):
            return True
        return self._is(self.t[k].mate + 1, ":") and self._is(self.around[k], "{") and self._member_place(a) and not self._is(a - 1, "?")

    def _parts(self, k: int) -> list[str]:
        """Texts between the commas of the bracket at k."""
        out, first = [], k + 1
        j = k + 1
        while j <= self.t[k].mate:
            if j == self.t[k].mate or self._is(j, ","):
                if first < j:
                    out.append(self._slice(first, j - 1))
                first = j + 1
            j = (self.t[j].mate if self.t[j].mate > j else j) + 1
        return out

    def _statements(self) -> Iterator[Found]:
        for k, t in enumerate(self.t):
            if t.kind != "name" or self._is(k - 1, ".", "?."):
                continue
            if t.text == "if" and self._is(k + 1, "("):
                yield self._make("if", "if_statement", k, self._if_end(k), condition=self._slice(k + 1, self.t[k + 1].mate))
            elif t.text == "throw" and not self._is(k + 1, ":"):
                end = self._expression_end(k + 1)
                if end > k:
                    yield self._make("throw", "throw_statement", k, end + 1 if self._is(end + 1, ";") else end, expression=self._slice(k + 1, end))
            elif t.text in ("const", "let", "var") and not self._is(k + 1, "enum", ":"):
                yield from self._declarators(k)
            elif t.text in ("type", "interface") and self._name(k + 1) and (k == 0 or self._new_line(k) or self._is(k - 1, ";", "{", "}", "export", "declare", "default")):
                j = self._after_types(k + 2)
                if t.text == "type" and self._is(j, "="):
                    end = self._expression_end(j + 1)
                    yield self._make("type_alias", "type_alias_declaration", k, end + 1 if self._is(end + 1, ";") else end, name=self.t[k + 1].text)
                elif t.text == "interface":
                    while j < len(self.t) and not self._is(j, "{"):
                        j += 1
                    if j < len(self.t):
                        self.bodies.add(j)
                        yield self._make("interface", "interface_declaration", k, self.t[j].mate, name=self.t[k + 1].text)

    def _declarators(self, k: int) -> Iterator[Found]:
        j = k + 1
        while self._name(j) or self._is(j, "{", "["):
            a = j
            name_end = self.t[j].mate if self._is(j, "{", "[") else j
            j = name_end + 1 + self._is(name_end + 1, "!")
            if self._is(j, "of", "in"):
                return  # the variable of a loop
            if self._is(j, ":"):
                j += 1
                while j < len(self.t) and not self._is(j, "=", ",", ";", ")", "}") and not self._next_statement(j):
                    if self._is(j, "of", "in") and self._is(self.around[k], "("):
                        return
                    j = self._after_types(j) if self._is(j, "<") else (self.t[j].mate if self.t[j].mate > j else j) + 1
            end, value = j - 1, None
            if self._is(j, "="):
                end = self._expression_end(j + 1)
                value = self._slice(j + 1, end) if end > j else None
            yield self._make("declaration", "variable_declarator", a, end, name=self._slice(a, name_end), value=value)
            j = end + 1
            if not self._is(j, ","):
                return
            j += 1
