"""A sandboxed template language for chat formats, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% statement %}`` and ``{# comment #}``; a ``-`` inside a tag strips the
white space on its side. Statements: ``for x in list``, ``if`` / ``elif`` / ``else``, ``set x = expression`` and
``generation``, whose output is what a model has to learn; the places of all such output are recorded. Expressions: texts,
integers, ``true``, ``false``, ``none``, lists, names, ``a.b``, ``a[b]``, ``+ - * // % ~``, comparisons, ``in``, ``and``,
``or``, ``not``, ``a if c else b`` and filters (``x | trim``). Inside a loop, ``loop`` has index, index0, first and last.

The sandbox: a name or a key is looked up in mappings and lists that the caller gives, never as an attribute; there are no
calls but filters from a fixed table; texts can't be multiplied, and loops only run over given lists.

Compilation is in three steps: a syntax tree, folding of all that is constant (operators and filters on constants, branches
that can't be taken, neighbouring texts), and one closure for each node that is left.
"""

from __future__ import annotations

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

TAG = re.compile(r"(\{\{-?|\{%-?|\{#)")
TOKEN = re.compile(r"\s*(?:(?P<int>\d+)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*%~<>=.,|()\[\]]))", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
WORDS = {"and", "or", "not", "in", "if", "else", "elif", "for", "set", "is", "endif", "endfor", "generation", "endgeneration"}


class TemplateError(ValueError):
    """A template that can't be compiled, or a value that it can't use."""


# The tree. Expressions are Const, Name, Get, Op, Cond, Items and Filter; statements Text, Out, For, If, Set and Mark.
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Cond:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Items:
    items: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    of: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (test, body); the test of "else" is Const(True)


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Mark:
    body: tuple


def _tags(source: str) -> Iterator[tuple[str, str]]:
    """("text", ...), ("out", inside) and ("do", inside) in order."""
    at, strip = 0, False
    while True:
        m = TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if m is None:
            yield "text", text
            return
        opening = m[0]
        yield "text", text.rstrip() if opening.endswith("-") else text
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[opening[:2]]
        end = _closing(source, m.end(), close)
        inside = source[m.end() : end]
        strip = close != "#}" and inside.endswith("-")
        if close != "#}":
            yield "out" if close == "}}" else "do", inside[:-1] if strip else inside
        at = end + 2


def _closing(source: str, at: int, close: str) -> int:
    """Where a tag ends; its mark may stand inside a quoted text."""
    quote = ""
    while at < len(source):
        c = source[at]
        if quote:
            at += 1 + (c == "\\")
            quote = "" if c == quote else quote
            continue
        if source.startswith(close, at):
            return at
        quote = c if c in "'\"" and close != "#}" else ""
        at += 1
    raise TemplateError(f"a tag has no {close}")


class _Expression:
    """Recursive descent over the tokens of one tag."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "//", "%"))

    def __init__(self, source: str):
        self.tokens, self.at, pos = [], 0, 0
        while source[pos:].strip():
            m = TOKEN.match(source, pos)
            if m is None:
                raise TemplateError(f"can't read {source[pos:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        return "" if kind == "text" else text

    def take(self, *wanted: str) -> str:
        if self.at >= len(self.tokens) or wanted and self.peek() not in wanted:
            raise TemplateError(f"{self.peek() or 'the end'!r} where {' or '.join(wanted) or 'a value'} is needed")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.peek() in WORDS:
            raise TemplateError(f"{self.peek() or 'the end'!r} is no name")
        if self.peek().startswith("_"):
            raise TemplateError("names don't start with an underscore")
        return self.take()

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.peek()!r} is one too many")

    def value(self):
        found = self.level(0)
        if self.peek() == "if":
            self.take()
            test = self.level(0)
            self.take("else")
            return Cond(test, found, self.value())
        return found

    def level(self, k: int):
        if k == len(self.LEVELS):
            return self.filtered()
        ops = self.LEVELS[k]
        if ops == ("not",):
            if self.peek() == "not":
                self.take()
                return Op("not", (self.level(k),))
            return self.level(k + 1)
        found = self.level(k + 1)
        while self.peek() in ops or self.peek() == "not" and "in" in ops:
            op = self.take()
            if op == "not":
                self.take("in")
                found = Op("not", (Op("in", (found, self.level(k + 1))),))
            else:
                found = Op(op, (found, self.level(k + 1)))
        return found

    def filtered(self):
        if self.peek() == "-":
            self.take()
            return Op("neg", (self.filtered(),))
        found = self.atom()
        while self.peek() in (".", "[", "|"):
            op = self.take()
            if op == ".":
                found = Get(found, Const(self.name()))
            elif op == "[":
                found = Get(found, self.value())
                self.take("]")
            else:
                name, args = self.name(), [found]
                if self.peek() == "(":
                    args += self.listed(")")
                found = Filter(name, tuple(args))
        return found

    def listed(self, close: str) -> list:
        self.take()
        out = []
        while self.peek() != close or self.at < len(self.tokens) and self.tokens[self.at][0] == "text":
            out.append(self.value())
            if self.peek() != close:
                self.take(",")
        self.take(close)
        return out

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, text = self.tokens[self.at]
        if kind == "int":
            return Const(int(self.take()))
        if kind == "text":
            self.take()
            return Const(ESCAPED.sub(lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if text == "[":
            return Items(tuple(self.listed("]")))
        if text == "(":
            self.take()
            found = self.value()
            self.take(")")
            return found
        if text.lower() in ("true", "false", "none"):
            self.take()
            return Const({"true": True, "false": False, "none": None}[text.lower()])
        return Name(self.name())


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    tags = list(_tags(source))
    at = 0

    def block(*ends: str) -> tuple[tuple, str, _Expression | None]:
        nonlocal at
        body = []
        while at < len(tags):
            kind, inside = tags[at]
            at += 1
            if kind == "text":
                body.append(Text(inside))
                continue
            e = _Expression(inside)
            if kind == "out":
                body.append(Out(e.value()))
                e.end()
                continue
            word = e.take()
            if word in ends:
                return tuple(body), word, e
            body.append(statement(word, e))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(body), "", None

    def statement(word: str, e: _Expression):
        if word == "for":
            name = e.name()
            e.take("in")
            of = e.value()
            e.end()
            body, _, last = block("endfor")
            last.end()
            return For(name, of, body)
        if word == "if":
            branches = []
            while True:
                test = Const(True) if word == "else" else e.value()
                e.end()
                body, word, e = block("endif") if word == "else" else block("elif", "else", "endif")
                branches.append((test, body))
                if word == "endif":
                    e.end()
                    return If(tuple(branches))
        if word == "set":
            name = e.name()
            e.take("=")
            value = e.value()
            e.end()
            return Set(name, value)
        if word == "generation":
            e.end()
            body, _, last = block("endgeneration")
            last.end()
            return Mark(body)
        raise TemplateError(f"{word!r} is no statement")

    return block()[0]


def _said(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} can't be put out")


def _number(f: Callable) -> Callable:
    def run(*args):
        if any(not isinstance(a, int) or isinstance(a, bool) for a in args):
            raise TemplateError("only integers can be reckoned with")
        return f(*args)

    return run


def _add(a, b):
    return a + b if isinstance(a, str) and isinstance(b, str) else _number(operator.add)(a, b)


def _get(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    if of is None:
        return None
    raise TemplateError(f"a {type(of).__name__} has no parts")


OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b, "not": operator.not_,
    "+": _add, "~": lambda a, b: _said(a) + _said(b), "neg": _number(operator.neg), **{k: _number(f) for k, f in (("-", operator.sub), ("*", operator.mul), ("//", operator.floordiv), ("%", operator.mod))},
}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: _said(x).strip(), "upper": lambda x: _said(x).upper(), "lower": lambda x: _said(x).lower(), "length": len,
    "default": lambda x, other="": other if x is None else x, "join": lambda x, by="": by.join(map(_said, x)), "replace": lambda x, a, b: _said(x).replace(a, b),
}


def _applied(f: Callable, args: Iterable) -> object:
    try:
        return f(*args)
    except (TypeError, AttributeError, ZeroDivisionError) as e:
        raise TemplateError(str(e)) from None


class Template:
    """A compiled template. ``filters`` adds to the table of filters; they have to be pure, as constants are folded."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.source, self.filters = source, FILTERS | (filters or {})
        self.tree = self._fold_body(parse(source))

    # Folding.

    def _fold(self, e):
        if isinstance(e, Op) and e.op in ("and", "or"):
            a, b = map(self._fold, e.args)
            if isinstance(a, Const):
                return (b if a.value else a) if e.op == "and" else (a if a.value else b)
            return Op(e.op, (a, b))
        if isinstance(e, Op):
            args = tuple(map(self._fold, e.args))
            return Const(_applied(OPERATORS[e.op], [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(e.op, args)
        if isinstance(e, Filter):
            if e.name not in self.filters:
                raise TemplateError(f"there is no filter {e.name!r}")
            args = tuple(map(self._fold, e.args))
            return Const(_applied(self.filters[e.name], [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Filter(e.name, args)
        if isinstance(e, Get):
            of, key = self._fold(e.of), self._fold(e.key)
            if isinstance(key, Const) and isinstance(key.value, str) and key.value.startswith("_"):
                raise TemplateError("keys don't start with an underscore")
            return Const(_get(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Get(of, key)
        if isinstance(e, Cond):
            test, yes, no = map(self._fold, (e.test, e.yes, e.no))
            return (yes if test.value else no) if isinstance(test, Const) else Cond(test, yes, no)
        if isinstance(e, Items):
            items = tuple(map(self._fold, e.items))
            return Const([x.value for x in items]) if all(isinstance(x, Const) for x in items) else Items(items)
        return e

    def _fold_body(self, body: Iterable) -> tuple:
        out: list = []
        for s in body:
            if isinstance(s, Out):
                value = self._fold(s.value)
                s = Text(_said(value.value)) if isinstance(value, Const) else Out(value)
            elif isinstance(s, Set):
                s = Set(s.name, self._fold(s.value))
            elif isinstance(s, For):
                s = For(s.name, self._fold(s.of), self._fold_body(s.body))
            elif isinstance(s, Mark):
                s = Mark(self._fold_body(s.body))
            elif isinstance(s, If):
                left = []
                for test, body_ in s.branches:
                    test = self._fold(test)
                    if isinstance(test, Const) and not test.value:
                        continue
                    left.append((test, self._fold_body(body_)))
                    if isinstance(test, Const):
                        break
                if not left or isinstance(left[0][0], Const):
                    self._join(out, left[0][1] if left else ())
                    continue
                s = If(tuple(left))
            self._join(out, [s])
        return tuple(out)

    @staticmethod
    def _join(out: list, more: Iterable) -> None:
        for s in more:
            if isinstance(s, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + s.text)
            elif not (isinstance(s, Text) and not s.text):
                out.append(s)

    # Closures: an expression takes the names, a statement the names and where to put its output.

    def _value(self, e) -> Callable[[dict], object]:
        if isinstance(e, Const):
            value = e.value
            return lambda env: value
        if isinstance(e, Name):
            name = e.name
            return lambda env: env.get(name)
        if isinstance(e, Get):
            of, key = self._value(e.of), self._value(e.key)
            return lambda env: _get(of(env), key(env))
        if isinstance(e, Cond):
            test, yes, no = map(self._value, (e.test, e.yes, e.no))
            return lambda env: yes(env) if test(env) else no(env)
        if isinstance(e, Items):
            items = list(map(self._value, e.items))
            return lambda env: [x(env) for x in items]
        args = list(map(self._value, e.args))
        if isinstance(e, Op) and e.op in ("and", "or"):
            a, b = args
            return (lambda env: a(env) and b(env)) if e.op == "and" else (lambda env: a(env) or b(env))
        f = OPERATORS[e.op] if isinstance(e, Op) else self.filters[e.name]
        if len(args) == 1:
            only = args[0]
            return lambda env: _applied(f, (only(env),))
        return lambda env: _applied(f, [a(env) for a in args])

    def _body(self, body: Iterable) -> Callable[[dict, Output], None]:
        steps = [self._statement(s) for s in body]

        def run(env: dict, out: Output) -> None:
            for step in steps:
                step(env, out)

        return steps[0] if len(steps) == 1 else run

    def _statement(self, s) -> Callable[[dict, Output], None]:
        if isinstance(s, Text):
            text = s.text
            return lambda env, out: out.put(text)
        if isinstance(s, Out):
            value = self._value(s.value)
            return lambda env, out: out.put(_said(value(env)))
        if isinstance(s, Set):
            name, value = s.name, self._value(s.value)
            return lambda env, out: env.__setitem__(name, value(env))
        if isinstance(s, Mark):
            body = self._body(s.body)

            def marked(env: dict, out: Output) -> None:
                start = out.size
                body(env, out)
                out.spans.append((start, out.size))

            return marked
        if isinstance(s, If):
            branches = [(self._value(test), self._body(body)) for test, body in s.branches]

            def chosen(env: dict, out: Output) -> None:
                for test, body in branches:
                    if test(env):
                        return body(env, out)

            return chosen
        name, of, body = s.name, self._value(s.of), self._body(s.body)

        def repeated(env: dict, out: Output) -> None:
            items = of(env)
            if not isinstance(items, (list, tuple)):
                raise TemplateError(f"{type(items).__name__} is no list")
            for k, item in enumerate(items):
                body(env | {name: item, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": k == len(items) - 1}}, out)

        return repeated

    def render(self, **names: object) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the places of all generated output in it, in code points."""
        out = Output()
        self._body(self.tree)(dict(names), out)
        return out.text(), out.spans

    def over(self, name: str) -> tuple[Callable, Callable, Callable]:
        """What comes before, for each item of, and after the one outer loop over the list ``name``, as three closures.

        So a long list can be rendered in parts. The first and last take (names, output), the middle one takes
        (names, output, item, index0, last). Only this loop may refer to the list.
        """
        loops = [k for k, s in enumerate(self.tree) if isinstance(s, For) and s.of == Name(name)]
        if len(loops) != 1 or _refers(self.tree[: loops[0]] + self.tree[loops[0]].body + self.tree[loops[0] + 1 :], name) or any(isinstance(s, Set) for s in self.tree):
            raise TemplateError(f"the template has to be a single loop over {name}, with text around it and nothing set outside")
        at = loops[0]
        body, item_name = self._body(self.tree[at].body), self.tree[at].name

        def each(env: dict, out: Output, item: object, index0: int, last: bool) -> None:
            body(env | {item_name: item, "loop": {"index0": index0, "index": index0 + 1, "first": index0 == 0, "last": last}}, out)

        return self._body(self.tree[:at]), each, self._body(self.tree[at + 1 :])


def _refers(node: object, name: str) -> bool:
    if isinstance(node, Name):
        return node.name == name
    if isinstance(node, (tuple, list)):
        return any(_refers(x, name) for x in node)
    return hasattr(node, "__dataclass_fields__") and any(_refers(getattr(node, f), name) for f in node.__dataclass_fields__ if not isinstance(getattr(node, f), str))


class Output:
    """Text as it grows, and where generated output stands in it."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)
