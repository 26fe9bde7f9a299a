"""A small sandboxed template language: parser, constant folding, and closures that render.

    text   {{ expr }}   {% for x in expr %} {% endfor %}   {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% set x = expr %}   {% generation %} {% endgeneration %}

Expressions: names, 'text', "text", numbers, true, false, none; x.key and x['key'] (keys of mappings only, never
attributes of Python objects); + ~ == != in not and or; parentheses; x | filter. Inside a loop: loop.index0, loop.first,
loop.last. There are no calls; filters are the functions the caller hands over. An unknown key or name is none, and none
renders as nothing.

Rendering yields (text, masked) pieces one by one, masked inside a generation block, and takes loops item by item, so an
endless list of messages is rendered in constant memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from itertools import chain
from typing import Any

Piece = tuple[str, bool]
Scope = dict[str, Any]
Value = Callable[[Scope], Any]
Body = Callable[[Scope, bool], Iterator[Piece]]


class TemplateError(ValueError):
    """A template that does not follow the language."""


# --- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: Any
    key: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class Assign:
    name: str
    of: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parser

_PART = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.\[\]()+~|=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str) -> None:
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise TemplateError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append(next((k, x) for k, x in zip(("str", "int", "name", "op"), m.groups(), strict=True) if x is not None))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.peek() in _WORDS:
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _left(self, below: Callable[[], Any], *ops: str) -> Any:
        out = below()
        while op := self.take(*ops):
            out = Binary(op, out, below())
        return out

    def either(self) -> Any:
        return self._left(self.both, "or")

    def both(self) -> Any:
        return self._left(self.negated, "and")

    def negated(self) -> Any:
        return Not(self.negated()) if self.take("not") else self._left(self.joined, "==", "!=", "in")

    def joined(self) -> Any:
        return self._left(self.filtered, "+", "~")

    def filtered(self) -> Any:
        out = self.atom()
        while op := self.take(".", "[", "|"):
            if op == ".":
                out = Get(out, Const(self.name()))
            elif op == "|":
                out = Filter(self.name(), out)
            else:
                out = Get(out, self.either())
                self.need("]")
        return out

    def atom(self) -> Any:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("str", "int"):
            kind, text = self.tokens[self.at]
            self.at += 1
            return Const(int(text) if kind == "int" else re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        name = self.name()
        return Const(_CONSTANTS[name]) if name in _CONSTANTS else Name(name)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in _PART.finditer(source):
        parts += [("text", source[at : m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    parts = [p for p in [*parts, ("text", source[at:])] if p[0] != "text" or p[1]]
    body, rest, stop = _block(parts, 0)
    if stop:
        raise TemplateError(f"unexpected {stop!r}")
    assert rest == len(parts)
    return body


def _block(parts: list[tuple[str, str]], at: int) -> tuple[tuple, int, str]:
    """Nodes up to a tag that ends a block, the place behind that tag, and the tag."""
    nodes: list[Any] = []
    while at < len(parts):
        kind, text = parts[at]
        at += 1
        if kind == "text":
            nodes.append(Output(Const(text)))
        elif kind == "out":
            nodes.append(Output(_Expression(text).whole()))
        else:
            word, _, rest = text.partition(" ")
            if word in ("endfor", "endif", "else", "elif", "endgeneration"):
                return tuple(nodes), at, text
            if word == "set":
                e = _Expression(rest)
                name = e.name()
                e.need("=")
                nodes.append(Assign(name, e.whole()))
            elif word == "for":
                e = _Expression(rest)
                name = e.name()
                e.need("in")
                over = e.whole()
                body, at, stop = _block(parts, at)
                _ends(stop, "endfor")
                nodes.append(For(name, over, body))
            elif word == "if":
                node, at = _if(rest, parts, at)
                nodes.append(node)
            elif word == "generation":
                body, at, stop = _block(parts, at)
                _ends(stop, "endgeneration")
                nodes.append(Generation(body))
            else:
                raise TemplateError(f"unknown tag {word!r}")
    return tuple(nodes), at, ""


def _ends(stop: str, wanted: str) -> None:
    if stop != wanted:
        raise TemplateError(f"{wanted!r} expected, found {stop!r}")


def _if(test: str, parts: list[tuple[str, str]], at: int) -> tuple[If, int]:
    body, at, stop = _block(parts, at)
    other: tuple = ()
    if stop.startswith("elif "):
        node, at = _if(stop[5:], parts, at)
        other = (node,)
    else:
        if stop == "else":
            other, at, stop = _block(parts, at)
        _ends(stop, "endif")
    return If(_Expression(test).whole(), body, other), at


# --- values


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _apply(op: str, left: Any, right: Any) -> Any:
    if op == "==":
        return left == right
    if op == "!=":
        return left != right
    if op == "in":
        return right is not None and left in right
    if op == "+" and isinstance(left, int) and isinstance(right, int):
        return left + right
    return _text(left) + _text(right)


# --- constant folding


def fold(nodes: Iterable[Any], filters: Mapping[str, Callable[[str], str]]) -> tuple:
    """The same template with constant expressions computed, dead branches gone and neighbouring texts joined."""
    out: list[Any] = []
    for node in nodes:
        for new in _folded(node, filters):
            if isinstance(new, Output) and isinstance(new.of, Const):
                new = Output(Const(_text(new.of.value)))
                if not new.of.value:
                    continue
                if out and isinstance(out[-1], Output) and isinstance(out[-1].of, Const):
                    new = Output(Const(out.pop().of.value + new.of.value))
            out.append(new)
    return tuple(out)


def _folded(node: Any, filters: Mapping) -> tuple:
    if isinstance(node, Output | Assign):
        return (replace(node, of=_fold_value(node.of, filters)),)
    if isinstance(node, If):
        test = _fold_value(node.test, filters)
        if isinstance(test, Const):
            return fold(node.body if test.value else node.other, filters)
        return (If(test, fold(node.body, filters), fold(node.other, filters)),)
    if isinstance(node, For):
        return (For(node.name, _fold_value(node.over, filters), fold(node.body, filters)),)
    return (Generation(fold(node.body, filters)),)


def _fold_value(node: Any, filters: Mapping) -> Any:
    if isinstance(node, Get):
        return Get(_fold_value(node.of, filters), _fold_value(node.key, filters))
    if isinstance(node, Not):
        of = _fold_value(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = _fold_value(node.of, filters)
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Binary):
        left, right = _fold_value(node.left, filters), _fold_value(node.right, filters)
        if isinstance(left, Const) and node.op in ("and", "or"):
            return right if bool(left.value) == (node.op == "and") else left
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(_apply(node.op, left.value, right.value))
        return Binary(node.op, left, right)
    return node


# --- closures


def _value(node: Any, filters: Mapping) -> Value:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        return lambda scope, name=node.name: scope.get(name)
    if isinstance(node, Get):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def get(scope: Scope) -> Any:
            found = of(scope)
            return found.get(key(scope)) if isinstance(found, dict) else None

        return get
    if isinstance(node, Not):
        of = _value(node.of, filters)
        return lambda scope: not of(scope)
    if isinstance(node, Filter):
        of, apply = _value(node.of, filters), filters[node.name]
        return lambda scope: apply(_text(of(scope)))
    left, right, op = _value(node.left, filters), _value(node.right, filters), node.op
    if op == "and":
        return lambda scope: left(scope) and right(scope)
    if op == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope: _apply(op, left(scope), right(scope))


def _body(nodes: tuple, filters: Mapping) -> Body:
    steps = [_step(n, filters) for n in nodes]
    return lambda scope, masked: chain.from_iterable(s(scope, masked) for s in steps)


def _step(node: Any, filters: Mapping) -> Body:
    if isinstance(node, Output):
        if isinstance(node.of, Const):
            return lambda scope, masked, text=node.of.value: ((text, masked),)
        of = _value(node.of, filters)
        return lambda scope, masked: ((_text(of(scope)), masked),)
    if isinstance(node, Assign):
        of, name = _value(node.of, filters), node.name

        def assign(scope: Scope, masked: bool) -> tuple:
            scope[name] = of(scope)
            return ()

        return assign
    if isinstance(node, If):
        test, yes, no = _value(node.test, filters), _body(node.body, filters), _body(node.other, filters)
        return lambda scope, masked: (yes if test(scope) else no)(scope, masked)
    if isinstance(node, Generation):
        inside = _body(node.body, filters)
        return lambda scope, masked: inside(scope, True)
    over, body, name = _value(node.over, filters), _body(node.body, filters), node.name

    def loop(scope: Scope, masked: bool) -> Iterator[Piece]:
        items, nothing = iter(over(scope) or ()), object()
        item, index = next(items, nothing), 0
        while item is not nothing:
            after = next(items, nothing)
            state = {"index0": index, "first": index == 0, "last": after is nothing}
            yield from body(scope | {name: item, "loop": state}, masked)
            item, index = after, index + 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable[[str], str]] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of the template's names that yields (text, masked) pieces."""
    filters = filters or {}
    body = _body(fold(parse(source), filters), filters)
    return lambda **names: body(names, False)
