"""A small sandboxed template language for conversations, compiled to Python closures.

Text stands for itself; `{{ expression }}` prints, `{% for x in messages %}`, `{% if %}` / `{% elif %}` / `{% else %}` and `{% generation %}`
have their `end...`. What lies inside `generation` is marked as text to learn from. Expressions: strings, numbers,
true, false, none, names, `.field`, `[index]`, `+`, `==`, `!=`, `in`, `not`, `and`, `or`, parentheses and `| filter`. Values come only
from the given variables by key, and filters only from a given table, so a template reaches nothing else.

Compiling: a syntax tree, constant folding (constant expressions and tests, neighbouring text), then one closure per node. The
closures yield pieces as they go and read `messages` one ahead, so a conversation of any length streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|.()\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Parses one expression to a tree of tuples."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.filters = 0, filters

    def whole(self):
        tree = self.any_of()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return fold(tree, self.filters)

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str):
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def any_of(self):
        tree = self.all_of()
        while self.take("or"):
            tree = ("or", tree, self.all_of())
        return tree

    def all_of(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.added()
        while op := self.take("==", "!=", "in"):
            tree = (op, tree, self.added())
        return tree

    def added(self):
        tree = self.reached()
        while self.take("+"):
            tree = ("+", tree, self.reached())
        return tree

    def reached(self):
        tree = self.single()
        while op := self.take(".", "[", "|"):
            if op == ".":
                tree = ("get", tree, ("const", self.name()))
            elif op == "[":
                tree = ("get", tree, self.any_of())
                self.need("]")
            else:
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", tree, ("const", name))
        return tree

    def single(self):
        if self.take("("):
            tree = self.any_of()
            self.need(")")
            return tree
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return "const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S)
        if kind == "number":
            return "const", int(value)
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("var", value)
        raise TemplateError(f"unexpected {value!r}")


def _get(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if key < len(value) else None
    return None


_BINARY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "get": _get}


def fold(tree, filters):
    """Evaluates the parts of an expression that hold no variable."""
    if tree[0] in ("const", "var"):
        return tree
    parts = [fold(x, filters) for x in tree[1:]]
    done = (tree[0], *parts)
    if all(p[0] == "const" for p in parts):
        return "const", closure(done, filters)({})
    if tree[0] in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (tree[0] == "and") else parts[0]
    return done


def closure(tree, filters) -> Callable[[dict], object]:
    """A function of the variables that evaluates the expression."""
    op = tree[0]
    if op == "const":
        value = tree[1]
        return lambda scope: value
    if op == "var":
        name = tree[1]
        return lambda scope: scope.get(name)
    left = closure(tree[1], filters)
    if op == "not":
        return lambda scope: not left(scope)
    if op == "filter":
        fn = filters[tree[2][1]]
        return lambda scope: fn(left(scope))
    right = closure(tree[2], filters)
    if op == "and":
        return lambda scope: left(scope) and right(scope)
    if op == "or":
        return lambda scope: left(scope) or right(scope)
    fn = _BINARY[op]
    return lambda scope: fn(left(scope), right(scope))


def _shown(value) -> str:
    return "" if value is None else str(value)


def parse(source: str, filters: dict[str, Callable]) -> list[tuple]:
    """Syntax tree of a template, folded."""
    root: list[tuple] = []
    stack: list[tuple[str, list, object]] = [("", root, None)]
    for part in _PARTS.split(source):
        body = stack[-1][1]
        if part.startswith("{#") or not part:
            continue
        if part.startswith("{{"):
            body.append(("print", _Expression(part[2:-2], filters).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"(\w+) in (\w+)", rest.strip())
                if not m:
                    raise TemplateError(f"cannot read {part!r}")
                node = ("for", m[1], m[2], [])
                body.append(node)
                stack.append(("for", node[3], node))
            elif word == "generation":
                node = ("generation", [])
                body.append(node)
                stack.append(("generation", node[1], node))
            elif word == "if":
                node = ("if", [(_Expression(rest, filters).whole(), [])])
                body.append(node)
                stack.append(("if", node[1][0][1], node))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                node = stack.pop()[2]
                node[1].append((_Expression(rest, filters).whole() if word == "elif" else ("const", True), []))
                stack.append(("if", node[1][-1][1], node))
            elif word == f"end{stack[-1][0]}" and len(stack) > 1:
                stack.pop()
            else:
                raise TemplateError(f"unexpected {part!r}")
        else:
            body.append(("text", part))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} has no end")
    return _folded(root)


def _folded(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "print" and node[1][0] == "const":
            node = ("text", _shown(node[1][1]))
        elif node[0] == "for":
            node = (*node[:3], _folded(node[3]))
        elif node[0] == "generation":
            node = ("generation", _folded(node[1]))
        elif node[0] == "if":
            arms = []
            for test, body in node[1]:
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, _folded(body)))
                if test[0] == "const":
                    break
            if not arms:
                continue
            if arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    _append(out, inner)
                continue
            node = ("if", arms)
        _append(out, node)
    return out


def _append(out: list[tuple], node: tuple):
    """Adds a node; text after text becomes one node."""
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _compiled(nodes: list[tuple], filters, learn: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(node, filters, learn) for node in nodes]

    def run(scope):
        for step in steps:
            yield from step(scope)

    return run


def _step(node: tuple, filters, learn: bool) -> Callable[[dict], Iterable[Piece]]:
    if node[0] == "text":
        piece = ((node[1], learn),)
        return lambda scope: piece
    if node[0] == "print":
        value = closure(node[1], filters)
        return lambda scope: ((_shown(value(scope)), learn),)
    if node[0] == "generation":
        return _compiled(node[1], filters, True)
    if node[0] == "if":
        arms = [(closure(test, filters), _compiled(body, filters, learn)) for test, body in node[1]]

        def choose(scope):
            for test, body in arms:
                if test(scope):
                    return body(scope)
            return ()

        return choose
    _, name, many, body = node
    inner = _compiled(body, filters, learn)

    def loop(scope):
        items, none = iter(scope.get(many) or ()), object()
        item, index = next(items, none), 0
        while item is not none:
            after = next(items, none)
            yield from inner({**scope, name: item, "loop": {"index": index + 1, "index0": index, "first": not index, "last": after is none}})
            item, index = after, index + 1

    return loop


class Template:
    """`render(messages, **variables)` yields (text, learn from it) pieces; `messages` may be any iterable of dicts."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tree = parse(source, filters)
        self._run = _compiled(self.tree, filters, False)

    def render(self, messages: Iterable[dict], **variables) -> Iterator[Piece]:
        return (p for p in self._run({"messages": messages, **variables}) if p[0])
