"""A compiler for a small sandboxed template language that formats conversations.

Text stands for itself; ``{{ expr }}`` writes a value, ``{# ... #}`` is a remark, and
there are the statements ``if / elif / else / endif``, ``for x in expr / endfor``,
``set x = expr`` and ``generation / endgeneration``, which marks what a model has
to produce. ``-`` beside a sign trims white space on its side. Expressions know
strings, whole numbers, lists, ``true false none``, names, ``a.b`` and ``a[b]``, ``| filter``,
``+ - * % ~``, comparisons, ``in``, ``not and or``, ``x if c else y`` and ``is defined``. There
is nothing else: no calls, no attributes of Python objects, no names but the variables given
and those that the template sets, so a template cannot reach outside.

A template is parsed into a tree, constant parts are folded, and the tree becomes
nested Python closures, each of which writes to a ``Sink``. Where ``messages`` is used
by one loop at the top only, the template takes them as a stream, one message at a time
with one more looked ahead for ``loop.last``, and what it wrote may be taken away in between.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template can't be compiled, or a value it meets can't be used so."""


# --- Values that are written -------------------------------------------------

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """``text`` without ``<|``: the sign is taken apart by one more backslash than there is, which ``unescape`` takes away."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_line(text: str) -> str:
    """``escape`` for what has to stay on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def _text(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (str, int)):
        return str(v)
    raise TemplateError(f"a {type(v).__name__} can't be written")


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)), "escape_line": lambda v: escape_line(_text(v)), "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(), "length": len, "string": _text, "first": lambda v: v[0] if v else None, "last": lambda v: v[-1] if v else None,
}


# --- Tree --------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """An operator or filter over its arguments; ``lazy`` ones decide which they need."""

    op: str
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class Put:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- Parsing -----------------------------------------------------------------

_SIGNS = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>()\[\].,|=]))")
_BACKSLASHED = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "is", "if", "else", *_WORDS}


def _tokens(code: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while code[at:].strip():
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"unexpected {code[at:].strip()[:20]!r}")
        kind = m.lastgroup
        v: object = m[kind]
        if kind == "int":
            v = int(v)
        elif kind == "str":
            v = re.sub(r"\\(.)", lambda x: _BACKSLASHED.get(x[1], x[1]), v[1:-1], flags=re.DOTALL)
        out.append((kind, v))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression, loosest binding first."""

    LEVELS = [("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "%")]

    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", None)

    def take(self, value=None):
        kind, v = self.peek()
        if kind == "end" or value is not None and (kind not in ("op", "name") or v != value):
            raise TemplateError(f"expected {value or 'a value'}, found {'the end' if kind == 'end' else v!r}")
        self.at += 1
        return kind, v

    def ahead(self, *values) -> bool:
        return self.peek()[0] in ("op", "name") and self.peek()[1] in values

    def whole(self):
        e = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return e

    def choice(self):
        e = self.any_of()
        if self.ahead("if"):
            self.take()
            test = self.any_of()
            self.take("else")
            return Apply("choice", (test, e, self.choice()))
        return e

    def any_of(self):
        e = self.all_of()
        while self.ahead("or"):
            self.take()
            e = Apply("or", (e, self.all_of()))
        return e

    def all_of(self):
        e = self.negated()
        while self.ahead("and"):
            self.take()
            e = Apply("and", (e, self.negated()))
        return e

    def negated(self):
        if self.ahead("not"):
            self.take()
            return Apply("not", (self.negated(),))
        return self.binary(0)

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.unary()
        e = self.binary(level + 1)
        while True:
            op = "not in" if self.ahead("not") and self.peek(1) == ("name", "in") else self.peek()[1]
            if self.peek()[0] not in ("op", "name") or op not in self.LEVELS[level]:
                return e
            self.at += 2 if op == "not in" else 1
            e = Apply(op, (e, self.binary(level + 1)))

    def unary(self):
        if self.ahead("-"):
            self.take()
            return Apply("negative", (self.unary(),))
        return self.tail(self.atom())

    def atom(self):
        kind, v = self.take()
        if kind in ("int", "str"):
            return Const(v)
        if kind == "name" and v in _WORDS:
            return Const(_WORDS[v])
        if kind == "name" and v not in _RESERVED:
            return Name(v)
        if v == "(":
            e = self.choice()
            self.take(")")
            return e
        if v == "[":
            items = []
            while not self.ahead("]"):
                items.append(self.choice())
                if not self.ahead("]"):
                    self.take(",")
            self.take("]")
            return ListOf(tuple(items))
        raise TemplateError(f"unexpected {v!r}")

    def tail(self, e):
        while True:
            if self.ahead("."):
                self.take()
                kind, v = self.take()
                if kind != "name":
                    raise TemplateError("a name has to follow the dot")
                e = Item(e, Const(v))
            elif self.ahead("["):
                self.take()
                e = Item(e, self.choice())
                self.take("]")
            elif self.ahead("|"):
                self.take()
                v = self.take()[1]
                if v not in FILTERS:
                    raise TemplateError(f"there is no filter {v!r}")
                e = Apply(f"|{v}", (e,))
            elif self.ahead("is"):
                self.take()
                no = self.ahead("not")
                if no:
                    self.take()
                self.take("defined")
                e = Apply("not", (Apply("defined", (e,)),)) if no else Apply("defined", (e,))
            else:
                return e


def _expression(code: str):
    return _Expression(_tokens(code)).whole()


def _cut(source: str) -> list[tuple[str, str]]:
    """(kind, code) of the parts of a template: text, write, do."""
    out, at, trim = [], 0, False
    while True:
        m = _SIGNS.search(source, at)
        text = source[at:m.start()] if m else source[at:]
        if trim:
            text = text.lstrip()
        if m and m[0].endswith("-"):
            text = text.rstrip()
        out.append(("text", text))
        if not m:
            return [x for x in out if x[0] != "text" or x[1]]
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        # Signs within strings don't close.
        inner = re.compile(r"(?:[^'\"]|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")*?" + re.escape(close), re.DOTALL)
        end = inner.match(source, m.end()) if close != "#}" else re.compile(r".*?#\}", re.DOTALL).match(source, m.end())
        if not end:
            raise TemplateError(f"{m[0]} is not closed")
        code = end[0][:-2]
        trim = code.endswith("-")
        if close != "#}":
            out.append(("write" if close == "}}" else "do", code.removesuffix("-").strip()))
        at = end.end()


def parse(source: str) -> tuple:
    """The tree of a template."""
    parts = _cut(source)
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out = []
        while at < len(parts):
            kind, code = parts[at]
            at += 1
            if kind == "text":
                out.append(Write(Const(code)))
            elif kind == "write":
                out.append(Write(_expression(code)))
            else:
                word, _, rest = code.partition(" ")
                if word in ends:
                    return tuple(out), code
                out.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), ""

    def branches(test: str):
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_expression(test), then, (branches(end[4:]),))
        return If(_expression(test), then, block("endif")[0] if end == "else" else ())

    def statement(word: str, rest: str):
        if word == "if":
            return branches(rest)
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m or m[1] in _RESERVED:
                raise TemplateError(f"for {rest}: expected a name, in, and a value")
            return For(m[1], _expression(m[2]), block("endfor")[0])
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)
            if not m or m[1] in _RESERVED:
                raise TemplateError(f"set {rest}: expected a name, =, and a value")
            return Put(m[1], _expression(m[2]))
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"there is no statement {word!r}")

    return block()[0]


# --- Folding -----------------------------------------------------------------


def _plus(a, b):
    if isinstance(a, str) != isinstance(b, str):
        raise TemplateError("text and numbers can't be added; ~ joins them")
    return a + b


def _times(a, b):
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("* and % take whole numbers")
    return a * b


def _rest(a, b):
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("* and % take whole numbers")
    return a % b


OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
    "~": lambda a, b: _text(a) + _text(b), "+": _plus, "-": operator.sub, "*": _times, "%": _rest, "not": operator.not_, "negative": operator.neg,
} | {f"|{n}": f for n, f in FILTERS.items()}


def fold(node):
    """An expression with its constant parts worked out."""
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, ListOf):
        items = tuple(map(fold, node.items))
        return Const([x.value for x in items]) if all(isinstance(x, Const) for x in items) else ListOf(items)
    if not isinstance(node, Apply):
        return node
    args = tuple(map(fold, node.args))
    first = args[0].value if isinstance(args[0], Const) else None
    known = isinstance(args[0], Const)
    if node.op == "choice":
        return (args[1] if first else args[2]) if known else Apply(node.op, args)
    if node.op in ("and", "or"):
        return (args[1] if bool(first) == (node.op == "and") else args[0]) if known else Apply(node.op, args)
    if node.op == "defined":
        return Const(True) if known else Apply(node.op, args)
    if all(isinstance(a, Const) for a in args):
        return Const(_use(OPERATORS[node.op], *[a.value for a in args]))
    return Apply(node.op, args)


def fold_block(nodes: Iterable) -> tuple:
    """A block whose constant texts are joined and whose branches with a known test are gone."""
    out: list = []

    def add(n):
        if isinstance(n, Write) and isinstance(n.value, Const):
            text = _text(n.value.value)
            if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                out[-1] = Write(Const(out[-1].value.value + text))
            elif text:
                out.append(Write(Const(text)))
        else:
            out.append(n)

    for n in nodes:
        if isinstance(n, Write):
            add(Write(fold(n.value)))
        elif isinstance(n, Put):
            out.append(Put(n.name, fold(n.value)))
        elif isinstance(n, If):
            test = fold(n.test)
            if isinstance(test, Const):
                for x in fold_block(n.then if test.value else n.other):
                    add(x)
            else:
                out.append(If(test, fold_block(n.then), fold_block(n.other)))
        elif isinstance(n, For):
            out.append(For(n.name, fold(n.over), fold_block(n.body)))
        else:
            out.append(Generation(fold_block(n.body)))
    return tuple(out)


# --- Closures ----------------------------------------------------------------


@dataclass
class Sink:
    """Takes the text as it is written, and where generation begins and ends, in characters of all that was written."""

    parts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    at: int = 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        """What was written since the last time, and its spans."""
        out = "".join(self.parts), self.spans
        self.parts, self.spans = [], []
        return out


class _Missing:
    """What isn't there; written as nothing, and false."""

    def __bool__(self):
        return False


MISSING = _Missing()


def _use(f, *args):
    if any(a is MISSING for a in args):
        args = tuple(None if a is MISSING else a for a in args)
    try:
        return f(*args)
    except (TypeError, IndexError, ZeroDivisionError) as e:
        raise TemplateError(f"a value can't be used so: {e}") from None


def _value(node) -> Callable[[dict], object]:
    """The closure of an expression: a function of the variables."""
    if isinstance(node, Const):
        v = node.value
        return lambda env: v
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name, MISSING)
    if isinstance(node, ListOf):
        items = [_value(x) for x in node.items]
        return lambda env: [x(env) for x in items]
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(env):
            o, k = of(env), key(env)
            if isinstance(o, dict) and isinstance(k, str):
                return o.get(k, MISSING)
            if isinstance(o, (list, str)) and isinstance(k, int) and not isinstance(k, bool):
                return o[k] if -len(o) <= k < len(o) else MISSING
            return MISSING

        return item
    args = [_value(a) for a in node.args]
    if node.op == "choice":
        test, yes, no = args
        return lambda env: yes(env) if test(env) else no(env)
    if node.op in ("and", "or"):
        a, b = args
        return (lambda env: b(env) if a(env) else a(env)) if node.op == "and" else (lambda env: a(env) or b(env))
    if node.op == "defined":
        return lambda env: args[0](env) is not MISSING
    f = OPERATORS[node.op]
    if len(args) == 1:
        one = args[0]
        return lambda env: _use(f, one(env))
    left, right = args
    return lambda env: _use(f, left(env), right(env))


def _looped(over: Iterable):
    """(item, loop) with one item looked ahead."""
    it, n = iter(over), 0
    now = next(it, MISSING)
    while now is not MISSING:
        after = next(it, MISSING)
        yield now, {"index": n + 1, "index0": n, "first": n == 0, "last": after is MISSING}
        now, n = after, n + 1


def _block(nodes: tuple) -> Callable[[dict, Sink], None]:
    """The closure of a block: it writes to a sink what the variables make of it."""
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env, sink):
        for s in steps:
            s(env, sink)

    return run


def _step(n) -> Callable[[dict, Sink], None]:
    if isinstance(n, Write):
        if isinstance(n.value, Const):
            text = n.value.value
            return lambda env, sink: sink.write(text)
        value = _value(n.value)

        def write(env, sink):
            v = value(env)
            sink.write(v if type(v) is str else "" if v is MISSING else _text(v))

        return write
    if isinstance(n, Put):
        name, value = n.name, _value(n.value)
        return lambda env, sink: env.__setitem__(name, value(env))
    if isinstance(n, If):
        test, then, other = _value(n.test), _block(n.then), _block(n.other)
        return lambda env, sink: then(env, sink) if test(env) else other(env, sink)
    if isinstance(n, For):
        name, over, body = n.name, _value(n.over), _block(n.body)

        def loop(env, sink):
            items = over(env)
            if items is MISSING or items is None:
                return
            if isinstance(items, (str, dict, int)):
                raise TemplateError(f"a {type(items).__name__} can't be looped over")
            for item, state in _looped(items):  # what a loop sets is gone after each turn
                body(env | {name: item, "loop": state}, sink)

        return loop
    body = _block(n.body)

    def generation(env, sink):
        start = sink.at
        body(env, sink)
        if sink.at > start:
            sink.spans.append((start, sink.at))

    return generation


def _names(node, found: list[str]) -> list[str]:
    """All names that a tree or part of it reads."""
    if isinstance(node, Name):
        found.append(node.name)
    elif isinstance(node, tuple):
        for x in node:
            _names(x, found)
    elif hasattr(node, "__dataclass_fields__"):
        for f in node.__dataclass_fields__:
            _names(getattr(node, f), found)
    return found


@dataclass(frozen=True)
class Template:
    """A compiled template: ``before``, then ``each`` message as ``name`` if it takes them as a stream, then ``after``."""

    source: str
    tree: tuple
    before: Callable[[dict, Sink], None]
    name: str | None = None
    each: Callable[[dict, Sink], None] | None = None
    after: Callable[[dict, Sink], None] | None = None

    def stream(self, messages: Iterable[dict], sink: Sink, **more):
        """Writes to the sink and pauses after each message of a stream; other templates get all messages at once."""
        if self.each is None:
            self.before({**more, "messages": list(messages)}, sink)
            return
        env = dict(more)
        self.before(env, sink)
        for item, state in _looped(messages):
            self.each(env | {self.name: item, "loop": state}, sink)
            yield
        self.after(env, sink)

    def render(self, messages: Iterable[dict], **more) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans of what is generated."""
        sink = Sink()
        for _ in self.stream(messages, sink, **more):
            pass
        return sink.take()


def compile_template(source: str) -> Template:
    """Parse, fold, and make closures; raises TemplateError for what the language doesn't have."""
    tree = fold_block(parse(source))
    loops = [i for i, n in enumerate(tree) if isinstance(n, For) and n.over == Name("messages")]
    if len(loops) == 1 and _names(tree, []).count("messages") == 1 and not any(isinstance(n, Put) and n.name == "messages" for n in tree):
        i = loops[0]
        return Template(source, tree, _block(tree[:i]), tree[i].name, _block(tree[i].body), _block(tree[i + 1:]))
    return Template(source, tree, _block(tree))
