"""A template compiler for chat formats: source to syntax tree, constants folded, Python closures generated.

The language has text, ``{{ expression }}``, ``{# comment #}`` and the statements ``for``, ``if``/``elif``/``else``,
``set`` and ``generation``, whose output is what a model is trained on. A ``-`` inside a tag's edge takes the white
space beside it away. Expressions have literals, names, ``.field``, ``[index]``, slices, filters (``|``), tests
(``is``), arithmetic on whole numbers, ``+`` and ``~`` for strings, comparisons, ``in``, logic, ``a if b else c`` and the call
``raise_exception(message)``. Nothing else can be called, fields are those of mappings only, and loops run over
given lists, so a template can neither reach Python objects nor run without end.

``Template.streams`` tells whether a conversation can be rendered turn by turn: its messages are met by one outer
loop only, and nothing asks for their number or for another message.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable


class TemplateError(ValueError):
    """The source is not of the language, or a rendering asks for what is not there."""


class _Undefined:
    def __bool__(self) -> bool:
        return False


UNDEFINED = _Undefined()
#: What a control string starts with, and one in a text with a backslash more.
_OPENING, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """The text without ``<|``: each ``<``, backslashes, ``|`` gets one more backslash."""
    return _OPENING.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_line(text: str) -> str:
    """Escaped, and in one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.DOTALL)


def _text(value) -> str:
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, bool | int):
        return "" if value is None else str(value)
    raise TemplateError("an undefined value cannot be written" if value is UNDEFINED else f"a {type(value).__name__} cannot be written")


def _length(value) -> int:
    if isinstance(value, str | list | dict):
        return len(value)
    raise TemplateError("only texts, lists and mappings have a length")


#: The filters and tests of the language.
FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "string": _text,
    "length": _length,
    "default": lambda x, other="": other if x is UNDEFINED else x,
    "escape": lambda x: escape(_text(x)),
    "escape_line": lambda x: escape_line(_text(x)),
}
TESTS: dict[str, Callable] = {
    "defined": lambda x: x is not UNDEFINED,
    "undefined": lambda x: x is UNDEFINED,
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "mapping": lambda x: isinstance(x, dict),
    "sequence": lambda x: isinstance(x, list | str),
}


def _add(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("only two texts or two whole numbers can be added")


def _whole(f):
    def run(a, b):
        if isinstance(a, int) and isinstance(b, int):
            return f(a, b)
        raise TemplateError("only whole numbers can be reckoned with")

    return run


def _within(a, b):
    if isinstance(b, list | dict) or isinstance(b, str) and isinstance(a, str):
        return a in b
    raise TemplateError("nothing can be in this value")


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key, UNDEFINED) if isinstance(key, str) else UNDEFINED
    if isinstance(value, list | str) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else UNDEFINED
    raise TemplateError(f"a {type(value).__name__} has no such items")


def _slice(value, a, b):
    if isinstance(value, list | str):
        return value[a:b]
    raise TemplateError("only texts and lists have slices")


def _raise(message):
    raise TemplateError(_text(message))


#: What a node of an expression does with the values of its children; all but ``raise`` may be folded.
WORK: dict[str, Callable] = {
    "+": _add, "~": lambda a, b: _text(a) + _text(b), "-": _whole(operator.sub), "%": _whole(operator.mod),
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": _within, "not": operator.not_, "item": _item, "slice": _slice, "raise": _raise,
}

_TAG = re.compile(r"\{%(-?)(.*?)(-?)%\}|\{\{(-?)(.*?)(-?)\}\}|\{#(-?).*?(-?)#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[-+~%<>|.,:()\[\]=]))", re.DOTALL)
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEPT = {"or", "and", "not", "in", "is", "if", "else"}
_CONTROL = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one tag; nodes are tuples whose first part is their kind."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def next_is(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in words

    def take(self, *words: str) -> str | None:
        if self.next_is(*words):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"{word!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at][1] not in _KEPT:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self):
        node = self.choice()
        self.end()
        return node

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"not understood: {self.tokens[self.at][1]!r}")

    def choice(self):
        node = self.either()
        if self.take("if"):
            condition = self.either()
            return ("if", condition, node, self.choice() if self.take("else") else ("const", ""))
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.summed()
        while True:
            if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                node = (sign, node, self.summed())
            elif self.next_is("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                node = ("not", ("in", node, self.summed()))
            elif self.take("is"):
                other, test = self.take("not"), self.take("none", "None") or self.name()
                test = test.lower()
                if test not in TESTS:
                    raise TemplateError(f"no such test: {test}")
                node = ("test", test, node)
                node = ("not", node) if other else node
            else:
                return node

    def summed(self):
        node = self.scaled()
        while sign := self.take("+", "-", "~"):
            node = (sign, node, self.scaled())
        return node

    def scaled(self):
        node = self.held()
        while self.take("%"):
            node = ("%", node, self.held())
        return node

    def held(self):
        if self.take("-"):
            return ("-", ("const", 0), self.held())
        node = self.primary()
        while True:
            if self.take("."):
                node = ("item", node, ("const", self.name()))
            elif self.take("["):
                node = self.bracket(node)
            elif self.take("|"):
                name, given = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"no such filter: {name}")
                if self.take("("):
                    while not self.take(")"):
                        given.append(self.choice())
                        if not self.next_is(")"):
                            self.need(",")
                node = ("filter", name, node, *given)
            else:
                return node

    def bracket(self, node):
        first = None if self.next_is(":") else self.choice()
        if self.take(":"):
            last = ("const", None) if self.next_is("]") else self.choice()
            self.need("]")
            return ("slice", node, first or ("const", None), last)
        self.need("]")
        return ("item", node, first)

    def primary(self):
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, word = self.tokens[self.at]
        if kind == "text":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: _CONTROL.get(m[1], m[1]), word[1:-1], flags=re.DOTALL))
        if kind == "number":
            self.at += 1
            return ("const", int(word))
        if kind == "name" and word in _WORDS:
            self.at += 1
            return ("const", _WORDS[word])
        name = self.name()
        if self.take("("):
            if name != "raise_exception":
                raise TemplateError(f"{name} cannot be called")
            node = ("raise", self.choice())
            self.need(")")
            return node
        return ("name", name)


def _pieces(source: str):
    """Texts and tags in order, with the white space taken that tags take."""
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if m[1] or m[4] or m[7] else text
        if m[2] is not None:
            yield "tag", m[2].strip()
        elif m[5] is not None:
            yield "show", m[5]
        at, strip = m.end(), bool(m[3] or m[6] or m[8])
    yield "text", source[at:].lstrip() if strip else source[at:]


def parse(source: str) -> list[tuple]:
    """The statements of a template."""
    stack: list[tuple[str, tuple, list]] = [("", (), [])]
    for kind, piece in _pieces(source):
        body = stack[-1][2]
        if kind == "text":
            if piece:
                body.append(("text", piece))
            continue
        if kind == "show":
            body.append(("show", _Expression(piece).whole()))
            continue
        word, _, rest = piece.partition(" ")
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            stack.append(("for", (name, e.whole()), []))
        elif word == "if":
            stack.append(("if", (_Expression(rest).whole(),), []))
        elif word in ("elif", "else") and stack[-1][0] == "if" and not (len(stack[-1][1]) > 1 and stack[-1][1][-1] == "else"):
            head, held, body = stack.pop()
            condition = _Expression(rest).whole() if word == "elif" else ("const", True)
            stack.append((head, (*held[: len(held) - len(held) % 1], body, condition, *(["else"] if word == "else" else [])), []))
        elif word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            body.append(("set", name, e.whole()))
        elif word == "generation":
            stack.append(("generation", (), []))
        elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] == word[3:]:
            head, held, body = stack.pop()
            if head == "if":
                held = [x for x in (*held, body) if x != "else"]
                node = ("if", [(held[i], held[i + 1]) for i in range(0, len(held), 2)])
            else:
                node = (head, *held, body)
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"not understood here: {piece!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return stack[0][2]


def _fold_expression(node):
    kind = node[0]
    if kind in ("const", "name"):
        return node
    named = kind in ("filter", "test")
    rest = [_fold_expression(x) for x in node[1 + named :]]
    node = (kind, *node[1 : 1 + named], *rest)
    if kind in ("or", "and", "if") and rest[0][0] == "const":
        chosen = bool(rest[0][1])
        return rest[1 if chosen else 2] if kind == "if" else rest[0] if chosen == (kind == "or") else rest[1]
    if kind != "raise" and all(x[0] == "const" for x in rest):
        try:
            return ("const", _expression(node)({}))
        except (TemplateError, TypeError):
            return node  # it fails when it is rendered, if it is
    return node


def fold(body: list[tuple]) -> list[tuple]:
    """The same template with constants reckoned, dead branches gone and neighbouring texts joined."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "show":
            node = ("show", _fold_expression(node[1]))
            if node[1][0] == "const" and node[1][1] is not UNDEFINED:
                node = ("text", _text(node[1][1]))
        elif kind == "set":
            node = ("set", node[1], _fold_expression(node[2]))
        elif kind == "for":
            node = ("for", node[1], _fold_expression(node[2]), fold(node[3]))
        elif kind == "generation":
            node = ("generation", fold(node[1]))
        elif kind == "if":
            branches = []
            for condition, own in node[1]:
                condition = _fold_expression(condition)
                if condition[0] != "const" or condition[1]:
                    branches.append((condition, fold(own)))
                if condition[0] == "const" and condition[1]:
                    break
            if not branches:
                continue
            if branches[0][0][0] == "const":
                for x in branches[0][1]:
                    _append(out, x)
                continue
            node = ("if", branches)
        _append(out, node)
    return out


def _append(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _expression(node) -> Callable[[dict], object]:
    """A closure from the names' values to the expression's."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name, UNDEFINED)
    if kind == "if":
        condition, a, b = map(_expression, node[1:])
        return lambda env: a(env) if condition(env) else b(env)
    if kind == "or":
        a, b = map(_expression, node[1:])
        return lambda env: a(env) or b(env)
    if kind == "and":
        a, b = map(_expression, node[1:])
        return lambda env: a(env) and b(env)
    named = kind in ("filter", "test")
    work = {"filter": FILTERS, "test": TESTS}[kind][node[1]] if named else WORK[kind]
    parts = [_expression(x) for x in node[1 + named :]]
    if len(parts) == 1:
        (a,) = parts
        return lambda env: work(a(env))
    if len(parts) == 2:
        a, b = parts
        return lambda env: work(a(env), b(env))
    return lambda env: work(*[x(env) for x in parts])


class Out:
    """What is rendered so far: texts, their code points, and the spans under the generation marker."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        found = "".join(self.parts), self.spans
        self.__init__()
        return found


def _statements(body: list[tuple]) -> Callable[[dict, Out], None]:
    steps = [_statement(x) for x in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for step in steps:
            step(env, out)

    return run


def _statement(node) -> Callable[[dict, Out], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.write(text)
    if kind == "show":
        shown = _expression(node[1])
        return lambda env, out: out.write(_text(shown(env)))
    if kind == "set":
        name, value = node[1], _expression(node[2])
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "generation":
        inner = _statements(node[1])

        def marked(env, out):
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return marked
    if kind == "if":
        branches = [(_expression(c), _statements(own)) for c, own in node[1]]

        def chosen(env, out):
            for condition, own in branches:
                if condition(env):
                    own(env, out)
                    return

        return chosen
    name, items, inner = node[1], _expression(node[2]), _statements(node[3])

    def loop(env, out):
        held = items(env)
        if not isinstance(held, list):
            raise TemplateError("loops run over lists")
        for i, item in enumerate(held):
            inner(_turn(env, name, item, i, i == len(held) - 1, len(held)), out)

    return loop


def _turn(env: dict, name: str, item, index: int, last: bool, length: int | None = None) -> dict:
    """What an iteration sees: names set inside it do not outlive it."""
    loop = {"index": index + 1, "index0": index, "first": index == 0, "last": last}
    return env | {name: item, "loop": loop if length is None else loop | {"length": length}}


def _mentions(node, found) -> bool:
    return isinstance(node, tuple | list) and (isinstance(node, tuple) and found(node) or any(_mentions(x, found) for x in node))


class Template:
    """A compiled template over ``messages``, a list of mappings, and further values by name."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _statements(self.tree)
        of_messages = lambda n: n == ("name", "messages")
        loops = [i for i, n in enumerate(self.tree) if n[0] == "for" and n[2] == ("name", "messages")]
        self.streams = len(loops) == 1 and not _mentions([n for i, n in enumerate(self.tree) if i != loops[0]], of_messages)
        if self.streams:
            at = loops[0]
            _, self._name, _, body = self.tree[at]
            counts = lambda n: n == ("item", ("name", "loop"), ("const", "length")) or n[0] == "set" and n[1] == "loop"
            plain = lambda n: n == ("name", "loop")
            fields = lambda n: n[0] == "item" and n[1] == ("name", "loop") and n[2][0] == "const"
            whole = sum(_count(body, plain)) != sum(_count(body, fields))
            self.streams = not (_mentions(body, of_messages) or _mentions(body, counts) or whole)
            self._before, self._each, self._after = (_statements(x) for x in (self.tree[:at], body, self.tree[at + 1 :]))

    def render(self, messages: list[dict], **values) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        self._run(values | {"messages": messages}, out)
        return out.take()

    def pieces(self, messages, most: int, **values):
        """Text, spans and number of messages of each piece; a piece ends after the message that makes it ``most`` long.

        ``messages`` is any iterable. Where the template streams, only the piece at hand is held.
        """
        out, env, held = Out(), dict(values), 0
        if not self.streams:
            whole = list(messages)
            self._run(env | {"messages": whole}, out)
            yield *out.take(), len(whole)
            return
        self._before(env, out)
        index, ahead = 0, next(messages := iter(messages), None)
        while ahead is not None:
            now, ahead = ahead, next(messages, None)
            self._each(_turn(env, self._name, now, index, ahead is None), out)
            index, held = index + 1, held + 1
            if out.length >= most and ahead is not None:
                yield *out.take(), held
                held = 0
        self._after(env, out)
        yield *out.take(), held


def _count(node, found):
    if isinstance(node, tuple | list):
        if isinstance(node, tuple) and found(node):
            yield 1
        for x in node:
            yield from _count(x, found)
