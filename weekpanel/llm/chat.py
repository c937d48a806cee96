"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constant parts are folded, and every node
becomes a Python closure; the closures render conversations piece by piece and mark the
pieces that a model should learn (``{% generation %}``).

Language: text; ``{{ expression }}``; ``{% if %} {% elif %} {% else %} {% endif %}``;
``{% for x in expression %} {% endfor %}`` (with ``loop.index``, ``loop.index0``,
``loop.first``, ``loop.last``); ``{% set x = expression %}``;
``{% generation %} {% endgeneration %}``; ``{# remark #}``; ``-`` inside a tag trims the
white space beside it.  Expressions: strings, whole numbers, true, false, none, names,
``x.key`` and ``x['key']``, ``not and or == != < <= > >= in ~``, ``a if b else c``, and the
filters of ``FILTERS`` after ``|``.  Sandbox: names come from the context alone, keys are
looked up in mappings alone (never attributes of objects), nothing can be called but the
filters, loops run over what the context holds, and nesting is bounded by ``DEEPEST``.  A
missing name or key is none, which prints as nothing.  Errors in a template raise
``TemplateError`` before any row is read.

``escape`` makes a text free of ``<``, with which every mark of a template must begin:
a backslash is doubled and ``<`` becomes a backslash and ``l``; ``unescape`` reverts it.

What Spark does.  Rows are dealt by conversation and sorted by turn (NULLs first; ties by
role and text); a task renders its conversations as streams, so it holds one turn and one
chunk of output, not a conversation, however long.  The result is a table of chunks,
``(conv_id, chunk, text, spans)``; spans are the code points of a chunk under the mask.  A
chunk ends where a piece ends.  NULL role or text is empty; rows with a NULL
conversation id form one conversation; repeated rows are repeated turns; an empty table
gives no rows; columns other than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.text import lean, small_batches

DEEPEST = 50
CHUNK_CHARS = 1 << 18


class TemplateError(ValueError):
    """A template that cannot be compiled."""


# --------------------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    name: str
    parts: tuple


@dataclass(frozen=True)
class Filtered:
    name: str
    of: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    of: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --------------------------------------------------------------------------- values and filters


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "<" if m[1] == "l" else m[1], text, flags=re.S)


def show(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(show(v)),
    "trim": lambda v: show(v).strip(),
    "upper": lambda v: show(v).upper(),
    "lower": lambda v: show(v).lower(),
    "capitalize": lambda v: show(v).capitalize(),
    "string": show,
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else None,
}


def _lookup(value: Any, key: Any) -> Any:
    return value.get(key) if isinstance(value, dict) and isinstance(key, (str, int)) else None


def _ordered(compare: Callable) -> Callable:
    def run(a, b):
        both = (isinstance(a, str) and isinstance(b, str)) or (isinstance(a, int) and isinstance(b, int))
        return both and compare(a, b)

    return run


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "in": lambda a, b: isinstance(a, str) and isinstance(b, (str, dict)) and a in b,
    "~": lambda a, b: show(a) + show(b),
}

# --------------------------------------------------------------------------- parser

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>~|().\[\]=]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_RESERVED = {"and", "or", "not", "in", "if", "else", "for", *_WORDS}
_CHARACTERS = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        at, kind = m.end(), m.lastgroup
        value = m[kind]
        if kind == "number":
            value = int(value)
        elif kind == "string":
            value = re.sub(r"\\(.)", lambda e: _CHARACTERS.get(e[1], e[1]), value[1:-1], flags=re.S)
        out.append((kind, value))
    return out


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, self.at, self.depth = _tokens(source), 0, 0

    def peek(self, *signs: str) -> bool:
        if self.at >= len(self.tokens):
            return False
        kind, value = self.tokens[self.at]
        return kind in ("sign", "name") and value in signs

    def take(self, *signs: str):
        if self.peek(*signs):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def variable(self) -> str:
        name = self.word()
        if name in _RESERVED or name == "loop":
            raise TemplateError(f"{name!r} cannot be set")
        return name

    def whole(self):
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self):
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("expressions are nested too deeply")
        out = self.either()
        if self.take("if"):
            test = self.either()
            out = Op("if", (test, out, self.choice() if self.take("else") else Const(None)))
        self.depth -= 1
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self):
        out = self.negation()
        while self.take("and"):
            out = Op("and", (out, self.negation()))
        return out

    def negation(self):
        times = 0
        while self.take("not"):
            times += 1
        out = self.comparison()
        if not times:
            return out
        out = Op("not", (out,))
        return out if times % 2 else Op("not", (out,))

    def comparison(self):
        out = self.joined()
        while sign := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            out = Op(sign, (out, self.joined()))
        return out

    def joined(self):
        out = self.filtered()
        while self.take("~"):
            out = Op("~", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.value()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            out = Filtered(name, out)
        return out

    def value(self):
        if self.take("("):
            out = self.choice()
            self.expect(")")
        elif self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        else:
            kind, value = self.tokens[self.at]
            if kind == "sign" or (kind == "name" and value in _RESERVED and value not in _WORDS):
                raise TemplateError(f"unexpected {value!r}")
            self.at += 1
            out = Const(value) if kind != "name" else Const(_WORDS[value]) if value in _WORDS else Name(value)
        while True:
            if self.take("."):
                out = Key(out, Const(self.word()))
            elif self.take("["):
                out = Key(out, self.choice())
                self.expect("]")
            elif self.peek("("):
                raise TemplateError("nothing can be called")
            else:
                return out


def _pieces(source: str) -> list[tuple[str, str]]:
    """Text, print and block parts in order, white space trimmed where tags ask for it."""
    out, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        kind = next(k for k in (0, 1, 2) if m[3 * k + 2] is not None)
        text = text.lstrip() if trim else text
        text = text.rstrip() if m[3 * kind + 1] else text
        if text:
            out.append(("text", text))
        if kind < 2:
            out.append((("print", "block")[kind], m[3 * kind + 2].strip()))
        at, trim = m.end(), bool(m[3 * kind + 3])
    rest = source[at:].lstrip() if trim else source[at:]
    if re.search(r"\{\{|\{%|\{#", rest):
        raise TemplateError("a tag is not closed")
    return out + ([("text", rest)] if rest else [])


class _Parser:
    def __init__(self, source: str):
        self.pieces, self.at = _pieces(source), 0

    def body(self, *ends: str, depth: int = 0, marked: bool = False) -> tuple[tuple, str, str]:
        """Nodes up to a block named in ``ends``; that block's name and rest."""
        if depth > DEEPEST:
            raise TemplateError("blocks are nested too deeply")
        out: list = []
        while self.at < len(self.pieces):
            kind, source = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out.append(Text(source))
                continue
            if kind == "print":
                out.append(Print(_Expression(source).whole()))
                continue
            name, _, rest = source.partition(" ")
            if name in ends:
                return tuple(out), name, rest
            out.append(self.block(name, rest, depth + 1, marked))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(out), "", ""

    def block(self, name: str, rest: str, depth: int, marked: bool):
        if name == "if":
            return self.branch(rest, depth, marked)
        if name == "for":
            e = _Expression(rest)
            variable = e.variable()
            e.expect("in")
            over = e.whole()
            return For(variable, over, self.body("endfor", depth=depth, marked=marked)[0])
        if name == "set":
            e = _Expression(rest)
            variable = e.variable()
            e.expect("=")
            return Set(variable, e.whole())
        if name == "generation":
            if marked:
                raise TemplateError("generation marks cannot be nested")
            return Generation(self.body("endgeneration", depth=depth, marked=True)[0])
        raise TemplateError(f"unexpected block {name!r}")

    def branch(self, test: str, depth: int, marked: bool) -> If:
        condition = _Expression(test).whole()
        then, end, rest = self.body("elif", "else", "endif", depth=depth, marked=marked)
        if end == "elif":
            return If(condition, then, (self.branch(rest, depth + 1, marked),))
        other = self.body("endif", depth=depth, marked=marked)[0] if end == "else" else ()
        return If(condition, then, other)


def parse(source: str) -> tuple:
    return _Parser(source).body()[0]


# --------------------------------------------------------------------------- folding


def _apply(node: Op, values: list) -> Any:
    if node.name == "not":
        return not values[0]
    if node.name == "if":
        return values[1] if values[0] else values[2]
    if node.name == "and":
        return values[0] and values[1]
    if node.name == "or":
        return values[0] or values[1]
    return BINARY[node.name](*values)


def fold(node: Any) -> Any:
    """An expression with its constant parts worked out."""
    if isinstance(node, Key):
        of, key = fold(node.of), fold(node.key)
        return Const(None) if isinstance(of, Const) else Key(of, key)
    if isinstance(node, Filtered):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filtered(node.name, of)
    if isinstance(node, Op):
        parts = tuple(fold(p) for p in node.parts)
        if all(isinstance(p, Const) for p in parts):
            return Const(_apply(node, [p.value for p in parts]))
        if isinstance(parts[0], Const):  # the first part alone decides these
            if node.name == "if":
                return parts[1] if parts[0].value else parts[2]
            if node.name in ("and", "or"):
                return parts[1] if bool(parts[0].value) == (node.name == "and") else parts[0]
        return Op(node.name, parts)
    return node


def fold_body(body: tuple) -> tuple:
    """Nodes with constant parts worked out, dead branches dropped and neighbouring texts joined."""
    out: list = []

    def add(node):
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif node != Text(""):
            out.append(node)

    for node in body:
        if isinstance(node, Print):
            of = fold(node.of)
            add(Text(show(of.value)) if isinstance(of, Const) else Print(of))
        elif isinstance(node, If):
            test, then, other = fold(node.test), fold_body(node.then), fold_body(node.other)
            if isinstance(test, Const):
                for n in then if test.value else other:
                    add(n)
            elif then or other:
                add(If(test, then, other))
        elif isinstance(node, For):
            over = fold(node.over)
            if not isinstance(over, Const):
                add(For(node.name, over, fold_body(node.body)))
        elif isinstance(node, Set):
            add(Set(node.name, fold(node.value)))
        elif isinstance(node, Generation):
            inner = fold_body(node.body)
            if inner:
                add(Generation(inner))
        else:
            add(node)
    return tuple(out)


# --------------------------------------------------------------------------- closures


def _value(node: Any) -> Callable[[dict], Any]:
    """An expression as a closure over the variables."""
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Key):
        of, key = _value(node.of), _value(node.key)
        return lambda env: _lookup(of(env), key(env))
    if isinstance(node, Filtered):
        of, run = _value(node.of), FILTERS[node.name]
        return lambda env: run(of(env))
    parts = [_value(p) for p in node.parts]
    if node.name == "not":
        return lambda env: not parts[0](env)
    if node.name == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if node.name == "or":
        return lambda env: parts[0](env) or parts[1](env)
    if node.name == "if":
        return lambda env: parts[1](env) if parts[0](env) else parts[2](env)
    first, second, run = parts[0], parts[1], BINARY[node.name]
    return lambda env: run(first(env), second(env))


Piece = tuple[str, bool]
Runner = Callable[[dict], Iterator[Piece]]


def _loop(node: For, marked: bool) -> Runner:
    over, body, name = _value(node.over), _sequence(node.body, marked), node.name

    def run(env: dict) -> Iterator[Piece]:
        items = over(env)
        if items is None or isinstance(items, (str, int)):
            return
        outer, index, rest = (env.get("loop"), env.get(name)), 0, iter(items)
        item = next(rest, run)  # run itself marks the end: no item of the context can be it
        while item is not run:
            following = next(rest, run)
            env["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": following is run}
            env[name] = item
            yield from body(env)
            item, index = following, index + 1
        env["loop"], env[name] = outer

    return run


def _statement(node: Any, marked: bool) -> Runner:
    if isinstance(node, Text):
        piece = (node.text, marked)
        return lambda env: iter((piece,))
    if isinstance(node, Print):
        of = _value(node.of)
        return lambda env: iter(((show(of(env)), marked),))
    if isinstance(node, If):
        test, then, other = _value(node.test), _sequence(node.then, marked), _sequence(node.other, marked)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, For):
        return _loop(node, marked)
    if isinstance(node, Generation):
        return _sequence(node.body, True)
    value, name = _value(node.value), node.name

    def assign(env: dict) -> Iterator[Piece]:
        env[name] = value(env)
        return iter(())

    return assign


def _sequence(body: tuple, marked: bool) -> Runner:
    runners = [_statement(n, marked) for n in body]
    if len(runners) == 1:
        return runners[0]

    def run(env: dict) -> Iterator[Piece]:
        for r in runners:
            yield from r(env)

    return run


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """``render(**context)``: the pieces ``(text, under the mask)`` of a rendering, lazily."""
    run = _sequence(fold_body(parse(source)), False)
    return lambda **context: run(dict(context))


# --------------------------------------------------------------------------- Spark

TURNS = (
    "{% for m in messages %}<turn>{{ m.role | escape }}<text>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
CHUNKS = "conv_id {}, chunk long, text string, spans array<struct<start:long,stop:long>>"


def _rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")])


def _chunks(pieces: Iterator[Piece], most: int) -> Iterator[tuple[str, list]]:
    """Texts of at least ``most`` characters (the last one aside) and their spans under the mask."""
    out, spans, size = [], [], 0
    for text, marked in pieces:
        if marked and text:
            spans.append({"start": size, "stop": size + len(text)})
        out.append(text)
        size += len(text)
        if size >= most:
            yield "".join(out), spans
            out, spans, size = [], [], 0
    if size:
        yield "".join(out), spans


def _format_batches(template: str, most: int, kind):
    def run(batches):
        import pyarrow as pa

        render = compile_template(template)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        types = [kind, pa.int64(), pa.string(), span]
        out, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "chunk", "text", "spans"])

        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in rows)
            for number, (text, spans) in enumerate(_chunks(render(messages=messages, conv_id=conv), most)):
                out.append((conv, number, text, spans))
                held += len(text)
                if held >= most:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    return lean(run)


def format_conversations(rows: DataFrame, template: str = TURNS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Renders every conversation of ``rows(conv_id, turn, role, text)``; a template sees ``messages`` (each with
    ``role`` and ``text``, to be looped over once) and ``conv_id``.  The chunks of a conversation lie in one partition, in order."""
    from pyspark.sql.pandas.types import to_arrow_type

    compile_template(template)  # errors show here, not in a task
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType
    laid = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    run = _format_batches(template, chunk_chars, to_arrow_type(kind))
    return laid.select("conv_id", "role", "text").mapInArrow(run, CHUNKS.format(kind.simpleString()))


DIGEST = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_batches(kind):
    """Reads turns back from text written with ``TURNS``, and the loss text from the spans."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = [c.split()[0] for c in DIGEST.split(", ")]
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        def chunks():
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("conv_id", "text", "spans")])

        for conv, parts in groupby(chunks(), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = formatted = 0
            open_turn = ""
            for _, text, spans in parts:
                formatted += len(text)
                for s in spans:
                    learned = unescape(text[s["start"] : s["stop"]])
                    loss_chars += len(learned)
                    loss.update(learned.encode())
                *whole, open_turn = (open_turn + text).split("</turn>\n")
                for turn in whole:
                    role, said = turn.removeprefix("<turn>").split("<text>")
                    turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                n += len(whole)
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted))
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return lean(run)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the loss text, read from what :func:`format_conversations` wrote with ``TURNS``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv_id"].dataType
    return formatted.mapInArrow(_digest_batches(to_arrow_type(kind)), DIGEST.format(kind.simpleString()))
