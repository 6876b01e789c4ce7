"""Chat formatting by compiled templates.

The template language is small and sandboxed: `{{ expression }}`, `{% for x in e %}`, `{% if e %}`,
`{% elif e %}`, `{% else %}`, `{% set x = e %}`, `{% generation %}`, each closed by its `{% end... %}`.
Expressions know literals, names, `a.key` and `a["key"]` on mappings only, comparison, `in`, `and`, `or`,
`not`, `+`, filters of FILTERS after `|`, and `loop.index`, `loop.first`, `loop.last`. There are no calls,
no Python attributes and no unbounded loops. A template is parsed into a tree, constant parts are folded, and
every node becomes a Python closure; rendering gives the text and the spans (code points) that
`{% generation %}` marks, which are the loss mask.

Control strings in texts are kept apart by an escape that can be undone: `<`, any backslashes and `|` get one
more backslash, so a formatted text has `<|` only where the template put it.

Conversations are rows (conv_id, turn, role, text); turns go by turn, then role, then text, null first. Null
roles and texts read as empty, repeated rows are turns of their own, a null conv_id is a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import bounded_batches

TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' + (m.role | label) }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_' + 'end|>' }}\n{% endfor %}")
FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,stop:long>>"


class TemplateError(ValueError):
    """The template is malformed or asks for something the sandbox does not have."""


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def label(role: str) -> str:
    """A role on one line: backslash and line feed are written as \\\\ and \\n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unlabel(written: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(written))


FILTERS: dict[str, Callable] = {
    "escape": escape, "label": label, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


# --- expressions: (constant?, closure) pairs, folded while they are built ---

@dataclass
class Expr:
    run: Callable[[dict], object]
    constant: bool = False


def _fold(run: Callable, *parts: Expr) -> Expr:
    """An expression over parts, evaluated at once if they are all constant."""
    if all(p.constant for p in parts):
        value = run({})
        return Expr(lambda env: value, True)
    return Expr(run)


_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<op>==|!=|<=|>=|[<>+|().\[\]]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r} in {source!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected in {self.source!r}")

    def whole(self) -> Expr:
        found = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r} in {self.source!r}")
        return found

    def either(self) -> Expr:
        left = self.both()
        while self.take("or"):
            a, b = left, self.both()
            left = _fold(lambda env, a=a, b=b: a.run(env) or b.run(env), a, b)
        return left

    def both(self) -> Expr:
        left = self.negated()
        while self.take("and"):
            a, b = left, self.negated()
            left = _fold(lambda env, a=a, b=b: a.run(env) and b.run(env), a, b)
        return left

    def negated(self) -> Expr:
        if self.take("not"):
            a = self.negated()
            return _fold(lambda env: not a.run(env), a)
        return self.compared()

    def compared(self) -> Expr:
        a = self.added()
        op = self.take("==", "!=", "<=", ">=", "<", ">", "in")
        if not op:
            return a
        b = self.added()
        test = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<=": lambda x, y: x <= y,
                ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, ">": lambda x, y: x > y,
                "in": lambda x, y: x in y}[op]
        return _fold(lambda env: test(a.run(env), b.run(env)), a, b)

    def added(self) -> Expr:
        left = self.filtered()
        while self.take("+"):
            a, b = left, self.filtered()
            left = _fold(lambda env, a=a, b=b: a.run(env) + b.run(env), a, b)
        return left

    def filtered(self) -> Expr:
        value = self.single()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = _fold(lambda env, a=value, f=FILTERS[name]: f(a.run(env)), value)
        return value

    def single(self) -> Expr:
        kind, text = self.peek()
        self.at += 1
        if kind == "str":
            value = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
            return Expr(lambda env: value, True)
        if kind == "num":
            value = int(text)
            return Expr(lambda env: value, True)
        if kind == "name" and text in ("true", "false", "none"):
            value = {"true": True, "false": False, "none": None}[text]
            return Expr(lambda env: value, True)
        if kind == "op" and text == "(":
            found = self.either()
            self.need(")")
        elif kind == "name" and text not in ("and", "or", "not", "in"):
            found = Expr(lambda env: _look_up(env, text))
        else:
            raise TemplateError(f"unexpected {text!r} in {self.source!r}")
        while op := self.take(".", "["):
            if op == ".":
                kind, key = self.peek()
                if kind != "name":
                    raise TemplateError(f"a key is expected after '.' in {self.source!r}")
                self.at += 1
                part = Expr(lambda env, key=key: key, True)
            else:
                part = self.either()
                self.need("]")
            found = Expr(lambda env, a=found, k=part: _look_up(a.run(env), k.run(env)))
        return found


def _look_up(held: object, key: object) -> object:
    if not isinstance(held, dict):
        raise TemplateError("only mappings have keys")
    if key not in held:
        raise TemplateError(f"no value {key!r}")
    return held[key]


# --- statements ---

@dataclass
class Out:
    """Text so far, its length, and the marked spans."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


@dataclass
class Node:
    kind: str  # text, print, for, if, set, generation
    value: object = None  # text or Expr
    name: str = ""
    body: list = field(default_factory=list)
    other: list = field(default_factory=list)


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def parse(source: str) -> list[Node]:
    """The tree of a template."""
    root = Node("root")
    open_nodes, branch, at = [root], [root.body], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            branch[-1].append(Node("text", source[at:m.start()]))
        at = m.end()
        if m[1] is not None:
            branch[-1].append(Node("print", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            part = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not part:
                raise TemplateError(f"bad loop {rest!r}")
            node = Node("for", _Expression(part[2]).whole(), part[1])
        elif word == "if":
            node = Node("if", _Expression(rest).whole())
        elif word == "generation" and not rest:
            node = Node("generation")
        elif word == "set":
            part = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not part:
                raise TemplateError(f"bad assignment {rest!r}")
            branch[-1].append(Node("set", _Expression(part[2]).whole(), part[1]))
            continue
        elif word in ("elif", "else") and open_nodes[-1].kind in ("if", "elif") and branch[-1] is open_nodes[-1].body:
            branch[-1] = open_nodes[-1].other
            if word == "elif":
                node = Node("elif", _Expression(rest).whole())
                branch[-1].append(node)
                open_nodes.append(node)
                branch.append(node.body)
            continue
        elif word.startswith("end") and not rest:
            while open_nodes[-1].kind == "elif":
                open_nodes.pop()
                branch.pop()
            if open_nodes[-1].kind != word[3:] or word == "endroot":
                raise TemplateError(f"{word} closes nothing")
            open_nodes.pop()
            branch.pop()
            continue
        else:
            raise TemplateError(f"unknown tag {m[2].strip()!r}")
        branch[-1].append(node)
        open_nodes.append(node)
        branch.append(node.body)
    if len(open_nodes) > 1:
        raise TemplateError(f"{open_nodes[-1].kind} is not closed")
    if at < len(source):
        root.body.append(Node("text", source[at:]))
    return root.body


def fold(nodes: list[Node]) -> list[Node]:
    """Print constants as text, settle constant conditions, join neighbouring texts."""
    flat: list[Node] = []
    for n in nodes:
        if n.kind == "print" and n.value.constant:
            flat.append(Node("text", _shown(n.value.run({}))))
        elif n.kind in ("if", "elif") and n.value.constant:
            flat.extend(fold(n.body if n.value.run({}) else n.other))
        else:
            flat.append(Node(n.kind, n.value, n.name, fold(n.body), fold(n.other)))
    result: list[Node] = []
    for n in flat:
        if n.kind == "text" and result and result[-1].kind == "text":
            result[-1] = Node("text", result[-1].value + n.value)
        else:
            result.append(n)
    return result


def _shown(value: object) -> str:
    if not isinstance(value, (str, int)):
        raise TemplateError("only strings and numbers can be printed")
    return value if isinstance(value, str) else str(value)


def _closure(nodes: list[Node]) -> Callable[[dict, Out], None]:
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Out) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node: Node) -> Callable[[dict, Out], None]:
    value = node.value
    if node.kind == "text":
        return lambda env, out: out.add(value)
    if node.kind == "print":
        return lambda env, out: out.add(_shown(value.run(env)))
    if node.kind == "set":
        return lambda env, out: env.__setitem__(node.name, value.run(env))
    body, other = _closure(node.body), _closure(node.other)
    if node.kind in ("if", "elif"):
        return lambda env, out: (body if value.run(env) else other)(env, out)
    if node.kind == "generation":
        def marked(env: dict, out: Out) -> None:
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))
        return marked

    def loop(env: dict, out: Out) -> None:
        items = value.run(env)
        if not isinstance(items, (list, tuple)):
            raise TemplateError("only lists can be looped over")
        for i, item in enumerate(items):
            body(env | {node.name: item,
                        "loop": {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)
    return loop


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function from the template's variables (keywords) to (text, marked spans)."""
    run = _closure(fold(parse(source)))

    def render(**variables) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        run(variables, out)
        return "".join(out.parts), out.spans

    return render


# --- conversations ---

def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss: one row per conversation.

    The rows of a conversation meet in one row because its text is one value; a conversation is as large as that
    text, however many there are.
    """
    bounded_batches(rows.sparkSession)
    compile_template(template)  # a malformed template fails here
    whole = (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("m"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for b in batches:
            made = [render(messages=m) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([t for t, _ in made], pa.string()),
                pa.array([[{"start": i, "stop": j} for i, j in s] for _, s in made],
                         pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            ], ["conv_id", "formatted", "loss"])

    return whole.mapInArrow(run, FORMATTED)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text that TEMPLATE formatted."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        found.append((unlabel(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask say, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, loss in zip(*(c.to_pylist() for c in b.columns)):
                turns = read_turns(text)
                learnt = "".join(unescape(text[s["start"]:s["stop"]]) for s in loss)
                rows.append((conv, len(turns),
                             hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                             len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long,"
                                     " loss_sha256 string, formatted_chars long")
