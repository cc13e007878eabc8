"""Chat formatting by a small sandboxed template compiler.

A template is parsed into a syntax tree, constant parts of the tree are folded, and the rest becomes Python
closures. Templates have no calls and no attributes but the keys of the values they are given, so they can
reach nothing else.

    {{ expr }}                                output
    {% for x in expr %} ... {% endfor %}      loop (loop.index, loop.first, loop.last)
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% set x = expr %}
    {% generation %} ... {% endgeneration %}  marks what the model is to learn
    expr: 'text', 12, true, false, none, x, x.key, x['key'], + ~ == != < <= > >= in and or not, ( ), expr | filter
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import table


class TemplateError(ValueError):
    """The template is malformed, or uses what it is not given."""


END_OF_TURN = "</turn>"
TURN_HEAD = "### "
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + END_OF_TURN + "\n{% endfor %}"
)


def escape(text: str) -> str:
    """A backslash before each backslash and each control string."""
    return text.replace("\\", "\\\\").replace(END_OF_TURN, "\\" + END_OF_TURN).replace(TURN_HEAD, "\\" + TURN_HEAD)


def escape_role(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escape, "escape_role": escape_role, "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}
BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b,
    "~": lambda a, b: shown(a) + shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~"))
TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z][A-Za-z0-9_]*)|(==|!=|<=|>=|[-+~<>()\[\].|=]))""", re.S)
CONSTANTS = {"true": True, "false": False, "none": None}


def shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# --- parsing: nodes are tuples (kind, ...) -------------------------------------------------------------------


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = m.lastindex
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else (0, "")

    def take(self, text: str | None = None) -> tuple:
        token = self.peek()
        if not token[0] or (text is not None and token[1] != text):
            raise TemplateError(f"expected {text or 'more'}, got {token[1]!r}")
        self.at += 1
        return token

    def whole(self) -> tuple:
        node = self.level(0)
        if self.peek()[0]:
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def level(self, depth: int) -> tuple:
        if depth == len(LEVELS):
            return self.filtered()
        if depth == 2 and self.peek() == (3, "not"):
            self.take()
            return ("not", self.level(2))
        node = self.level(depth + 1)
        while self.peek()[0] in (3, 4) and self.peek()[1] in LEVELS[depth]:
            op = self.take()[1]
            right = self.level(depth + 1)
            node = (op, node, right) if op in ("and", "or") else ("binary", op, node, right)
        return node

    def filtered(self) -> tuple:
        node = self.primary()
        while self.peek() == (4, "|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def primary(self) -> tuple:
        kind, text = self.take()
        if kind == 1:
            node = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == 2:
            node = ("const", int(text))
        elif kind == 3:
            node = ("const", CONSTANTS[text]) if text in CONSTANTS else ("name", text)
        elif text == "(":
            node = self.level(0)
            self.take(")")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek() in ((4, "."), (4, "[")):
            if self.take()[1] == ".":
                node = ("item", node, ("const", self.take()[1]))
            else:
                node = ("item", node, self.level(0))
                self.take("]")
        return node


def parse(source: str) -> list[tuple]:
    """The template's syntax tree: a list of nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    body, at = _block(parts, 0, ())
    if at != len(parts):
        raise TemplateError(f"unexpected {parts[at]!r}")
    return body


def _tag(part: str) -> tuple[str, str]:
    word, _, rest = part[2:-2].strip().partition(" ")
    return word, rest


def _block(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int]:
    """Nodes up to a tag in ends, and that tag's place."""
    out: list[tuple] = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{{") and at % 2:
            out.append(("output", Expression(part[2:-2]).whole()))
        elif part.startswith("{%") and at % 2:
            word, rest = _tag(part)
            if word in ends:
                return out, at
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"malformed for: {rest!r}")
                body, at = _block(parts, at + 1, ("endfor",))
                out.append(("for", m[1], Expression(m[2]).whole(), body))
            elif word == "if":
                branches = []
                while True:
                    test = Expression(rest).whole() if word != "else" else ("const", True)
                    body, at = _block(parts, at + 1, ("elif", "else", "endif") if word != "else" else ("endif",))
                    branches.append((test, body))
                    word, rest = _tag(parts[at])
                    if word == "endif":
                        break
                out.append(("if", branches))
            elif word == "set":
                name, _, value = rest.partition("=")
                out.append(("set", name.strip(), Expression(value).whole()))
            elif word == "generation":
                body, at = _block(parts, at + 1, ("endgeneration",))
                out.append(("generation", body))
            else:
                raise TemplateError(f"unexpected tag {word!r}")
        elif part:
            out.append(("text", part))
        at += 1
    if ends:
        raise TemplateError(f"missing {ends[-1]!r}")
    return out, at


# --- folding -------------------------------------------------------------------------------------------------


def fold_expression(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("const", "name"):
        return node
    args = [fold_expression(x) if isinstance(x, tuple) else x for x in node[1:]]
    if all(x[0] == "const" for x in args if isinstance(x, tuple)):
        try:
            return ("const", compile_expression((kind, *args))({}))
        except TypeError as error:
            raise TemplateError(f"constants do not fit: {error}") from error
    if kind in ("and", "or") and args[0][0] == "const":
        return args[1] if bool(args[0][1]) == (kind == "and") else args[0]
    return (kind, *args)


def fold(nodes: list[tuple]) -> list[tuple]:
    """Constant expressions become values, constant output becomes text, dead branches go, texts are joined."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "output":
            value = fold_expression(node[1])
            new = [("text", shown(value[1]))] if value[0] == "const" else [("output", value)]
        elif kind == "for":
            new = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif kind == "set":
            new = [("set", node[1], fold_expression(node[2]))]
        elif kind == "generation":
            new = [("generation", fold(node[1]))]
        elif kind == "if":
            live = []
            for test, body in ((fold_expression(t), fold(b)) for t, b in node[1]):
                if test[0] == "const" and not test[1]:
                    continue
                live.append((test, body))
                if test[0] == "const":
                    break
            new = live[0][1] if live and live[0][0][0] == "const" else [("if", live)] if live else []
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            else:
                out.append(x)
    return out


# --- closures ------------------------------------------------------------------------------------------------


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"no item {key!r}")


def compile_expression(node: tuple) -> Callable[[dict], Any]:
    kind, *args = node
    if kind == "const":
        value = args[0]
        return lambda env: value
    if kind == "name":
        name = args[0]

        def lookup(env: dict) -> Any:
            if name not in env:
                raise TemplateError(f"no value {name!r}")
            return env[name]

        return lookup
    if kind == "filter":
        run, inner = FILTERS[args[0]], compile_expression(args[1])
        return lambda env: run(inner(env))
    if kind == "not":
        inner = compile_expression(args[0])
        return lambda env: not inner(env)
    if kind == "binary":
        op, a, b = BINARY[args[0]], compile_expression(args[1]), compile_expression(args[2])
        return lambda env: op(a(env), b(env))
    a, b = compile_expression(args[0]), compile_expression(args[1])
    if kind == "item":
        return lambda env: _item(a(env), b(env))
    if kind == "and":
        return lambda env: a(env) and b(env)
    return lambda env: a(env) or b(env)


class Sink:
    """Collects output, its length so far, and the spans that are marked as generation."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def compile_nodes(nodes: list[tuple]) -> Callable[[dict, Sink], None]:
    steps = [_compile_node(x) for x in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, sink: Sink) -> None:
        for step in steps:
            step(env, sink)

    return run


def _compile_node(node: tuple) -> Callable[[dict, Sink], None]:
    kind, *args = node
    if kind == "text":
        text = args[0]
        return lambda env, sink: sink.write(text)
    if kind == "output":
        value = compile_expression(args[0])
        return lambda env, sink: sink.write(shown(value(env)))
    if kind == "set":
        name, given = args[0], compile_expression(args[1])
        return lambda env, sink: env.__setitem__(name, given(env))
    if kind == "generation":
        inner = compile_nodes(args[0])

        def generation(env: dict, sink: Sink) -> None:
            start = sink.length
            inner(env, sink)
            sink.spans.append((start, sink.length))

        return generation
    if kind == "for":
        name, over, body = args[0], compile_expression(args[1]), compile_nodes(args[2])

        def loop(env: dict, sink: Sink) -> None:
            rows = over(env)
            for k, row in enumerate(rows):
                body(env | {name: row, "loop": {"index": k + 1, "first": k == 0, "last": k == len(rows) - 1}}, sink)

        return loop
    branches = [(compile_expression(t), compile_nodes(b)) for t, b in args[0]]

    def choose(env: dict, sink: Sink) -> None:
        for test, body in branches:
            if test(env):
                body(env, sink)
                return

    return choose


class Template:
    def __init__(self, source: str = TEMPLATE) -> None:
        self.tree = fold(parse(source))
        self._run = compile_nodes(self.tree)

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text, and the spans (in code points) to learn from."""
        sink = Sink()
        self._run({"messages": messages}, sink)
        return "".join(sink.parts), sink.spans


TURN = re.compile(r"### ((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from text that the default template made."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted string, spans array<struct<start, end>>), one row per conversation.

    Turns are in the order of turn, then role, then text; null turns come first; null role or text is empty.
    Repeated rows are turns of their own. A null conv_id is a conversation of its own. Other columns are not
    looked at. Empty in, empty out. The template is compiled once a task; it is checked here first.
    """
    Template(template)
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    talks = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            made = [compiled.render(x) for x in b.column("turns").to_pylist()]
            spans = [[{"start": s, "end": e} for s, e in x[1]] for x in made]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([x[0] for x in made], pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "spans"])

    schema = talks.select("conv_id").schema.add("formatted", "string")
    return talks.mapInArrow(run, f"{schema.simpleString()[7:-1]}, spans array<struct<start:bigint,end:bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted text and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("spans").to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                every = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = [list(x) for x in zip(*out, strict=True)] or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digests(format_conversations(turns.unionAll(extra)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ') AS et,
         replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### '), chr(10), '\n') AS er FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || er || chr(10) || et || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
