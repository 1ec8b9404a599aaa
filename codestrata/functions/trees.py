"""Source text to syntax-tree nodes, one text at a time.

The standard library parses; this module only numbers and names the nodes. It
runs inside Spark tasks (see ``operators.nodes`` and ``functions.sql``).

Modes: ``native`` keeps the parser's own names, ``annotated`` adds roles,
``semantic`` also maps common constructs to shared types.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings
from collections import Counter
from html.parser import HTMLParser
from json.decoder import scanstring

MODES = ("semantic", "annotated", "native")

# Parser name -> version of the rules below.
PARSERS = {"html": "v1.0.0", "json": "v1.0.0", "python": "v1.0.0"}

# Parser name -> types a semantic root can have. A JSON text may be any value.
ROOT_TYPES = {
    "html": frozenset({"Document"}),
    "json": frozenset({"Bool", "List", "Map", "Null", "Number", "String"}),
    "python": frozenset({"Module"}),
}

# Elements without an end tag.
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    return mode


class Tree:
    """Nodes of one text in document order, as parallel lists."""

    def __init__(self, mode: str):
        self.semantic = mode == "semantic"
        self.with_roles = mode != "native"
        self.type: list[str] = []
        self.roles: list[tuple[str, ...]] = []
        self.attrs: list[tuple[tuple[str, str], ...]] = []
        self.token: list[str | None] = []
        self.start_line: list[int | None] = []
        self.end_line: list[int | None] = []
        self.parent: list[int | None] = []
        self.depth: list[int] = []
        self.post: list[int] = []
        self.open_nodes: list[int] = []
        self._closed = 0

    def __len__(self) -> int:
        return len(self.type)

    def columns(self) -> dict[str, list]:
        return {
            "post": self.post,
            "depth": self.depth,
            "parent_pre": self.parent,
            "type": self.type,
            "roles": self.roles,
            "attrs": self.attrs,
            "token": self.token,
            "start_line": self.start_line,
            "end_line": self.end_line,
        }

    def open(self, kind, roles=(), attrs=(), token=None, start=None, end=None) -> None:
        """Begin a node; ``attrs`` are (name, value) pairs."""
        stack = self.open_nodes
        self.parent.append(stack[-1] if stack else None)
        self.depth.append(len(stack))
        stack.append(len(self.type))
        self.type.append(kind)
        self.roles.append(roles if self.with_roles else ())
        self.attrs.append(attrs)
        self.token.append(token)
        self.start_line.append(start)
        self.end_line.append(end)
        self.post.append(-1)

    def close(self, end=None) -> None:
        pre = self.open_nodes.pop()
        self.post[pre] = self._closed
        self._closed += 1
        if end is not None:
            self.end_line[pre] = end

    def leaf(self, *node) -> None:
        self.open(*node)
        self.close()


def _clean(value: str) -> str:
    """Text that UTF-8 can hold: lone surrogates become ``?``."""
    return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


def parse(content: bytes | str | None, lang: str | None, mode: str = "semantic") -> Tree | None:
    """The tree of ``content``, or None when there is no parser or no tree (``tree_or_reason``)."""
    return tree_or_reason(content, lang, mode)[0]


def tree_or_reason(
    content: bytes | str | None, lang: str | None, mode: str = "semantic"
) -> tuple[Tree | None, str | None]:
    """The tree, or why there is none: ``no parser``, ``no content``, ``invalid``, ``too deep``.

    Running out of memory is not a property of the text and is raised.
    """
    parser = {"python": _python, "html": _html, "json": _json}.get((lang or "").lower())
    if parser is None:
        return None, "no parser"
    if content is None:
        return None, "no content"
    tree = Tree(mode)
    # Integers of any length are valid in all three languages.
    digits = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parser(content.encode() if isinstance(content, str) else bytes(content), tree)
    except RecursionError:
        return None, "too deep"
    except MemoryError as error:
        # The Python grammar reports its own limit of nesting under this name.
        if not str(error).startswith("Parser stack overflowed"):
            raise
        return None, "too deep"
    except (SyntaxError, ValueError, AssertionError) as error:
        deep = "too many nested" in str(error) or "too many levels" in str(error)
        return None, "too deep" if deep else "invalid"
    finally:
        sys.set_int_max_str_digits(digits)
    return tree, None


# Python. Semantic types: FunctionGroup, Function, Identifier,
# QualifiedIdentifier, Argument, Import, String, Number, Bool, Block.

_PYTHON_ROLES = {
    ast.FunctionDef: ("Function", "Declaration"),
    ast.AsyncFunctionDef: ("Function", "Declaration"),
    ast.Lambda: ("Function", "Anonymous"),
    ast.ClassDef: ("Type", "Declaration"),
    ast.Call: ("Call", "Expression"),
    ast.Name: ("Identifier", "Expression"),
    ast.Attribute: ("Qualified", "Identifier", "Expression"),
    ast.arg: ("Argument",),
    ast.Import: ("Import", "Declaration"),
    ast.ImportFrom: ("Import", "Declaration"),
    ast.Constant: ("Literal", "Expression"),
    ast.Module: ("File", "Module"),
    ast.Return: ("Return", "Statement"),
    ast.If: ("If", "Statement"),
    ast.For: ("For", "Statement"),
    ast.While: ("While", "Statement"),
    ast.Assign: ("Assignment", "Statement"),
}
_PYTHON_TYPES = {
    ast.FunctionDef: "FunctionGroup",
    ast.AsyncFunctionDef: "FunctionGroup",
    ast.Lambda: "Function",
    ast.Name: "Identifier",
    ast.Attribute: "QualifiedIdentifier",
    ast.arg: "Argument",
    ast.Import: "Import",
    ast.ImportFrom: "Import",
}
_PYTHON_NAMES = {
    ast.FunctionDef: "name",
    ast.AsyncFunctionDef: "name",
    ast.ClassDef: "name",
    ast.Name: "id",
    ast.arg: "arg",
    ast.alias: "name",
    ast.keyword: "arg",
    ast.ImportFrom: "module",
}


# Fields that hold no node of their own: expression context and operators.
_PYTHON_UNUSED = frozenset({"ctx", "op", "ops"})


def _python(content: bytes, tree: Tree) -> None:
    # Explicit stack: (node, role from the parent), or None to close a node.
    pending: list = [(ast.parse(content), ())]
    while pending:
        step = pending.pop()
        if step is None:
            tree.close()
            continue
        children = _open_python(*step, tree)
        if children:
            pending.append(None)
            children.reverse()
            pending += children
        else:
            tree.close()


def _open_python(node: ast.AST, role: tuple, tree: Tree) -> list:
    """Open a node; returns its children with the roles they get from it."""
    kind = type(node)
    roles = _PYTHON_ROLES.get(kind, ()) + role
    start, end = getattr(node, "lineno", None), getattr(node, "end_lineno", None)
    if kind is ast.Constant:
        name = _literal_type(node.value) if tree.semantic else "Constant"
        tree.open(name, roles, (), _literal(node.value), start, end)
        return []
    children, scalars = [], []
    for field in kind._fields:
        if field in _PYTHON_UNUSED:
            continue
        value = getattr(node, field, None)
        if isinstance(value, list):
            children += [(child, ()) for child in value if isinstance(child, ast.AST)]
        elif isinstance(value, ast.AST):
            children.append((value, ("Callee",) if field == "func" else ()))
        elif value is not None:
            scalars.append((field, _clean(str(value))))
    if not tree.semantic:
        tree.open(kind.__name__, roles, tuple(scalars), None, start, end)
        return children
    named = _PYTHON_NAMES.get(kind)
    attrs = tuple(("Name", value) for field, value in scalars if field == named)
    own = attrs[0][1] if attrs else None
    if kind is ast.Name and role:
        # The name called stays an Identifier, below the node with the role.
        tree.open("QualifiedIdentifier", roles, (), None, start, end)
        tree.leaf("Identifier", _PYTHON_ROLES[kind], attrs, own, start, end)
        return []
    name = _PYTHON_TYPES.get(kind, kind.__name__)
    tree.open(name, roles, attrs, own if kind is ast.Name else None, start, end)
    if name == "FunctionGroup":
        tree.leaf("Identifier", ("Identifier", "Name"), attrs, own, start, start)
    elif kind is ast.Attribute:
        attribute = _clean(node.attr)
        tree.leaf(
            "Identifier", ("Identifier", "Name"), (("Name", attribute),), attribute, start, end
        )
    return children


def _literal(value) -> str:
    if isinstance(value, str):
        return _clean(value)
    return repr(value)


def _literal_type(value) -> str:
    if isinstance(value, bool):
        return "Bool"
    if isinstance(value, (int, float, complex)):
        return "Number"
    return {str: "String", bytes: "Bytes"}.get(type(value), "Constant")


# HTML. Elements keep their tag as type; semantic text is String.


class _HtmlReader(HTMLParser):
    def __init__(self, tree: Tree):
        super().__init__(convert_charrefs=True)
        self.tree = tree
        self.tags: list[str] = []
        self.open_tags: Counter[str] = Counter()

    def _line(self) -> int:
        return self.getpos()[0]

    def _element(self, tag, attrs):
        line = self._line()
        pairs = {_clean(name): _clean(value or "") for name, value in attrs}
        self.tree.open(_clean(tag), ("Element",), tuple(pairs.items()), None, line, line)

    def handle_starttag(self, tag, attrs):
        self._element(tag, attrs)
        if tag in VOID_ELEMENTS:
            self.tree.close()
        else:
            self.tags.append(tag)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._element(tag, attrs)
        self.tree.close()

    def handle_endtag(self, tag):
        if self.open_tags[tag]:
            closed = None
            while closed != tag:
                closed = self.tags.pop()
                self.open_tags[closed] -= 1
                self.tree.close(self._line())

    def handle_data(self, data):
        if data.strip():
            line = self._line()
            kind = "String" if self.tree.semantic else "text"
            last = line + data.count("\n")
            self.tree.leaf(kind, ("Literal", "String"), (), _clean(data), line, last)

    def handle_comment(self, data):
        line = self._line()
        kind = "Comment" if self.tree.semantic else "comment"
        last = line + data.count("\n")
        self.tree.leaf(kind, ("Comment", "Noop"), (), _clean(data), line, last)


def _html(content: bytes, tree: Tree) -> None:
    reader = _HtmlReader(tree)
    tree.open("Document" if tree.semantic else "document", ("File",), (), None, 1)
    reader.feed(content.decode("utf-8", "replace"))
    reader.close()
    while tree.open_nodes:
        tree.close(reader.getpos()[0])


# JSON. Semantic types: Map, Pair, List, String, Number, Bool, Null.

_JSON_NATIVE = {
    "Map": "object",
    "Pair": "pair",
    "List": "array",
    "String": "string",
    "Number": "number",
    "Bool": "boolean",
    "Null": "null",
}


_JSON_SPACE = re.compile(r"[ \t\n\r]*")
_JSON_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_JSON_NAMES = {"true": ("Bool", "Boolean"), "false": ("Bool", "Boolean"), "null": ("Null", "Null")}


def _json(content: bytes, tree: Tree) -> None:
    """One pass over the text; depth costs a list entry, not a stack frame."""
    text = content.decode(json.detect_encoding(content), "surrogatepass")
    closers: list[str] = []  # of the open maps and lists
    at = _json_value(text, _JSON_SPACE.match(text).end(), tree, closers)
    while closers:
        at = _JSON_SPACE.match(text, at).end()
        mark = text[at : at + 1]
        if closers[-1] == "}":
            tree.close()  # the pair
        if mark == closers[-1]:
            closers.pop()
            tree.close()
            at += 1
        elif mark == ",":
            at = _JSON_SPACE.match(text, at + 1).end()
            at = _json_member(text, at, tree, closers)
        else:
            raise ValueError(f"expected , or {closers[-1]} at {at}")
    if _JSON_SPACE.match(text, at).end() != len(text):
        raise ValueError(f"text after the value at {at}")


def _json_member(text: str, at: int, tree: Tree, closers: list[str]) -> int:
    """Read the next member of the innermost list or map (see ``_json_value``)."""
    if closers[-1] == "}":
        at = _json_name(text, at, tree)
    return _json_value(text, at, tree, closers)


def _json_name(text: str, at: int, tree: Tree) -> int:
    """Open a pair with its name; gives the place of its value."""
    if text[at : at + 1] != '"':
        raise ValueError(f"expected a name at {at}")
    name, at = scanstring(text, at + 1, True)
    at = _JSON_SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"expected : at {at}")
    name = _clean(name)
    _json_open(tree, "Pair", ("Key",), (("Name", name),), name)
    return _JSON_SPACE.match(text, at + 1).end()


def _json_open(tree: Tree, kind: str, roles, attrs=(), token=None) -> None:
    tree.open(kind if tree.semantic else _JSON_NATIVE[kind], roles, attrs, token)


def _json_value(text: str, at: int, tree: Tree, closers: list[str]) -> int:
    """Read a value; of a map or list only as far as its first leaf."""
    while True:
        mark = text[at : at + 1]
        if mark in ("{", "["):
            kind, closer = ("Map", "}") if mark == "{" else ("List", "]")
            _json_open(tree, kind, (kind,))
            at = _JSON_SPACE.match(text, at + 1).end()
            if text[at : at + 1] == closer:
                tree.close()
                return at + 1
            closers.append(closer)
            if closer == "}":
                at = _json_name(text, at, tree)
            continue
        if mark == '"':
            value, at = scanstring(text, at + 1, True)
            _json_open(tree, "String", ("Literal", "String"), (), _clean(value))
        elif number := _JSON_NUMBER.match(text, at):
            _json_open(tree, "Number", ("Literal", "Number"), (), number[0])
            at = number.end()
        else:
            name = next((name for name in _JSON_NAMES if text.startswith(name, at)), None)
            if name is None:
                raise ValueError(f"no value at {at}")
            kind, role = _JSON_NAMES[name]
            _json_open(tree, kind, ("Literal", role), (), name)
            at += len(name)
        tree.close()
        return at


# Nodes as JSON text.


def render(tree: Tree, roots: list[int]) -> str:
    """JSON array with the subtree of each root; works for any depth."""
    return "[" + ",".join(_render_one(tree, root) for root in roots) + "]"


def _render_one(tree: Tree, root: int) -> str:
    parts: list[str] = []
    open_nodes: list[int] = []
    for node in range(root, len(tree)):
        if node != root and tree.depth[node] <= tree.depth[root]:
            break
        while open_nodes and open_nodes[-1] != tree.parent[node] and node != root:
            parts.append("]}")
            open_nodes.pop()
        if parts and not parts[-1].endswith("["):
            parts.append(",")
        parts.append(_head(tree, node) + ',"children":[')
        open_nodes.append(node)
    return "".join(parts) + "]}" * len(open_nodes)


def _head(tree: Tree, node: int) -> str:
    head: dict = {"@type": tree.type[node]}
    if tree.roles[node]:
        head["@role"] = tree.roles[node]
    if tree.token[node] is not None:
        head["@token"] = tree.token[node]
    if tree.start_line[node] is not None:
        head["@pos"] = {"start": tree.start_line[node], "end": tree.end_line[node]}
    head["attrs"] = dict(tree.attrs[node])
    return json.dumps(head, ensure_ascii=False)[:-1]
