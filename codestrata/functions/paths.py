"""Path queries over tree nodes: ``/``, ``//T``, ``/T``, ``*``, ``[@a]``, ``[@a="v"]``.

``@roleX`` tests a role, ``@token`` the token, any other name an attribute.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_STEP = re.compile(r"""(//?)(\*|[\w:.-]+)((?:\[@\w+(?:=(?:"[^"]*"|'[^']*'))?\])*)""")
_TEST = re.compile(r"""\[@(\w+)(?:=(?:"([^"]*)"|'([^']*)'))?\]""")


class Step(NamedTuple):
    descendant: bool
    kind: str | None
    tests: tuple[tuple[str, str | None], ...]


def steps_of(query: str) -> list[Step]:
    """Steps of a path; ``/`` alone is the root and has none."""
    if query == "/":
        return []
    steps, end = [], 0
    for match in _STEP.finditer(query):
        if match.start() != end:
            break
        end = match.end()
        tests = tuple(
            (t[1], t[2] if t[2] is not None else t[3]) for t in _TEST.finditer(match[3])
        )
        steps.append(Step(match[1] == "//", None if match[2] == "*" else match[2], tests))
    if not steps or end != len(query):
        raise ValueError(f"not a path of nodes: {query}")
    return steps


def role_of(name: str) -> str | None:
    """The role a test name stands for: ``roleCallee`` -> ``Callee``."""
    return name[4:] if re.fullmatch(r"role[A-Z]\w*", name) else None


def matches(tree, query: str) -> list[int]:
    """Nodes of one ``functions.trees.Tree`` that ``query`` selects, in document order."""
    steps = steps_of(query)
    if not steps:
        return [0] if len(tree) else []
    context: set[int] | None = None
    for step in steps:
        found: set[int] = set()
        below = [False] * len(tree)  # has an ancestor in the context
        for node, parent in enumerate(tree.parent):
            if context is None:
                reached = step.descendant or parent is None
            else:
                in_parent = parent in context
                below[node] = in_parent or (parent is not None and below[parent])
                reached = below[node] if step.descendant else in_parent
            if reached and _fits(tree, node, step):
                found.add(node)
        context = found
    return sorted(context or ())


def _fits(tree, node: int, step: Step) -> bool:
    if step.kind is not None and tree.type[node] != step.kind:
        return False
    for name, value in step.tests:
        role = role_of(name)
        if role and value is None:
            if role not in tree.roles[node]:
                return False
            continue
        actual = tree.token[node] if name == "token" else dict(tree.attrs[node]).get(name)
        if actual is None or (value is not None and actual != value):
            return False
    return True
