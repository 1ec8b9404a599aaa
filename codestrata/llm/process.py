"""What a Python process keeps from one task to the next."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

_STORE = "_codestrata_llm_process"


def kept_in_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, once per process and key.

    Functions reach the workers by value, so module variables and caches on
    functions would last for one task only.
    """
    store = sys.modules.get(_STORE)
    if store is None:
        store = sys.modules[_STORE] = types.ModuleType(_STORE)
        store.values = {}
    if key not in store.values:
        store.values[key] = make()
    return store.values[key]
