"""Reading analyses: model output that should be JSON of a fixed shape and often is not quite.

``load`` finds the JSON in a text; ``elements`` and ``name_of`` give members the schema's regular shape.
"""

from __future__ import annotations

import json
from typing import Any

#: What counts as no value: it keeps its position but is no case.
_NOTHING = (None, "", {})


def is_nothing(value: Any) -> bool:
    return any(value == x and type(value) is type(x) for x in _NOTHING)


def _decode(text: str) -> Any:
    """The JSON value in ``text``, whatever stands before its first bracket and after its end; ValueError if there is none."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        raise ValueError("no JSON")
    return json.JSONDecoder().raw_decode(text, at)[0]


def load(text: str | None) -> Any:
    """The value of an analysis text, or None where it does not parse. JSON encoded as a JSON string is decoded again."""
    value: Any = text
    for _ in range(4):
        if not isinstance(value, str):
            return value
        try:
            value = _decode(value)
        except (ValueError, RecursionError):
            return None
    return None if isinstance(value, str) else value


def as_object(value: Any) -> dict | None:
    """An analysis as an object; one that stands alone in an array is taken out of it."""
    while isinstance(value, list) and len(value) == 1:
        value = value[0]
    return value if isinstance(value, dict) else None


def elements(value: Any) -> list:
    """A member that the schema has as an array: null is empty, a single value is an array of one."""
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def structure_units(value: Any) -> list:
    """The units of a document structure, which may stand under its own name in an object."""
    while isinstance(value, dict) and "structure" in value and "type" not in value:
        value = value["structure"]
    return elements(value)


def name_of(value: Any) -> str | None:
    """The name of an element that is a name or an object with one; None for nothing, blanks and other values."""
    if isinstance(value, dict):
        value = value.get("name")
    return value if isinstance(value, str) and value.strip() else None


def member(value: Any, key: str) -> list:
    return elements(value.get(key)) if isinstance(value, dict) else []
