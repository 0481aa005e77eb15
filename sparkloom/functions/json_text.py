"""Strict JSON helpers for Arrow-batched UDFs."""

from __future__ import annotations

import json
import re
from typing import Any


class Number(str):
    """A JSON number as written, so that no digit is lost and no limit of ``int`` applies."""

    __slots__ = ()


def _refuse(constant: str) -> None:
    raise ValueError(constant)


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)
_SPACE = " \t\n\r"

class BROKEN:
    """What :func:`parse_strict` returns for text that is not one JSON value; a class keeps its identity in workers."""


def parse_strict(text: str) -> Any:
    """The value of ``text`` by RFC 8259, or :data:`BROKEN`.

    Numbers come as :class:`Number`; NaN, Infinity, a byte order mark, comments, single quotes,
    control characters in strings and trailing text are refused. Values nested too deep for the decoder
    are read with a stack.
    """
    try:
        value, end = _DECODER.raw_decode(text, len(text) - len(text.lstrip(_SPACE)))
    except ValueError:
        return BROKEN
    except RecursionError:
        return _parse_deep(text)
    return value if not text[end:].strip(_SPACE) else BROKEN


_TOKEN = re.compile(r'[ \t\n\r]*([\[\]{},:]|"(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null)')


def _parse_deep(text: str) -> Any:
    """As :func:`parse_strict`, for any depth: open arrays and objects are held on a stack."""
    root: list = []
    stack: list[tuple[list | dict, str | None]] = [(root, None)]  # holder and the key that waits for a value
    at, expects = 0, "value"  # value, key, colon, or end (a comma or the end of the holder)
    first = False  # right behind an opening mark
    while True:
        holder, key = stack[-1]
        if holder is root and root and len(stack) == 1:
            return root[0] if not text[at:].strip(_SPACE) else BROKEN
        match = _TOKEN.match(text, at)
        if match is None:
            return BROKEN
        mark, at = match[1], match.end()
        closes = (mark == "]" and isinstance(holder, list)) or (mark == "}" and isinstance(holder, dict))
        if closes and len(stack) > 1 and (first or expects == "end"):
            stack.pop()
            expects, first = "end", False
        elif mark == "," and expects == "end":
            expects = "key" if isinstance(holder, dict) else "value"
        elif mark == ":" and expects == "colon":
            expects = "value"
        elif expects == "key" and mark[0] == '"':
            try:
                stack[-1] = (holder, json.loads(mark))
            except ValueError:
                return BROKEN
            expects, first = "colon", False
        elif expects == "value" and mark not in ("]", "}", ",", ":"):
            value: Any = [] if mark == "[" else {} if mark == "{" else None
            if mark not in ("[", "{"):
                try:
                    value = _DECODER.decode(mark)
                except ValueError:
                    return BROKEN
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            expects, first = "end", False
            if mark in ("[", "{"):
                stack.append((value, None))
                expects, first = ("value" if mark == "[" else "key"), True
        else:
            return BROKEN


def kind(value: Any) -> str:
    """JSON type of a parsed value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Number):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def token(value: Any) -> str:
    """A value as nullable text: a scalar as its JSON token, ``{`` for an object and ``[`` followed by
    the first characters of its elements' tokens, each kind once, for an array."""
    if value is None:
        return "null"
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return '"' + clean(value)
    if isinstance(value, list):
        return "[" + "".join(sorted(set(map(token_start, value))))
    return "{"


def token_start(value: Any) -> str:
    return {"null": "n", "boolean": "t", "number": "0", "string": '"', "array": "[", "object": "{"}[kind(value)]


def clean(text: str) -> str:
    """Text without lone surrogates, which UTF-8 cannot hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")
