"""Small per-document XML and JSON helpers used inside tasks."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def xml_leaves(text: str, max_depth: int, only_empty_attributes: bool) -> tuple[str | None, list[tuple[str, str, str]]]:
    """(path, field, value) of element texts and attributes, and what was wrong with the text, if anything."""
    out: list[tuple[str, str, str]] = []
    names: list[str] = []
    status = None
    try:
        for event, el in ET.iterparse(io.BytesIO(text.encode()), events=("start", "end")):
            if event == "start":
                names.append(_local(el.tag))
                continue
            path = "/".join(names) if len(names) <= max_depth else ""
            if path:
                value = (el.text or "").strip()
                if value:
                    out.append((path, names[-1], value))
                if not only_empty_attributes or (len(el) == 0 and not value):
                    out += [(f"{path}/@{_local(a)}", _local(a), v) for a, v in el.attrib.items() if v.strip()]
            else:
                status = "depth_exceeded"
            names.pop()
            el.clear()
    except ET.ParseError:
        return "malformed", out
    return status, out


def _no_constant(name: str):
    raise ValueError(name)


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _deep_json(text: str):
    """The value of a JSON text of any depth: open containers lie on a list, not on the call stack."""
    decode = json.JSONDecoder(strict=True).raw_decode

    def skip(at: int) -> int:
        return _SPACE.match(text, at).end()

    def key_at(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("a key is missing")
        key, at = decode(text, at)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError("a colon is missing")
        return key, skip(at + 1)

    top: list = []
    open_: list[list] = [[top, None]]  # container, key of the value to come
    at = skip(0)
    while True:
        c = text[at : at + 1]
        node = {} if c == "{" else [] if c == "[" else None
        if node is not None:
            value, at = node, at + 1
        elif c == '"':
            value, at = decode(text, at)
        elif m := _NUMBER.match(text, at):
            value, at = m[0], m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError("a value is missing")
            value, at = _WORDS[word], at + len(word)
        into, key = open_[-1]
        if isinstance(into, dict):
            into[key] = value if node is not None or c == '"' else None  # only strings and containers matter here
        else:
            into.append(value if node is not None or c == '"' else None)
        at = skip(at)
        if node is not None:
            open_.append([node, None])
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    open_[-1][1], at = key_at(at)
                continue
        while True:  # after a value
            into = open_[-1][0]
            if into is top:
                if at != len(text):
                    raise ValueError("more than one value")
                return top[0]
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(into, dict):
                    open_[-1][1], at = key_at(at)
                break
            if c != ("}" if isinstance(into, dict) else "]"):
                raise ValueError("a container is not closed")
            open_.pop()
            at = skip(at + 1)


def json_leaves(text: str, max_depth: int, arrays: bool) -> tuple[str | None, list[tuple[str, str, str]]]:
    """(path, key, value) of strings directly under a key in containers down to a depth, and what was wrong, if anything."""
    try:
        try:
            root = json.loads(text, parse_constant=_no_constant)
        except RecursionError:
            root = _deep_json(text)
    except ValueError:
        return "malformed", []
    out: list[tuple[str, str, str]] = []
    status = None
    todo = [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        if not isinstance(node, (dict, list)):
            continue
        if depth > max_depth:
            status = "depth_exceeded"
        elif isinstance(node, dict):
            for key, value in node.items():
                child = f"{path}.{key}" if path else key
                if isinstance(value, str):
                    out.append((child, key, value))
                else:
                    todo.append((value, child, depth + 1))
        elif arrays:
            todo += [(item, f"{path}[{i}]", depth + 1) for i, item in enumerate(node)]
    return status, out
