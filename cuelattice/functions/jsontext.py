"""JSON of any depth: Python's parser where it goes, an iterative one beyond it."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_NAMES = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_NAME = re.compile("|".join(map(re.escape, _NAMES)))


def loads(text: str):
    """The value that ``text`` holds; ValueError where it is damaged. Of a repeated key the last counts."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parsed(text)


def _parsed(text: str):
    """``json.loads`` without recursion: containers that are open lie on a stack."""
    root: list = []
    stack: list = [root]
    keys: list = [None]  # the key that waits for its value, of each open object
    at = _SPACE.match(text).end()
    fresh = True  # whether a value may begin here; else a comma or an end comes
    while True:
        if len(stack) == 1 and root:
            if at != len(text):
                raise ValueError("text after the value")
            return root[0]
        top = stack[-1]
        c = text[at : at + 1]
        if not c:
            raise ValueError("the text ends early")
        if c in "]}" and (c == "]") == isinstance(top, list) and len(stack) > 1 and (not fresh or not top) and keys[-1] is None:
            stack.pop(), keys.pop()
            fresh, at = False, _SPACE.match(text, at + 1).end()
            continue
        if not fresh:
            if c != ",":
                raise ValueError("no comma")
            fresh, at = True, _SPACE.match(text, at + 1).end()
            # nothing may end right after a comma
            if text[at : at + 1] in ("]", "}"):
                raise ValueError("a comma before the end")
            continue
        if isinstance(top, dict) and keys[-1] is None:
            if c != '"':
                raise ValueError("no key")
            key, at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            keys[-1], at = (key,), _SPACE.match(text, at + 1).end()
            continue
        inner = None
        if c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in "{[":
            value = inner = {} if c == "{" else []
            at += 1
        elif m := _NAME.match(text, at):
            value, at = _NAMES[m.group()], m.end()
        elif m := _NUMBER.match(text, at):
            value, at = (float if m.group(1) or m.group(2) else int)(m.group()), m.end()
        else:
            raise ValueError("no value")
        if isinstance(top, dict):
            top[keys[-1][0]] = value
            keys[-1] = None
        else:
            top.append(value)
        fresh = False
        if inner is not None:
            stack.append(inner), keys.append(None)
            fresh = True
        at = _SPACE.match(text, at).end()


def _scalar(value) -> str:
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    return json.dumps(value)


def canonical(value) -> str:
    """Text that is equal for equal JSON values, of any depth: sorted keys, whole floats as integers."""
    out: list[str] = []
    stack: list = [(value, False)]
    while stack:
        v, said = stack.pop()
        if said:
            out.append(v)
        elif isinstance(v, dict):
            stack.append(("}", True))
            for i, k in enumerate(sorted(v, reverse=True)):
                stack.append((v[k], False))
                stack.append((f"{'' if i == len(v) - 1 else ','}{json.dumps(k)}:", True))
            stack.append(("{", True))
        elif isinstance(v, list):
            stack.append(("]", True))
            for i in range(len(v) - 1, -1, -1):
                stack.append((v[i], False))
                if i:
                    stack.append((",", True))
            stack.append(("[", True))
        else:
            out.append(_scalar(v))
    return "".join(out)
