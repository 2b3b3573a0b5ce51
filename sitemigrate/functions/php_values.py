"""Serialised values of PHP to JSON. Lengths of strings count bytes; objects lose their class.

Values are read in one pass without recursion, so they may nest to any depth. A back-reference (``R:n;`` or ``r:n;``) names the
n-th value in the order of reading, counted from 1, keys left out; it is written as a copy of that value, or as null where
the value isn't over yet, so that a cycle ends.
"""

from __future__ import annotations

import json
import re

_SCALAR = re.compile(rb"([bid]):([^;{}]*);")
_COUNTED = re.compile(rb"([saOC]):(\d+):")
_REFERENCE = re.compile(rb"([Rr]):(\d+);")


class _Open:
    """An array or object that isn't over: how many pairs are to come, its keys, and where its pieces stand."""

    def __init__(self, kind: bytes, n: int, slot: int, at: int):
        self.kind, self.n, self.slot, self.at = kind, n, slot, at
        self.keys: list[int | str] = []
        self.places: dict[int | str, tuple[int, int]] = {}


def to_json(value: str | None) -> str | None:
    """Compact JSON of a serialised value, None if it isn't one. Lists stay lists, other arrays become objects."""
    if value is None:
        return None
    try:
        return _convert(value.strip().encode("utf-8"))
    except (ValueError, IndexError, UnicodeDecodeError):
        return None


def _convert(data: bytes) -> str:
    out: list[str] = []  # pieces of JSON; those before keys and around arrays are filled in at an array's end
    slots: list[tuple[int, int] | None] = []  # the pieces of each value, None while it is open
    stack: list[_Open] = []
    at = 0
    while True:
        while stack and len(stack[-1].keys) == stack[-1].n:
            if data[at : at + 1] != b"}":
                raise ValueError("no end of array")
            at += 1
            done = stack.pop()
            _close(done, out)
            slots[done.slot] = (done.at, len(out))
        if not stack and slots:
            break
        if stack:
            key, at = _scalar(data, at)
            if not isinstance(key, (int, str)) or isinstance(key, bool):
                raise ValueError("a key is neither number nor string")
            owner = stack[-1]
            if owner.kind == b"O" and isinstance(key, str):
                key = key.rpartition("\0")[2]
            if key in owner.places:  # of a repeated key, the last value counts
                first = owner.places[key][0]
                out[first : owner.places[key][1]] = [""] * (owner.places[key][1] - first)
            owner.keys.append(key)
            owner.places[key] = (len(out), -1)
            out.append("")
        start = len(out)
        if m := _REFERENCE.match(data, at):
            span = slots[int(m[2]) - 1] if 0 < int(m[2]) <= len(slots) else None
            if not 0 < int(m[2]) <= len(slots) or not stack:
                raise ValueError("a reference to no value")
            out.append("null" if span is None else "".join(out[span[0] : span[1]]))
            at = m.end()
            if m[1] == b"r":  # a copy is a value of its own, a reference isn't
                slots.append((start, len(out)))
        elif (m := _COUNTED.match(data, at)) and m[1] in b"aO":
            n, at = _body(data, m)
            slots.append(None)
            stack.append(_Open(m[1], n, len(slots) - 1, start))
            out.append("")
            continue
        else:
            item, at = _scalar(data, at)
            out.append(json.dumps(item, ensure_ascii=False))
            slots.append((start, len(out)))
        if stack:
            owner = stack[-1]
            owner.places[owner.keys[-1]] = (owner.places[owner.keys[-1]][0], len(out))
    if at != len(data):
        raise ValueError("more than one value")
    return "".join(out)


def _close(done: _Open, out: list[str]) -> None:
    """Brackets, commas and keys of an array or object whose pairs are all there."""
    is_list = done.kind == b"a" and done.keys == list(range(done.n))
    out[done.at] = "[" if is_list else "{"
    for i, (place, key) in enumerate(sorted((place, key) for key, (place, _) in done.places.items())):
        out[place] = ("," if i else "") + ("" if is_list else json.dumps(str(key), ensure_ascii=False) + ":")
    out.append("]" if is_list else "}")


def _body(data: bytes, m: re.Match) -> tuple[int, int]:
    """The number of pairs of an array or object, and where they begin."""
    n, at = int(m[2]), m.end()
    if m[1] == b"O":  # the class name, then its number of fields
        if data[at : at + 1] != b'"' or data[at + 1 + n : at + 3 + n] != b'":':
            raise ValueError("a class name's length is wrong")
        at += 3 + n
        colon = data.index(b":", at)
        n, at = int(data[at:colon]), colon + 1
    if data[at : at + 1] != b"{":
        raise ValueError("no array body")
    return n, at + 1


def _scalar(data: bytes, at: int) -> tuple[object, int]:
    if data[at : at + 2] == b"N;":
        return None, at + 2
    if m := _SCALAR.match(data, at):
        kind, text = m[1], m[2].decode()
        if kind == b"d":
            number = float(text.lower().replace("inf", "Infinity") if "inf" in text.lower() else text)
            return (number if number == number and abs(number) != float("inf") else None), m.end()
        return (int(text) != 0 if kind == b"b" else int(text)), m.end()
    m = _COUNTED.match(data, at)
    if not m or m[1] != b"s":
        raise ValueError("unknown kind" if not m else "a format that can't be read")
    n, at = int(m[2]), m.end()
    text, tail = data[at + 1 : at + 1 + n], data[at + 1 + n : at + 3 + n]
    if data[at : at + 1] != b'"' or tail != b'";':
        raise ValueError("a string's length is wrong")
    return text.decode("utf-8", "replace"), at + 3 + n
