"""What a text must hold for a regular expression to be found in it."""

from __future__ import annotations

_META = frozenset(".^$*+?()[]{}|\\")


def required(pattern: str) -> str | None:
    """The longest run of plain characters that every match of ``pattern`` holds, or None if none can be told.

    Only what stands outside of groups, classes and alternatives counts, so a
    run may be missed but never made up.
    """
    if pattern.startswith("(?") and not pattern.startswith("(?:"):
        return None  # flags may change what characters mean
    best, run, at = "", "", 0
    while at < len(pattern):
        char = pattern[at]
        literal = None
        if char == "\\":
            after = pattern[at + 1 : at + 2]
            if after in ("Q", "E"):
                return None
            literal = after if after and not after.isalnum() else None
            at += 2
            if after in ("x", "u", "p", "P", "c", "0", "k", "N"):
                return best if len(best) > len(run) else run or None  # what follows is part of the escape
        elif char == "(":
            at = _behind_group(pattern, at)
            if at is None:
                return None
        elif char == "[":
            at = _behind_class(pattern, at)
            if at is None:
                return None
        elif char == "|":
            return None
        elif char in ")]}":
            literal, at = char, at + 1
        elif char == "{":
            return None  # a count is read where what it counts is
        elif char in _META:
            at += 1
        else:
            literal, at = char, at + 1
        optional = repeated = False
        if at < len(pattern) and pattern[at] in "?*+{" and char not in "^|":
            optional = pattern[at] in "?*{"
            repeated = True
            if pattern[at] == "{":
                close = pattern.find("}", at)
                if close < 0:
                    return None
                at = close + 1
            else:
                at += 1
            if at < len(pattern) and pattern[at] in "?+":
                at += 1
        if literal is not None and not optional:
            run += literal
        if literal is None and char not in "^$" or repeated:
            best, run = max(best, run, key=len), ""
    return max(best, run, key=len) or None


def _behind_class(pattern: str, at: int) -> int | None:
    at += 1
    at += pattern[at : at + 1] == "^"
    at += pattern[at : at + 1] == "]"
    while at < len(pattern) and pattern[at] != "]":
        if pattern[at] == "[":
            return None  # classes within classes
        at += 2 if pattern[at] == "\\" else 1
    return at + 1 if at < len(pattern) else None


def _behind_group(pattern: str, at: int) -> int | None:
    if pattern.startswith("(?", at) and not pattern.startswith("(?:", at):
        return None
    depth = 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 2
            continue
        if pattern[at] == "[":
            at = _behind_class(pattern, at)
            if at is None:
                return None
            continue
        depth += {"(": 1, ")": -1}.get(pattern[at], 0)
        at += 1
        if not depth:
            return at
    return None
