"""User patterns are written in Python's regular-expression dialect; Spark matches with Java's.

Only spelling differs for most patterns, so the tokens that differ are respelled at plan time
and constructs Java cannot express are refused.
"""

from __future__ import annotations

import re

from .text import WS_CLASS

_TOKEN = re.compile(
    r"\\U[0-9A-Fa-f]{8}|\\N\{[^}]*\}|\\0[0-7]{0,2}|\\[1-3][0-7]{2}|\\.|\(\?P<\w+>|\(\?P=\w+\)|\(\?\(|\(\?#[^)]*\)"
    r"|\(\?[aiLmsux]+(?:-[imsx]+)?[:)]|\(\?-[imsx]+:|\{,\d*\}|\{\d+(?:,\d*)?\}|&&|.",
    re.DOTALL,
)
_CLASSES = {
    "d": r"\p{Nd}", "D": r"\P{Nd}",
    "w": r"\p{L}\p{N}_", "W": None,
    "s": WS_CLASS, "S": None,
}


def _escape(body: str, in_class: bool) -> str:
    """Java spelling of one backslash escape."""
    if body in ("d", "D"):
        return _CLASSES[body]
    if body in ("w", "s"):
        return _CLASSES[body] if in_class else f"[{_CLASSES[body]}]"
    if body in ("W", "S"):
        return f"[^{_CLASSES[body.lower()]}]"
    if body[0] == "U":
        return rf"\x{{{int(body[1:], 16):x}}}"
    if body[0] == "0" or (len(body) == 3 and body[0] in "123"):
        return rf"\x{{{int(body, 8):x}}}"
    if body == "Z":
        return r"\z"
    if body == "v":
        return r"\x0B"
    if body == "b" and in_class:
        return r"\x08"
    if body[0] == "N":
        raise ValueError("named characters are not supported in patterns; use the character itself")
    return "\\" + body


def _inline_flags(token: str) -> str:
    if set(token) & set("aLx"):
        raise ValueError(f"inline flags {token!r} are not supported")
    return token.replace("i", "iu", 1) if "u" not in token else token


def java_pattern(pattern: str) -> tuple[str, int]:
    """(the same pattern for Spark, its number of groups); ``ValueError`` if it is not valid."""
    try:
        compiled = re.compile(pattern)
    except re.error as problem:
        raise ValueError(f"not a valid regular expression: {pattern!r} ({problem})") from None
    out: list[str] = []
    in_class = at_class_start = False
    for match in _TOKEN.finditer(pattern):
        token = match.group()
        if token[0] == "\\":
            out.append(_escape(token[1:], in_class))
        elif in_class:
            if token == "]" and not at_class_start:
                in_class = False
                out.append(token)
            elif token == "^" and at_class_start and out[-1] == "[":
                out.append(token)
                continue
            else:
                out.append("".join("\\" + ch if ch in "[]&" else ch for ch in token))
        elif token == "[":
            in_class = at_class_start = True
            out.append(token)
            continue
        elif token.startswith("(?P<"):
            out.append("(")
        elif token.startswith("(?P="):
            out.append(f"(?:\\{compiled.groupindex[token[4:-1]]})")
        elif token == "(?(":
            raise ValueError("conditional groups are not supported in patterns")
        elif token.startswith("(?#"):
            pass
        elif token.startswith("(?") and token[-1] in ":)" and len(token) > 3:
            out.append(_inline_flags(token))
        elif token[0] == "{" and len(token) > 1:
            out.append(token.replace("{,", "{0,", 1))
        elif token in "{}":
            out.append("\\" + token)
        else:
            out.append(token)
        at_class_start = False
    # (?d): only a line feed ends a line for ".", "^" and "$".
    return "(?d)" + "".join(out), compiled.groups
