"""Wildcards as regular expressions that Java, RE2 and Python read alike."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Item:
    """kind: star, one, text or set; ``value``: the character, or the members; ``inverted`` for sets."""

    kind: str
    value: str = ""
    inverted: bool = False


def items(glob: str) -> list[Item]:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        found = _set(glob, i) if c == "[" else None
        if found:
            out.append(found[0])
            i = found[1]
            continue
        out.append(Item("star") if c == "*" else Item("one") if c == "?" else Item("text", c))
        i += 1
    return out


def _set(glob: str, at: int) -> tuple[Item, int] | None:
    """A closed ``[...]``: ``!`` or ``^`` inverts, ``]`` counts as a member in the first place, ``a-z`` is a range."""
    i = at + 1
    inverted = glob[i : i + 1] in ("!", "^") and i < len(glob)
    i += inverted
    members: list[str] = []
    last = None
    while i < len(glob):
        c = glob[i]
        if c == "]" and members:
            return Item("set", "".join(sorted(set(members))), inverted), i + 1
        if c == "-" and last is not None and i + 1 < len(glob) and glob[i + 1] != "]" and last <= glob[i + 1]:
            members += map(chr, range(ord(last), ord(glob[i + 1]) + 1))
            last = glob[i + 1]
            i += 2
            continue
        members.append(c)
        last = c
        i += 1
    return None


def is_glob(text: str) -> bool:
    return "*" in text or "?" in text or any(x.kind == "set" for x in items(text))


def escape(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z_\u0080-\U0010ffff])", r"\\\1", text)


def _members(item: Item, never: str) -> str:
    inner = "".join(escape(c) for c in item.value if c not in never or item.inverted)
    if item.inverted:
        return f"[^{inner}{escape(never)}]"
    return f"[{inner}]" if inner else r"[^\s\S]"


def regex(glob: str, within: str = "") -> str:
    """The expression of a glob, not anchored; ``within`` holds characters that no wildcard takes."""
    any_one = f"[^{escape(within)}]" if within else r"[\s\S]"
    text = {"star": f"{any_one}*", "one": any_one}
    return "".join(text.get(x.kind) or (escape(x.value) if x.kind == "text" else _members(x, within)) for x in items(glob))


def whole(glob: str) -> str:
    return f"^{regex(glob)}$"


def literals(glob: str, most: int = 128) -> list[str] | None:
    """All texts of a glob that has only sets, up to ``most``; else None."""
    out = [""]
    for x in items(glob):
        if x.kind in ("star", "one") or x.inverted:
            return None
        choices = x.value if x.kind == "set" else [x.value]
        if len(out) * len(choices) > most:
            return None
        out = [a + b for a in out for b in choices]
    return list(dict.fromkeys(out))


def segments(path: str) -> list[str]:
    return [x for x in path.replace("\\", "/").split("/") if x]


def path_regex(pattern: str) -> str | None:
    """Consecutive segments of a path: group 1 is what comes before them, group 2 what they take.

    A segment is a prefix or a glob; ``**`` stands for any number of segments; a leading slash starts at
    the root. The path need not end where the pattern does.
    """
    parts = segments(pattern)
    if not parts:
        return None
    rooted = pattern.replace("\\", "/").startswith("/")
    out = ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            out += r"[\s\S]*" if last else r"(?:[^/]+(?:/+|$))*?"
        else:
            out += (regex(p, "/") if is_glob(p) else escape(p) + "[^/]*") + (r"(?=/|$)" if last else r"(?:/+|$)")
    before = "()" if rooted else "((?:[^/]+/+)*?)"
    return f"^/*{before}({out})"
