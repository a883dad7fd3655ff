"""The query language: text to clauses.

Words are parted by white space outside quotes. A leading ``!`` or ``-`` negates, ``|``
gives alternatives, ``field:`` scopes; quotes mean exact, ``*``, ``?`` and ``[...]``
wildcards, anything else is fuzzy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from trovana.functions.text import fold_text
from trovana.plans.glob import is_glob

#: Names of the fields, and of the query for applications.
FIELDS = {
    "name": ("name", "file", "filename", "basename"),
    "path": ("path", "folder", "dir", "directory"),
    "ext": ("ext", "extension", "suffix"),
    "kind": ("kind", "type"),
}
APPS = ("app", "apps", "application", "applications")
_FIELD_OF = {alias: name for name, aliases in FIELDS.items() for alias in aliases}


@dataclass(frozen=True)
class Term:
    """field: any, name, path, ext or kind; mode: fuzzy, exact or wildcard, or literal: fuzzy without near matches."""

    field: str
    token: str
    mode: str


@dataclass(frozen=True)
class Query:
    """Each positive clause needs one of its terms, no negative clause may have any."""

    positive: tuple[tuple[Term, ...], ...] = ()
    negative: tuple[tuple[Term, ...], ...] = field(default=())

    @property
    def empty(self) -> bool:
        return not self.positive and not self.negative


def cut(text: str, separators: str | None) -> list[str]:
    """Non-empty parts between separators outside double quotes; None: white space."""
    out, held, quoted = [], [], False
    for c in text:
        if c == '"':
            quoted = not quoted
        if not quoted and (c.isspace() if separators is None else c in separators):
            out.append("".join(held))
            held = []
        else:
            held.append(c)
    return [x for x in [*out, "".join(held)] if x]


def pattern(raw: str) -> tuple[str, str]:
    """(token, mode) of a term's text."""
    text = raw.strip()
    if text.startswith('"'):
        text = text[1:]
        return fold_text(text[:-1] if text.endswith('"') else text), "exact"
    if text.endswith('"'):
        return fold_text(text[:-1]), "exact"
    return fold_text(text), "wildcard" if is_glob(text) else "fuzzy"


def _extension(token: str) -> str:
    return token[2:] if token.startswith("*.") else token[1:] if token.startswith(".") else token


def term(field_name: str, raw: str) -> Term | None:
    token, mode = pattern(raw)
    if not token:
        return None
    if field_name == "ext":
        token = _extension(token)
        return Term("ext", token, "exact" if mode == "fuzzy" else mode) if token else None
    if field_name == "kind":
        return Term("kind", token, "fuzzy")
    if field_name == "any" and token.startswith("*.") and len(token) > 2:
        return Term("ext", _extension(token), mode)
    if field_name == "any" and token.startswith(".") and len(token) > 1:
        return Term("ext", token[1:], "exact")
    return Term(field_name, token, mode)


def clause(body: str) -> tuple[Term, ...]:
    head, colon, rest = body.partition(":")
    name = _FIELD_OF.get(fold_text(head)) if colon else None
    texts = cut(rest if name else body, "|")
    if name in ("ext", "kind"):
        texts = [x for t in texts for x in cut(t, ",;")]
    return tuple(t for x in texts if (t := term(name or "any", x)))


def parse(text: str) -> Query:
    positive, negative = [], []
    for word in cut(text.strip(), None):
        negated = word[0] in "!-" and len(word) > 1
        terms = clause(word[1:] if negated else word)
        if terms:
            (negative if negated else positive).append(terms)
    return Query(tuple(positive), tuple(negative))


def apps_query(text: str) -> str | None:
    """What follows the prefix of an application query, which must come first; None for other queries."""
    head, colon, rest = text.strip().partition(":")
    return rest.strip() if colon and head.strip().lower() in APPS else None


def literal(query: Query) -> Query:
    """The query without near matches: what is fuzzy in names and paths must stand there in one piece.

    Negative clauses stay as they are, so that what this finds is part of what the query finds.
    """
    plain = lambda terms: tuple(Term(t.field, t.token, "literal") if t.mode == "fuzzy" and t.field in ("any", "name", "path") else t for t in terms)
    return Query(tuple(map(plain, query.positive)), query.negative)


def highlight(text: str) -> str | None:
    """The first text or extension token, without wildcard characters."""
    for terms in parse(text).positive:
        for t in terms:
            if t.field != "kind":
                return "".join(c for c in t.token if c not in "*?[]!^")
    return None
