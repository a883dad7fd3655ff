"""A matcher for one row in plain Python, to hold the compiled columns against."""

import re

from trovana.functions import fuzzy
from trovana.functions.text import SEPARATORS, fold_text
from trovana.plans import glob
from trovana.plans.query import parse

RANK = {"metadata": 0, "weakPath": 1, "near": 2, "substring": 3, "prefix": 5, "exact": 6}


def bin_of(score):
    return max(0, min(int(score / 2000), 4))


def edge(text, at):
    return at == 0 or text[at - 1] in SEPARATORS


def top(found):
    best = None
    for m in found:
        if m and (best is None or (RANK[m[0]], bin_of(m[1]), m[1]) > (RANK[best[0]], bin_of(best[1]), best[1])):
            best = m
    return best


def quoted(text, token, base, field):
    at = text.find(token)
    if at < 0:
        return None
    kind = "exact" if text == token else "prefix" if at == 0 else "substring"
    return kind, base + 500 * edge(text, at) - min(10 * at, 900), field


def name_match(name, token):
    low = fold_text(name)
    if low == token:
        return "exact", 10000, "name"
    if low.startswith(token):
        return "prefix", 9200 - min(len(low), 300), "name"
    at = low.find(token)
    if at >= 0:
        return "substring", 7700 + 650 * edge(low, at) - min(12 * at, 900), "name"
    near = fuzzy.near_name(name, low, token)
    return ("near", near[0], "name") if near else None


def path_match(directory, token, delta):
    plain = quoted(fold_text(directory), token, 4000, "path")
    if plain:
        return "weakPath", plain[1] + delta, "ancestorPath"
    near = fuzzy.near_path(directory, token) if len(token) <= 3 else None
    return ("weakPath", near[0] + delta, "ancestorPath") if near else None


def segment_fits(segment, p):
    return bool(re.fullmatch(glob.regex(p), segment)) if glob.is_glob(p) else segment.startswith(p)


def segments_match(parts, pattern, start):
    """The end of the first match, by trying."""
    if not pattern:
        return start
    if pattern[0] == "**":
        if len(pattern) == 1:
            return len(parts)
        for at in range(start, len(parts) + 1):
            end = segments_match(parts, pattern[1:], at)
            if end is not None:
                return end
        return None
    if start < len(parts) and segment_fits(parts[start], pattern[0]):
        return segments_match(parts, pattern[1:], start + 1)
    return None


def structured(path, pattern, base, per, most, step, far):
    parts, wanted = glob.segments(fold_text(path)), glob.segments(pattern)
    if not parts or not wanted:
        return None
    rooted = pattern.startswith("/")
    for start in [0] if rooted else range(len(parts)):
        end = segments_match(parts, wanted, start)
        if end is not None:
            return "weakPath", base + 450 * rooted + min(per * (end - start), most) - min(step * start, far), "path"
    return None


def wildcard_path(path, token, base):
    if "/" in token or "**" in token:
        return structured(path, token, base, 80, 640, 70, 700)
    low = fold_text(path)
    return ("weakPath", base - min(len(low), 300), "path") if re.fullmatch(glob.regex(token), low) else None


def term_match(row, t):
    name, path, directory, ext, is_directory = row["name"], row["path"], row["directory_path"], row["file_extension"], row["is_directory"]
    token = t.token
    if t.field == "ext":
        if t.mode == "wildcard":
            return ("substring", 4700, "fileExtension") if re.fullmatch(glob.regex(token), ext) else None
        if ext == token:
            return "exact", 4900 if t.mode == "exact" else 4800, "fileExtension"
        return ("prefix", 3600, "fileExtension") if t.mode == "fuzzy" and ext.startswith(token) else None
    if t.field == "kind":
        names = ["app", "application"] if is_directory and ext == "app" else []
        names += ["folder", "directory", "dir"] if is_directory else ["file"]
        return ("metadata", 4400, "kind") if any(n.startswith(token) for n in names) else None
    low = fold_text(name)
    if t.mode == "exact":
        ways = {"any": [quoted(low, token, 5200, "name"), quoted(fold_text(directory), token, 3700, "path")], "name": [quoted(low, token, 5200, "name")], "path": [quoted(fold_text(directory), token, 4000, "path")]}
    elif t.mode == "wildcard":
        own = ("substring", 5100 - min(len(low), 300), "name") if "/" not in token and re.fullmatch(glob.regex(token), low) else None
        ways = {"any": [own, wildcard_path(path, token, 3900)], "name": [own], "path": [wildcard_path(path, token, 4100)]}
    elif "/" in token:
        ways = {"any": [structured(path, token, 4100, 90, 720, 80, 800)], "name": [], "path": [structured(path, token, 4500, 90, 720, 80, 800)]}
    else:
        ways = {"any": [name_match(name, token), path_match(directory, token, -400)], "name": [name_match(name, token)], "path": [path_match(directory, token, 0)]}
    return top(ways[t.field])


def explain(row, text):
    """(class, bin, score, field), or None."""
    q = parse(text)
    if any(term_match(row, t) for terms in q.negative for t in terms) or not q.positive:
        return None
    found = [top([term_match(row, t) for t in terms]) for terms in q.positive]
    if not all(found):
        return None
    best = top(found)
    score = sum(m[1] for m in found) - min(4 * row["path"].count("/"), 120) - 35 * row["is_hidden"]
    return best[0], bin_of(score), score, best[2]
