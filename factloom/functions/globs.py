"""Globs as Java regular expressions, so that path filters run inside the scan's projection."""

from __future__ import annotations

import re


def glob_to_regex(glob: str) -> str:
    """** crosses separators (and takes a slash after it), * and ? stay inside a segment."""
    out = []
    for part in re.split(r"(\*\*/?|\*|\?)", glob):
        if part.startswith("**"):
            out.append("[^\\x00]*")
        elif part == "*":
            out.append("[^/]*")
        elif part == "?":
            out.append("[^/]")
        else:
            out.append(re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", part))
    return "^" + "".join(out) + "$"


def any_glob(globs: list[str]) -> str:
    return "|".join(f"(?:{glob_to_regex(g)})" for g in globs) or "(?!)"


def owner_pattern_to_regex(pattern: str) -> str:
    """An ownership pattern: rooted if it holds an inner slash; a pattern without a wildcard in its last part covers a tree."""
    p = pattern.strip()
    tree = p.endswith("/") or not re.search(r"[*?]", p.rstrip("/").rsplit("/", 1)[-1])
    rooted = "/" in p.rstrip("/")
    body = glob_to_regex(p.strip("/"))[1:-1]
    return f"{'^' if rooted else '^(?:.*/)?'}{body}{'(?:/.*)?' if tree else ''}$"
