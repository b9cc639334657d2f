"""One regular expression for a whole vocabulary.

A flat alternation of n terms is tried term by term at every word start. Sharing prefixes
makes the cost depend on the length of the matched word instead of the size of the
vocabulary, with the same result: at one position the longest term that ends on a word
boundary wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from .text import case_flags, escape_literal, word_boundaries

_END = ""


def vocabulary_regex(terms: Iterable[str]) -> str:
    """Case-insensitive Java regex for any of ``terms`` between Unicode word boundaries."""
    terms = list(terms)
    flags = case_flags("".join(terms))
    branches: dict[str, dict] = {}
    for term in terms:
        before, after = word_boundaries(term)
        _insert(branches.setdefault(before, {}), term, f"(?-{flags}:{after})")
    return "(?:" + "|".join(f"{b}(?{flags}:{_render(t)})" for b, t in branches.items()) + ")"


def _insert(node: dict, term: str, end: str) -> None:
    for ch in term:
        node = node.setdefault(ch, {})
    node[_END] = end


def _render(node: dict) -> str:
    prefix = ""
    while len(node) == 1 and _END not in node:
        ch, node = next(iter(node.items()))
        prefix += escape_literal(ch)
    options = [escape_literal(ch) + _render(sub) for ch, sub in node.items() if ch != _END]
    if _END in node:
        options.append(node[_END])
    body = options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"
    return prefix + body


def longest_first(terms: Iterable[str]) -> list[str]:
    """Distinct terms, longest first, ties in the given order."""
    return sorted(dict.fromkeys(terms), key=len, reverse=True)


def batched_regexes(terms: Iterable[str], batch_size: int = 500) -> list[str]:
    """One regex per batch of the longest-first vocabulary.

    Matches never overlap within a batch; matches of different batches may.
    """
    ordered = longest_first(terms)
    return [vocabulary_regex(ordered[i : i + batch_size]) for i in range(0, len(ordered), batch_size)]
