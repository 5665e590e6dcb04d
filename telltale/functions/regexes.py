"""Regular expressions in the dialect of the JVM, and one factored expression for many needles."""

from __future__ import annotations

import re

LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = LETTER + r"(?:" + LETTER + r"|['\-])+"
TOKEN = r"(?:" + LETTER + r"|['\-])+"
BARE = LETTER + "+"
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}]{2}|[\x{1F300}-\x{1FAFF}\x{2705}\x{274C}\x{2728}\x{2B50}\x{2B55}\x{2757}\x{26A1}\x{2764}\x{2B06}\x{1F004}]\x{FE0F}?|[\x{2190}-\x{2BFF}]\x{FE0F}"
#: What every emoji begins with.
SYMBOLS = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}\-])")


def quoted(literal: str) -> str:
    return _SPECIAL.sub(r"\\\1", literal)


def unicode(pattern: str) -> str:
    """A pattern whose classes, boundaries and cases are Unicode's, with lines that end at a newline only."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    return f"(?Ud{flags[1] if flags else ''}){pattern[flags.end() if flags else 0 :]}"


def needles(words: list[str]) -> str:
    """Any of ``words`` between word boundaries, the longest first, with white space of any kind for a space.

    Words with a common beginning share it, so that a place in the text is tried a letter at a time, not a word at a time.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def build(node: dict) -> str:
        branches = [(quoted(c) if c != " " else r"(?U:\s)+") + build(sub) for c, sub in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return BEFORE + "(?:" + build(tree) + ")" + AFTER if words else "(?!)"
