"""Replacement patterns of the host dialect in Java's words."""

from __future__ import annotations

import re


def first_match(pattern: str, replacement: str) -> tuple[str, str]:
    r"""Pattern and replacement (Java's) that replace the first match of a pattern alone; \1 in the replacement is a group.

    What is before and after the match are groups too, so the pattern's own groups and back references move on by two.
    """
    moved = re.sub(r"\\(\\|[1-9])", lambda m: m[0] if m[1] == "\\" else f"\\{int(m[1]) + 2}", pattern)
    groups = len(re.findall(r"(?<!\\)(?:\\\\)*\((?!\?)|\(\?P?<(?![=!])", re.sub(r"\[[^\]]*\]", "", pattern)))
    put = re.sub(r"\\(\d)|\\\\|[$]", lambda m: "\\$" if m[0] == "$" else f"${{{int(m[1]) + 2}}}" if m[1] else m[0], replacement)
    return rf"\A([\s\S]*?)({moved})([\s\S]*)\z", f"$1{_plain_groups(put)}${groups + 3}"


def _plain_groups(text: str) -> str:
    """Java has no braces around numbered groups; a digit after a group is escaped instead."""
    return re.sub(r"\$\{(\d+)\}(\d?)", lambda m: f"${m[1]}" + (f"\\{m[2]}" if m[2] else ""), text)


def every_match(replacement: str) -> str:
    put = re.sub(r"\\(\d)|\\\\|[$]", lambda m: "\\$" if m[0] == "$" else f"${{{m[1]}}}" if m[1] else m[0], replacement)
    return _plain_groups(put)
