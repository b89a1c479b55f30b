"""What the tests of this folder share."""

from __future__ import annotations


def by_id(rows) -> dict:
    return {r["doc_id"]: r for r in rows}
