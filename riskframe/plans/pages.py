"""Result modes, canonical orders, pages with signed cursors, and hard bounds."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE, MAX_PAGE = 20, 100

# The canonical order of each kind of row.
ORDERS = {
    "methods": ["file", "start_line", "start_column", "id"],
    "methods_by_risk": [F.desc, "risk", "id"],
    "diagnostics": ["code", "path"],
    "nodes": ["id"],
    "edges": ["id"],
    "references": ["id"],
    "comparisons": ["comparison_id"],
    "violations": ["from", "to", "kind"],
    "findings": ["priority", "kind", "id"],
    "mutants": ["file", "start_line", "start_column", "id"],
    "tests": ["file", "name"],
    "scope_files": ["path"],
    "seeds": ["kind", "node_id"],
    "sources": ["path", "sha256"],
}


def ordered(df: DataFrame, kind: str) -> DataFrame:
    cols = ORDERS[kind]
    if cols[0] is F.desc:
        return df.orderBy(F.desc(cols[1]), *cols[2:])
    return df.orderBy(*[c for c in cols if c in df.columns])


def in_mode(methods: DataFrame, mode: str) -> DataFrame:
    """summary: none, violations: those above the threshold, highest and all: all."""
    if mode not in ("summary", "violations", "highest", "all"):
        raise ValueError(f"unknown result mode {mode}")
    return methods.where("false") if mode == "summary" else methods.where("above_threshold") if mode == "violations" else methods


def page(df: DataFrame, order: list, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """Rows offset to offset + limit in order; limit 1 to 100. Spark takes the first offset + limit of each task only."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit 1 to 100, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """The DataFrame, unless it has more than most rows, which is an error and never a truncation."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df


def cursor(secret: bytes, snapshot: str, mode: str, offset: int) -> str:
    """A cursor that only this secret can have made, and only for this snapshot and mode."""
    body = json.dumps({"snapshot": snapshot, "mode": mode, "offset": offset}, separators=(",", ":")).encode()
    mac = hmac.new(secret, body, hashlib.sha256).digest()
    return base64.urlsafe_b64encode(body + mac).rstrip(b"=").decode()


def cursor_offset(secret: bytes, text: str, snapshot: str, mode: str) -> int:
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except ValueError:
        raise ValueError("malformed cursor") from None
    body, mac = raw[:-32], raw[-32:]
    if not hmac.compare_digest(hmac.new(secret, body, hashlib.sha256).digest(), mac):
        raise ValueError("cursor wasn't made here")
    got = json.loads(body)
    if got["snapshot"] != snapshot or got["mode"] != mode:
        raise ValueError("cursor of another snapshot or mode")
    return got["offset"]
