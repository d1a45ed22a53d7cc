"""Identities: digests of parts, opaque handles and page cursors.

Nulls: a digest with a null part is null; a handle of a null id is null.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts, each followed by a NUL character."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat(*[x for c in cols for x in (c.cast("string"), F.chr(F.lit(0)))]), 256)


def prefixed(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), digest(*parts))


def handle(kind: str, generation: Column | str, ident: Column | str) -> Column:
    """kb.<kind>1.<base64url of JSON with keys T, G, I>, without padding."""
    g, i = (F.col(x) if isinstance(x, str) else x for x in (generation, ident))
    body = F.concat(F.lit('{"T":"' + kind + '","G":"'), g, F.lit('","I":"'), i, F.lit('"}'))
    raw = F.regexp_replace(F.regexp_replace(F.base64(body.cast("binary")), r"\s", ""), "=+$", "")
    return F.concat(F.lit(f"kb.{kind}1."), F.translate(raw, "+/", "-_"))


def read_handle(text: str, kind: str) -> tuple[str, str]:
    """(generation, id) of a handle; ValueError if it isn't one of that kind."""
    head = f"kb.{kind}1."
    if not text.startswith(head):
        raise ValueError("handle of another kind")
    body = text[len(head) :]
    x = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    if x.get("T") != kind:
        raise ValueError("handle of another kind")
    return x["G"], x["I"]


def write_cursor(stamp: str, family: str, offset: int) -> str:
    """An opaque cursor that is bound to the generations and the query family it was made for."""
    return base64.urlsafe_b64encode(json.dumps({"Generation": stamp, "Family": family, "Offset": offset}).encode()).decode().rstrip("=")


def read_cursor(text: str, stamp: str, family: str) -> int:
    """The offset; ValueError if the cursor was made for other generations or another family."""
    x = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    if x["Generation"] != stamp or x["Family"] != family or x["Offset"] < 0:
        raise ValueError("invalid continuation")
    return int(x["Offset"])
