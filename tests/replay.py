"""A transport for the tests: canned answers by the field q."""

from __future__ import annotations

import json

ANSWERS = {"list": json.dumps([{"dahiti_id": 627, "type": "River"}, {"type": "Lake"}]), "broken": "{"}


def replay(url: str, fields: dict) -> tuple[int, str]:
    if fields["q"] not in ANSWERS:
        raise OSError("down")
    return 200, ANSWERS[fields["q"]]
