"""A transport that counts in a folder how often each request was made, and fails as its fields say."""

import os
import urllib.error


def flaky(url, fields):
    place = os.path.join(fields["folder"], fields["q"])
    with open(place, "a") as f:
        f.write("x")
    n = os.path.getsize(place)
    kind, _, times = fields["q"].partition("_")
    if times and n <= int(times):
        if kind == "slow":
            raise TimeoutError
        if kind == "lost":
            raise ConnectionResetError("gone")
        if kind == "busy":
            raise urllib.error.HTTPError(url, 503, "busy", None, None)
        return {"wrong": 401, "limit": 429}.get(kind, 200), "{"
    return 200, '{"data": []}'
