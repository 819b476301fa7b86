"""A service for tests of the fetching source: answers depend on the query only."""

import json

from placelens.sources.fetch import Response


def send(query: str) -> Response:
    if query.startswith("area"):
        n = int(query.split()[1])
        return Response(200, json.dumps({"elements": [{"type": "node", "id": i, "lat": 35.0 + i, "lon": 139.0, "tags": {"name": f"n{i}"}} for i in range(n)]}).encode())
    if query == "busy":
        return Response(504, b"")
    if "# attempt" in query:  # whole only with another text
        return Response(200, b'{"results": {"bindings": [{"item": {"type": "uri", "value": "Q1"}, "ja": {"type": "literal", "value": "a"}}, {"item": {"type": "uri", "value": "Q2"}}]}}')
    return Response(200, b'{"results": {"bind', cached=True)
