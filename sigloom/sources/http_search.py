"""The export endpoint over HTTP: the default transport of :mod:`sigloom.sources.export`.

Options: ``url``, and ``username`` with ``password`` or a ``token``; ``scheme`` of the authorization header
(Bearer); ``verify`` (true), ``timeout`` in seconds (120).  Lines are handed on as they arrive.
"""

from __future__ import annotations

import json
import ssl
import urllib.parse
import urllib.request
from collections.abc import Iterator

LOGIN, EXPORT = "/services/auth/login", "/services/search/jobs/export"  # fixed values
TIMEOUT = 120
_keys: dict = {}


def _post(options: dict, path: str, form: dict, headers: dict):
    request = urllib.request.Request(options["url"].rstrip("/") + path, urllib.parse.urlencode(form).encode(), headers)
    checked = str(options.get("verify", "true")).lower() == "true"
    context = ssl.create_default_context()
    if not checked:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    return urllib.request.urlopen(request, timeout=float(options.get("timeout", TIMEOUT)), context=context if request.type == "https" else None)


def session_key(options: dict) -> str:
    """The token given, or the key of a login, one for each server and user in a process."""
    from sigloom.sources.export import SessionKey

    if options.get("token"):
        return options["token"]

    def login() -> str:
        with _post(options, LOGIN, {"username": options["username"], "password": options["password"], "output_mode": "json"}, {}) as answer:
            return json.load(answer)["sessionKey"]

    return _keys.setdefault((options["url"], options["username"]), SessionKey(login))()


def export(search: str, start: float, end: float, options: dict) -> Iterator[bytes]:
    headers = {"Authorization": f"{options.get('scheme', 'Bearer')} {session_key(options)}"}
    with _post(options, EXPORT, {"search": search, "earliest_time": start, "latest_time": end, "output_mode": "json"}, headers) as answer:
        yield from answer
