"""Files behind HTTP URLs."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from ..errors import LoadError

SCHEMES = ("http", "https")
TIMEOUT_S = 30
LARGEST = 4 << 30
CHUNK = 1 << 20


def fetch(url: str, schemes=SCHEMES, hosts: list[str] | None = None, largest: int = LARGEST) -> Iterator[bytes]:
    """The body of a URL in chunks; scheme and, if any are listed, host must be allowed, those of redirects as well.

    A body of more than `largest` bytes is an error.
    """

    def allowed(target: str) -> None:
        parts = urllib.parse.urlsplit(target)
        if parts.scheme not in schemes or hosts is not None and parts.hostname not in hosts:
            raise LoadError(f"not an allowed URL: {target}")

    class Redirects(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            allowed(newurl)
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    allowed(url)
    size = 0
    try:
        with urllib.request.build_opener(Redirects).open(url, timeout=TIMEOUT_S) as got:
            while chunk := got.read(CHUNK):
                size += len(chunk)
                if size > largest:
                    raise LoadError(f"{url}: larger than {largest} bytes")
                yield chunk
    except urllib.error.URLError as e:
        raise LoadError(f"{url}: {e}") from e
