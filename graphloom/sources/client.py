"""A client for one provider: addresses, bodies, lazy authorisation, rate limits, retry cycles; recorded transports for tests.

The transport is injected, so that readers can build a client on an executor and tests need no network. One partition should own
one rate-limited endpoint.
"""

from __future__ import annotations

import email.utils
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlencode, urljoin

from ..model.errors import ConfigError, RetriesExceededError
from .paginated import Response, TokenBucket, error_of, is_retryable, should_throttle

SECONDS_LEFT, EPOCH = "remaining_epoch_s", "datetime_epoch_s"
#: Wait without a reset header, and what is added to a stated one, in seconds.
UNKNOWN_RESET, CLOCK_SLACK = 60.0, 1.0


@dataclass(frozen=True)
class Call:
    """What a transport gets."""

    method: str
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes | None = None


@dataclass(frozen=True)
class RateLimit:
    """Header names, how the reset header is meant, and the used share above which the next call waits."""

    threshold: float = 0.9
    limit: str = "ratelimit-limit"
    remaining: str = "ratelimit-remaining"
    reset: str = "ratelimit-reset"
    mode: str = SECONDS_LEFT


def reset_delay(headers: dict[str, str], rate: RateLimit, now: Callable[[], float] = time.time) -> float:
    """Seconds until the limit is reset."""
    value = headers.get(rate.reset)
    if not value:
        return UNKNOWN_RESET
    if rate.mode == SECONDS_LEFT:
        return int(value) + CLOCK_SLACK
    if rate.mode == EPOCH:
        date = headers.get("date")
        here = email.utils.parsedate_to_datetime(date).timestamp() if date else now()
        return int(value) - here + CLOCK_SLACK
    raise ConfigError(f"unknown reset mode {rate.mode}")


def encode_body(body: object, kind: str) -> tuple[bytes | None, dict[str, str]]:
    """Bytes and content type of a body of kind json, form (url-encoded) or text."""
    if body is None:
        return None, {}
    if kind == "json":
        return json.dumps(body, ensure_ascii=False).encode(), {"content-type": "application/json"}
    if kind == "form":
        return urlencode(body).encode(), {"content-type": "application/x-www-form-urlencoded"}
    if kind == "text":
        return str(body).encode(), {"content-type": "text/plain"}
    raise ConfigError(f"unknown kind of body {kind}")


@dataclass
class Client:
    """Calls below a base address. ``auth`` is asked for headers once, before the first call."""

    transport: Callable[[Call], Response]
    base_url: str = ""
    auth: Callable[[], dict[str, str]] | None = None
    bucket: TokenBucket | None = None
    rate: RateLimit | None = None
    attempts: int = 3
    delay: float = 30.0
    factor: float = 2.0
    timeout_cycles: int = 3
    sleep: Callable[[float], None] = time.sleep
    _auth: dict[str, str] | None = None

    def call(self, endpoint: str, method: str = "GET", body: object = None, kind: str = "json", headers: dict[str, str] | None = None) -> Response:
        """One call, without retries."""
        if self.auth and self._auth is None:
            self._auth = self.auth()
        if self.bucket:
            self.bucket.take()
        data, typed = encode_body(body, kind)
        return self.transport(Call(method, urljoin(self.base_url, endpoint), {**typed, **(self._auth or {}), **(headers or {})}, data))

    def limited(self, response: Response) -> Response:
        """Wait after a response that has used up more of the limit than allowed."""
        h = {k.lower(): v for k, v in (response.headers or {}).items()}
        if self.rate and h.get(self.rate.limit) and h.get(self.rate.remaining) and should_throttle(int(h[self.rate.limit]), int(h[self.rate.remaining]), self.rate.threshold):
            self.sleep(reset_delay(h, self.rate))
        return response

    def request(self, endpoint: str, **options) -> Response:
        """A call with retries. A timeout starts a new cycle of attempts, ``timeout_cycles`` times at most."""
        for cycle in range(self.timeout_cycles + 1):
            try:
                return self._cycle(endpoint, options)
            except TimeoutError as e:
                if cycle == self.timeout_cycles:
                    raise RetriesExceededError(f"{endpoint}: timed out in {cycle + 1} cycles") from e
        raise AssertionError

    def _cycle(self, endpoint: str, options: dict) -> Response:
        for i in range(self.attempts):
            if i:
                self.sleep(self.delay * self.factor ** (i - 1))
            r = self.limited(self.call(endpoint, **options))
            if r.status < 400:
                return r
            if not is_retryable(r.status):
                raise error_of(r.status, endpoint)
        raise RetriesExceededError(f"{endpoint}: status {r.status} after {self.attempts} attempts")


@dataclass
class Recording:
    """A transport that replays a file of responses, or, where the file is missing, asks ``live`` and records on :meth:`save`.

    Headers named in ``secret`` are not written down.
    """

    path: str
    live: Callable[[Call], Response] | None = None
    secret: tuple[str, ...] = ("authorization", "cookie", "set-cookie")

    def __post_init__(self):
        file = Path(self.path)
        self.replaying = file.exists()
        self.entries = json.loads(file.read_text()) if self.replaying else []

    def _redact(self, headers: dict[str, str] | None) -> dict[str, str]:
        return {k: "[REDACTED]" if k.lower() in self.secret else v for k, v in (headers or {}).items()}

    def __call__(self, call: Call) -> Response:
        if self.replaying:
            for i, e in enumerate(self.entries):
                if (e["method"], e["url"]) == (call.method, call.url):
                    del self.entries[i]
                    return Response(e["status"], e["body"], e["headers"])
            raise LookupError(f"no recorded response to {call.method} {call.url}")
        if self.live is None:
            raise LookupError(f"no recording at {self.path}")
        r = self.live(call)
        self.entries.append({"method": call.method, "url": call.url, "request": self._redact(call.headers), "status": r.status, "body": r.body, "headers": self._redact(r.headers)})
        return r

    def save(self) -> None:
        if not self.replaying:
            Path(self.path).write_text(json.dumps(self.entries, indent=1))
