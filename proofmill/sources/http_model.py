"""An optional model behind HTTP: prompts in, JSON replies out. Nothing uses it by default."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator


class ModelError(RuntimeError):
    """A call that failed; the chunk keeps its rule-based text."""


class ModelTimeout(ModelError):
    """No answer in time."""


class ModelUnavailable(ModelError):
    """Nothing answers at the address."""


class BadReply(ModelError):
    """The answer is not what the endpoint should send."""


class HttpModel:
    """Posts {"model", "prompt"} to `url` and takes the string under `field` of the JSON answer.

    Instances hold settings only, so they are pickled to the executors.
    """

    def __init__(self, url: str, model: str, field: str = "response", timeout: float = 30.0, probe_timeout: float = 5.0):
        self.url, self.model, self.field, self.timeout, self.probe_timeout = url, model, field, timeout, probe_timeout

    def available(self) -> bool:
        """Whether something answers at the host; the driver asks once before it plans calls."""
        try:
            with urllib.request.urlopen("/".join(self.url.split("/")[:3]), timeout=self.probe_timeout):
                return True
        except urllib.error.HTTPError:
            return True
        except OSError:
            return False

    def _call(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "format": "json"}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                data = json.loads(answer.read())
        except TimeoutError as e:
            raise ModelTimeout(str(e)) from e
        except urllib.error.HTTPError as e:
            raise BadReply(f"status {e.code}") from e
        except OSError as e:
            raise ModelUnavailable(str(e)) from e
        except ValueError as e:
            raise BadReply(str(e)) from e
        if not isinstance(data, dict) or not isinstance(data.get(self.field), str):
            raise BadReply(f"no text under {self.field!r}")
        return data[self.field]

    def __call__(self, prompts: Iterator[str]) -> Iterator[str]:
        for prompt in prompts:
            yield self._call(prompt)
