"""One document's content, from whatever names it: a path, a URL, bytes, a byte stream or an image in memory."""

from __future__ import annotations

import io
import re
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

from pagemill.sources.kinds import PDF_MAGIC, PDF_SUFFIX

URL = re.compile(r"^https?://")
#: Seconds that a server may take.
TIMEOUT = 30.0


@dataclass(frozen=True)
class Content:
    """What was found: its kind (path, url, bytes, image), a name if it has one, and bytes or an image object."""

    kind: str
    name: str
    data: bytes | None = None
    image: object | None = None

    @property
    def is_pdf(self) -> bool:
        """The rule of ``kinds.is_pdf``: a path by its suffix, bytes by their first four, a URL by either."""
        named = urlsplit(self.name).path.lower().endswith(PDF_SUFFIX) or self.name.lower().endswith(PDF_SUFFIX)
        magic = (self.data or b"")[: len(PDF_MAGIC)] == PDF_MAGIC
        return {"path": named, "url": named or magic, "bytes": magic}.get(self.kind, False)


def fetch(url: str, timeout: float = TIMEOUT) -> bytes:
    """The body of a GET; an HTTP error or a server that can't be reached raises OSError."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "pagemill"}), timeout=timeout) as answer:
        return answer.read()


def load(source: object, timeout: float = TIMEOUT) -> Content:
    """The content of one source. A missing path is FileNotFoundError, a failed GET OSError, any other type ValueError."""
    if isinstance(source, (bytes, bytearray, memoryview)):
        return Content("bytes", "", bytes(source))
    if isinstance(source, io.IOBase):
        return Content("bytes", "", source.read())
    if isinstance(source, str) and URL.match(source.strip()):
        return Content("url", source.strip(), fetch(source.strip(), timeout))
    if isinstance(source, (str, Path)):
        path = Path(source)
        if not path.is_file():
            raise FileNotFoundError(f"File not found: {path}")
        return Content("path", str(path), path.read_bytes())
    if hasattr(source, "convert") and hasattr(source, "size"):  # an image object, whatever library made it
        return Content("image", "", image=source.convert("RGB"))
    raise ValueError(f"Unsupported source type: {type(source).__name__}")


def flatten(sources: object) -> Iterator[object]:
    """Single sources out of lists and tuples of any depth, in order."""
    if isinstance(sources, (list, tuple)):
        for s in sources:
            yield from flatten(s)
    else:
        yield sources
