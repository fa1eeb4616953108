"""Reading single documents: a model that is fetched and loaded when it is first needed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

from pagemill import backends
from pagemill.cache import ModelCache
from pagemill.errors import ModelNotInstalledError
from pagemill.operators import catalog
from pagemill.operators.prompts import DEFAULT_PROMPT, TASK_PROMPTS, json_prompt
from pagemill.operators.recognise import Recogniser
from pagemill.sources import content

#: bytes of a PDF, dots an inch, wanted pages -> what the recogniser takes as pages.
Renderer = Callable[[bytes, int, list[int] | None], list]


def chosen(total: int, page: int | Iterable[int] | None) -> list[int]:
    """1-based numbers of the wanted pages; those out of range are left out, and if none is left all are read."""
    wanted = [] if page is None else [page] if isinstance(page, int) else list(page)
    return [n for n in wanted if 1 <= n <= total] or list(range(1, total + 1))


class Engine:
    """One catalog model for single documents; ``recognise`` and ``batch`` do the same for tables of them.

    With ``fetch`` (repository, folder) a model that is missing from the cache is fetched; without, or with
    ``auto_download`` off, a missing model raises unless a recogniser is given, which needs no files.
    """

    def __init__(self, model: str | None = None, device: str | None = None, auto_download: bool = True, cache: ModelCache | None = None, fetch: Callable | None = None, recogniser: Recogniser | None = None, render: Renderer = backends.render_pdf):
        self.entry = catalog.get(model) if model is not None else next(m for m in catalog.MODELS if m[8])
        self._device, self._recogniser, self._render, self._loaded = device, recogniser, render, False
        if recogniser is None:
            self.ensure(self.model_id, cache, fetch, auto_download)

    @property
    def model_id(self) -> str:
        return self.entry[0]

    @property
    def model_name(self) -> str:
        return self.entry[1]

    @property
    def device(self) -> str:
        return backends.choose_device(self._device)

    @property
    def is_loaded(self) -> bool:
        return self._loaded

    @staticmethod
    def ensure(model: str, cache: ModelCache | None = None, fetch: Callable | None = None, auto_download: bool = True) -> Path:
        """The model's folder, fetched if it is missing; an unknown name raises before anything else."""
        known = catalog.get(model)[0]
        cache = cache or ModelCache(Path.home() / ".cache" / "pagemill")
        if not cache.is_installed(known) and not auto_download:
            raise ModelNotInstalledError(f"Model {known!r} is not installed")
        return cache.download(known, fetch)

    def load(self) -> Recogniser:
        """The recogniser, in memory; a second call does nothing."""
        if not self._loaded:
            self._recogniser = self._recogniser or backends.factory(self.model_id, self._device)()
            self._recogniser.load()
            self._loaded = True
        return self._recogniser

    def _pages(self, source: object, dpi: int) -> tuple[list, bool]:
        found = content.load(source)
        if found.is_pdf:
            return self._render(found.data, dpi, None), True
        return [found.image if found.image is not None else found.data], False

    def read(self, source: object, prompt: str = DEFAULT_PROMPT, page: int | Iterable[int] | None = None, dpi: int = 200, max_new_tokens: int | None = None) -> str:
        """The text of a document; several pages are headed by their numbers, as ``operators.pages.assembled`` does it."""
        model = self.load()
        pages, _ = self._pages(source, dpi)
        wanted = chosen(len(pages), page)
        more = {} if max_new_tokens is None else {"max_new_tokens": max_new_tokens}
        texts = [model.predict(pages[n - 1], prompt, **more) for n in wanted]
        return texts[0] if len(texts) == 1 else "\n\n".join(f"--- Page {n} ---\n{t}" for n, t in zip(wanted, texts, strict=True))

    def read_pdf(self, source: object, prompt: str = DEFAULT_PROMPT, max_pages: int | None = None, dpi: int = 144, max_new_tokens: int | None = None) -> list[dict]:
        """page, total_pages and text of the first ``max_pages`` pages of a PDF."""
        model = self.load()
        pages, _ = self._pages(source, dpi)
        more = {} if max_new_tokens is None else {"max_new_tokens": max_new_tokens}
        return [{"page": n, "total_pages": len(pages), "text": model.predict(p, prompt, **more)} for n, p in enumerate(pages[:max_pages], 1)]

    def extract_table(self, source: object) -> str:
        return self.read(source, TASK_PROMPTS["table"])

    def extract_formula(self, source: object) -> str:
        return self.read(source, TASK_PROMPTS["formula"])

    def extract_json(self, source: object, schema: str | None = None) -> str:
        return self.read(source, json_prompt(schema))

    def batch_read(self, sources: object, prompt: str = DEFAULT_PROMPT) -> list[str]:
        """Texts of sources in order, lists inside lists included."""
        return [self.read(s, prompt) for s in content.flatten(sources)]

    def __repr__(self) -> str:
        return f"<Engine model={self.model_id!r} device={self._device!r} {'loaded' if self._loaded else 'idle'}>"
