"""Models by their catalog id, and PDF rendering: adapters that import what they need when they are loaded."""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable
from dataclasses import dataclass

from pagemill.errors import BackendUnavailableError
from pagemill.operators import catalog
from pagemill.operators.prompts import DEFAULT_PROMPT
from pagemill.operators.recognise import Recogniser


def _imported(name: str, what: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise BackendUnavailableError(f"{what} needs the package {name!r}, which is not installed") from e


def choose_device(wanted: str | None = None) -> str:
    """``wanted`` if given, else cuda where torch finds it, else cpu."""
    if wanted:
        return wanted
    try:
        return "cuda" if importlib.import_module("torch").cuda.is_available() else "cpu"
    except ImportError:
        return "cpu"


@dataclass(frozen=True)
class Limits:
    """What a model generates unless told otherwise, and what it needs on a GPU."""

    max_new_tokens: int
    min_vram_gb: float


# Each model's default token limit and least video memory.
LIMITS = {"glm-ocr": Limits(512, 6.0), "smolvlm": Limits(512, 2.0), "lighton-ocr": Limits(1024, 4.0), "hunyuan-ocr": Limits(4096, 8.0)}


class VisionModel(Recogniser):
    """A vision-language model of the catalog through the transformers library; pages are image objects or encoded images."""

    def __init__(self, model_id: str, device: str | None = None, weights: str | None = None):
        row = catalog.get(model_id)
        self.model_id, self.limits, self.weights, self.wanted = row[0], LIMITS[row[0]], weights or row[9], device
        self.device: str | None = None
        self._processor = self._model = None

    def load(self) -> None:
        if self._model is not None:
            return
        library, torch = _imported("transformers", self.model_id), _imported("torch", self.model_id)
        self.device = choose_device(self.wanted)
        kind = torch.bfloat16 if self.device == "cuda" else torch.float32
        self._processor = library.AutoProcessor.from_pretrained(self.weights, trust_remote_code=True)
        self._model = library.AutoModelForImageTextToText.from_pretrained(self.weights, torch_dtype=kind, trust_remote_code=True).to(self.device).eval()

    def predict(self, page, prompt: str | None = None, max_new_tokens: int | None = None) -> str:
        self.load()
        if isinstance(page, (bytes, bytearray)):
            page = _imported("PIL.Image", self.model_id).open(io.BytesIO(page)).convert("RGB")
        asked = [{"role": "user", "content": [{"type": "image", "image": page}, {"type": "text", "text": prompt or DEFAULT_PROMPT}]}]
        inputs = self._processor.apply_chat_template(asked, tokenize=True, add_generation_prompt=True, return_dict=True, return_tensors="pt").to(self.device)
        with _imported("torch", self.model_id).inference_mode():
            out = self._model.generate(**inputs, max_new_tokens=max_new_tokens or self.limits.max_new_tokens, do_sample=False)
        return self._processor.decode(out[0, inputs["input_ids"].shape[1] :], skip_special_tokens=True).strip()

    def device_requirements(self) -> dict[str, object]:
        return {"cuda": False, "min_vram_gb": self.limits.min_vram_gb}


Factory = Callable[[], Recogniser]
_REGISTERED: dict[str, Callable[[str | None], Recogniser]] = {}


def register(model_id: str, make: Callable[[str | None], Recogniser]) -> None:
    """``make(device)`` takes the place of the built-in adapter of a catalog model."""
    _REGISTERED[catalog.get(model_id)[0]] = make


def factory(model_id: str, device: str | None = None) -> Factory:
    """What makes the recogniser of a model, by id or any name the catalog knows; nothing is imported or loaded yet."""
    known = catalog.get(model_id)[0]
    own = _REGISTERED.get(known)
    return (lambda: own(device)) if own else (lambda: VisionModel(known, device))


def render_pdf(data: bytes, dpi: int = 200, pages: list[int] | None = None) -> list[object]:
    """RGB images of a PDF's pages (1-based ``pages``, all by default) at ``dpi`` / 72 of its own size."""
    document = _imported("pypdfium2", "PDF rendering").PdfDocument(data)
    try:
        wanted = range(1, len(document) + 1) if pages is None else pages
        return [document[n - 1].render(scale=dpi / 72).to_pil().convert("RGB") for n in wanted]
    finally:
        document.close()
