"""Model folders on disk: what is installed, how large it is, and removal."""

from __future__ import annotations

import shutil
from pathlib import Path

from pagemill.errors import DownloadError
from pagemill.operators import catalog


class ModelCache:
    """A folder of model folders, by canonical id; a model is installed if its folder has anything in it."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def path(self, name: str) -> Path:
        return self.root / catalog.get(name)[0]

    def is_installed(self, name: str) -> bool:
        p = self.path(name)
        return p.is_dir() and any(p.iterdir())

    def installed(self) -> list[str]:
        return [m[0] for m in catalog.MODELS if self.is_installed(m[0])]

    def disk_usage_gb(self, name: str) -> float:
        p = self.path(name)
        return round(sum(f.stat().st_size for f in p.rglob("*") if f.is_file()) / 1024**3, 3) if p.exists() else 0.0

    def remove(self, name: str) -> bool:
        """Whether there was something to remove; an unknown name raises before anything is touched."""
        p = self.path(name)
        if not p.exists():
            return False
        shutil.rmtree(p)
        return True

    def download(self, name: str, fetch=None, force: bool = False) -> Path:
        """Fetch a model by ``fetch(repository, folder)`` unless it is installed; there is no default fetcher."""
        p = self.path(name)
        if self.is_installed(name) and not force:
            return p
        if fetch is None:
            raise DownloadError(f"no fetcher for {catalog.get(name)[9]}")
        p.mkdir(parents=True, exist_ok=True)
        try:
            fetch(catalog.get(name)[9], p)
        except OSError as e:
            raise DownloadError(str(e)) from e
        return p
