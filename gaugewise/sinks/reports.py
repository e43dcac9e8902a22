"""Archive of the CSV files of a run."""

from __future__ import annotations

import zipfile
from pathlib import Path


def collect_statistics(folder: str | Path, archive: str = "statistics.zip") -> Path | None:
    """Packs all CSV files below ``folder`` into one archive inside it; None if there are none."""
    root = Path(folder)
    files = sorted(p for p in root.rglob("*.csv") if p.is_file())
    if not files:
        return None
    target = root / archive
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for file in files:
            packed.write(file, file.relative_to(root))
    return target
