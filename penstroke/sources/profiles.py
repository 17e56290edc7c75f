"""Stored profiles."""

from __future__ import annotations

import json
from pathlib import Path


def load_profile(spec: str) -> tuple[str, dict]:
    """Label and profile of ``path`` or ``label:path``; without a label the file's stem is the label.

    A colon in first or second place is a drive's, and an existing path has no label.
    """
    at = spec.find(":")
    label, path = (spec[:at], spec[at + 1 :]) if at > 1 and not Path(spec).exists() else (Path(spec).stem, spec)
    return label, json.loads(Path(path).read_text(encoding="utf-8"))
