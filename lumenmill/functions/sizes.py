"""Sizes of memory as text."""

from __future__ import annotations

import re

POWERS = {"": 0, "B": 0, "KB": 1, "MB": 2, "GB": 3, "K": 1, "M": 2, "G": 3, "KI": 1, "MI": 2, "GI": 3}


def memory_bytes(text: str) -> int:
    """Bytes of a size such as ``2GB``, ``0.5 gb``, ``4Gi`` or ``1024``; every unit counts in powers of 1024."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([A-Za-z]*)\s*", str(text))
    if not found or found[2].upper() not in POWERS:
        raise ValueError(f"{text!r} is not a size of memory")
    return int(float(found[1]) * 1024 ** POWERS[found[2].upper()])
