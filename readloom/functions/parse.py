"""Text options: shifts, truncation, strands, sample names."""

from __future__ import annotations

from pathlib import Path

STRANDS = {"forward": "forward", "fwd": "forward", "+": "forward", "reverse": "reverse", "rev": "reverse", "-": "reverse", "both": "both"}


def _whole(part: str) -> int | None:
    try:
        return int(part.strip())
    except ValueError:
        return None


def shift(text: str) -> tuple[int, int, int, int]:
    """``five,three,five_reverse,three_reverse``; a part that is no number is 0."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError(f"a shift has 4 parts, not {len(parts)}: {text!r}")
    a, b, c, d = (_whole(p) or 0 for p in parts)
    return a, b, c, d


def truncation(text: str) -> tuple[int | None, int | None]:
    """``five,three``; a part that is no number is left out."""
    parts = text.split(",")
    if len(parts) != 2:
        raise ValueError(f"a truncation has 2 parts, not {len(parts)}: {text!r}")
    return _whole(parts[0]), _whole(parts[1])


def strand(text: str) -> str:
    if text.lower() not in STRANDS:
        raise ValueError(f"unknown strand {text!r}")
    return STRANDS[text.lower()]


def sample_names(paths: list[str]) -> list[str]:
    """File stems; one that is taken gets the next of ``_1``, ``_2`` and so on that neither a stem nor a name before it is."""
    stems = [Path(p).stem for p in paths]
    out: list[str] = []
    for stem in stems:
        name, k = stem, 0
        while name in out or (k and name in stems):
            k += 1
            name = f"{stem}_{k}"
        out.append(name)
    return out
