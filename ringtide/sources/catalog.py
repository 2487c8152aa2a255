"""Recordings on disk: which system wrote a folder, and which of its streams is which."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = {"adc": r"[-_.]adc$", "lf": r"[-_.](lfp|lf)$"}


def band_of(name, band: str) -> Column:
    """Whether a stream's name ends in the suffix of a side band."""
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(c).rlike(BANDS[band])


def detect_layout(folder: str) -> str:
    """"meta" for folders with sidecar files, "structured" for folders with a structure file."""
    structured = False
    for _root, _dirs, files in os.walk(folder):
        if any(f.endswith(".meta") for f in files):
            return "meta"
        structured = structured or "structure.oebin" in files or "settings.xml" in files
    if structured:
        return "structured"
    raise ValueError(f"{folder}: no recording layout recognised")


def stream_candidates(names: list[str], layout: str, band: str = "ap") -> list[str]:
    """Streams of one band, by the naming rules of the layout."""
    lowered = [(n, n.lower()) for n in names]
    if layout == "meta":
        if band == "adc":
            return [n for n, low in lowered if low.startswith("nidq")]
        return [n for n, low in lowered if low.endswith("." + band)]
    if band == "adc":
        return [n for n, low in lowered if re.search(BANDS["adc"], low)]
    probes = [(n, low) for n, low in lowered if "probe" in low]
    if band == "lf":
        return [n for n, low in probes if re.search(BANDS["lf"], low)]
    return [n for n, low in probes if not re.search(BANDS["lf"], low) and not re.search(BANDS["adc"], low)]


def only_stream(names: list[str], layout: str, band: str = "ap") -> str | None:
    """The one stream of a band; None where a side band is absent, refused where several fit."""
    found = stream_candidates(names, layout, band)
    if len(found) == 1:
        return found[0]
    if not found and band != "ap":
        return None
    raise ValueError(f"{len(found)} streams fit band {band!r}: {found or names}")
