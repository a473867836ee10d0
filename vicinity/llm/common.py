"""What the corpus operators share: tables, the shared folder and word rules."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import drop, scope, shared_path, written

__all__ = ["NOT_WORD", "WORD_SPACE", "drop", "lower_ascii", "released", "resident", "scope", "shared_path", "strings", "table", "words_of", "written"]

#: White space that separates words: space and the five controls 0x09-0x0D.
WORD_SPACE = "\x20\x09-\x0d"
NOT_WORD = re.compile(f"[{WORD_SPACE}]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of characters other than the six white-space ones."""
    if not text:
        return []
    if text.isascii():
        # split() also cuts at 0x1C-0x1F, which are word characters here
        if not _ODD_ASCII.search(text):
            return text.split()
    return [w for w in NOT_WORD.split(text) if w]


_ODD_ASCII = re.compile("[\x1c-\x1f]")


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def strings(texts: pa.Array) -> pa.Array:
    """The texts as large strings, null as empty, in buffers of their own: some kernels misread a slice that was cast."""
    own = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))
    return own.cast(pa.large_string())


def released() -> None:
    """Gives memory that a task has freed back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_resident: tuple = (None, None)


def resident(name: object, make: Callable[[], object] | None = None) -> object:
    """The one object that a Python worker keeps between its tasks: a model or codec with its cache. Whatever another
    operator has left there goes first, so a worker that serves many stages holds one of them at a time."""
    global _resident
    if _resident[0] != name:
        _resident = (None, None)
        released()
        _resident = (name, make() if make else None)
    return _resident[1]
