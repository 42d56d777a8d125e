"""Words of letters and digits as the resampling and search contracts cut them, byte by byte.

A word is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII; only A to Z are lower-cased.
In UTF-8 all bytes of the latter are 128 or more, so that a text is cut as bytes, without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_LETTERS = bytes(b + 32 if chr(b).isupper() and b < 128 else b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def cut_words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8; none for a null."""
    return text.translate(_LETTERS).split() if text else []


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """The texts of a batch as bytes, one at a time."""
    column = batch.column(batch.schema.get_field_index(name))
    return (x.as_py() for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()))
