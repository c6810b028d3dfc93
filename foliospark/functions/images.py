"""Images by their bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: JPEG markers of a frame header (those of tables and arithmetic conditioning aside), and of no segment.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset((0xD8, 0xD9))


def jpeg_size(data: bytes) -> tuple[int, int]:
    """(width, height) by the first frame header; (0, 0) if the segments end or break before one."""
    at = 2
    while at + 3 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in BARE:
            at += 2
        elif marker in FRAMES:
            box = data[at + 5 : at + 9]
            return (int.from_bytes(box[2:], "big"), int.from_bytes(box[:2], "big")) if len(box) == 4 else (0, 0)
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 0, 0


def inspect(data: bytes | None, suffix: str = "") -> tuple[int, int, str]:
    """(width, height, format): by signature; else 0, 0 and the suffix in capitals."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), "PNG"
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), "GIF"
    if data[:2] == b"\xff\xd8" and (size := jpeg_size(data)) != (0, 0):
        return *size, "JPEG"
    return 0, 0, (suffix or "").lstrip(".").upper()


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("format", T.StringType())]))
def image_info(data: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inspect(d, s) for d, s in zip(data, suffix)], columns=["width", "height", "format"])
