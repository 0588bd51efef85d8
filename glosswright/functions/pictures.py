"""Sizes of pictures from the heads of their files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])
# Fixed values of the formats.
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
#: JPEG segments that hold a size, and those without a length.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
BARE = {0x01, *range(0xD0, 0xD9)}


def picture_size(data: bytes | None) -> tuple[int | None, int | None]:
    """Width and height of a PNG or JPEG file, which may be cut off after its head; nulls for what is neither, or has no size in what there is of it."""
    data = data or b""
    if data.startswith(PNG):
        return struct.unpack(">II", data[16:24]) if data[12:16] == b"IHDR" and len(data) >= 24 else (None, None)
    if not data.startswith(JPEG):
        return None, None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None, None
        kind = data[at + 1]
        if kind == 0xFF:  # padding
            at += 1
        elif kind in BARE:
            at += 2
        elif kind in FRAMES:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None, None


@F.pandas_udf(SIZE)
def picture_sizes(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([picture_size(x) for x in data], columns=["width", "height"]).astype("Int32")
