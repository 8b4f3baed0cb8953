"""Rows of two frames as sorted text, doubles to five digits."""

import math


def _cell(v):
    if v is None or str(v) == "<NA>" or v != v:
        return "None"
    if isinstance(v, float):
        v = round(v, 5)
        return "0" if v == 0 or not math.isfinite(v) else f"{v:.5f}"
    text = str(v).removesuffix(" 00:00:00")
    return "None" if text in ("NaT", "<NA>") else text


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(_cell(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))
