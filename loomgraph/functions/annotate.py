"""Marks put around parts of texts (FN12)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def marked(text: str, spans: list[dict], nested: bool = True, crossed: str = "drop") -> str:
    """A text with each span's `open` before its start and its `close` behind its end.

    Spans may lie in each other: the longer one goes outside, of equal ones the first given; with `nested` off only the
    outermost are marked. Of two that cross, the one that starts later goes, or it is an error (`crossed`). An empty span
    is marked where it is: behind a span that ends there, in one that it equals. Spans with a bound that is null or
    outside the text go."""
    around: list[dict] = []
    out, at = [], 0

    def upto(place: int) -> None:
        nonlocal at
        out.append(text[at:place])
        at = place

    def leave() -> None:
        last = around.pop()
        upto(int(last["end"]))
        out.append(last["close"])

    whole = [s for s in spans if s["start"] is not None and s["end"] is not None and 0 <= s["start"] <= s["end"] <= len(text)]
    for s in sorted(whole, key=lambda s: (s["start"], -s["end"])):
        while around and around[-1]["end"] <= s["start"] and around[-1]["start"] < s["end"]:
            leave()
        if around and s["end"] > around[-1]["end"]:
            if crossed != "drop":
                raise ValueError(f"spans cross: {around[-1]} and {s}")
            continue
        if around and not nested:
            continue
        upto(int(s["start"]))
        out.append(s["open"])
        around.append(s)
    while around:
        leave()
    return "".join([*out, text[at:]])


def annotate(text: Column, spans: Column, nested: bool = True) -> Column:
    """marked() of a column of texts and one of lists of spans (start, end, open, close); null texts stay null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([None if t is None else marked(t, [s if isinstance(s, dict) else s.asDict() for s in (ss if ss is not None else []) if s is not None], nested) for t, ss in zip(texts, lists, strict=True)], dtype=object)

    return run(text, spans)
