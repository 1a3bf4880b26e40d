"""Cutting oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.space import WHITE_SPACE

#: Ends of paragraphs, sentences, clauses and words, strongest first; the end of the match is the boundary.
_BOUNDARIES = tuple(
    re.compile(x)
    for x in (
        rf"\n[{WHITE_SPACE}]*\n[{WHITE_SPACE}]*",
        rf"[.!?…。！？]+[\"'»”’)\]]*[{WHITE_SPACE}]+",
        rf"[;:][{WHITE_SPACE}]+|\r?\n[{WHITE_SPACE}]*",
        rf"[{WHITE_SPACE}]+",
    )
)
_TOKEN = re.compile(rf"[^{WHITE_SPACE}]+[{WHITE_SPACE}]*|[{WHITE_SPACE}]+")


@dataclass(frozen=True)
class SplitParams:
    limit: int  # greatest length of a piece, in code points
    overlap: int = 224  # greatest length that a piece repeats of the one before
    least_fill: float = 0.5  # a stronger boundary is preferred only if it fills this share of the limit


def _joined(text: str, at: int) -> bool:
    """Whether a cut at `at` would part a mark, a joiner or a selector from its base."""
    return unicodedata.category(text[at]) in ("Mn", "Mc", "Me", "Cf", "Sk") or ord(text[at - 1]) == 0x200D


def spans(text: str, p: SplitParams) -> list[tuple[int, int]]:
    """The [start, end) of each piece of the text; one span if it is not over the limit."""
    size = len(text)
    if size <= p.limit:
        return [(0, size)] if size else []
    levels = [[m.end() for m in b.finditer(text)] for b in _BOUNDARIES]
    # The sizes of the tokens, summed up: entry i is where token i starts.
    starts = [0, *accumulate(len(m.group()) for m in _TOKEN.finditer(text))]
    out, start, done = [], 0, 0
    while True:
        reach = start + p.limit
        if reach >= size:
            return [*out, (start, size)]
        end = 0
        for least in (max(done, start + int(p.limit * p.least_fill)), done):
            for ends in levels:
                i = bisect_right(ends, reach) - 1
                if i >= 0 and ends[i] > least:
                    end = ends[i]
                    break
            if end:
                break
        if not end:  # no boundary at all: a hard cut, but not inside a cluster of marks
            end = reach
            while end > done + 1 and end > reach - 32 and _joined(text, end):
                end -= 1
            if _joined(text, end):
                end = reach
        out.append((start, end))
        # Step back by the overlap, to the first token that starts within it; with none, to a place inside a token.
        i = bisect_left(starts, end - p.overlap)
        back = starts[i] if i < len(starts) and starts[i] < end else end - p.overlap
        start, done = max(back, start + 1, end - p.limit + 1), end


def split_fields(df: DataFrame, id_cols: list[str], fields: dict[str, SplitParams]) -> DataFrame:
    """(id_cols..., field, piece_no, start, end, text): the pieces of every text over its field's limit, in order from 0.

    Length is counted in code points, after white space at both ends is removed; start and end refer to that text.
    A piece never exceeds the limit and never repeats more than `overlap` of the one before; joining the pieces
    without what they repeat gives the text back. Null, empty and blank texts and texts within the limit give no
    rows. Equal texts of the same ids give their pieces once, different ones all of theirs. Ids may be null. Only
    id_cols and the fields are read, all of them in one scan.
    """
    keys = [df.schema[c] for c in id_cols]
    texts = {f: f"__text{n}" for n, f in enumerate(fields)}
    over = reduce(lambda a, b: a | b, [F.coalesce(F.length(F.col(f)) > p.limit, F.lit(False)) for f, p in fields.items()])
    rows = df.filter(over).select(*id_cols, *(F.col(f).alias(t) for f, t in texts.items()))
    names = [*id_cols, "field", "piece_no", "start", "end", "text", "__whole"]
    schema = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in keys) + ", field string, piece_no int, start int, end int, text string, __whole long"
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())

    def run(batches):
        for b in batches:
            row, cols = [], tuple([] for _ in types)
            for field, p in fields.items():
                for i, text in enumerate(b.column(texts[field]).to_pylist()):
                    if text is None or len(text) <= p.limit or len(text := text.strip(WHITE_SPACE)) <= p.limit:
                        continue
                    whole = xxhash.xxh3_64_intdigest(text) - 2**63
                    for n, (s, e) in enumerate(spans(text, p)):
                        row.append(i)
                        for c, v in zip(cols, (field, n, s, e, text[s:e], whole)):
                            c.append(v)
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(taken) for c in id_cols] + [pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return rows.mapInArrow(run, schema).dropDuplicates([*id_cols, "field", "__whole", "piece_no"]).drop("__whole")


def split_oversized(df: DataFrame, id_cols: list[str], text_col: str, params: SplitParams) -> DataFrame:
    """(id_cols..., piece_no, start, end, text): split_fields for one field."""
    return split_fields(df, id_cols, {text_col: params}).drop("field")
