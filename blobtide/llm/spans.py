"""Column helpers for arrays of struct<kind, start, end, base> found in a text (code points, end exclusive)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from blobtide.llm import words as W

SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
)
Span = tuple[str, int, int, bool]


def span_column(finder: Callable[[], Callable[[str], list[Span]]]):
    """Column function text -> spans. `finder` makes, once per worker, the function that searches a text."""

    @F.arrow_udf(SPAN_DDL)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = finder()
        for batch in batches:
            rows = []
            for data, offsets in W.slices(batch):
                raw = data.tobytes()
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    rows.append(
                        [
                            {"kind": k, "start": s, "end": e, "base": base}
                            for k, s, e, base in search(raw[a:b].decode("utf-8", "replace"))
                        ]
                    )
            yield pa.array(rows, _ARROW)

    return found


def count(spans: str, kind: str) -> Column:
    """How many base spans have this kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_digest(spans: str) -> Column:
    return F.sha2(listed(F.filter(spans, lambda s: s["base"])), 256)
