"""Spans of pattern matches as array columns, from built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256
_PIECE = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _running(numbers: Column, whole: Callable[[Column], Column], two: Callable[[Column, Column], Column]) -> Column:
    """Running aggregate of an array, each element included. Blocks are aggregated first, so it costs little more than linearly."""
    one = lambda b: F.slice(b["n"], b["i"] * _BLOCK + 1, _BLOCK)

    def with_blocks(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda i: whole(one({"n": n, "i": i})))
        before = let(blocks, lambda b: F.transform(b, lambda _, i: F.when(i > 0, whole(F.slice(b, F.lit(1), i)))))
        return let(before, lambda b: F.transform(n, lambda _, i: let(F.floor(i / _BLOCK).cast("int"), lambda k: two(F.get(b, k), whole(F.slice(n, k * _BLOCK + 1, i % _BLOCK + 1))))))

    return let(numbers, lambda n: F.when(F.size(n) > 0, with_blocks(n)).otherwise(n))


def running_sum(numbers: Column) -> Column:
    return _running(numbers, lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x), lambda a, b: F.coalesce(a, F.lit(0)) + b)


def running_max(numbers: Column) -> Column:
    return _running(numbers, F.array_max, F.greatest)


def running_min(numbers: Column) -> Column:
    return _running(numbers, F.array_min, F.least)


def match_spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, kind, end, text>> of the leftmost non-overlapping matches; code points, end exclusive.

    The text between matches gives the positions: a match ends after all gaps and matches
    up to it.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def placed(p: Column) -> Column:
        ends = running_sum(F.transform(p["hits"], lambda h, i: F.length(h) + F.length(F.get(p["gaps"], i))))
        span = lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), h.alias("text"))
        return F.zip_with(p["hits"], ends, span)

    return let(parts, lambda p: F.when(F.size(p["hits"]) > 0, placed(p)).otherwise(no_spans()))


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind:string,end:int,text:string>>")


def spans_where(text: Column, pattern: str, kind: str, may: Column) -> Column:
    """match_spans only where the cheaper test ``may`` holds."""
    return F.when(may, match_spans(text, pattern, kind)).otherwise(no_spans())


def joined(spans: Column, key: Callable[[Column], list[Column]]) -> Column:
    """kind:start:end, comma-joined in the order of ``key``."""
    rows = F.transform(spans, lambda s: F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key(s))), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("said")))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["said"]), ",")


def rank(kind: Column, order: list[str]) -> Column:
    """Position of ``kind`` in ``order`` (from 1)."""
    return F.array_position(F.array(*map(F.lit, order)), kind)


def near_class(spans: Column, member: Callable[[Column], Column], reach: int = 0) -> Column:
    """For ``spans`` sorted by start: which of them come within ``reach`` code points of a span of the class ``member``.

    One sweep each way: of the members that start no later the greatest end decides, of those
    that start no earlier the least start. A member is near itself.
    """
    far = 1 << 30
    ends = running_max(F.transform(spans, lambda s: F.when(member(s), s["end"]).otherwise(-far)))
    starts = F.reverse(running_min(F.reverse(F.transform(spans, lambda s: F.when(member(s), s["start"]).otherwise(far)))))
    close = lambda s, i, e: (F.get(e["before"], i) > s["start"] - reach) | (F.get(e["after"], i) < s["end"] + reach)
    return let(F.struct(ends.alias("before"), starts.alias("after")), lambda e: F.transform(spans, lambda s, i: close(s, i, e)))


def keep_flagged(spans: Column, flags: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The spans for which ``keep(span, flag)`` holds."""
    return let(flags, lambda f: F.filter(spans, lambda s, i: keep(s, F.get(f, i))))


def pieces_of(text: Column) -> Column:
    """``text`` cut every ``_PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def taken(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text cut by pieces_of; costs their length and two pieces, wherever they stand."""
    first = F.floor(a / _PIECE).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, F.floor((b - 1) / _PIECE).cast("int") - first + 1), "")
    return F.when(b > a, F.substring(some, a % _PIECE + 1, b - a)).otherwise("")


def redact(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``."""
    bare = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    cut = lambda s: F.struct(s.alias("s"), running_max(F.transform(s, lambda x: x["end"])).alias("done"), pieces_of(text).alias("pieces"))

    def rest(c: Column) -> Column:
        before = lambda i: F.coalesce(F.get(c["done"], i - 1), F.lit(0))
        kept = F.transform(c["s"], lambda s, i: F.when(s["start"] >= before(i), F.concat(taken(c["pieces"], before(i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), taken(c["pieces"], F.element_at(c["done"], -1), F.length(text)))

    return F.when(F.size(spans) > 0, let(bare, lambda s: let(cut(s), rest))).otherwise(text)
