"""Spans of pattern matches in DataFrame functions: positions in code points,
end exclusive, in time that grows with the text and its spans.

Sums and maxima along an array go by blocks of places, and pieces of a text are
taken out of blocks of its characters, so nothing is done over from the start
of the text or of the array for each span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Set around matches; a text's own marks are changed to a neighbour first, which no pattern here tells apart.
_MARK, _OTHER = "\uE000", "\uE001"
_BLOCK = 128
#: Code points of a block of text.
_TEXT_BLOCK = 256

SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def record(**fields: Column) -> Column:
    """A struct by explicit names; aliases are lost deep inside nested lambdas."""
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def total(a: Column, b: Column) -> Column:
    return a + b


def most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def before_each(values: Column, op: Callable[[Column, Column], Column], levels: int = 1) -> Column:
    """``op`` (a sum, a maximum) over 0 and all ints before each place."""
    over = lambda c: F.aggregate(c, F.lit(0), op)

    def inside(v: Column, sums: Column | None) -> Column:
        # sums before each block, then over the places of the own block
        def place(_: Column, i: Column) -> Column:
            at = F.floor(i / _BLOCK).cast("int")
            return over(F.slice(v, F.lit(1), i)) if sums is None else op(F.get(sums, at), over(F.slice(v, at * _BLOCK + 1, i % _BLOCK)))

        return F.transform(v, place)

    if not levels:
        return let(values, lambda v: inside(v, None))
    whole = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / _BLOCK).cast("int"), F.lit(0))), lambda b: over(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(values, lambda v: let(before_each(whole(v), op, levels - 1), lambda sums: inside(v, sums)))


def text_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end`` of the text of the blocks."""
    first = F.floor(start / _TEXT_BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / _TEXT_BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * _TEXT_BLOCK + 1, end - start)).otherwise("")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches."""
    return between_marks(F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_OTHER)), pattern, f"{_MARK}$0{_MARK}"))


def between_marks(marked: Column) -> Column:
    """array<struct<start, end, value>> of what is set between marks, as places of the text without marks."""
    return let(F.split(marked, _MARK), lambda parts: F.when(F.size(parts) > 1, _located(parts)).otherwise(F.array().cast(SPAN)))


def without_marks(marked: Column) -> Column:
    return F.replace(marked, F.lit(_MARK), F.lit(""))


def rewritten(text: Column, spans: Column, form: Callable[[Column, Column], Column]) -> Column:
    """The text with ``form`` of each span and its value between marks in its
    place; ``spans`` are sorted by start and do not overlap."""
    text = F.replace(text, F.lit(_MARK), F.lit(_OTHER))

    def parts(blocks: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: let(
            F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0),
            lambda start: F.when(i < F.size(spans), let(F.get(spans, i), lambda s: F.concat(
                piece(blocks, start, s["start"]), F.lit(_MARK), let(piece(blocks, s["start"], s["end"]), lambda v: form(s, v)), F.lit(_MARK))))
            .otherwise(piece(blocks, start, F.length(text)))))

    return F.when(F.size(spans) > 0, F.array_join(let(text_blocks(text), parts), "")).otherwise(text)


def _located(parts: Column) -> Column:
    """Gaps and matches in turn, to spans."""
    def spans(n: Column, before: Column) -> Column:
        def one(i: Column) -> Column:
            at = 2 * i + 1
            return let(F.get(before, at), lambda s: record(start=s, end=s + F.get(n, at), value=F.get(parts, at)))

        return F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), one)

    return let(F.transform(parts, F.length), lambda n: let(before_each(n, total), lambda before: spans(n, before)))


def free_of(spans: Column, others: Column) -> Column:
    """Those of ``spans``, which are in order and do not overlap, that overlap
    none of ``others``. All are put in order by start: what began before and
    reaches into a span shows in the greatest end so far, and what begins within
    it is the next one in order."""
    def tagged(c: Column, own: int) -> Column:
        return F.transform(c, lambda s, i: record(start=s["start"], own=F.lit(own), end=s["end"], at=i))

    def kept(own: Column, every: Column, reach: Column) -> Column:
        def is_free(e: Column, i: Column) -> Column:
            after = F.get(every, i + 1)
            return (e["own"] == 1) & (F.get(reach, i) <= e["start"]) & ~F.coalesce((after["own"] == 0) & (after["start"] < e["end"]), F.lit(False))

        return F.transform(F.filter(every, is_free), lambda e: F.get(own, e["at"]))

    def among(own: Column, taken: Column) -> Column:
        ordered = lambda body: let(F.array_sort(F.concat(tagged(taken, 0), tagged(own, 1))), body)
        reach = lambda every: before_each(F.transform(every, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(0)), most)
        return F.when((F.size(own) > 0) & (F.size(taken) > 0), ordered(lambda every: let(reach(every), lambda r: kept(own, every, r)))).otherwise(own)

    return let(spans, lambda own: let(others, lambda taken: among(own, taken)))


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined; ``spans`` hold the number of their kind as ``kind``."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def runs(spans: Column) -> Column:
    """array<struct<start, end>>: overlapping spans as one; ``spans`` are sorted by start."""
    def heads(every: Column, reach: Column) -> Column:
        first = F.filter(F.transform(every, lambda s, i: record(start=s["start"], reach=F.get(reach, i), i=i)), lambda x: (x["i"] == 0) | (x["start"] >= x["reach"]))
        # a run ends where the greatest end lies when the next one begins
        last = F.array_max(F.transform(every, lambda s: s["end"]))
        return let(first, lambda h: let(last, lambda z: F.transform(h, lambda x, i: record(start=x["start"], end=F.coalesce(F.get(h, i + 1)["reach"], z)))))

    return let(spans, lambda every: let(before_each(F.transform(every, lambda s: s["end"]), most), lambda reach: heads(every, reach)))


def redact(text: Column, spans: Column, by: str) -> Column:
    """The text with each run of overlapping spans replaced; ``spans`` are sorted by start."""
    def cut(found: Column, blocks: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(found)), lambda i: let(
            F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0),
            lambda start: piece(blocks, start, F.when(i < F.size(found), F.get(found, i)["start"]).otherwise(F.length(text))))), by)

    return F.when(F.size(spans) > 0, let(runs(spans), lambda found: let(text_blocks(text), lambda blocks: cut(found, blocks)))).otherwise(text)
