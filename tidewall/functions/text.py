"""Text columns: masks, excerpts, matches and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FOLD_BLOCK = 1024
_TEXT_BLOCK = 32768


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def mask_value(value: Column, mask_char="*") -> Column:
    """Keep the first and last character; mask everything when there are at most two."""
    n = F.length(value)
    ch = _lit(mask_char)
    return F.when(n <= 2, F.repeat(ch, n)).otherwise(
        F.concat(F.substring(value, 1, 1), F.repeat(ch, n - 2), F.right(value, F.lit(1)))
    )


def context_excerpt(text: Column, offset: Column, length: Column, radius: int = 40) -> Column:
    """Up to ``radius`` characters either side of a match, cut to a word start, with ellipses."""
    start = F.greatest(offset - radius, F.lit(0))
    end = F.least(offset + length + radius, F.length(text))
    raw = F.substring(text, start + 1, end - start)
    space = F.instr(raw, " ")
    cut = F.when((start > 0) & (space > 1), F.substring(raw, space, F.length(raw))).otherwise(raw)
    return F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
        cut,
        F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )


def before_window(text: Column, offset: Column, size: int) -> Column:
    start = F.greatest(offset - size, F.lit(0))
    return F.substring(text, start + 1, offset - start)


def after_window(text: Column, offset: Column, length: Column, size: int) -> Column:
    return F.substring(text, offset + length + 1, F.lit(size))


def gap_lengths(text: Column, pattern: str) -> Column:
    """Lengths of the stretches between the hits of a pattern (one more than there are hits)."""
    return F.transform(F.split(text, pattern, -1), lambda p: F.length(p))


def _blocks(array: Column, size: int = _FOLD_BLOCK) -> Column:
    """An array cut into arrays of ``size`` elements."""
    last = F.floor((F.size(array) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(array, b * size + 1, size))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: the one element of an array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hit_offsets(hits: Column, gaps: Column) -> Column:
    """Character offsets of hits, given the gap lengths around them.

    A prefix sum over an array, in runs of 1,024 hits: first the sum of each run, then the sums before each run, then
    the places inside it, so that a hit costs the same however many there are. Both arguments must be
    materialised columns.
    """
    add = lambda a, x: a + x
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.greatest(F.size(hits), F.lit(1))), lambda h, g: F.struct(g.alias("g"), F.length(h).alias("l")))

    def places(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["g"] + x["l"]))

        def with_sums(sums: Column) -> Column:
            def run(block: Column, i: Column) -> Column:
                start = F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), add)
                return F.aggregate(
                    block,
                    F.struct(start.alias("pos"), F.array().cast("array<int>").alias("out")),
                    lambda acc, x: F.struct(
                        (acc["pos"] + x["g"] + x["l"]).alias("pos"), F.array_append(acc["out"], acc["pos"] + x["g"]).alias("out")
                    ),
                    lambda acc: acc["out"],
                )

            return F.flatten(F.transform(blocks, run))

        return _bound(sums, with_sums)

    cut = _bound(pairs, lambda p: _bound(_blocks(p), places))
    return F.when(F.size(hits) == 0, F.array().cast("array<int>")).otherwise(cut)


def redaction_segments(matches: Column) -> Column:
    """Non-overlapping stretches to overwrite, from matches ordered by offset.

    A character covered by several matches takes the mask of the one that starts first; of two that
    start together, the later rule.
    """
    ordered = F.array_sort(
        F.transform(
            matches,
            lambda m: F.struct(
                m["offset"].alias("s"), (-m["rule_ord"]).alias("p"), m["length"].alias("n"), m["masked_text"].alias("t")
            ),
        )
    )
    empty = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def fold(block: Column, reached: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(reached.alias("cur"), empty.alias("out")),
            lambda acc, m: F.when(m["s"] + m["n"] <= acc["cur"], acc).otherwise(
                F.struct(
                    (m["s"] + m["n"]).alias("cur"),
                    F.array_append(
                        acc["out"],
                        F.struct(
                            F.greatest(m["s"], acc["cur"]).alias("s"),
                            (m["s"] + m["n"]).alias("e"),
                            F.substring(m["t"], F.greatest(acc["cur"] - m["s"], F.lit(0)) + 1, m["n"]).alias("t"),
                        ),
                    ).alias("out"),
                )
            ),
            lambda acc: acc["out"],
        )

    def segments(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda m: m["s"] + m["n"])))
        reached = lambda ends, i: F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0))
        return _bound(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: fold(b, reached(e, i)))))

    # the end reached before a run of matches is the largest end of the runs before it
    cut = _bound(ordered, lambda o: _bound(_blocks(o), segments))
    return F.when(F.size(matches) == 0, empty).otherwise(cut)


def overwrite_segments(text: Column, segments: Column) -> Column:
    """Write segments over a text. Long texts go in blocks so that each write copies one block only, and
    in stretches of 32 blocks so that a block looks through the segments of its stretch only."""

    def within(segs: Column, lo: Column, hi: Column) -> Column:
        return F.filter(segs, lambda s: (s["e"] > lo) & (s["s"] < hi))

    def one(block: Column, lo: Column, segs: Column) -> Column:
        hi = lo + _TEXT_BLOCK
        return F.aggregate(
            within(segs, lo, hi),
            block,
            lambda acc, s: F.overlay(
                acc,
                F.substring(
                    s["t"],
                    F.greatest(lo - s["s"], F.lit(0)) + 1,
                    F.least(s["e"], hi) - F.greatest(s["s"], lo),
                ),
                F.greatest(s["s"], lo) - lo + 1,
            ),
        )

    def stretch(part: Column, i: Column) -> Column:
        size = 32 * _TEXT_BLOCK
        lo = i * size
        blocks = F.regexp_extract_all(part, F.lit(r"(?s).{1,%d}" % _TEXT_BLOCK), F.lit(0))
        mine = within(segments, lo, lo + size)
        return _bound(mine, lambda segs: F.array_join(F.transform(blocks, lambda b, j: one(b, lo + j * _TEXT_BLOCK, segs)), ""))

    stretches = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % (32 * _TEXT_BLOCK)), F.lit(0))
    return F.when(F.size(segments) == 0, text).otherwise(F.array_join(F.transform(stretches, stretch), ""))


def contains_any(col: Column, words) -> Column:
    """Whether the text holds any of the words; false for null."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col, F.lit(w))
    return F.coalesce(out, F.lit(False))
