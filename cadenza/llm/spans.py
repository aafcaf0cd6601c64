"""Spans of pattern matches, with built-in functions only.

``split`` gives the text between the matches and ``regexp_extract_all`` the
matches; both walk the leftmost non-overlapping matches, so running sums of
their lengths are the offsets, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import fresh

SPAN = "array<struct<kind:string,start:int,end:int,text:string,before:string>>"
#: Code points kept of the text before a match.
BEFORE = 24
#: Spans are appended in groups of this size, else appending would copy too much.
GROUP = 256


def empty() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def matches(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """All matched texts; ``needs`` is a cheap condition that any match fulfils."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if needs is None else F.when(needs, found).otherwise(F.expr("cast(array() as array<string>)"))


def spans(text: Column, found: Column, kind: str, pattern: str) -> Column:
    """The matches ``found`` as an array of (kind, start, end, text, before)."""
    gaps = F.transform(
        F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(BEFORE)).alias("tail"))
    )
    both = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / GROUP).cast("int")),
        lambda i: F.slice(both, i * GROUP + 1, F.least(F.lit(GROUP), F.size(found) - i * GROUP)),
    )

    def one(acc: Column, b: Column) -> Column:
        begin = acc["at"] + b["g"]["n"]
        end = begin + F.length(b["m"])
        span = F.struct(
            F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), b["m"].alias("text"), b["g"]["tail"].alias("before")
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def group(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), empty().alias("out")), one)
        return F.transform(
            F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out"))
        )[0]

    start = F.struct(F.lit(0).alias("at"), empty().alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(groups, start, group, lambda acc: acc["out"])).otherwise(empty())


def with_spans(df: DataFrame, text: str, rules: dict[str, tuple[str, str, Column | None]]) -> DataFrame:
    """Add a column of spans per rule: name -> (kind, pattern, needs).

    Two projections, so that no text is matched twice.
    """
    names = fresh(df, *[f"{n}_found" for n in rules])
    df = df.select(
        "*", *[matches(F.col(text), pattern, needs).alias(n) for n, (_, pattern, needs) in zip(names, rules.values())]
    )
    return df.select(
        *[c for c in df.columns if c not in names],
        *[
            spans(F.col(text), F.col(f), kind, pattern).alias(n)
            for f, (n, (kind, pattern, _)) in zip(names, rules.items())
        ],
    )


def digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def listed(found: Column, order: list[str]) -> Column:
    """Spans as "kind:start:end", comma-joined, by start and then by kind."""
    rank = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")
        ),
    )
    parts = F.transform(
        F.array_sort(F.array_distinct(keyed)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def counted(found: Column) -> Column:
    return F.size(found).cast("long")
