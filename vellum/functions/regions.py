"""Notes that two hands write: managed keys and named regions are renewed, all else stays the user's.

A region NAME stands between the lines `%% vellum:NAME:start … %%` and `%% vellum:NAME:end %%`;
what follows "start" (a version, a hint) may be of any earlier form. A note is put together
anew from its parts, so every rule is about one part: keys of the frontmatter, text before,
inside and after each region. What several rules read is bound by ``let``, so a note is cut
once at each mark, not once for every part that a rule names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.identifiers import let
from vellum.sources.notes import split_frontmatter

KEY = r"^([^\s#:][^:\n]*):(?:\s|$)"


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def frontmatter_blocks(frontmatter: Column) -> Column:
    """Array of key and text: a key with the lines that belong to it; lines before the first key have none, blank ones of them are left out."""
    cut = F.split(_text(frontmatter), r"\r?\n(?=[^\s#:][^:\n]*:(?:\s|$))")
    blocks = F.transform(cut, lambda b: F.struct(F.nullif(F.trim(F.regexp_extract(b, KEY, 1)), F.lit("")).alias("key"), b.alias("text")))
    return F.filter(blocks, lambda b: b["key"].isNotNull() | (F.trim(b["text"]) != ""))


def renewed_frontmatter(existing: Column, managed: Column, owned: list[str], when_given: list[str] = ()) -> Column:
    """Frontmatter with the ``managed`` entries (array of key and text, null or empty text left out) first, then what the user has.

    Of the user's blocks those of ``owned`` keys go; ``when_given`` keys go only where
    ``managed`` has them, be it without text. Unknown keys and comments stay in order.
    """
    given = F.transform(F.coalesce(managed, F.array().cast("array<struct<key: string, text: string>>")), lambda m: m["key"])
    fresh = F.filter(F.transform(managed, lambda m: m["text"]), lambda t: _text(t) != "")
    gone = lambda b: b["key"].isin(*[k for k in owned if k not in when_given]) | (b["key"].isin(*when_given) & F.array_contains(given, b["key"]) if when_given else F.lit(False))
    kept = F.filter(frontmatter_blocks(existing), lambda b: b["key"].isNull() | ~F.coalesce(gone(b), F.lit(False)))
    return F.array_join(F.concat(F.coalesce(fresh, F.array().cast("array<string>")), F.transform(kept, lambda b: b["text"])), "\n")


def _marks(name: str) -> tuple[str, str]:
    return rf"(?m)^%% vellum:{name}:start(?:[^\S\n][^\n]*)?%%[ \t]*$", rf"(?m)^%% vellum:{name}:end %%[ \t]*$"


def opening(name: str, version: int) -> str:
    return f"%% vellum:{name}:start v{version} %%"


def closing(name: str) -> str:
    return f"%% vellum:{name}:end %%"


def _cut(text: Column, pattern: str) -> Column:
    """Struct of before, mark and rest of a text at the first match of ``pattern``, which must not be empty; null where there is none."""
    halves = lambda s: F.when(F.size(s) > 1, F.struct(s[0].alias("before"), F.regexp_extract(text, pattern, 0).alias("mark"), s[1].alias("rest")))
    return let(F.split(text, pattern, 2), halves)


def region(text: Column, name: str) -> Column:
    """Struct of before, inside and after of a region; null where the text has no opening line with a closing one after it."""
    start, end = _marks(name)
    parts = lambda s, t: F.struct(s[0].alias("before"), F.regexp_replace(t[0], r"\A\s*\n|\s+\z", "").alias("inside"), t[1].alias("after"))
    opened = lambda s: F.when(F.size(s) > 1, let(F.split(s[1], end, 2), lambda t: parts(s, t)))
    return let(F.split(_text(text), rf"{start}(?=(?s:.*?){end})", 2), opened)


def put_region(text: Column, name: str, block: Column, version: int, after: str | None = None, before: str | None = None) -> Column:
    """``text`` with the region renewed; a null block leaves the text as it is.

    A text without the region gets it after the region ``after``, else before the heading
    line ``before``, else after its first heading, else at its end.
    """
    new = F.concat(F.lit(opening(name, version) + "\n\n"), F.regexp_replace(block, r"\A\s+|\s+\z", ""), F.lit("\n\n" + closing(name)))
    ways: list[tuple] = []  # how to cut a text without the region, and what to make of it
    if after is not None:
        ways.append((rf"(?m)^%% vellum:{after}:end %%[ \t]*$", lambda c: F.concat(c["before"], c["mark"], F.lit("\n\n"), new, c["rest"])))
    if before is not None:
        ways.append((rf"(?m)^\Q{before}\E[ \t]*$", lambda c: F.concat(c["before"], new, F.lit("\n\n"), c["mark"], c["rest"])))
    ways.append((r"(?m)^# [^\n]*[ \t]*$", lambda c: F.concat(c["before"], c["mark"], F.lit("\n\n"), new, F.lit("\n"), c["rest"])))

    def placed(body: Column, k: int = 0) -> Column:
        if k == len(ways):
            return let(F.regexp_replace(body, r"\s+\z", ""), lambda ended: F.concat(ended, F.when(ended == "", "").otherwise("\n\n"), new, F.lit("\n")))
        pattern, make = ways[k]
        return let(_cut(body, pattern), lambda c: F.when(c.isNotNull(), make(c)).otherwise(placed(body, k + 1)))

    put = let(_text(text), lambda body: let(region(body, name), lambda found: F.when(found.isNotNull(), F.concat(found["before"], new, found["after"])).otherwise(placed(body))))
    return F.when(block.isNull(), text).otherwise(put)


def _both(base: Column, mine: Column, name: str, rule) -> Column:
    """A rule about a region in two notes."""
    return let(region(base, name), lambda old: let(region(mine, name), lambda now: rule(old, now)))


def region_state(base: Column, mine: Column, name: str) -> Column:
    """What the user did with a region since ``base`` was written: same, edited, removed, or new where base had none."""
    told = lambda old, now: F.when(old.isNull(), "new").when(now.isNull(), "removed").when(old["inside"] == now["inside"], "same").otherwise("edited")
    return _both(base, mine, name, told)


def own_lines(base: Column, mine: Column, name: str) -> Column:
    """Lines that the user put into a region since ``base`` was written, in order; none where either has no region."""
    lines = lambda part: F.split(part["inside"], "\n")
    added = lambda old, now: let(lines(old), lambda had: F.filter(lines(now), lambda x: (F.trim(x) != "") & ~F.array_contains(had, x)))
    return F.coalesce(_both(base, mine, name, added), F.array().cast("array<string>"))


def merged_note(base: Column, mine: Column, managed: Column, owned: list[str], regions: list[tuple[str, Column]], version: int, user_heading: str, when_given: list[str] = ()) -> Column:
    """A note after a sync: managed keys and regions from the new data, everything else from ``mine``.

    ``regions`` are names with their new text, in order; each later one goes after the one
    before it where the note lacks it. Lines that the user put into a region since ``base``
    was written are not lost: they go below the user's heading. A null note is made anew.
    """
    heading = rf"(?m)^\Q{user_heading}\E[ \t]*$"

    def renewed(body: Column, k: int = 0) -> Column:
        if k == len(regions):
            ended = F.concat(F.regexp_replace(body, r"\s+\z", ""), F.lit(f"\n\n{user_heading}\n"))
            return F.when(body.rlike(heading), body).otherwise(ended)
        (name, block), last = regions[k], regions[k - 1][0] if k else None
        return let(put_region(body, name, block, version, after=last, before=user_heading if k else None), lambda b: renewed(b, k + 1))

    def whole(base: Column, mine: Column) -> Column:
        saved = F.array_join(F.flatten(F.array(*[own_lines(base, mine, name) for name, _ in regions])), "\n")
        added = lambda body, own: F.when(own != "", F.replace(F.regexp_replace(body, heading, f"{user_heading}\n\x00"), F.lit("\n\x00"), F.concat(F.lit("\n\n"), own, F.lit("\n")))).otherwise(body)
        note = lambda parts: F.concat(
            F.lit("---\n"), renewed_frontmatter(parts["frontmatter"], managed, owned, when_given), F.lit("\n---\n\n"),
            let(renewed(F.regexp_replace(parts["body"], r"\A\n+", "")), lambda body: let(_text(saved), lambda own: added(body, own))),
        )
        return let(split_frontmatter(mine), note)

    return let(_text(base), lambda b: let(_text(mine), lambda m: whole(b, m)))
