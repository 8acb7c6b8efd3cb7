"""Whitespace, case and list helpers as JVM column expressions."""
from pyspark.sql import Column, functions as F

from enrichflow.fixed_values import ARCHIVE_KEY_PREFIX

# Every character a Unicode-aware strip removes; plain trim() removes spaces only.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def bind(fn, **cols: Column) -> Column:
    """Evaluate columns once and hand them to ``fn`` by name.

    A column used several times is otherwise copied into the expression tree at every use, which
    grows exponentially for nested string work.
    """
    packed = F.struct(*(col.alias(name) for name, col in cols.items()))
    return F.element_at(F.transform(F.array(packed), lambda row: fn(**{name: row[name] for name in cols})), 1)


def once(col: Column) -> Column:
    """The same values behind a barrier: filters and explodes on the column stay above its computation.

    Catalyst pushes a filter on a computed column below the projection and computes the column again
    inside the filter, which doubles expensive text work. It leaves non-deterministic columns alone,
    and the partition number (never negative) makes the column one without changing its values.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def strip(col: Column) -> Column:
    """Cut Unicode whitespace at both ends (linear, no regex backtracking)."""
    return F.btrim(col, F.lit(BLANKS))


def squeeze(col: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.btrim(F.regexp_replace(col, r"[\s\x1c-\x1f\x85\p{Z}]+", " "), F.lit(" "))


def _foldings() -> tuple[dict[str, str], str, str]:
    """What full case folding does beyond ``lower()``: characters that become several, and single ones (from, to)."""
    lowered = {chr(i).lower() for i in range(0x110000) if not 0xD800 <= i < 0xE000}
    folded = {c: c.casefold() for c in sorted(lowered, key=lambda c: (len(c), c)) if len(c) == 1 and c.casefold() != c}
    one = {c: f for c, f in folded.items() if len(f) == 1}
    return {c: f for c, f in folded.items() if len(f) > 1}, "".join(one), "".join(one.values())


_LONG, _FROM, _TO = _foldings()
_WESTERN = "\u0148"  # up to here, two characters fold further than lower() does


def _ranges() -> str:
    """A class of few ranges that holds every folding character above ``_WESTERN``; gaps of up to 64 code points are filled."""
    points = sorted(ord(c) for c in [*_LONG, *_FROM] if c > _WESTERN)
    runs = [[points[0], points[0]]]
    for point in points[1:]:
        if point - runs[-1][1] > 64:
            runs.append([point, point])
        runs[-1][1] = point
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


_FAR = _ranges()


def fold_case(col: Column) -> Column:
    """Full Unicode case folding. A text without far characters that may fold costs one test and two replacements."""
    low = F.lower(col)

    def fold(singles: str, to: str, several: dict[str, str]) -> Column:
        out = F.translate(low, singles, to) if singles else low
        for char, text in several.items():
            out = F.replace(out, F.lit(char), F.lit(text))
        return out

    near = {c: f for c, f in {**_LONG, **dict(zip(_FROM, _TO))}.items() if c <= _WESTERN}
    return F.when(low.rlike(_FAR), fold(_FROM, _TO, _LONG)).otherwise(fold("", "", near) if near else low)


def fold_title(col: Column) -> Column:
    """Comparison form of a title: case folded, whitespace collapsed."""
    return squeeze(fold_case(col))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def numbered(items: Column) -> Column:
    """``1. a\\n2. b`` from an array of strings."""
    return F.array_join(
        F.transform(items, lambda text, i: F.concat((i + 1).cast("string"), F.lit(". "), text)), "\n"
    )


def archive_key(archive_id: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_KEY_PREFIX), archive_id)


def escape_markup(col: Column) -> Column:
    """Escape the five markup characters; the ampersand goes first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(raw), F.lit(entity))
    return col
