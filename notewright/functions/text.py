"""Text and date expressions, all of them native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() sees it.
_SPACE = r"[\s\x1c-\x1f]"
_STRIP = rf"(?U)\A{_SPACE}+|{_SPACE}+\z"
_SOLID = r"(?U)[^\s\x1c-\x1f]"
#: Strings that stand for a missing value.
MISSING = ("nan", "none", "")
#: Characters a chunk may hold and chunks a text may be cut into.
CHUNK_CHARS, MOST_CHUNKS = 4000, 16


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _STRIP, "")


def is_blank(x: Column) -> Column:
    return ~x.rlike(_SOLID)


def normalize_text(x: Column) -> Column:
    """Stripped and lower-case; null if nothing is left."""
    return F.nullif(F.lower(strip(x)), F.lit(""))


def clean(x: Column) -> Column:
    """x, or null where it only says that a value is missing."""
    return F.when(~F.lower(strip(x)).isin(*MISSING), x)


def blank_missing(x: Column) -> Column:
    """A cell as a display shows it: '' for null and for a cell that reads nan."""
    s = x.cast("string")
    return F.when(s.isNull() | (F.lower(s) == "nan"), F.lit("")).otherwise(s)


_ISO = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?([+-][0-9]{2}:[0-9]{2}|Z)?)?\z"


def note_day(time: Column, shift_days: Column) -> Column:
    """The ISO time's day, moved by whole days, as yyyy-MM-dd; 'unknown' if either can't be read.

    An offset from UTC in the time does not move its day.
    """
    wall = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(time, r"([+-][0-9]{2}:[0-9]{2}|Z)\z", ""), r"\A([0-9-]{10})[T ]([0-9]{2})\z", "$1T$2:00"))
    day = F.date_format(F.date_add(wall.cast("date"), shift_days.cast("int")), "yyyy-MM-dd")
    return F.coalesce(F.when(time.rlike(_ISO), day), F.lit("unknown"))


def prompt_date(time: Column) -> Column:
    """A timestamp as prompts show it."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def _cut(text: Column, before: Column) -> Column:
    """0-based start of the last blank line that lies before `before`, else of the last line end; -1 if none."""
    turned = F.reverse(F.substring(text, F.lit(1), before))
    size = F.length(turned)
    blank, single = F.locate("\n\n", turned), F.locate("\n", turned)
    return F.when(blank > 0, size - blank - 1).when(single > 0, size - single).otherwise(-1)


def split_at_newline(text: Column, before: Column) -> Column:
    """struct(head, tail): text cut at the last blank line before a position, else the last line end.

    Without one, or if all of text lies before it, head is the whole text and tail empty. Line
    ends at the start of the tail are dropped.
    """
    cut = F.when(before >= F.length(text), F.lit(-1)).otherwise(_cut(text, before))
    return let(
        cut,
        lambda at: F.when(at < 0, F.struct(text.alias("head"), F.lit("").alias("tail"))).otherwise(
            F.struct(F.substring(text, F.lit(1), at).alias("head"), F.regexp_replace(F.substring(text, at + 1, F.length(text)), r"\A\n+", "").alias("tail"))
        ),
    )


def chunk_number(text: Column, chars: int = CHUNK_CHARS, most: int = MOST_CHUNKS) -> Column:
    """Pieces a text is cut into before blank ones are dropped: 1 up to `chars`, else 2 to `most`."""
    n = F.length(text)
    return F.when(n <= chars, F.lit(1)).otherwise(F.least(F.lit(most), F.greatest(F.lit(2), F.floor(n / (chars + 1)).cast("int") + 1)))


def chunks(text: Column, chars: int = CHUNK_CHARS, most: int = MOST_CHUNKS) -> Column:
    """array<string>: text cut at line ends into the fewest pieces meant to hold `chars` each.

    A fold over the pieces: each step cuts one from what is left. A piece can be longer where
    there is no line end, and so can the last; blank pieces are dropped.
    """
    pieces = chunk_number(text, chars, most)
    size = F.floor(F.length(text) / pieces).cast("int")

    def step(acc, _):
        return F.when(acc["rest"] == "", acc).otherwise(let(split_at_newline(acc["rest"], size), lambda s: F.struct(s["tail"].alias("rest"), F.concat(acc["done"], F.array(s["head"])).alias("done"))))

    cut = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), pieces - 1)),
        F.struct(text.alias("rest"), F.array().cast("array<string>").alias("done")),
        step,
        lambda acc: F.when(acc["rest"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["rest"]))),
    )
    return F.when(F.length(text) <= chars, F.array(text)).otherwise(F.filter(cut, lambda c: ~is_blank(c)))


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".(\.[^.]*)\z", 1))


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))
