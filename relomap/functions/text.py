"""String functions as columns. White space is the six ASCII characters of C's ``isspace``, byte lengths are of UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class, for Java's and RE2's regular expressions alike.
SPACE = r" \t\n\r\f\x0B"


def has_content(text: Column) -> Column:
    """Whether any character is not white space."""
    return text.rlike(f"[^{SPACE}]")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_space(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. A single space is not replaced by itself."""
    return F.trim(F.regexp_replace(text, f" [{SPACE}]++|[\\t\\n\\r\\f\\x0B][{SPACE}]*+", " "))


def escape_canonical(text: Column) -> Column:
    """Backslash, line feed and tab as two characters each; parentheses stay, so the encoding is not injective."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def preview(text: Column, most: int = 60) -> Column:
    """Collapsed text, cut after ``most`` bytes, at the last whole character within them, and marked with dots if it is cut.

    Only the beginning is collapsed, up to one more character than can be shown; white space around it does not count.
    """
    begin = F.regexp_extract(text, f"^[{SPACE}]*+((?:[{SPACE}]*+[^{SPACE}]){{0,{most + 1}}})", 1)
    flat = F.regexp_replace(begin, f"[{SPACE}]+", " ")

    def cut(flat: Column) -> Column:
        head = F.left(flat, F.lit(most))
        fits = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: F.octet_length(F.left(flat, k)) <= most))
        whole = F.when(F.octet_length(head) <= most, head).otherwise(F.left(flat, fits))
        return F.when(F.octet_length(flat) > most, F.concat(whole, F.lit("..."))).otherwise(flat)

    # An array of one, so that the collapsed beginning has a name: what a lambda mentions is made again at every call.
    return F.get(F.transform(F.array(flat), cut), F.lit(0))


def pad_right(text: Column, width: int) -> Column:
    """Pad with spaces; longer texts are not cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def pad_left(text: Column, width: Column) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0)).cast("int")), text)


def path_union(paths: Column) -> Column:
    return F.array_join(paths, " | ")


def split_filename(name: Column) -> Column:
    """``original|modified`` at the first bar as a struct; null where there is none."""
    at = F.instr(name, "|")
    both = F.struct(F.substring(name, F.lit(1), at - 1).alias("original"), F.substring(name, at + 1, F.length(name)).alias("modified"))
    return F.when(at > 0, both)


def parse_position(text: Column) -> Column:
    """``L:C`` as a struct of line and column, both from 1; null where it is not that."""
    pattern = r"^[ \t]*\+?(\d+)[^:]*:[ \t]*\+?(\d+)"
    line, col = (F.nullif(F.regexp_extract(text, pattern, i).try_cast("bigint"), F.lit(0)) for i in (1, 2))
    return F.when(line.isNotNull() & col.isNotNull(), F.struct(line.alias("line"), col.alias("col")))


def clamp(a: Column, b: Column, low: Column, high: Column) -> Column:
    """The part of the interval between ``a`` and ``b``, whichever is less, that lies in [low, high]; null if none."""
    x, y = F.greatest(F.least(a, b), low), F.least(F.greatest(a, b), high)
    return F.when(x <= y, F.struct(x.alias("begin"), y.alias("end")))


def move_ids_label(ids: Column) -> Column:
    return F.concat(F.lit("m="), F.array_join(ids.cast("array<string>"), ","))


def files_of_paths(paths: Column) -> Column:
    """Sorted distinct file names of paths that have a ``[@filename=...]`` step, in either kind of quotes."""
    found = F.transform(paths, lambda p: F.regexp_extract(p, r"\[@filename=(?:\"([^\"]*)\"|'([^']*)')\]", 0))
    names = F.transform(F.filter(found, lambda p: p != ""), lambda p: F.regexp_replace(p, r"^\[@filename=.|.\]$", ""))
    return F.array_sort(F.array_distinct(names))


def diff_kind(full_name: Column) -> Column:
    """``insert`` or ``delete`` for the two diff tags, else null."""
    return F.when(full_name == "diff:insert", "insert").when(full_name == "diff:delete", "delete")


def kind_label(kind: Column) -> Column:
    return F.when(kind == "insert", "INS").otherwise("DEL")


def existing_move_id(attribute: Column) -> Column:
    """The number that a ``move`` attribute starts with, modulo 2**32; 0 if it does not start with one; null if absent."""
    digits = F.regexp_extract(attribute, f"^[{SPACE}]*\\+?(\\d+)", 1)
    return F.when(attribute.isNotNull(), F.coalesce(digits.try_cast("decimal(38,0)") % F.lit(4294967296).cast("decimal(38,0)"), F.lit(0)).cast("long"))


def numeric_move(attribute: Column) -> Column:
    """The number that a ``move`` attribute starts with, modulo 2**32; null if it does not start with one."""
    digits = F.regexp_extract(attribute, f"^[{SPACE}]*\\+?(\\d+)", 1)
    return (digits.try_cast("decimal(38,0)") % F.lit(4294967296).cast("decimal(38,0)")).cast("long")
