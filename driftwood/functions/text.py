"""Text operators on code and docstrings, all as native column expressions.

Lines are split on ``\\n`` only, lengths count code points, and stripping uses the full set of
Unicode white space, because the texts are Python source and must behave as Python strings do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt markers of the fill-in-the-middle format.
PREFIX = "<|fim_prefix|>"
SUFFIX = "<|fim_suffix|>"
MIDDLE = "<|fim_middle|>"
SEPARATOR = "<|file_separator|>"
INDENT = "    "
TRIPLE = '"""'
TRIPLE_SINGLE = "'''"

# The characters Python's str.strip() removes, as a regular-expression class.
PY_SPACE = r"[\t-\r\x1c- \x85\xa0  -     　]"

# Verdict marks in order of precedence.
VERDICT_MARKS = ("docstring-0_better", "docstring-1_better", "docstring-2_better", "none_fit")


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` mentions it.

    Without it a value named inside a lambda would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, PY_SPACE + r"+\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A" + PY_SPACE + "+", "")


def strip(text: Column) -> Column:
    return lstrip(rstrip(text))


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    shorter = F.length(F.replace(text, F.lit(needle), F.lit("")))
    return ((F.length(text) - shorter) / F.lit(len(needle))).cast("int")


def has_min_newlines(text: Column, minimum: int = 3) -> Column:
    return count_of(text, "\n") >= minimum


def normalise_source(text: Column) -> Column:
    """CRLF and CR become LF, then every tab becomes four spaces."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(unix, F.lit("\t"), F.lit(INDENT))


def short_label(text: Column) -> Column:
    """Text before the first space."""
    return F.substring_index(text, " ", 1)


def folder_name(full_name: Column) -> Column:
    return F.replace(full_name, F.lit("/"), F.lit("_"))


def _leading_spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def _cut_left(lines: Column, units: Column) -> Column:
    """The lines, each without that many indent units, as a text."""
    unit = len(INDENT)
    return let(
        F.struct(lines.alias("lines"), (units * unit + 1).cast("int").alias("start")),
        lambda v: F.array_join(F.transform(v["lines"], lambda line: F.substring(line, v["start"], F.length(line))), "\n"),
    )


def clean_code(code: Column) -> Column:
    """Cut comments, strip line ends, dedent by whole units, collapse the first run of line breaks."""
    stripped = F.transform(lines_of(code), lambda line: rstrip(F.substring_index(line, "#", 1)))

    def units(lines: Column) -> Column:
        return F.array_min(F.transform(lines, lambda line: F.floor(_leading_spaces(line) / 4)))

    dedented = let(stripped, lambda lines: _cut_left(lines, units(lines)))
    return F.regexp_replace(dedented, r"(?s)\A(.*?)\n{2,}", "$1\n")


def dedent(code: Column) -> Column:
    """Remove whole indent units while every line has one or is white space only."""
    def depth(line: Column) -> Column:
        blank = line.rlike(r"\A" + PY_SPACE + r"+\z")
        return (
            F.when(line == "", F.lit(0))
            .when(blank, F.ceil(F.length(line) / 4))
            .otherwise(F.floor(_leading_spaces(line) / 4))
        ).cast("int")

    indented = let(lines_of(code), lambda lines: _cut_left(lines, F.array_min(F.transform(lines, depth))))
    # Most functions start in the first column, which settles it without looking at the lines.
    return F.when(code.rlike(r"\A" + PY_SPACE), indented).otherwise(code)


def body_begin(code: Column) -> Column:
    """Offset behind the first colon that ends a line; 1 where there is none."""
    return F.instr(code, ":\n") + 1


def remove_docstring(code: Column) -> Column:
    """The code without its first triple-quoted block; null where the block has no end."""
    def cut(v: Column) -> Column:
        # Positions count from 1; 0 stands for "not found".
        opened = F.struct(v["code"].alias("code"), v["mark"].alias("mark"), F.position(v["mark"], v["code"]).alias("start"))
        return let(opened, closed)

    def closed(v: Column) -> Column:
        end = F.when(v["start"] > 0, F.position(v["mark"], v["code"], v["start"] + 1)).otherwise(F.lit(0))
        return let(F.struct(v["code"].alias("code"), v["start"].alias("start"), end.alias("end")), joined)

    def joined(v: Column) -> Column:
        rest = F.substring(v["code"], v["end"] + 3, F.length(v["code"]))
        return F.when(v["end"] > 0, F.concat(F.substring(v["code"], F.lit(1), v["start"] - 1), rest))

    mark = F.when(code.contains(TRIPLE), F.lit(TRIPLE)).otherwise(F.lit(TRIPLE_SINGLE))
    return let(F.struct(code.alias("code"), mark.alias("mark")), cut)


def docstring_span(code: Column) -> Column:
    """Struct of the 1-based first and last docstring line inside a function text.

    The first line holding a delimiter decides which delimiter counts. Of the lines that hold it once
    or twice only the first two matter: a line with two is a whole docstring, a line with one opens it.
    """
    def with_mark(lines: Column) -> Column:
        holder = F.get(F.filter(lines, lambda line: line.contains(TRIPLE) | line.contains(TRIPLE_SINGLE)), F.lit(0))
        mark = F.when(holder.contains(TRIPLE), F.lit(TRIPLE)).otherwise(F.lit(TRIPLE_SINGLE))
        return let(F.struct(lines.alias("lines"), mark.alias("mark")), lambda v: let(events(v), span))

    def events(v: Column) -> Column:
        def event(line: Column, i: Column) -> Column:
            hits = ((F.length(line) - F.length(F.replace(line, v["mark"], F.lit("")))) / 3).cast("int")
            return F.struct((i + 1).alias("line"), hits.alias("hits"))

        return F.filter(F.transform(v["lines"], event), lambda e: e["hits"].isin(1, 2))

    def span(found: Column) -> Column:
        one, two = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        whole = one["hits"] == 2
        reopened = F.coalesce(two["hits"] == 2, F.lit(False))
        first = F.when(whole, one["line"]).when(reopened, two["line"]).otherwise(one["line"])
        last = F.when(whole, one["line"]).otherwise(two["line"])
        return F.struct(first.alias("first_line"), last.alias("last_line"))

    return let(lines_of(code), with_mark)


def training_prompt(code: Column, begin: Column, docstring: Column) -> Column:
    header = F.substring(code, F.lit(1), begin)
    body = F.substring(code, begin + 1, F.length(code))
    return F.concat(
        F.lit(PREFIX), header, F.lit(f"\n{INDENT}{TRIPLE}{SUFFIX}{TRIPLE}\n{INDENT}"), body,
        F.lit(MIDDLE), docstring, F.lit(SEPARATOR),
    )


def serving_prompt(code: Column) -> Column:
    def prompt(text: Column) -> Column:
        header = F.substring_index(text, ":\n", 1)
        body = lstrip(F.substring(text, F.length(header) + 3, F.length(text)))
        return F.concat(
            F.lit(PREFIX), header, F.lit(f":\n\n{INDENT}{TRIPLE}{SUFFIX}{TRIPLE}\n{INDENT}"), body, F.lit(MIDDLE)
        )

    return let(F.replace(F.regexp_replace(code, r"\r{2,}", "\r"), F.lit("\r\n"), F.lit("\n")), prompt)


def clean_generation(text: Column) -> Column:
    answer = F.substring_index(F.substring_index(text, MIDDLE, -1), TRIPLE, 1)
    return strip(F.replace(answer, F.lit(SEPARATOR), F.lit("")))


def docstring_block(docstring: Column) -> Column:
    """A replacement docstring, indented and quoted, ending in a line break."""
    return F.concat(F.lit(f"{INDENT}{TRIPLE}\n{INDENT}"), docstring, F.lit(f"\n{INDENT}{TRIPLE}\n"))


def verdict(answer: Column) -> Column:
    """First verdict named in a judge's answer, in fixed order; null where there is none."""
    result = F.lit(None).cast("string")
    for name in reversed(VERDICT_MARKS):
        result = F.when(answer.contains(name), F.lit(name)).otherwise(result)
    return result
