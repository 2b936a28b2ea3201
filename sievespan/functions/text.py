"""Column functions on text."""

from pyspark.sql import Column, functions as F


def fixed_decimals(value: str | Column, places: int) -> Column:
    """Text with ``places`` decimals, ties to even on the exact binary value."""
    pattern = "0." + "0" * places if places else "0"
    column = F.col(value) if isinstance(value, str) else value
    return F.call_function("format_number", column, F.lit(pattern))


BLANKS = " \t\n\r\x0b\x0c"


def stripped(text: str | Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(BLANKS))


def listed_ids(text: str | Column) -> Column:
    """Ids of a comma-separated list: trimmed, empty ones dropped."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(column, ","), stripped), lambda x: x != "")


def tokens(line: str | Column) -> Column:
    """Words of a line, split on any white space; one empty word for a blank line."""
    return F.split(stripped(line), r"\s+")


def token_pairs(line: str | Column) -> Column:
    """``name value name value ...`` as a map of doubles.

    A last name without a value is left out. A value that is no number makes
    the whole map empty; of a repeated name the last value counts.
    """
    words = tokens(line)
    names = F.filter(F.slice(words, 1, F.size(words) - F.size(words) % 2), lambda w, i: i % 2 == 0)
    values = F.filter(words, lambda w, i: i % 2 == 1)
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.try_cast("double").alias("value")))
    empty = F.create_map().cast("map<string,double>")
    mapped = F.reduce(pairs, empty, lambda found, p: F.map_concat(
        F.map_filter(found, lambda k, v: k != p["name"]), F.create_map(p["name"], p["value"])))
    return F.when(F.exists(pairs, lambda p: p["value"].isNull()), empty).otherwise(mapped)


def job_name(id_col: str, key_col: str) -> Column:
    return F.concat_ws("_", F.col(id_col), F.col(key_col))


def job_id(name: str) -> Column:
    """Id part of a job name: all before the last underscore."""
    return F.regexp_extract(name, r"(?s)^(.*)_([^_]*)$", 1)


def job_key(name: str) -> Column:
    """Key part of a job name: all after the last underscore."""
    return F.regexp_extract(name, r"(?s)^(.*)_([^_]*)$", 2)
