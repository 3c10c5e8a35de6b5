"""Text, path and FTP functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uri_filename(uri: Column) -> Column:
    """What follows the last slash of a URI, up to the first question mark, space or semicolon."""
    return F.substring_index(F.split(uri, "[? ;]", 2)[0], "/", -1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1)


def url_path(url: Column) -> Column:
    """The path of a URL without its query and fragment; a slash at least."""
    p = F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def port_of_pair(message: Column) -> Column:
    """The data port in a PASV answer or a PORT command: the last two of six numbers, high and low."""
    six = r"(\d+),(\d+),(\d+),(\d+),(\d+),(\d+)"
    return (F.regexp_extract(message, six, 5).try_cast("int") * 256 + F.regexp_extract(message, six, 6).try_cast("int")).cast("int")


def port_of_bars(message: Column) -> Column:
    """The data port in an EPSV answer: between the last two bars."""
    return F.regexp_extract(message, r"\|(\d+)\|[^|]*$", 1).try_cast("int")


def response_code(line: Column) -> Column:
    """The three digits that begin an FTP response; 0 if there are none."""
    return F.coalesce(F.regexp_extract(line, r"^(\d{3})", 1).try_cast("int"), F.lit(0))


def fact(line: Column, name: str) -> Column:
    """A fact of an MLSD line, by its name in any case."""
    return F.regexp_extract(line, rf"(?i)(?:^|;){name}=([^;]*);", 1)


def fact_name(line: Column) -> Column:
    """The file name of an MLSD line: what follows the last '; '."""
    return F.substring_index(line, "; ", -1)


def prefixed(text: Column, mark: str) -> Column:
    """Every line of a text that is not empty, with a mark before it."""
    return F.concat(F.lit(mark), F.regexp_replace(text, "\n(?=.)", "\n" + mark.replace("[", r"\[").replace("]", r"\]").replace("\\", "")))


def display_name(first: Column, second: Column, padded: Column, name: Column, suffix: Column) -> Column:
    """The name a file is listed by: ids, a mark for missing bytes, its own name if under 225 characters, and a suffix."""
    own = F.when((F.length(name) > 0) & (F.length(name) < 225), F.concat(F.lit("_"), name)).otherwise("")
    return F.concat(first.cast("string"), F.lit("-"), second.cast("string"), F.when(padded, "_0PAD").otherwise(""), own, suffix)
