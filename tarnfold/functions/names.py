"""Small adapters of names, codes, cursors and keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of stored sources by MIME type, how types are read, and the version of cache keys.
EXTENSIONS = {
    "application/pdf": ".pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx", "application/msword": ".doc", "application/vnd.ms-powerpoint": ".ppt", "application/vnd.ms-excel": ".xls",
}
TEXTS, CONVERTED = ["text/plain", "text/markdown"], list(EXTENSIONS)
CACHE_VERSION = 1


def _by(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.coalesce(key, F.lit("")))


def artifact_extension(filename: Column, mime: Column) -> Column:
    """The file name's own extension, lower-cased, if it has at most 10 characters, else the type's, else .bin."""
    own = F.concat(F.lit("."), F.lower(F.substring_index(filename, ".", -1)))
    return F.coalesce(F.when(F.contains(filename, F.lit(".")) & (F.length(own) <= 10), own), _by(EXTENSIONS, mime), F.lit(".bin"))


def projected(content: Column, mime: Column, converted: Column | None = None) -> Column:
    """struct(markdown, profile, error_code) of a source: texts as they are, HTML without its tags, documents as a converter gave them; other types are errors."""
    from tarnfold.sources.files import html_without_tags

    text = F.decode(content, "UTF-8")
    given = F.lit(None).cast("string") if converted is None else converted
    row = lambda md, profile, code: F.struct(md.alias("markdown"), F.lit(profile).alias("profile"), code.alias("error_code"))
    none = F.lit(None).cast("string")
    return (
        F.when(mime.isin(TEXTS), row(text, "text", none)).when(mime == "text/html", row(html_without_tags(text), "html", none))
        .when(mime.isin(CONVERTED), row(given, "converted", F.when(given.isNull(), "CONVERTER_MISSING")))
        .otherwise(row(none, "unknown", F.lit("INVALID_MIME_TYPE")))
    )


def error_code(code: Column) -> Column:
    """The code alone, also of one written with its class; empty is null."""
    return F.when(F.coalesce(code, F.lit("")) != "", F.substring_index(code, ".", -1))


def scope_id(value: Column) -> Column:
    """Trimmed; an empty one is an error."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(F.coalesce(v, F.lit("")) == "", F.raise_error(F.lit("a scope id must not be empty")).cast("string")).otherwise(v)


def cursor(value: Column) -> Column:
    """struct(number, name): a cursor of digits is a number, another a name, an empty one neither."""
    digits = value.rlike(r"^\d+$")
    return F.struct(F.when(digits, value.cast("bigint")).alias("number"), F.when(~digits & (value != ""), value).alias("name"))


def retry_delay(attempt: Column, base: float, most: float) -> Column:
    """Seconds before the next attempt, without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def page_key(source: Column, page: Column, dpi: Column, crop: list[Column], masks: Column, prompt: Column, model: Column) -> Column:
    """The content address of one page's extraction: all that can change it, in one canonical form. masks is an array of (x, y, w, h) structs of doubles."""
    six = lambda c: F.round(c.cast("double"), 6)
    areas = F.array_sort(F.transform(F.coalesce(masks, F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")), lambda m: F.array(six(m["x"]), six(m["y"]), six(m["w"]), six(m["h"]))))
    whole = F.struct(F.array(*map(six, crop)).alias("crop"), dpi.alias("dpi"), areas.alias("masks"), model.alias("model"), page.alias("page"), F.coalesce(prompt, F.lit("")).alias("prompt"), source.alias("src"), F.lit(CACHE_VERSION).alias("v"))
    return F.sha2(F.to_json(whole), 256)
