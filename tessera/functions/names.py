"""Names and addresses: safe file names, kinds of documents, object keys, settings and fonts, as expressions."""

from __future__ import annotations

import mimetypes
import os
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.cleaning import stripped

# Exported kind of a cloud document, words of document addresses, prefixes of the object store, font names, and settings that mean yes.
EXPORTS = {"doc": "docx", "docx": "docx", "sheet": "xlsx", "bitable": "xlsx", "slides": "pptx"}
DOCUMENT_WORDS = ("wiki", "docx", "docs", "doc", "sheets", "base", "bitable", "slides", "file")
CATEGORIES = {
    "一般类、文本居多的word文档": "common_structure_docx",
    "流程类数据WORD": "process_description_docx",
    "结构化word文档": "structured_docx",
    "主题明确的PPT": "clear_theme_pptx",
    "普通表格": "common_structure_xlsx",
}
PREFIX_OF = {"pptx": "clear_theme_pptx", "xlsx": "common_structure_xlsx"}
DEFAULT_PREFIX = "common_structure_docx"
BOLD = ("bold", "black", "heavy", "semibold", "demibold", "extrabold", "ultrabold")
NOT_BOLD = ("regular", "normal", "book", "light", "thin", "medium", "roman")
YES = ("1", "true", "yes", "y", "on")
URL_TAIL = "[.,;:!?，。；：！？、）)\\]}\"']+$"
VIDEO_LIKE = ("gif", "git")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./\\]\.([^./\\]+)$", 1))


def safe_name(name: Column) -> Column:
    """A file name without separators, reserved marks and white space; untitled if nothing is left."""
    out = F.regexp_replace(stripped(F.coalesce(name, F.lit(""))), r'[\\/:*?"<>|]+', "_")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", ""), r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("untitled"))


def with_extension(title: Column, extension: Column) -> Column:
    """A safe name that ends in the extension, once."""
    name = safe_name(title)
    return F.when(suffix(name) == F.lower(extension), name).otherwise(F.concat(name, F.lit("."), extension))


def export_extension(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in EXPORTS.items() for x in pair]), F.lower(F.coalesce(kind, F.lit(""))))


def node_file_name(title: Column, kind: Column) -> Column:
    """The file name of a tree's node: files keep their names, documents get their export's extension."""
    extension = export_extension(kind)
    return F.when((kind == "file") | extension.isNull(), safe_name(title)).otherwise(with_extension(title, extension))


def is_document_node(kind: Column) -> Column:
    return F.coalesce(kind == "file", F.lit(False)) | export_extension(kind).isNotNull()


def document_link(url: Column) -> Column:
    """Struct (kind, token) of a cloud document's address: the first path word that names a kind, and what follows it."""
    found = rf"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*?)??/({'|'.join(DOCUMENT_WORDS)})/+([^/?#]+)"
    return F.struct(F.regexp_extract(url, found, 1).alias("kind"), F.regexp_extract(url, found, 2).alias("token"))


def clean_url(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), URL_TAIL, "")


def view_url(url: Column, base: Column, token: Column) -> Column:
    """A node's address as given, else built from the address of the tree it was found in."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    built = F.when((root != "") & (F.coalesce(F.trim(token), F.lit("")) != ""), F.concat(root, F.lit("/wiki/"), F.trim(token))).otherwise("")
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), built)


def object_prefix(name: Column, category: Column | None = None) -> Column:
    """Folder of the object store: of the category (by either of its names; an unknown one is an error), else by suffix."""
    by_suffix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PREFIX_OF.items() for x in pair]), suffix(name)), F.lit(DEFAULT_PREFIX))
    if category is None:
        return by_suffix
    given = stripped(category)
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair]), given), F.when(given.isin(*CATEGORIES.values()), given))
    return F.when(F.coalesce(category, F.lit("")) == "", by_suffix).otherwise(F.coalesce(named, F.raise_error(F.concat(F.lit("unsupported category: "), given)).cast("string")))


def content_type(name: Column) -> Column:
    """By suffix, from the interpreter's table of kinds."""
    known = {k.lstrip("."): v for k, v in sorted({**mimetypes.types_map, ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}.items())}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), suffix(name)), F.lit("application/octet-stream"))


def quoted(path: Column) -> Column:
    """An address' path with its separators as they are."""
    parts = F.transform(F.split(path, "/"), lambda p: F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")))
    return F.array_join(parts, "/")


def object_url(endpoint: str, bucket: Column, key: Column) -> Column:
    return F.concat(F.lit(endpoint.rstrip("/") + "/"), quoted(bucket), F.lit("/"), quoted(key))


def endpoint(value: str) -> tuple[str, bool]:
    """Host of an endpoint, and whether it is reached by TLS."""
    return value.split("://", 1)[-1].rstrip("/"), value.startswith("https://")


def retrieval_url(query_url: Column, path: str = "/retrieval/flow") -> Column:
    """The address of the retrieval beside that of the query."""
    return F.concat(F.regexp_replace(F.regexp_replace(query_url, "/+$", ""), "/query$", ""), F.lit(path))


def is_bold(font: Column, flags: Column) -> Column:
    """By the font's name, else by its flag."""
    name = F.regexp_replace(F.lower(F.coalesce(font, F.lit(""))), "[-_ ]", "")
    names = lambda words: reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words])
    return F.when(names(BOLD), True).when(names(NOT_BOLD), False).otherwise(F.coalesce(flags.bitwiseAND(16) != 0, F.lit(False)))


def is_video_like(path: Column) -> Column:
    return suffix(path).isin(*VIDEO_LIKE)


def setting(name: str, default=None, *others: str):
    """The first of the named environment variables that has a value."""
    return next((v for n in (name, *others) if (v := os.environ.get(n))), default)


def as_bool(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() in YES


def as_float(value: str | None, default: float | None) -> float | None:
    return default if value is None else float(value) if value.strip() else None
