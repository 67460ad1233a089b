"""Routing of fetched content by type and size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 25 << 20
#: Media types of pages, and of files that can be read besides all kinds of text.
PAGES = ("text/html", "application/xhtml+xml")
FILES = (
    "application/pdf", "application/json", "application/xml", "application/msword", "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.openxmlformats-officedocument.wordprocessingml.template",
    "application/vnd.oasis.opendocument.text", "application/vnd.jupyter", "application/sql", "application/typescript", "application/ecmascript",
    "application/dart", "application/vnd.dart", "application/x-sh", "application/x-shellscript", "application/x-csh", "application/x-zsh",
    "application/x-powershell", "application/x-php", "application/x-latex", "application/x-tex", "application/x-hwp", "application/x-hwp-v5", "application/zip",
)


def route(mime_type: Column, size: Column) -> Column:
    """HTML, FILE (also any kind of text), UNSUPPORTED, or TOO_LARGE for anything over MAX_BYTES."""
    plain = F.lower(F.trim(F.element_at(F.split(mime_type, ";"), 1)))
    return F.when(size > MAX_BYTES, "TOO_LARGE").when(plain.isin(*PAGES), "HTML").when(plain.isin(*FILES) | plain.startswith("text/"), "FILE").otherwise("UNSUPPORTED")
