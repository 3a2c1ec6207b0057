"""Tags of a page with their attributes, read once for all extractors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = r"(?i)<(?:meta|link|img|a)\b[^>]*>"
_ATTRIBUTE = r"""([A-Za-z][-A-Za-z0-9_:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_URL = r"""(?i)https?://[^\s"'<>()\[\]]+"""


def tags(html: Column) -> Column:
    """``array<struct<kind, names, values>>`` of the meta, link, img and a tags, in order."""

    def parsed(tag):
        quoted = F.zip_with(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 2), F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 3), lambda a, b: F.concat(a, b))
        return F.struct(
            F.lower(F.regexp_extract(tag, r"^<([A-Za-z]+)", 1)).alias("kind"),
            F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 1), lambda n: F.lower(n)).alias("names"),
            quoted.alias("values"),
        )

    return F.transform(F.regexp_extract_all(html, F.lit(_TAG), 0), parsed)


def attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute, null if it is absent or empty."""
    return F.nullif(F.get(tag["values"], (F.array_position(tag["names"], name) - 1).cast("int")), F.lit(""))


def picture(tag: Column) -> Column:
    """The first attribute of a tag that is src or ends with -src, as lazily loaded images have."""
    is_source = F.transform(tag["names"], lambda n: (n == "src") | n.endswith("-src"))
    return F.nullif(F.get(tag["values"], (F.array_position(is_source, True) - 1).cast("int")), F.lit(""))


def pictures(found: Column) -> Column:
    return F.filter(F.transform(F.filter(found, lambda t: t["kind"] == "img"), picture), lambda v: v.isNotNull())


def values_of(found: Column, kind: str, value: str, where: str | None = None, one_of: tuple[str, ...] = ()) -> Column:
    """An attribute of all tags of a kind, of those only whose attribute ``where`` is one of the given."""

    def fits(tag):
        test = tag["kind"] == kind
        return test & F.coalesce(F.lower(attribute(tag, where)).isin(*one_of), F.lit(False)) if where else test

    return F.filter(F.transform(F.filter(found, fits), lambda t: attribute(t, value)), lambda v: v.isNotNull())


def urls_in(html: Column) -> Column:
    """All absolute addresses in a text, wherever they are."""
    return F.regexp_extract_all(html, F.lit(_URL), 0)
