"""URL expressions by regular expressions, so that odd URLs give null, not errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only pick a rendition of the same image.
RENDITION = ["w", "h", "fit", "auto", "q", "fm", "dpr", "crop", "s", "t"]
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.when(url.rlike(_PARTS), F.regexp_extract(url, _PARTS, group))


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port, null if there is none."""
    authority = F.regexp_replace(_part(url, 2), r"^[^@]*@", "")
    return F.nullif(F.lower(F.regexp_replace(authority, r":\d*$", "")), F.lit(""))


def normalize_url(url: Column) -> Column:
    """Origin, path and the parameters that don't pick a rendition; other text as it is."""
    keys = "|".join(RENDITION)
    kept = F.filter(F.split(_part(url, 4), "&"), lambda p: (p != "") & ~p.rlike(rf"^({keys})(=|$)"))
    query = F.nullif(F.array_join(kept, "&"), F.lit(""))
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    # the origin has no user, and no port that is the usual one
    scheme = F.lower(_part(url, 1))
    place = F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    usual = F.when(scheme == "https", ":0*443$").when(scheme == "http", ":0*80$").otherwise(":$")
    whole = F.concat(scheme, F.lit("://"), F.regexp_replace(place, usual, F.lit("")), path)
    return F.coalesce(F.concat(whole, F.coalesce(F.concat(F.lit("?"), query), F.lit(""))), url)


def is_public_url(url: Column) -> Column:
    """http or https to a host that is not local, internal or in a private range."""
    host = F.regexp_replace(host_of(url), r"^\[|\]$", "")
    octet = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in (1, 2, 3, 4)]
    numeric = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (octet[0] <= 255) & (octet[1] <= 255) & (octet[2] <= 255) & (octet[3] <= 255)
    a, b = octet[:2]
    private = (
        a.isin(0, 10, 127)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 100) & b.between(64, 127))
        | (a >= 224)
    )
    local = (
        (host == "localhost")
        | host.endswith(".localhost")
        | host.endswith(".internal")
        | host.isin("metadata.google.internal", "::1")
        | host.startswith("fe80:")
        | host.startswith("fc")
        | host.startswith("fd")
    )
    fine = F.lower(_part(url, 1)).isin("http", "https") & host.isNotNull() & ~local & ~F.coalesce(numeric & private, F.lit(False))
    return F.coalesce(fine, F.lit(False))


def host_blocked(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether an address is of one of the hosts or of a host below it."""
    host = host_of(url)
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return F.coalesce(out, F.lit(False))
