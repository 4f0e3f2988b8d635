"""Request outcomes and endpoint notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.text import strip


def classify_status(status: Column) -> Column:
    """HTTP status to outcome class; no status at all is ``error``."""
    return (
        F.when(status.isNull(), "error")
        .when(status == 200, "ok")
        .when(status.isin(403, 429), "blocked")
        .when(status.between(500, 599), "server_err")
        .otherwise("fail")
    )


def is_throttled(status: Column) -> Column:
    """403 or 429; false, not null, when there is no status."""
    return F.coalesce(status.isin(403, 429), F.lit(False))


def is_final(status: Column) -> Column:
    """Outcomes a download is not tried again for: saved, or known to be absent."""
    return F.coalesce(status.isin(200, 404), F.lit(False))


def normalise_endpoint(line: Column) -> Column:
    """One endpoint notation to URL form; null where the notation is not known."""
    text = strip(line)
    parts = F.split(text, ":")
    return (
        F.when(F.contains(text, F.lit("://")), text)
        .when(F.contains(text, F.lit("@")), F.concat(F.lit("http://"), text))
        .when(
            F.size(parts) == 4,
            F.concat(F.lit("http://"), parts[2], F.lit(":"), parts[3], F.lit("@"), parts[0], F.lit(":"), parts[1]),
        )
        .when(F.size(parts) == 2, F.concat(F.lit("http://"), text))
    )


def mask_credentials(url: Column) -> Column:
    """Hide the password of ``scheme://user:password@host``, with or without scheme and user.

    The password ends at the last ``@`` before the first slash of the address, for it may hold ``@`` and ``:`` itself.
    """
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)?([^:/]*):([^/]+)@", "$1$2:****@")
