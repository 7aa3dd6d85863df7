"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Browser-internal pages that are refused.
INTERNAL = r"^(?:chrome|edge|about|chrome-extension|devtools):"

# Query parameters whose value is a secret.
SECRET_PARAM = (r"(?i)([?&;](?:access_token|api_?key|auth|key|passwd|password|pwd|secret|session"
                r"|sig|signature|token)=)([^&#\s\"'<>\[\]]+)")

USERINFO = r"(?i)([a-z][a-z0-9+.-]*://[^\s/:@\[\]]+:)([^\s/@\[\]]+)@"


def page_url(c: Column) -> Column:
    """Scheme, host, port and path: no user, query or fragment."""
    host = F.regexp_replace(F.try_parse_url(c, F.lit("AUTHORITY")), "^[^@]*@", "")
    return F.concat(F.try_parse_url(c, F.lit("PROTOCOL")), F.lit("://"), host,
                    F.try_parse_url(c, F.lit("PATH")))


def is_internal(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(INTERNAL)


def userinfo(c: Column) -> Column:
    """`user:pass` of a URL, null when there is none."""
    return F.try_parse_url(c, F.lit("USERINFO"))


def query_param(c: Column, name: str) -> Column:
    return F.try_parse_url(c, F.lit("QUERY"), F.lit(name))
