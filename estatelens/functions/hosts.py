"""Host and scheme classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens import rules


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def bare_host(host: Column) -> Column:
    return F.btrim(F.lower(host), F.lit("[]"))


def is_local_host(host: Column) -> Column:
    """X11: loopback and link-local names."""
    h = bare_host(host)
    return _any(h.isin(rules.LOCAL_HOSTS), h.endswith(".localhost"), h.endswith(".local"))


def host_kind(host: Column) -> Column:
    """Ordered rules from the most telling host to the plain API."""
    h = F.lower(host)
    auth = _any(
        h.isin("accounts.google.com", "login.microsoftonline.com"),
        *[h.endswith(s) for s in (".auth0.com", ".okta.com", ".oktapreview.com")],
        h.contains("cognito-idp"),
        h.contains("keycloak"),
        *[h.startswith(s) for s in ("oauth.", "auth.", "login.")],
    )
    store = _any(
        h.isin("s3.amazonaws.com", "storage.googleapis.com"),
        *[h.endswith(s) for s in (".s3.amazonaws.com", ".storage.googleapis.com", ".blob.core.windows.net")],
        h.rlike(r"^s3[.\-][a-z0-9\-]+\.amazonaws\.com$"),
        h.contains("minio"),
    )
    broker = _any(
        h.contains("kafka"),
        h.contains("rabbitmq"),
        *[h.endswith(s) for s in (".servicebus.windows.net", ".sqs.amazonaws.com", ".sns.amazonaws.com")],
        h.startswith("sqs."),
        h.startswith("sns."),
    )
    cache = _any(h.contains("redis"), h.contains("memcached"))
    return (
        F.when(auth, "auth_provider")
        .when(store, "object_store")
        .when(broker, "message_broker")
        .when(cache, "cache")
        .otherwise("http_api")
    )


def scheme_kind(scheme: Column, host: Column) -> Column:
    """Kind by scheme, by host for the web schemes; null when denied."""
    s = F.lower(scheme)
    out = F.when(s.isin(rules.DENIED_SCHEMES), F.lit(None).cast("string"))
    for kind in ("message_broker", "cache", "object_store"):
        out = out.when(s.isin([k for k, v in rules.SCHEME_KINDS.items() if v == kind]), F.lit(kind))
    return out.when(s.isin("http", "https"), host_kind(host)).otherwise(F.lit("other"))
