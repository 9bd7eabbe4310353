"""Error classification as columns; rows never fail a job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Error categories.
CATEGORIES = ("validation", "timeout", "aborted", "rate_limited", "upstream_http", "network", "binary_content", "internal")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date; 60 by default, never below 0."""
    trimmed = F.btrim(header)
    seconds = F.regexp_extract(trimmed, r"^([0-9]+)", 1).try_cast("long")
    date = F.try_to_timestamp(F.regexp_extract(trimmed, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    left = F.unix_seconds(date) - F.unix_seconds(now)
    return F.coalesce(seconds, F.when(left.isNotNull(), F.greatest(left, F.lit(0))), F.lit(60)).cast("long")


def http_status_category(status: Column) -> Column:
    return F.when(status == 429, "rate_limited").when(status.isin(408, 504), "timeout").when(status == 415, "binary_content").when(status == 499, "aborted").when(status >= 400, "upstream_http")


def category(kind: Column, status: Column) -> Column:
    """One of CATEGORIES from the kind of failure and a status, or null without a failure."""
    return (
        F.when(kind.isin("invalid-url", "blocked-host", "unsupported-protocol"), "validation").when(kind == "timeout", "timeout").when(kind == "abort", "aborted")
        .when(kind.isin("dns", "connect", "reset"), "network").when(http_status_category(status).isNotNull(), http_status_category(status)).when(kind.isNotNull(), "internal")
    )


def code(status: Column) -> Column:
    """The error code of an upstream status."""
    return F.when(status >= 400, F.concat(F.lit("HTTP_"), status.cast("string")))


def issue_text(issues: Column) -> Column:
    """The different messages of a list, in order, as one line."""
    return F.array_join(F.array_distinct(F.filter(issues, lambda x: x.isNotNull())), "; ")


def owner_key(subject: Column, client: Column, token: Column, session: Column) -> Column:
    """Who owns a task: the hashed subject, else client and token, else the session, else ``default``."""
    pair = F.sha2(F.concat(client, F.lit(":"), token), 256)
    return F.coalesce(F.sha2(subject, 256), pair, session, F.lit("default"))


# Public messages by kind; %s stands for the target.
MESSAGES = {
    "cloud-metadata": "Blocked IP range: %s. Cloud metadata endpoints are not allowed",
    "blocked-ip": "Blocked IP range: %s. Private IPs are not allowed",
    "blocked-host": "Blocked host: %s. Internal hosts are not allowed",
    "dns-timeout": "DNS lookup timed out for %s",
    "dns-empty": "No DNS results returned for %s",
    "address-family": "Invalid address family returned for %s",
    "unsupported-protocol": "Unsupported redirect protocol: %s",
    "invalid-host": "Invalid hostname provided",
    "invalid-url": "Invalid URL",
    "invalid-redirect": "Invalid redirect target",
    "redirect-credentials": "Redirect target includes credentials",
}
PUBLIC_REASONS = ("aborted", "queue_full", "timeout")


def message(kind: Column, target: Column) -> Column:
    """The public message of a failure; null for kinds without one."""
    out = None
    for name, text in MESSAGES.items():
        value = F.format_string(text, target) if "%s" in text else F.lit(text)
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def payload(text: Column, url: Column, category_: Column, status: Column, retry: Column, timeout: Column, reason: Column) -> Column:
    """The error as JSON: message and address, category, code and status where known, and of the details only the public ones."""
    details = F.struct(retry.alias("retryAfter"), F.when(timeout >= 0, timeout).alias("timeout"), F.when(reason.isin(*PUBLIC_REASONS), reason).alias("reason"))
    some = retry.isNotNull() | F.coalesce(timeout >= 0, F.lit(False)) | F.coalesce(reason.isin(*PUBLIC_REASONS), F.lit(False))
    return F.to_json(F.struct(text.alias("error"), url.alias("url"), category_.alias("category"), code(status).alias("code"), status.alias("statusCode"), F.when(some, details).alias("details")))
