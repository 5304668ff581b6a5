"""Source statuses: classification of failures, roll-up, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity of a status.
SEVERITY = {"success": 0, "skipped": 1, "rate-limited": 2, "unavailable": 3, "failed": 4}
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
DAY_MS = 24 * 60 * 60 * 1000


def severity(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), status), F.lit(4))


def merge_statuses(log: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """One row per group and source: counts and durations add up; any success wins and clears the error; else the worst
    status (the earlier among equals) with the first error. ``ordinal`` is the place of its first entry."""
    worst = F.max_by("status", F.struct(severity(F.col("status")), -F.col(seq)))
    good = F.max((F.col("status") == "success").cast("int")) == 1
    first_error = F.min_by("error", F.when(F.col("error").isNotNull(), F.col(seq)))
    return log.groupBy(*by, "name").agg(
        F.when(good, "success").otherwise(worst).alias("status"),
        F.sum("result_count").alias("result_count"),
        F.sum("duration_ms").alias("duration_ms"),
        F.when(~good, first_error).alias("error"),
        F.min(seq).alias("ordinal"),
    )


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60 + 0.5)
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


def classify(kind: Column, code: Column, retry_after_ms: Column) -> Column:
    """struct(status, error) of a failed request; kind as in http, timeout, aborted, network, parse, blocked, circuit-open, cooldown."""
    secs = F.when(retry_after_ms > 0, F.ceil(retry_after_ms / 1000))
    out = lambda s, e: F.struct(F.lit(s).alias("status"), (e if isinstance(e, Column) else F.lit(e)).alias("error"))
    quota = F.when(secs.isNotNull(), F.concat(F.lit("provider quota exhausted; usable again in ~"), duration_text(secs))).otherwise(F.lit("provider quota exhausted"))
    opened = F.when(secs.isNotNull(), F.concat(F.lit("circuit breaker open after repeated failures; retrying in ~"), secs.cast("string"), F.lit("s"))).otherwise(
        F.lit("circuit breaker open after repeated failures")
    )
    said = F.when(code.isNotNull(), F.concat(F.lit("provider responded "), code.cast("string"))).otherwise(F.lit("request failed"))
    return (
        F.when(code == 429, out("rate-limited", "provider rate limit reached; backed off"))
        .when(code == 401, out("skipped", "source authentication/configuration issue"))
        .when(code == 403, out("unavailable", "access denied by provider"))
        .when(kind == "aborted", out("skipped", "cancelled"))
        .when(kind == "timeout", out("unavailable", "request timed out"))
        .when(kind == "cooldown", out("rate-limited", quota))
        .when(kind == "circuit-open", out("unavailable", opened))
        .when(kind == "blocked", out("failed", "request blocked by URL policy"))
        .when(code.between(500, 599), out("unavailable", said))
        .otherwise(out("failed", said))
    )


def is_unhealthy(kind: Column, code: Column) -> Column:
    """The failure speaks against the source and not against the request."""
    local = kind.isin("aborted", "blocked", "circuit-open", "cooldown")
    client = F.coalesce(code.between(400, 499) & (code != 429), F.lit(False))
    return ~local & ~client


def retry_after_ms(header: Column, now: Column) -> Column:
    """Delay in ms of a Retry-After header: seconds or an HTTP date; 0 .. 24 h; NULL if it is neither."""
    h = F.trim(header)
    secs = F.when(F.regexp_like(h, F.lit(r"^\d+(?:\.\d+)?$")), h.try_cast("double") * 1000.0)
    date = F.try_to_timestamp(F.regexp_replace(h, r"^[A-Za-z]{3}, (.*) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = (F.unix_micros(date) - F.unix_micros(now)).cast("double") / 1000.0
    clamp = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(v, F.lit(float(DAY_MS)))))
    return F.coalesce(clamp(secs), clamp(wait))


def backoff_ms(attempt: Column, base_ms: int, most_ms: int, jitter: Column | None = None) -> Column:
    """base * 2^attempt up to the cap; with jitter (0 .. 1) drawn from the upper half."""
    capped = F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(0)).cast("double")), F.lit(float(most_ms)))
    return F.floor((capped if jitter is None else capped / 2 + jitter * capped / 2) + 0.5).cast("bigint")


def retry_decision(kind: Column, code: Column, attempt: Column, wait_ms: Column, retries: int, base_ms: int, most_ms: int) -> Column:
    """struct(retry, delay_ms, reason, provider_directed)."""
    out = lambda yes, delay, reason, directed: F.struct(F.lit(yes).alias("retry"), delay.cast("bigint").alias("delay_ms"), F.lit(reason).alias("reason"), F.lit(directed).alias("provider_directed"))
    wait, told = backoff_ms(attempt, base_ms, most_ms), F.least(wait_ms, F.lit(float(most_ms)))
    http = ~kind.isin("timeout", "network", "aborted")
    has = F.coalesce(wait_ms > 0, F.lit(False))
    return (
        F.when(attempt >= retries, out(False, F.lit(0), "none", False))
        .when(kind == "timeout", out(True, wait, "timeout", False))
        .when(kind == "network", out(True, wait, "network", False))
        .when(http & (code == 429) & has, out(True, told, "rate-limited", True))
        .when(http & (code == 429), out(True, wait, "rate-limited", False))
        .when(http & code.isin(408, 425), out(True, wait, "timeout", False))
        .when(http & code.isin(500, 502, 503, 504) & has, out(True, told, "server-error", True))
        .when(http & code.isin(500, 502, 503, 504), out(True, wait, "server-error", False))
        .otherwise(out(False, F.lit(0), "none", False))
    )


def source_report(sources: DataFrame, log: DataFrame) -> DataFrame:
    """Sources with their roles, availability and what the request log says of them."""
    stats = log.groupBy("name").agg(
        F.count("*").alias("requests"), F.sum((F.col("status") == "success").cast("bigint")).alias("successes"), F.sum("result_count").alias("results"),
        F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.max_by("status", "seq").alias("last_status"),
    )
    roles = sources.groupBy("source_key", "source_name").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.max("available").alias("available"))
    return roles.join(stats, roles["source_name"] == stats["name"], "left").drop("name")


def mask_secrets(c: Column) -> Column:
    """Blanks keys, tokens and e-mail addresses in log text."""
    v = F.regexp_replace(c, r"(?i)((?:api[_-]?key|token|authorization|password|secret)\"?\s*[=:]\s*\"?(?:bearer\s+)?)[^\s\"&,;]+", "$1[redacted]")
    return F.regexp_replace(v, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")


