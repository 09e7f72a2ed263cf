"""Error and status text columns (H4-H6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Worker exception type -> user-facing text.
WORKER_ERRORS = {
    "ConnectionError": "Could not connect to a required service. Please try again.",
    "ConnectionRefusedError": "Could not connect to a required service. Please try again.",
    "TimeoutError": "The operation took too long and was stopped. Please try again.",
    "AuthenticationError": "API authentication failed. Please check your API keys.",
    "RateLimitError": "An external API rate limit was hit. Please try again in a moment.",
    "OperationalError": "A database error occurred. Please try again.",
    "SSRFError": "The URL could not be accessed for security reasons.",
}
# Substrings (case-insensitive) that make a worker message safe to keep.
WORKER_SAFE_SUBSTRINGS = ["SSRF", "OPENAI_API_KEY", "rate limit", "timed out", "timeout", "DNS",
                          "Name or service not known"]
GENERIC_ERROR = "Something went wrong during generation. Please try again."
SOFT_TIME_LIMIT_ERROR = "Job exceeded the maximum allowed duration and was terminated."
# Substrings (lower-case) that make a stored message safe to show.
SHOWN_SAFE_SUBSTRINGS = ["rate limit", "timed out", "timeout", "not found", "not set", "api key",
                         "ssrf", "security", "exceeded", "please try", "too many", "unavailable"]
# Server status -> message.
SERVER_MESSAGES = {
    400: "The request was invalid. Please check your input and try again.",
    401: "Authentication required. Please sign in and try again.",
    403: "You do not have permission to perform this action.",
    404: "The requested resource was not found.",
    405: "This action is not supported.",
    429: "Too many requests. Please wait a moment and try again.",
    500: "Something went wrong on our end. Please try again later.",
    502: "The server is temporarily unavailable. Please try again later.",
    503: "The service is temporarily unavailable. Please try again later.",
}
# Client-side classes (status -> message, code).
CLIENT_RATE_LIMITED = ("Rate limit exceeded. Please try again later.", "RATE_LIMITED")
CLIENT_UNAUTHORIZED = ("Authentication required.", "UNAUTHORIZED")
CLIENT_FORBIDDEN = ("You do not have permission to perform this action.", "FORBIDDEN")
CLIENT_NOT_FOUND = ("Resource not found.", "NOT_FOUND")
CLIENT_VALIDATION = ("The request was invalid. Please check your input.", "VALIDATION_ERROR")
CLIENT_SERVER = ("Something went wrong on our end. Please try again later.", "SERVER_ERROR")
CLIENT_NETWORK = ("Could not connect to the server. Please check your connection and try again.",
                  "NETWORK_ERROR")
CLIENT_FALLBACK = ("An unexpected error occurred. Please try again.", "UNKNOWN")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map_expr(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def worker_error(exc_type, message, soft_time_limit=None) -> Column:
    """H4: user-safe text for a worker failure.

    Soft time limit -> its own text; a known exception type -> fixed text; a
    message containing a safe substring (any case) -> its first 200 chars;
    else the generic text.
    """
    t, m = _c(exc_type), F.coalesce(_c(message), F.lit(""))
    lower = F.lower(m)
    safe = None
    for s in WORKER_SAFE_SUBSTRINGS:
        hit = lower.contains(s.lower())
        safe = hit if safe is None else (safe | hit)
    out = (F.when(t.isin(*WORKER_ERRORS.keys()), F.element_at(_map_expr(WORKER_ERRORS), t))
           .when(safe, F.substring(m, 1, 200))
           .otherwise(F.lit(GENERIC_ERROR)))
    if soft_time_limit is not None:
        out = F.when(_c(soft_time_limit), F.lit(SOFT_TIME_LIMIT_ERROR)).otherwise(out)
    return out


def shown_error(raw) -> Column:
    """H5: stored error -> text shown to the user (NULL/empty -> NULL)."""
    r = _c(raw)
    lower = F.lower(r)
    safe = None
    for s in SHOWN_SAFE_SUBSTRINGS:
        hit = lower.contains(s)
        safe = hit if safe is None else (safe | hit)
    return (F.when(r.isNull() | (r == ""), F.lit(None).cast("string"))
            .when(safe, F.substring(r, 1, 300))
            .otherwise(F.lit(GENERIC_ERROR)))


def server_message(status) -> Column:
    """H6 (server): status -> message; unknown -> the 500 message."""
    s = _c(status)
    return F.coalesce(F.element_at(_map_expr(SERVER_MESSAGES), s.cast("int")), F.lit(SERVER_MESSAGES[500]))


def client_error(status, server_msg=None) -> Column:
    """H6 (client): status -> struct(message, code) in the client's order."""
    s = _c(status).cast("int")
    sm = _c(server_msg) if server_msg is not None else F.lit(None).cast("string")

    def pair(msg, code):
        return F.struct(F.lit(msg).alias("message"), F.lit(code).alias("code"))

    return (F.when(s == 429, pair(*CLIENT_RATE_LIMITED))
            .when(s == 401, pair(*CLIENT_UNAUTHORIZED))
            .when(s == 403, pair(*CLIENT_FORBIDDEN))
            .when(s == 404, pair(*CLIENT_NOT_FOUND))
            .when(s == 422, F.struct(F.coalesce(sm, F.lit(CLIENT_VALIDATION[0])).alias("message"),
                                     F.lit(CLIENT_VALIDATION[1]).alias("code")))
            .when(s >= 500, pair(*CLIENT_SERVER))
            .when(s == 0, pair(*CLIENT_NETWORK))
            .otherwise(F.struct(F.coalesce(sm, F.lit(CLIENT_FALLBACK[0])).alias("message"),
                                F.lit(CLIENT_FALLBACK[1]).alias("code"))))
