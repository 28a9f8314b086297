"""Advisory findings may never widen authority: the first rule that a policy change breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMITS = ("velocity_limit_units", "slew_limit_units", "command_ttl_ms", "lease_expiry_ms")
FIELDS = ("authorization", *LIMITS, "watchdog_epoch", "capability_digest")


def violation(policy: Column, before: str = "before", after: str = "after") -> Column:
    """Null if allowed. record_only allows no change; restrict_only allows to deny and to lower limits."""
    b, a = (lambda f: F.col(f"{before}.{f}")), (lambda f: F.col(f"{after}.{f}"))
    changed = F.lit(False)
    for f in FIELDS:
        changed = changed | ~b(f).eqNullSafe(a(f))
    out = F.when((policy == "record_only") & changed, "record_only_changed").when(policy == "record_only", F.lit(None))
    out = out.when(b("capability_digest") != a("capability_digest"), "capability_changed").when(b("watchdog_epoch") != a("watchdog_epoch"), "watchdog_changed")
    out = out.when((b("authorization") == "deny") & (a("authorization") == "allow"), "deny_became_allow")
    for f in LIMITS:
        out = out.when(a(f) > b(f), f"{f}_increased")
    return out
