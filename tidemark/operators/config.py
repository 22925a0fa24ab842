"""Configuration findings: one row of settings against a table of rules, severities by environment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVIRONMENTS = ("development", "staging", "production")


@dataclass(frozen=True)
class Check:
    id: str
    category: str
    broken: Column
    severity: tuple[str, str, str]  # in the order of ENVIRONMENTS


def placeholder(value: Column) -> Column:
    """A secret that is empty or still an example."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return (v == "") | v.rlike("^(change[-_ ]?me|example|placeholder|your[-_ ].*|secret|password|xxx+)")


def unroutable(host: Column) -> Column:
    """Dotted quads that lead nowhere outside: loopback, private, link-local, unspecified, broadcast, multicast."""
    p = F.split(host, r"\.")
    part = lambda k: p[k].try_cast("int")
    valid = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*(part(k) for k in range(4))) <= 255)
    a, b = part(0), part(1)
    inside = a.isin(0, 10, 127) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168) | (a == 169) & (b == 254) | (a == 100) & b.between(64, 127) | (a >= 224)
    return F.when(valid, inside).otherwise(False)


def checks() -> list[Check]:
    """The settings' rules; a rule whose severity is ok in an environment finds nothing there."""
    c = F.col
    secrets = [Check(f"{n.replace('_', '-')}-placeholder", "secrets", placeholder(c(n)), ("warning", "critical", "critical")) for n in ("admin_api_key", "admin_session_secret", "db_password", "test_audio_service_key")]
    return [
        Check("deployment-env-invalid", "environment", ~c("declared_env").isin(*ENVIRONMENTS) & c("declared_env").isNotNull(), ("warning", "warning", "warning")),
        Check("dev-flag-in-deployed-env", "access", c("is_development"), ("ok", "critical", "critical")),
        *secrets,
        Check("secret-too-short", "secrets", F.length("admin_session_secret") < 32, ("ok", "warning", "critical")),
        Check("unroutable-host", "network", unroutable(c("public_host")), ("ok", "warning", "critical")),
        Check("plain-http", "network", c("public_url").startswith("http://"), ("ok", "warning", "critical")),
    ]


def findings(settings: DataFrame, chosen: Sequence[Check] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, env, id, category, severity) of every broken rule, in one pass over the settings."""
    env = F.when(F.col("declared_env").isin(*ENVIRONMENTS), F.col("declared_env")).otherwise("production")
    at = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array_position(F.array(*map(F.lit, ENVIRONMENTS)), F.col("env")).cast("int"))
    cells = [
        F.when(F.coalesce(c.broken, F.lit(False)), F.struct(F.lit(c.id).alias("id"), F.lit(c.category).alias("category"), F.element_at(F.array(*map(F.lit, c.severity)), at).alias("severity")))
        for c in (checks() if chosen is None else chosen)
    ]
    rows = settings.withColumn("env", env).select(*keys, "env", F.explode(F.array_compact(F.array(*cells))).alias("f"))
    return rows.select(*keys, "env", "f.*").where("severity <> 'ok'")


#: What marks an example secret, and shortest secrets of sessions and of local accounts.
MARKER, SESSION_SECRET, LOCAL_PASSWORD = "CHANGEME", 32, 8
SSO = ("azure_tenant_id", "azure_client_id", "azure_client_secret", "azure_redirect_uri", "allowed_group")


def console_checks() -> list[Check]:
    """The rules of an admin console's settings: text columns, empty where unset, and ``is_development``.

    Columns: declared_env, is_development, admin_api_key, admin_session_secret, db_password, test_audio_service_key,
    local_credentials (user, blank, password), those of SSO, redis_url.
    """
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    unset = lambda c: t(c) == ""
    example = lambda v: F.upper(v).contains(MARKER)
    local = F.trim(t("local_credentials")) != ""
    raw = t("local_credentials")
    blank = F.instr(raw, " ")
    password = F.when((blank > 1) & (blank < F.length(raw)), F.substring(raw, blank + 1, F.length(raw)))
    n_sso = sum((F.when(unset(c), 0).otherwise(1) for c in SSO), F.lit(0))
    able = ~unset(SSO[0]) & ~unset(SSO[1]) & ~unset(SSO[2])
    beyond = unset(SSO[0]) | unset(SSO[1]) | unset(SSO[2]) | unset(SSO[3])
    key = F.regexp_extract(t("redis_url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@:]*):([^/@]*)@", 1)
    is_url = t("redis_url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    grave, rising, mild = ("advisory", "critical", "critical"), ("advisory", "warning", "critical"), ("advisory", "warning", "warning")
    example_secrets = {"admin-api-key": "admin_api_key", "admin-session-secret": "admin_session_secret", "db-password": "db_password", "test-audio-service-key": "test_audio_service_key"}
    secret = t("admin_session_secret")
    # Ids, categories and severities of the rules.
    return [
        Check("deployment-env-invalid", "environment", ~F.col("declared_env").isin(*ENVIRONMENTS), ("warning", "warning", "warning")),
        Check("dev-flag-in-deployed-env", "access", F.col("is_development"), ("ok", "critical", "critical")),
        *(Check(f"{name}-placeholder", "secrets", example(t(c)), grave) for name, c in example_secrets.items()),
        Check("admin-api-key-missing", "secrets", unset("admin_api_key"), ("critical", "critical", "critical")),
        Check("db-password-missing", "secrets", unset("db_password"), ("warning", "critical", "critical")),
        Check("admin-session-secret-missing", "secrets", secret == "", rising),
        Check("admin-session-secret-weak", "secrets", ~example(secret) & (secret != "") & (F.length(secret) < SESSION_SECRET), rising),
        Check("sso-incomplete-config", "access", (n_sso > 0) & (n_sso < len(SSO)) & beyond, mild),
        Check("admin-local-credentials-placeholder", "access", local & example(raw), grave),
        Check("admin-local-credentials-malformed", "access", local & ~example(raw) & password.isNull(), grave),
        Check("admin-local-credentials-weak", "access", local & ~example(raw) & (F.length(password) < LOCAL_PASSWORD), rising),
        Check("no-login-method", "access", ~local & (n_sso < len(SSO)), ("critical", "critical", "critical")),
        Check("local-login-only", "access", local & ~able, ("ok", "advisory", "warning")),
        Check("sso-no-group-restriction", "access", able & unset("allowed_group"), rising),
        Check("fleet-telemetry-disabled", "telemetry", unset("redis_url"), ("advisory", "advisory", "warning")),
        Check("redis-url-no-password", "telemetry", is_url & (key == ""), rising),
        Check("redis-url-placeholder-password", "telemetry", example(key), grave),
    ]
