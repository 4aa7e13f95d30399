"""What can be told of a finding's value: what each detector's provider offers, checks of the form alone, and the
meaning of a provider's answer. Nothing here sends anything; a live probe is a function that the caller gives."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodesift.operators import providers
from lodesift.operators.findings import free_names
from lodesift.operators.registry import BUILT_IN

#: Detectors whose values need an origin or a companion that the user tells, that are only checked
#: for their form, or that aren't checked at all. All others can be probed.
REQUIRES_CONTEXT = ("auth0-management-token", "datadog-api-key", "github-oauth-token", "github-token", "gitlab-pat", "grafana-api-key", "shopify-access-token", "snyk-api-key", "twilio-api-key")
FORMAT_ONLY = ("azure-entra-secret", "azure-storage-key", "coinbase-api-key", "gcp-service-account", "rabbitmq-connection-string", "snowflake-credentials")
NEVER = ("database-connection-string", "discord-webhook-url", "ftp-credentials", "generic-api-key", "hashicorp-vault-token", "jwt", "ldap-credentials", "private-key", "redis-connection-string", "slack-webhook", "structured-config-secret")
UNVERIFIED = providers.UNVERIFIED


def kind(detector_id: str) -> str:
    for name, ids in (("requires_context", REQUIRES_CONTEXT), ("format_only", FORMAT_ONLY), ("none", NEVER)):
        if detector_id in ids:
            return name
    return "live"


def capabilities(spark: SparkSession) -> DataFrame:
    """(detector_id, severity, kind), a row for each built-in detector."""
    return spark.createDataFrame([(d.id, d.severity, kind(d.id)) for d in BUILT_IN.values()], "detector_id string, severity string, kind string")


def with_capability(found: DataFrame) -> DataFrame:
    """found and the kind of each finding's detector; `none` for rules of the user. The other side has a row for
    each detector, whatever is scanned."""
    return found.join(F.broadcast(capabilities(found.sparkSession).select("detector_id", "kind")), "detector_id", "left").fillna("none", ["kind"])


@F.pandas_udf(StringType())
def _judged(detector_id: pd.Series, code: pd.Series, body: pd.Series, content_type: pd.Series) -> pd.Series:
    rows = zip(detector_id, code, body, content_type, strict=True)
    return pd.Series([providers.judged(d, None if pd.isna(c) else int(c), (b or "").encode(), k or "") for d, c, b, k in rows], dtype="object")


def status_of_answer(detector_id: Column, code: Column, body: Column, content_type: Column) -> Column:
    """What a provider's answer says of a value, of recorded answers: status code, body as text, media type. A null
    code is no answer. Detectors that can't be asked for stay unverified."""
    return _judged(detector_id, code.cast("int"), body, content_type)


def well_formed(detector_id: Column, raw: Column, raw_v2: Column) -> Column:
    """Whether a value has the form that its provider issues; null for detectors without such a check. raw and
    raw_v2 are strings."""
    whole = F.coalesce(raw_v2, raw)
    parts = F.map_from_entries(F.transform(F.filter(F.split(whole, ";"), lambda p: p.contains("=")), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))), F.regexp_replace(p, "^[^=]*=", ""))))
    account = F.try_element_at(parts, F.lit("accountname"))
    key = F.try_element_at(parts, F.lit("accountkey"))
    filled = lambda name: F.coalesce(F.length(F.get_json_object(whole, f"$.{name}")) > 0, F.lit(False))
    return (
        F.when(detector_id == "azure-entra-secret", raw.rlike(r"\A[A-Za-z0-9~._-]{34,40}\z"))
        .when(detector_id == "azure-storage-key", F.coalesce((F.length(account) > 0) & (F.length(key) > 0) & F.try_to_binary(key, F.lit("base64")).isNotNull(), F.lit(False)))
        .when(detector_id == "coinbase-api-key", raw.rlike(r"\A[A-Za-z0-9+/=]{16,64}\z"))
        .when(detector_id == "gcp-service-account", (F.coalesce(F.get_json_object(whole, "$.type"), F.lit("")) == "service_account") & filled("project_id") & filled("private_key_id") & filled("client_email"))
        .when(detector_id == "rabbitmq-connection-string", F.coalesce(raw.rlike(r"\Aamqps?://[^:/?#@]+(:[^@]*)?@[^:/?#]+"), F.lit(False)))
        .when(detector_id == "snowflake-credentials", (F.octet_length(raw) >= 8) & F.coalesce(raw_v2.contains("snowflakecomputing.com"), F.lit(True)))
    )


def verified(found: DataFrame, transport: providers.Transport, tasks: int = 4, rate: float = 10.0, origins: Mapping[str, str] | None = None) -> DataFrame:
    """found (with raw, raw_v2 and extra) and a status: each distinct value of a detector that has a provider is asked for
    once, and all findings of it get the answer. transport sends a request and returns the answer. At most `rate`
    requests a second are sent in all and for each detector, each of the tasks having its share. origins: for
    detectors whose providers run at addresses of the user's own. raw and raw_v2 are dropped.

    The findings are scanned once: those of a value come to one task, in order, so no join is needed. A task holds
    one answer at a time."""
    trusted = {d: providers.trusted_origin(o) for d, o in (origins or {}).items()}
    columns = [c for c in found.columns if c not in ("raw", "raw_v2")]
    key, raw, second = free_names(found, "key", "raw", "raw_v2")[0], "raw", "raw_v2"
    mark = F.sha2(F.concat_ws("\x00", "detector_id", F.hex(raw), F.coalesce(F.hex(second), F.lit(""))), 256)
    dealt = found.withColumn(key, mark).repartition(tasks, key).sortWithinPartitions(key).select(*columns, key, raw, second)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter, last, status = providers.Limiter(rate / tasks), None, UNVERIFIED
        for batch in batches:
            at = batch.schema.get_field_index
            told = []
            for own, id, value, other, extra in zip(*[batch.column(at(c)).to_pylist() for c in (key, "detector_id", raw, second)], batch.column(at("extra")).to_pylist() if at("extra") >= 0 else [None] * batch.num_rows, strict=True):
                if own != last:
                    context = dict(extra or ()) | ({"raw_v2": other.decode("utf-8", "replace")} if other else {})
                    last, status = own, providers.ask(id, (value or b"").decode("utf-8", "replace"), context, transport, limiter, trusted.get(id))
                told.append(status)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(told, pa.string())], names=[*columns, "status"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema[: len(columns)])
    return dealt.mapInArrow(send, f"{schema}, status string")
