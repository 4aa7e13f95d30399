"""What to do about a finding: a row for each built-in detector, joined to findings.

The words follow from what kind of credential a detector finds; only the names of providers are listed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.operators.registry import BUILT_IN


class Advice(NamedTuple):
    title: str
    steps: tuple[str, ...]
    urgency: str
    checklist: tuple[str, ...]


#: Detectors by kind of credential, with the name of what issues it.
ISSUERS: dict[str, dict[str, str]] = {
    "token": {
        "airtable-pat": "Airtable", "auth0-management-token": "Auth0", "bitbucket-app-password": "Bitbucket", "circleci-token": "CircleCI", "cloudflare-api-token": "Cloudflare",
        "databricks-token": "Databricks", "digitalocean-token": "DigitalOcean", "discord-bot-token": "Discord", "dockerhub-pat": "Docker Hub", "doppler-token": "Doppler", "figma-pat": "Figma",
        "github-oauth-token": "GitHub", "github-token": "GitHub", "gitlab-pat": "GitLab", "hashicorp-vault-token": "Vault", "huggingface-token": "Hugging Face", "jwt": "the token's issuer",
        "notion-token": "Notion", "npm-token": "npm", "okta-api-token": "Okta", "postmark-server-token": "Postmark", "pypi-api-token": "PyPI", "sentry-token": "Sentry",
        "shopify-access-token": "Shopify", "slack-token": "Slack", "sonarcloud-token": "SonarCloud", "telegram-bot-token": "Telegram", "terraform-cloud-token": "Terraform Cloud", "vercel-token": "Vercel",
    },
    "key": {
        "anthropic-api-key": "Anthropic", "aws-access-key-id": "AWS", "azure-entra-secret": "Entra ID", "azure-storage-key": "Azure Storage", "coinbase-api-key": "Coinbase", "datadog-api-key": "Datadog",
        "deepseek-api-key": "DeepSeek", "gcp-service-account": "Google Cloud", "generic-api-key": "the key's issuer", "grafana-api-key": "Grafana", "heroku-api-key": "Heroku", "infura-api-key": "Infura",
        "launchdarkly-sdk-key": "LaunchDarkly", "linear-api-key": "Linear", "mailgun-api-key": "Mailgun", "newrelic-api-key": "New Relic", "openai-api-key": "OpenAI", "pagerduty-api-key": "PagerDuty",
        "rubygems-api-key": "RubyGems", "sendgrid-api-key": "SendGrid", "snyk-api-key": "Snyk", "stripe-api-key-live": "Stripe", "stripe-api-key-test": "Stripe (test mode)",
        "structured-config-secret": "the configured service", "supabase-service-key": "Supabase", "twilio-api-key": "Twilio",
    },
    "login": {
        "database-connection-string": "the database", "ftp-credentials": "the file server", "ldap-credentials": "the directory", "rabbitmq-connection-string": "RabbitMQ",
        "redis-connection-string": "Redis", "snowflake-credentials": "Snowflake",
    },
    "webhook": {"discord-webhook-url": "Discord", "slack-webhook": "Slack", "teams-webhook": "Teams"},
    "private key": {"private-key": "all that trusts it"},
}

#: For each kind: the title, the steps, and what to look at afterwards.
WORDS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "token": ("Revoke the token at {0}", ("Issue another token at {0} with no more scopes than needed.", "Put it where the old one is read from, outside of the repository.", "Revoke the old token."), ("Has the audit log of {0} uses that aren't yours?", "Does the value stand elsewhere, in history too?")),
    "key": ("Replace the key of {0}", ("Make another key at {0}.", "Deploy it from a secret store.", "Disable the old key, watch for failures, then delete it."), ("Do usage and bills at {0} show calls that aren't yours?", "Does the value stand elsewhere, in history too?")),
    "login": ("Change the password for {0}", ("Set another password, or another account with fewer rights, on {0}.", "Restart the clients with it.", "Close {0} to networks that don't need it."), ("Do the logs of {0} show sessions that aren't yours?", "Was data read or changed?")),
    "webhook": ("Delete the webhook of {0}", ("Make another webhook in {0}.", "Point the senders at it.", "Delete the old one."), ("Were messages posted that aren't yours?",)),
    "private key": ("Withdraw the private key from {0}", ("Generate another pair where it will be used.", "Register the new public key or request a certificate for it.", "Withdraw the old public key, or have the certificate revoked."), ("Which hosts and accounts accept the old key?",)),
}

URGENCY = {"critical": "now", "high": "today", "medium": "this week", "low": "when convenient"}


def advice(detector_id: str) -> Advice | None:
    """What to do about findings of a built-in detector; None for others."""
    for kind, issuers in ISSUERS.items():
        if issuer := issuers.get(detector_id):
            title, steps, checklist = WORDS[kind]
            return Advice(title.format(issuer), tuple(s.format(issuer) for s in steps), URGENCY[BUILT_IN[detector_id].severity], tuple(c.format(issuer) for c in checklist))
    return None


def table(spark: SparkSession) -> DataFrame:
    """A row for each built-in detector."""
    rows = [(id, a.title, list(a.steps), a.urgency, list(a.checklist)) for id in BUILT_IN if (a := advice(id))]
    return spark.createDataFrame(rows, "detector_id string, remediation_title string, remediation_steps array<string>, remediation_urgency string, remediation_checklist array<string>")


def enriched(found: DataFrame) -> DataFrame:
    """Findings with advice; nulls for the user's rules. Columns of these names that are there already are replaced.
    The table has a row for each built-in detector, so it is broadcast."""
    advised = table(found.sparkSession)
    return found.drop(*[c for c in advised.columns if c != "detector_id"]).join(F.broadcast(advised), "detector_id", "left")
