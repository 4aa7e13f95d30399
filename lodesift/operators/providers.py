"""How each provider is asked whether a value is active, and what its answers mean.

A provider is a row: the request (method, address, headers), the status codes of active and inactive values, and what
the body must hold for either. Nothing here opens a connection: requests go through a transport that the caller gives,
and judged() is a function of the answer alone, so recorded answers are judged in the same way."""

from __future__ import annotations

import base64
import ipaddress
import json
import re
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from email.utils import parsedate_to_datetime
from typing import NamedTuple
from urllib.parse import urlsplit

UNVERIFIED, ACTIVE, INACTIVE, ERROR = "unverified", "verified_active", "verified_inactive", "verify_error"
AGENT = "lodesift"
#: Of an answer's body that is looked at; one that is judged as a whole mustn't be longer.
MOST_BODY = 1 << 20
#: An answer 429 to a GET is asked once more if the provider names a wait of so many seconds at most.
LONGEST_WAIT = 2.0
#: Requests for one finding that a provider may declare.
MOST_REQUESTS = 8


class Request(NamedTuple):
    method: str
    url: str
    headers: Mapping[str, str]
    body: bytes = b""


class Answer(NamedTuple):
    code: int
    body: bytes = b""
    headers: Mapping[str, str] = {}  # noqa: RUF012


Transport = Callable[[Request], Answer]


@dataclass(frozen=True)
class Provider:
    url: str  # {origin}: that the user trusts; {value}, {username}, {host}, {domain}, ...: of the finding
    headers: tuple[tuple[str, str], ...] = (("Authorization", "Bearer {value}"),)
    method: str = "GET"
    body: bytes = b""
    login: tuple[str, str] | None = None
    active: tuple[int, ...] = (200,)
    inactive: tuple[int, ...] = (401,)
    typed: tuple[tuple[str, type], ...] | None = None  # members that have the type, if they are there; None: the body isn't read
    filled: tuple[str, ...] = ()  # members without which the answer tells nothing
    flag: str | None = None  # a member that is true for active values and false, or absent, for others
    strict_flag: bool = False  # an absent flag tells nothing
    failed: tuple[str, str] | None = None  # a member that isn't empty tells this status
    rejected: tuple[str, tuple[str, ...]] | None = None  # a member, and what it must say for a value to be inactive
    is_json: bool = False  # only answers of that media type count
    whole: bool = False  # nothing may follow the value, and the body must not be cut
    regions: tuple[str, ...] = ()  # further addresses; a value is inactive if it is so at all of them
    asks_all: bool = False  # go on to the next region after anything but an active value
    needs: tuple[str, ...] = ()
    budget: int = 2

    @property
    def trusts(self) -> bool:
        return "{origin}" in self.url


def _named(member: str, **more: object) -> Callable[[str], Provider]:
    return lambda url, **own: Provider(url, typed=((member, str),), **(more | own))


BASIC = ()
TOKEN = lambda name: ((name, "{value}"),)
_JSON_BODY = ("Content-Type", "application/json")

#: Addresses, headers and members of the providers' public interfaces.
PROVIDERS: dict[str, Provider] = {
    "airtable-pat": _named("id")("https://api.airtable.com/v0/meta/whoami"),
    "anthropic-api-key": Provider("https://api.anthropic.com/v1/models", (("x-api-key", "{value}"), ("anthropic-version", "2023-06-01")), typed=(("data", list),)),
    "auth0-management-token": Provider("{origin}/api/v2/clients?per_page=1&include_fields=true&fields=client_id", typed=(("", list),), is_json=True),
    "bitbucket-app-password": _named("display_name")("https://api.bitbucket.org/2.0/user", headers=BASIC, login=("{username}", "{value}"), needs=("username",)),
    "circleci-token": _named("name")("https://circleci.com/api/v2/me", headers=TOKEN("Circle-Token")),
    "cloudflare-api-token": Provider("https://api.cloudflare.com/client/v4/user/tokens/verify", typed=(("success", bool), ("errors", list)), flag="success"),
    "databricks-token": _named("userName")("{host}/api/2.0/preview/scim/v2/Me", needs=("host",)),
    "datadog-api-key": Provider("{origin}/api/v1/validate", TOKEN("DD-API-KEY"), inactive=(403,), typed=(("valid", bool),), flag="valid", strict_flag=True, rejected=("errors", ("forbidden",)), is_json=True, whole=True),
    "deepseek-api-key": Provider("https://api.deepseek.com/models", typed=(("data", list),)),
    "digitalocean-token": _named("account.email")("https://api.digitalocean.com/v2/account"),
    "discord-bot-token": _named("username")("https://discord.com/api/v10/users/@me", headers=(("Authorization", "Bot {value}"),)),
    "dockerhub-pat": _named("username")("https://hub.docker.com/v2/user/"),
    "doppler-token": Provider("https://api.doppler.com/v3/me"),
    "figma-pat": _named("handle")("https://api.figma.com/v1/me", headers=TOKEN("X-Figma-Token"), inactive=(403,)),
    "github-oauth-token": Provider("{origin}/user", (("Authorization", "Bearer {value}"), ("Accept", "application/vnd.github+json")), typed=(("login", str),), filled=("login",), rejected=("message", ("bad credentials",)), is_json=True, whole=True),
    "github-token": Provider("{origin}/user", (("Authorization", "Bearer {value}"), ("Accept", "application/vnd.github+json")), typed=(("login", str),), filled=("login",), rejected=("message", ("bad credentials",)), is_json=True, whole=True),
    "gitlab-pat": Provider("{origin}/api/v4/user", TOKEN("PRIVATE-TOKEN"), typed=(("id", int), ("username", str)), filled=("id", "username"), rejected=("message", ("401 unauthorized",)), is_json=True, whole=True, budget=4),
    "grafana-api-key": Provider("{origin}/api/access-control/user/permissions", (("Accept", "application/json"), ("Authorization", "Bearer {value}")), typed=(("", dict),), rejected=("message", ("invalid api key", "unauthorized")), is_json=True, whole=True),
    "heroku-api-key": _named("email")("https://api.heroku.com/account", headers=(("Authorization", "Bearer {value}"), ("Accept", "application/vnd.heroku+json; version=3"))),
    "huggingface-token": _named("name")("https://huggingface.co/api/whoami-v2"),
    "infura-api-key": Provider("https://mainnet.infura.io/v3/{value}", (_JSON_BODY,), "POST", b'{"jsonrpc":"2.0","method":"web3_clientVersion","params":[],"id":1}', inactive=(401, 403), typed=(("result", str),), flag="result", failed=("error", INACTIVE)),
    "launchdarkly-sdk-key": Provider("https://app.launchdarkly.com/api/v2/caller-identity", TOKEN("Authorization")),
    "linear-api-key": Provider("https://api.linear.app/graphql", (("Authorization", "Bearer {value}"), _JSON_BODY), "POST", b'{"query":"{ viewer { id name } }"}', typed=(("data.viewer", dict),), filled=("data.viewer",), failed=("errors", INACTIVE)),
    "mailgun-api-key": Provider("https://api.mailgun.net/v3/domains", BASIC, login=("api", "{value}"), regions=("https://api.eu.mailgun.net/v3/domains",), budget=4),
    "newrelic-api-key": Provider("https://api.newrelic.com/graphql", (("Accept", "application/json"), ("Api-Key", "{value}"), _JSON_BODY), "POST", b'{"query":"query { requestContext { userId } }"}', typed=(), filled=("data.requestContext.userId",), failed=("errors", ERROR), rejected=("errors.message", ("authentication required",)), is_json=True, whole=True, regions=("https://api.eu.newrelic.com/graphql",), asks_all=True),
    "notion-token": _named("name")("https://api.notion.com/v1/users/me", headers=(("Authorization", "Bearer {value}"), ("Notion-Version", "2022-06-28"))),
    "npm-token": _named("name")("https://registry.npmjs.org/-/npm/v1/user"),
    "okta-api-token": _named("profile.login")("https://{domain}/api/v1/users/me", headers=(("Authorization", "SSWS {value}"),), needs=("domain",)),
    "openai-api-key": Provider("https://api.openai.com/v1/models", typed=(("data", list),)),
    "pagerduty-api-key": _named("user.name")("https://api.pagerduty.com/users/me", headers=(("Authorization", "Token token={value}"),)),
    "postmark-server-token": _named("Name")("https://api.postmarkapp.com/server", headers=TOKEN("X-Postmark-Server-Token")),
    "pypi-api-token": Provider("https://upload.pypi.org/legacy/", BASIC, login=("__token__", "{value}"), active=(405,), inactive=(401, 403)),
    "rubygems-api-key": Provider("https://rubygems.org/api/v1/api_key.json", TOKEN("Authorization")),
    "sendgrid-api-key": Provider("https://api.sendgrid.com/v3/scopes", typed=(("scopes", list),)),
    "sentry-token": Provider("https://sentry.io/api/0/organizations/"),
    "shopify-access-token": Provider("{origin}/admin/api/2026-07/graphql.json", (("Accept", "application/json"), _JSON_BODY, ("X-Shopify-Access-Token", "{value}")), "POST", b'{"query":"query { shop { name } }"}', typed=(("data.shop.name", str),), filled=("data.shop.name",), failed=("errors", ERROR), is_json=True),
    "slack-token": Provider("https://slack.com/api/auth.test", (("Authorization", "Bearer {value}"), ("Content-Type", "application/json; charset=utf-8")), "POST", inactive=(), typed=(("ok", bool), ("error", str)), flag="ok"),
    "snyk-api-key": Provider("{origin}/rest/self?version=2024-10-15", (("Authorization", "token {value}"), ("Version", "2024-10-15")), typed=(), filled=("data",), rejected=("message", ("invalid auth token provided",)), is_json=True, whole=True),
    "sonarcloud-token": Provider("https://sonarcloud.io/api/authentication/validate", BASIC, login=("{value}", ""), typed=(("valid", bool),), flag="valid"),
    "stripe-api-key-live": Provider("https://api.stripe.com/v1/balance", BASIC, login=("{value}", ""), active=(200, 403), typed=(("error", dict),)),
    "stripe-api-key-test": Provider("https://api.stripe.com/v1/balance", BASIC, login=("{value}", ""), active=(200, 403), typed=(("error", dict),)),
    "supabase-service-key": Provider("https://api.supabase.com/v1/projects"),
    "teams-webhook": Provider("{value}", (_JSON_BODY,), "POST", b"{}", active=(400,), inactive=(404,), budget=1),
    "telegram-bot-token": Provider("https://api.telegram.org/bot{value}/getMe", (), typed=(("ok", bool), ("result.username", str)), flag="ok"),
    "terraform-cloud-token": _named("data.attributes.username")("https://app.terraform.io/api/v2/account/details"),
    "twilio-api-key": Provider("{origin}/2010-04-01/Accounts.json", BASIC, login=("{api_key_sid}", "{value}"), typed=(), filled=("accounts",), is_json=True, needs=("api_key_sid",)),
    "vercel-token": _named("user.username")("https://api.vercel.com/v2/user", inactive=(401, 403)),
    # asked through a client of the caller's own, which signs; its error codes stand in the body
    "aws-access-key-id": Provider("https://sts.amazonaws.com/?Action=GetCallerIdentity&Version=2011-06-15", (), inactive=(400, 401, 403), needs=("raw_v2",), budget=1),
}
#: Error codes by which the service tells that a pair of keys isn't valid.
AWS_REJECTIONS = ("InvalidClientTokenId", "SignatureDoesNotMatch", "ExpiredToken", "ExpiredTokenException", "InvalidToken", "TokenRefreshRequired", "AuthFailure", "UnrecognizedClientException", "IncompleteSignature")
_INSTALLATION = Provider("{origin}/installation/repositories", PROVIDERS["github-oauth-token"].headers, typed=(("total_count", int), ("repositories", list)), filled=("repositories",), rejected=("message", ("bad credentials",)), is_json=True, whole=True)


# Answers


def _member(value: object, path: str) -> object:
    """What stands at a dotted path, None if nothing does; names are compared without case if none is equal."""
    for name in path.split(".") if path else ():
        if not isinstance(value, dict):
            return None
        value = value.get(name, next((v for k, v in value.items() if k.lower() == name.lower()), None))
    return value


def _read(body: bytes, whole: bool) -> object:
    """The first JSON value of a body, alone in it if whole; an error if there is none."""
    text = body.decode("utf-8", "replace").lstrip(" \t\r\n")
    value, end = json.JSONDecoder().raw_decode(text)
    if whole and text[end:].strip(" \t\r\n"):
        raise ValueError("something follows the value")
    return value


def _is_json(kind: str) -> bool:
    media = kind.partition(";")[0].strip().lower()
    return media == "application/json" or (media.startswith("application/") and media.endswith("+json"))


def _of_type(value: object, path: str, kind: type) -> bool:
    """Whether a member has a type, or it or what would hold it is absent or null."""
    head, _, rest = path.partition(".")
    if path:
        return value is None or (isinstance(value, dict) and _of_type(_member(value, head), rest, kind))
    return value is None or (isinstance(value, kind) and (kind is not int or not isinstance(value, bool)))


def _accepted(p: Provider, body: bytes) -> str:
    if p.typed is None:
        return ACTIVE
    try:
        value = _read(body, p.whole)
    except ValueError:
        return ERROR
    holds_object = all(path for path, _ in p.typed)
    if (holds_object and not _of_type(value, "", dict)) or not all(_of_type(value, path, kind) for path, kind in p.typed):
        return ERROR
    if not holds_object and value is None:
        return ERROR
    if p.failed and _member(value, p.failed[0]) not in (None, [], ""):
        return p.failed[1]
    for path in p.filled:
        found = _member(value, path)
        if found is None or (isinstance(found, str) and not found.strip()) or (isinstance(found, int) and found <= 0):
            return ERROR
    if p.flag:
        found = _member(value, p.flag)
        if found is None and p.strict_flag:
            return ERROR
        return ACTIVE if found else INACTIVE
    return ACTIVE


def _refused(p: Provider, body: bytes) -> str:
    if not p.rejected:
        return INACTIVE
    path, allowed = p.rejected
    try:
        value = _read(body, True)
    except ValueError:
        return ERROR
    listed, _, member = path.partition(".")
    found = _member(value, listed)
    if isinstance(found, list):
        said = [_member(x, member) if member else x for x in found]
        if not member and len(said) != 1:
            return ERROR
    else:
        said = [found]
    return INACTIVE if said and all(isinstance(x, str) and x.strip().lower() in allowed for x in said) else ERROR


def judged(detector_id: str, code: int | None, body: bytes = b"", content_type: str = "", provider: Provider | None = None) -> str:
    """What an answer says of a value. No answer, a redirect, a code that is neither of an active nor of an inactive
    value, or a body that proves neither, is an error; detectors without a provider stay unverified."""
    p = provider or PROVIDERS.get(detector_id)
    if p is None:
        return UNVERIFIED
    if code is None:
        return ERROR
    if detector_id == "aws-access-key-id" and code in p.inactive:
        text = body.decode("utf-8", "replace")
        return INACTIVE if any(x in text for x in AWS_REJECTIONS) else ERROR
    if code not in (*p.active, *p.inactive):
        return ERROR
    if (p.is_json and not _is_json(content_type)) or (p.whole and len(body) > MOST_BODY):
        return ERROR
    return _accepted(p, body[:MOST_BODY]) if code in p.active else _refused(p, body[:MOST_BODY])


# Requests


def trusted_origin(text: str) -> str:
    """An address that the user trusts to be sent values: https, a host with a name, no login, path or query. What
    isn't so is an error, as are names and numbers of machines at hand. It never comes from what is scanned."""
    parts = urlsplit(text.strip())
    host = (parts.hostname or "").rstrip(".").lower()
    if parts.scheme.lower() != "https" or not host or "@" in parts.netloc or parts.path not in ("", "/") or "?" in text or "#" in text:
        raise ValueError("an origin is https:// and a host, and a port if need be")
    numeric = all(re.fullmatch(r"0x[0-9a-f]*|[0-9]+", part) for part in host.split("."))
    try:
        ipaddress.ip_address(host)
        numeric = True
    except ValueError:
        pass
    if numeric or re.search(r"[*\s]", host) or host == "localhost" or host.endswith(".localhost"):
        raise ValueError("an origin names a host that others can reach")
    try:
        port = parts.port
    except ValueError:
        raise ValueError("a port is a number from 1 to 65535") from None
    if port == 0:
        raise ValueError("a port is a number from 1 to 65535")
    return f"https://{host}" + (f":{port}" if port else "")


def provider_for(detector_id: str, value: str) -> Provider | None:
    """The provider that can tell of a value; None for kinds of values that can't be asked for without harm."""
    if detector_id == "github-oauth-token":
        return PROVIDERS[detector_id] if value.startswith(("gho_", "ghu_")) else _INSTALLATION if value.startswith("ghs_") else None
    if detector_id == "gitlab-pat" and not value.startswith("glpat-"):
        return None
    return PROVIDERS.get(detector_id)


def requests_for(detector_id: str, value: str, context: Mapping[str, str], origin: str | None = None) -> list[Request]:
    """The requests for a value, one for each region; none if the value is empty, or an origin or a companion that the
    provider needs isn't there."""
    p = provider_for(detector_id, value)
    if p is None or not value.strip() or any(not context.get(x) for x in p.needs) or (p.trusts and origin is None):
        return []
    known = {**context, "value": value, "origin": trusted_origin(origin) if p.trusts and origin else ""}
    fill = lambda text: re.sub(r"\{(\w+)\}", lambda m: known.get(m[1], ""), text)
    headers = {k: fill(v) for k, v in p.headers} | {"User-Agent": AGENT}
    if p.login:
        headers["Authorization"] = "Basic " + base64.b64encode(":".join(map(fill, p.login)).encode()).decode()
    return [Request(p.method, fill(url), headers, p.body) for url in (p.url, *p.regions)]


class Limiter:
    """A token bucket: `rate` requests a second, as many at once at most. One for all detectors and one for each."""

    def __init__(self, rate: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.now, self.sleep = rate, now, sleep
        self.held: dict[str, tuple[float, float]] = {}

    def wait(self, detector_id: str) -> None:
        for name in ("", detector_id) if self.rate > 0 else ():
            burst = max(1.0, float(int(self.rate)))
            left, at = self.held.get(name, (burst, self.now()))
            left = min(burst, left + (self.now() - at) * self.rate)
            if left < 1:
                self.sleep((1 - left) / self.rate)
                left = 1.0
            self.held[name] = left - 1, self.now()


def _wait_told(headers: Mapping[str, str]) -> float | None:
    told = next((v for k, v in headers.items() if k.lower() == "retry-after"), "").strip()
    if re.fullmatch("[0-9]+", told):
        return float(told)
    try:
        return max(0.0, parsedate_to_datetime(told).timestamp() - time.time())
    except (TypeError, ValueError):
        return None


def ask(detector_id: str, value: str, context: Mapping[str, str], transport: Transport, limiter: Limiter, origin: str | None = None) -> str:
    """The status of a value by its provider's answers. No more requests are sent than the provider's budget; nothing
    that a transport raises gets out, as it may quote the value."""
    try:
        requests = requests_for(detector_id, value, context, origin)
    except ValueError:
        return UNVERIFIED
    p = provider_for(detector_id, value)
    if p is None or not requests:
        return UNVERIFIED
    left = min(max(p.budget, len(requests)), MOST_REQUESTS)
    told = []
    for request in requests:
        for again in (True, False):
            if not left:
                return ERROR
            left -= 1
            limiter.wait(detector_id)
            try:
                answer = transport(request)
            except Exception:
                answer = None
            wait = _wait_told(answer.headers) if again and answer and answer.code == 429 and request.method in ("GET", "HEAD") else None
            if wait is None or wait > LONGEST_WAIT:
                break
            limiter.sleep(wait)
        kind = next((v for k, v in answer.headers.items() if k.lower() == "content-type"), "") if answer else ""
        told.append(judged(detector_id, answer.code, answer.body, kind, p) if answer else ERROR)
        if told[-1] == ACTIVE or (told[-1] != INACTIVE and not p.asks_all):
            return told[-1]
    return INACTIVE if set(told) == {INACTIVE} else ERROR
