"""Where signals are forwarded to: validation, headers, display."""

from __future__ import annotations

import base64
from urllib.parse import urlsplit, urlunsplit

from teleloom.config import ConfigError, Proxy, ProxyAuth

#: Hosts that mean this machine.
LOCAL = {"", "0.0.0.0", "::", "::1", "127.0.0.1", "localhost"}


def _split(url: str):
    """Parts of a URL; a bare host:port has no scheme."""
    return urlsplit(url) if "://" in url else urlsplit("//" + url)


def normalize_host_port(addr: str) -> str:
    """host:port in lower case, every name of this machine being localhost."""
    host, colon, port = addr.rpartition(":")
    if not colon or not port or (":" in host and not (host.startswith("[") and host.endswith("]"))):
        raise ConfigError(f"address {addr!r}: want host:port")
    host = host.strip("[]").lower()
    if host in LOCAL:
        host = "localhost"
    return f"[{host}]:{port}" if ":" in host else f"{host}:{port}"


def endpoint(url: str) -> tuple[str, bool]:
    """(endpoint, insecure) for gRPC: http and bare hosts are insecure, https isn't."""
    parts = urlsplit(url) if "://" in url else None
    if parts and parts.scheme.lower() in ("http", "https"):
        return parts.netloc, parts.scheme.lower() == "http"
    return url, True


def headers(auth: ProxyAuth) -> dict[str, str]:
    """S6."""
    if auth.type == "bearer":
        return {"Authorization": f"Bearer {auth.token}"}
    if auth.type == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{auth.username}:{auth.password}".encode()).decode()}
    return dict(auth.headers) if auth.type == "headers" else {}


def _check_auth(a: ProxyAuth) -> None:
    allowed = {"bearer": {"token"}, "basic": {"username", "password"}, "headers": {"headers"}}
    needed = {"bearer": "token", "basic": "username", "headers": "headers"}
    if not a.type:
        if a.has_fields():
            raise ConfigError("proxy auth fields need a type")
        return
    if a.type not in allowed:
        raise ConfigError(f"unknown proxy auth type {a.type!r}: want bearer, basic or headers")
    given = {n for n in ("token", "username", "password", "headers") if getattr(a, n)}
    if needed[a.type] not in given:
        raise ConfigError(f"proxy auth {a.type} needs {needed[a.type]}")
    if given - allowed[a.type]:
        raise ConfigError(f"proxy auth {a.type} takes {' and '.join(sorted(allowed[a.type]))} only")


def validate(proxy: Proxy, otlp_grpc: str, otlp_http: str) -> None:
    """Url and protocol come together, no credentials in the url, no forwarding to ourselves."""
    if not proxy.url and not proxy.protocol:
        if proxy.auth.type or proxy.auth.has_fields():
            raise ConfigError("proxy auth needs a proxy url and protocol")
        return
    if not proxy.url or not proxy.protocol:
        raise ConfigError("proxy url and protocol go together")
    if proxy.protocol not in ("grpc", "http"):
        raise ConfigError(f"unknown proxy protocol {proxy.protocol!r}: want grpc or http")
    parts = _split(proxy.url)
    if "@" in parts.netloc:
        raise ConfigError("a proxy url must not hold credentials; use the auth settings")
    _check_auth(proxy.auth)
    schemed = "://" in proxy.url
    if schemed and (parts.scheme.lower() not in ("http", "https") or not parts.netloc):
        raise ConfigError(f"proxy url {proxy.url!r}: want http(s)://host:port")
    if not schemed and (proxy.protocol == "http" or "/" in proxy.url):
        raise ConfigError(f"proxy url {proxy.url!r}: want {'http(s)://' if proxy.protocol == 'http' else ''}host:port")
    if normalize_host_port(parts.netloc) == normalize_host_port(otlp_grpc if proxy.protocol == "grpc" else otlp_http):
        raise ConfigError(f"proxy url {proxy.url!r} leads back to this receiver")


def parse_headers(args: list[str]) -> dict[str, str]:
    """name=value pairs; blanks around either are dropped, pairs without a name or ``=`` left out."""
    out = {}
    for a in args:
        k, eq, v = a.partition("=")
        if eq and k.strip():
            out[k.strip()] = v.strip()
    return out


def redact(url: str) -> str:
    """The url with its credentials hidden."""
    parts = urlsplit(url)
    if "@" not in parts.netloc:
        return url
    return urlunsplit(parts._replace(netloc="REDACTED:REDACTED@" + parts.netloc.rpartition("@")[2]))


def fan_out(proxy: Proxy) -> list[str]:
    """The sinks of each signal's pipeline."""
    return ["store"] + ([f"proxy-{proxy.protocol}"] if proxy.url else [])
