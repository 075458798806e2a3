import pytest

from teleloom import proxy
from teleloom.config import Config, ConfigError, Proxy, ProxyAuth, load_file, log_level, resolve
from teleloom.streaming.state import Hub, backoff


def test_files(tmp_path):
    assert load_file(tmp_path / "none.toml") == Config()
    f = tmp_path / "c.toml"
    f.write_text('http = ":9"\ntrace_cap = 42\ndebug = true\n[proxy.auth]\ntoken = "x"\n')
    c = load_file(f)
    assert (c.http, c.trace_cap, c.debug, c.log_cap, c.proxy.auth.token) == (":9", 42, True, 5000, "x")
    f.write_text('htttp = "x"\nsome_other = 1\n[proxy]\nodd = 2\n')
    with pytest.raises(ConfigError, match="htttp, proxy.odd, some_other"):
        load_file(f)
    for bad in ("trace_cap = true", 'trace_cap = "x"', "= ", "proxy = 3"):
        f.write_text(bad)
        with pytest.raises(ConfigError):
            load_file(f)


def test_precedence(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("trace_cap = 2\nmetric_cap = 3\nlog_cap = 4\n")
    c = resolve(f, {"TELELOOM_METRIC_CAP": "30", "TELELOOM_LOG_CAP": "40", "TELELOOM_DEBUG": "true"}, {"log_cap": 400, "debug": None})
    assert (c.trace_cap, c.metric_cap, c.log_cap, c.debug) == (2, 30, 400, True)
    with pytest.raises(ConfigError):
        resolve(None, {}, {"trace_cap": 0})
    with pytest.raises(ConfigError):
        resolve(None, {"TELELOOM_TRACE_CAP": "many"})
    assert Config(max_data_points=0).points == 1000 and log_level("WARN") == 30
    with pytest.raises(ConfigError):
        log_level("loud")


GRPC, HTTP = "0.0.0.0:4317", "0.0.0.0:4318"


@pytest.mark.parametrize("p", [
    Proxy("http://h:1"), Proxy("", "grpc"), Proxy("127.0.0.1:4317", "grpc"), Proxy("http://localhost:4318", "http"), Proxy("http://u:p@h:1", "http"), Proxy("h:1", "http"), Proxy("ftp://h:1", "grpc"), Proxy("h/1:2", "grpc"), Proxy("h:1", "udp"), Proxy("h", "grpc"),
    Proxy("h:1", "grpc", ProxyAuth("bearer")), Proxy("h:1", "grpc", ProxyAuth("bearer", "t", "u")), Proxy("h:1", "grpc", ProxyAuth("", "t")), Proxy("h:1", "grpc", ProxyAuth("odd")), Proxy("h:1", "grpc", ProxyAuth("headers")), Proxy(auth=ProxyAuth("bearer", "t")),
])
def test_bad_proxies(p):
    with pytest.raises(ConfigError):
        proxy.validate(p, GRPC, HTTP)


def test_good_proxies():
    for p in (Proxy(), Proxy("h:1", "grpc"), Proxy("https://h:1", "grpc", ProxyAuth("basic", username="a", password="b")), Proxy("http://h:1", "http", ProxyAuth("bearer", "t")), Proxy("http://h:1", "http", ProxyAuth("headers", headers={"a": "b"}))):
        proxy.validate(p, GRPC, HTTP)
    assert proxy.headers(ProxyAuth("basic", username="alice", password="secret")) == {"Authorization": "Basic YWxpY2U6c2VjcmV0"}
    assert proxy.endpoint("http://h:1") == ("h:1", True) and proxy.endpoint("https://h:1") == ("h:1", False) and proxy.endpoint("h:1") == ("h:1", True)
    assert proxy.redact("http://u:p@h:1/x") == "http://REDACTED:REDACTED@h:1/x" and proxy.redact("http://h:1") == "http://h:1"
    assert [proxy.normalize_host_port(a) for a in ("[::]:1", ":1", "0.0.0.0:1", "Host:2", "[fe80::1]:3")] == ["localhost:1"] * 3 + ["host:2", "[fe80::1]:3"]
    assert proxy.parse_headers(["a = b", "x", "=y", "c=d=e"]) == {"a": "b", "c": "d=e"}
    assert proxy.fan_out(Proxy()) == ["store"] and proxy.fan_out(Proxy("h:1", "grpc")) == ["store", "proxy-grpc"]


def test_hub_drops_when_full():
    h = Hub(queue=2, buffer=1)
    h.broadcast("traces", 0)
    assert not h.pending  # nobody listens
    c = h.subscribe()
    for i in range(3):
        h.broadcast("traces", i)
    h.dispatch()
    assert [m["data"] for m in h.take(c)] == [0] and h.dropped == 2 and h.take(c) == []
    h.unsubscribe(c)
    b = iter(backoff())
    assert [next(b) for _ in range(7)] == [1, 2, 4, 8, 16, 30, 30]
