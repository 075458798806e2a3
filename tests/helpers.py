"""Small inputs in the layout of the canonical tables."""

SPAN = "trace_id string, span_id string, parent_span_id string, name string, kind string, service_name string, start_ns bigint, end_ns bigint, duration_ns bigint, status_code string, status_message string, attributes map<string,string>, events array<struct<name:string,ts_ns:bigint,attributes:map<string,string>>>, resource map<string,string>, batch_seq bigint, arrival_seq bigint"
LOG = "ts_ns bigint, observed_ts_ns bigint, trace_id string, span_id string, severity_number int, severity_text string, body string, service_name string, attributes map<string,string>, resource map<string,string>, arrival_seq bigint"
POINT = "service_name string, metric_name string, instance_id string, description string, unit string, metric_type string, temporality string, is_monotonic boolean, ts_ns bigint, value double, count double, sum double, min double, max double, attributes map<string,string>, resource map<string,string>, received_at timestamp, batch_seq bigint, arrival_seq bigint"


def _names(schema):
    depth, names, word = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            names.append(word.strip().split()[0])
            word = ""
        else:
            word += c
    return names


def frame(spark, schema, rows):
    """Rows as dicts; columns that are left out are null. arrival_seq defaults to the position."""
    names = _names(schema)
    data = [tuple({"arrival_seq": i + 1, "batch_seq": 1, **r}.get(n) for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


MS = 10**6


def span(trace, sid, parent="", start=0, end=0, **more):
    return {"trace_id": trace, "span_id": sid, "parent_span_id": parent, "start_ns": start * MS, "end_ns": end * MS, "name": sid, "service_name": "svc", "status_code": "Unset", **more}


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
