"""Raw payload lines to one nested shape.

Exporters wrap a record (``candidate``, ``data.attributes``, a list of one, JSON inside a JSON string) and
write its lists as a list, a list of parts, an object by place number, an object of columns, ``items`` with a
total, a single object, bare names, or JSON text. ``normalise_payload`` undoes all of that for one line; the
result has one fixed schema, so everything after it is plain columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The lists of a record, the field that names an entry, and their fields.
LIST_FIELDS = {
    "career_history": ["title", "company", "industry", "company_size", "description", "duration_months", "start_date", "end_date", "is_current"],
    "education": ["degree", "field_of_study", "institution", "tier", "end_year"],
    "skills": ["name", "proficiency", "endorsements", "duration_months"],
}
NAMING_FIELD = {"career_history": "company", "education": "institution", "skills": "name"}
SIGNAL_FIELDS = ["github_activity_score", "notice_period_days", "preferred_work_mode", "willing_to_relocate", "last_active_date", "signup_date", "open_to_work_flag", "recruiter_response_rate", "interview_completion_rate", "applications_submitted_30d", "saved_by_recruiters_30d", "profile_completeness_score", "verified_email", "verified_phone"]

PAYLOAD_SCHEMA = (
    "struct<candidate_id:string,"
    + "".join(f"{k}:array<struct<{','.join(f'{x}:string' for x in v)}>>," for k, v in LIST_FIELDS.items())
    + f"redrob_signals:struct<skill_assessment_scores:array<struct<key:string,value:string>>,expected_salary_range_inr_lpa:struct<min:string,max:string>,{','.join(f'{x}:string' for x in SIGNAL_FIELDS)}>>"
)


def _opened(x: object) -> object:
    """JSON text inside JSON is opened, however deep."""
    while isinstance(x, str) and x.lstrip("﻿ \t\r\n")[:1] in ("{", "[", '"'):
        try:
            x = json.loads(x.lstrip("﻿"))
        except ValueError:
            return x
    return x


def _records(x: object) -> list[dict]:
    x = _opened(x)
    if isinstance(x, list):
        return [r for y in x for r in _records(y)]
    if not isinstance(x, dict):
        return []
    for wrap in ("candidate", "data", "attributes"):
        if isinstance(_opened(x.get(wrap)), (dict, list)) and not any(k in x for k in (*LIST_FIELDS, "redrob_signals")):
            return _records(x[wrap])
    return [x]


def _entry(x: object, name: str) -> dict | None:
    x = _opened(x) if not isinstance(x, str) or x[:1] == "{" else x
    if x is None or isinstance(x, dict):
        return x
    return {NAMING_FIELD[name]: x}


def _entries(x: object, name: str) -> list | None:
    x = _opened(x)
    if x is None:
        return None
    if isinstance(x, list):
        out: list = []
        for y in x:
            part = _opened(y) if isinstance(y, str) and y[:1] == "[" else y
            out += (_entries(part, name) or []) if isinstance(part, list) else [_entry(y, name)]
        return out
    if not isinstance(x, dict):
        return [_entry(x, name)]
    if "items" in x and "items" not in LIST_FIELDS[name]:
        return _entries(x["items"], name)
    if x and all(k.isdigit() for k in x):
        by_place = {int(k): v for k, v in x.items()}
        return [_entry(by_place.get(k), name) for k in range(max(by_place) + 1)] if max(by_place) < 10 * len(x) + 10 else [_entry(by_place[k], name) for k in sorted(by_place)]
    columns = {k: v for k, v in x.items() if isinstance(v, list)}
    if columns and set(columns) & set(LIST_FIELDS[name]):
        n = max(map(len, columns.values()))
        return [{k: v[i] if i < len(v) else None for k, v in columns.items()} for i in range(n)]
    return [x] if x else []


def _scalar(x: object) -> str | None:
    if x is None or isinstance(x, str):
        return x
    return json.dumps(x, ensure_ascii=False)


def _row(entry: dict | None, fields: list[str]) -> dict | None:
    return None if entry is None else {f: _scalar(entry.get(f)) for f in fields}


def normalise_payload(line: str | None) -> dict | None:
    """The record of one line in the fixed shape, or null where the line is no record."""
    if line is None:
        return None
    try:
        found = _records(json.loads(line.lstrip("﻿")))
    except (ValueError, RecursionError):
        return None
    if not found:
        return None
    out: dict = {"candidate_id": next((_scalar(r["candidate_id"]) for r in found if r.get("candidate_id") is not None), None)}
    for name, fields in LIST_FIELDS.items():
        parts = [_entries(r.get(name), name) for r in found]
        out[name] = None if all(p is None for p in parts) else [_row(e, fields) for p in parts if p for e in p]
    for r in found:
        signals = _opened(r.get("redrob_signals"))
        signals = signals[0] if isinstance(signals, list) and len(signals) == 1 else signals
        if not isinstance(signals, dict):
            continue
        scores = _opened(signals.get("skill_assessment_scores"))
        if isinstance(scores, dict):
            pairs = [{"key": k, "value": _scalar(v)} for k, v in scores.items()]
        elif isinstance(scores, list):
            pairs = [{"key": _scalar(s.get("name")), "value": _scalar(s.get("score"))} for s in scores if isinstance(s, dict)]
        else:
            pairs = None
        salary = _opened(signals.get("expected_salary_range_inr_lpa"))
        out["redrob_signals"] = _row(signals, SIGNAL_FIELDS) | {
            "skill_assessment_scores": pairs,
            "expected_salary_range_inr_lpa": _row(salary, ["min", "max"]) if isinstance(salary, dict) else None,
        }
        break
    return out


def payload_records(lines: DataFrame, key: str, payload: str) -> DataFrame:
    """``key`` and the columns of PAYLOAD_SCHEMA of every line that is a record; broken, null and empty lines give none.

    Lines go through Python once and come back as columns.
    """
    schema = T.StructType([lines.schema[key], *T.DataType.fromDDL(PAYLOAD_SCHEMA).fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                record = normalise_payload(line)
                if record is not None:
                    keys.append(k)
                    found.append(record)
            yield pa.RecordBatch.from_arrays([pa.array(keys, kinds.field(0).type), *(pa.array([r.get(f.name) for r in found], f.type) for f in list(kinds)[1:])], schema=kinds)

    return lines.select(key, payload).mapInArrow(run, schema)
