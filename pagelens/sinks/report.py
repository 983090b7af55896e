"""Reports: canonical JSON, strict reading back, display order, chain cells and a self-contained HTML page."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shapes import shape
from ..operators.ledger import STAGES

SCHEMA_VERSION = "1"
# Keys that differ between two runs over the same observations; patterns of outside references; size of a page.
VOLATILE_KEYS = ("scanned_at", "duration_s", "resolved_ips", "probed_at", "fetched_at", "from_cache", "cache_hits", "requests_made", "http_requests")
OUTSIDE = (r"""<link[^>]+rel=["']?stylesheet""", r"<script[^>]+\bsrc=", r"""<img[^>]+\bsrc=["']?https?:""", r"@import", r"""url\(\s*["']?https?:""")
MOST_BYTES = 2_000_000
RANK = {"fail": 3, "unknown": 2, "pass": 1, "na": 0}
GLYPH = {"pass": "✓", "fail": "✕", "unknown": "?", "na": "–"}

REPORT = shape(
    "struct<schema_version:string,domain:string,scanned_at:string,duration_s:double,headline:string,verdict_kind:string,"
    "counts:struct<n_positions:long,n_pass:long,n_fail:long,n_unknown:long,n_na:long>,"
    "positions:array<struct<position_id:string,stage:string,url:string,status:string,reason:string,detail:string>>,"
    "findings:array<struct<finding_id:string,kind:string,severity:long,occurrences:long,url:string,found_on:string,root_cause_id:string,counted:boolean,confidence:string>>,"
    "root_causes:array<struct<cause_id:string,defect:string,n_targets:long,n_instances:long,severity:long,summary:string>>>"
)


class ReportMismatch(ValueError):
    """A text that is no report of this version."""


def assert_counts(counts: dict, positions: list) -> None:
    """pass, fail, unknown and not applicable add up to all positions, and there are as many as counted."""
    total = sum(counts[f"n_{k}"] for k in RANK)
    if total != counts["n_positions"] or total != len(positions):
        raise AssertionError(f"{total} positions by state, {counts['n_positions']} counted, {len(positions)} listed")


def counts_hold(counts: DataFrame) -> DataFrame:
    """Of counts (n_positions and one column a state) the rows that do not add up; empty if all do."""
    return counts.filter(sum(F.col(f"n_{k}") for k in RANK) != F.col("n_positions"))


def report_json(reports: DataFrame) -> DataFrame:
    """(domain, json) of rows in the shape of REPORT: compact, keys in the order of the alphabet at each depth, nulls kept."""

    def sorted_struct(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[sorted_struct(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: sorted_struct(x, kind.elementType))
        return c

    whole = F.struct(*[sorted_struct(F.col(f.name), f.dataType).alias(f.name) for f in sorted(REPORT.fields, key=lambda f: f.name)])
    return reports.select("domain", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def canonical(text: str) -> str:
    """A JSON text with sorted keys, two spaces and a last newline."""
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def strip_volatile(x):
    """A decoded report without the keys that differ between runs, at any depth."""
    if isinstance(x, dict):
        return {k: strip_volatile(v) for k, v in x.items() if k not in VOLATILE_KEYS}
    return [strip_volatile(v) for v in x] if isinstance(x, list) else x


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON text a line. Refuses to overwrite."""
    report_json(reports).select(F.col("json").alias("value")).write.mode("errorifexists").text(path)


_KINDS = {T.StringType: str, T.LongType: int, T.DoubleType: (int, float), T.BooleanType: bool}


def _check(kind: T.DataType, value, at: str) -> None:
    if value is None:
        return
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise ReportMismatch(f"{at}: an object is wanted")
        if extra := sorted(set(value) - set(kind.names)):
            raise ReportMismatch(f"{at}: unknown fields {extra}")
        if missing := sorted(set(kind.names) - set(value)):
            raise ReportMismatch(f"{at}: missing fields {missing}")
        for f in kind.fields:
            _check(f.dataType, value[f.name], f"{at}.{f.name}")
    elif isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ReportMismatch(f"{at}: a list is wanted")
        for i, v in enumerate(value):
            _check(kind.elementType, v, f"{at}[{i}]")
    elif not isinstance(value, _KINDS[type(kind)]) or (isinstance(value, bool) and not isinstance(kind, T.BooleanType)):
        raise ReportMismatch(f"{at}: {type(value).__name__} is no {kind.simpleString()}")


def parse_report(text: str) -> dict:
    """A report from its JSON text, checked field by field; anything unknown, missing or of another kind is an error."""
    try:
        value = json.loads(text)
    except ValueError as e:
        raise ReportMismatch(f"no JSON: {e}") from e
    if not isinstance(value, dict) or value.get("schema_version") != SCHEMA_VERSION:
        raise ReportMismatch(f"schema_version {value.get('schema_version') if isinstance(value, dict) else None!r}, wanted {SCHEMA_VERSION!r}")
    _check(REPORT, value, "$")
    return value


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a folder of JSON lines, strictly: a broken line or another version fails the job; keys that REPORT lacks are an error too."""
    raw = spark.read.text(path)
    known = F.array(*[F.lit(n) for n in REPORT.names])
    checked = raw.withColumn("_extra", F.array_except(F.json_object_keys("value"), known)).withColumn("_bad", F.size("_extra") != 0)
    good = checked.withColumn("value", F.when(F.coalesce("_bad", F.lit(True)), F.raise_error(F.concat(F.lit("no report of this version: "), F.substring("value", 1, 80)))).otherwise(F.col("value")))
    r = good.select(F.from_json("value", REPORT, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    version = F.when(F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True)), F.raise_error(F.lit("another schema_version"))).otherwise(F.col("schema_version"))
    return r.withColumn("schema_version", version)


def display_order(findings: DataFrame, causes: DataFrame) -> DataFrame:
    """Findings in the order of a report: (site, group_rank, cause_id, finding_id, rank). Groups by severity, instances and id, orphans last; inside by severity, occurrences and id."""
    f = findings.join(causes.select("site", F.col("cause_id").alias("root_cause_id"), F.col("severity").alias("_s"), F.col("n_instances").alias("_n"), F.lit(True).alias("_c")), ["site", "root_cause_id"], "left")
    group = F.struct(F.col("_c").isNull().alias("orphan"), (-F.coalesce("_s", F.lit(0))).alias("s"), (-F.coalesce("_n", F.lit(0))).alias("n"), F.when(F.col("_c"), F.col("root_cause_id")).alias("cause_id"))
    g = f.groupBy("site", group.alias("g")).agg(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), (-F.col("occurrences")).alias("n"), "finding_id"))).alias("members"))
    g = g.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("g", "members"))).alias("groups")).select("site", F.posexplode("groups").alias("group_rank", "x"))
    return g.select("site", "group_rank", F.col("x.g.cause_id").alias("cause_id"), F.posexplode("x.members").alias("rank", "m")).select("site", "group_rank", "cause_id", "m.finding_id", "rank")


def chain_cells(sites: DataFrame, positions: DataFrame) -> DataFrame:
    """Six cells a site, also empty ones: (site, stage, ord, n_positions and counts by state, status). A cell is fail over unknown over pass over na."""
    cells = sites.select("site", F.posexplode(F.array(*map(F.lit, STAGES))).alias("ord", "stage"))
    n = positions.groupBy("site", "stage").agg(F.count(F.lit(1)).alias("n_positions"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in RANK])
    j = cells.join(n, ["site", "stage"], "left").na.fill(0)
    return j.withColumn("status", F.when(F.col("n_fail") > 0, "fail").when(F.col("n_unknown") > 0, "unknown").when(F.col("n_pass") > 0, "pass").otherwise("na"))


def cell_detail(counts: dict) -> str:
    """What stands in a cell: counts of each state that occurs, or that there is nothing."""
    parts = [f"{GLYPH[s]} {counts[f'n_{s}']} {s}" for s in ("pass", "fail", "unknown", "na") if counts.get(f"n_{s}")]
    return " · ".join(parts) or "nothing to look at"


def chain_svg(cells: list[dict]) -> str:
    """The six cells as an inline drawing; states differ in shape and stroke, not only in colour."""
    shapes = {
        "pass": '<circle r="15" stroke-width="1"/>',
        "fail": '<polygon points="-6,-15 6,-15 15,-6 15,6 6,15 -6,15 -15,6 -15,-6" stroke-width="3"/>',
        "unknown": '<polygon points="0,-17 17,0 0,17 -17,0" stroke-width="2" stroke-dasharray="4 3"/>',
        "na": '<rect x="-13" y="-13" width="26" height="26" stroke-width="1" stroke-dasharray="1 3"/>',
    }
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" class="chain" role="img" viewBox="0 0 {len(cells) * 178} 98">']
    for k, c in enumerate(cells):
        text = [f'<text y="{y}" text-anchor="middle">{html.escape(t)}</text>' for y, t in ((5, GLYPH[c["status"]]), (32, c["stage"]), (47, f"{c['n_positions']} positions"), (62, cell_detail(c)))]
        out.append(f'<g class="{c["status"]}" data-stage="{c["stage"]}" transform="translate({k * 178 + 78},26)">{shapes[c["status"]]}{"".join(text)}</g>')
    return "".join([*out, "</svg>"])


def defang(text: str) -> str:
    """Quoted text that only looks like an outside reference, written so that nothing reads it as one."""
    text = re.sub(r"""(?i)url\((?=\s*["']?https?:)""", "url&#40;", text)
    return re.sub("(?i)@import", "&#64;import", text)


def assert_self_contained(page: str) -> None:
    for p in OUTSIDE:
        if m := re.search(p, page, re.I):
            raise AssertionError(f"the page refers to the outside: {m[0][:80]!r}")
    if len(page.encode()) >= MOST_BYTES:
        raise AssertionError("the page is too large")


def render_html(report: dict, cells: list[dict]) -> str:
    """One report (parse_report) as a page of its own; all that comes from a site is escaped. The gates run before it is returned."""
    assert_counts(report["counts"], report["positions"])
    if sum(c["n_positions"] for c in cells) != report["counts"]["n_positions"]:
        raise AssertionError("the cells do not add up to the positions")
    e = lambda x: html.escape("" if x is None else str(x))
    link = lambda u: f'<a href="{e(u)}">{e(u)}</a>' if str(u or "").startswith(("http://", "https://")) else e(u)
    table = lambda head, rows: f"<table><tr>{''.join(f'<th>{e(h)}</th>' for h in head)}</tr>{''.join('<tr>' + ''.join(f'<td>{c}</td>' for c in r) + '</tr>' for r in rows)}</table>"
    order = {c["cause_id"]: k for k, c in enumerate(report["root_causes"] or [])}
    found = sorted(report["findings"] or [], key=lambda f: (order.get(f["root_cause_id"], len(order)), -(f["severity"] or 0), -(f["occurrences"] or 0), f["finding_id"]))
    unknown = [p for p in report["positions"] if p["status"] == "unknown"]
    body = [
        f"<h1>{e(report['domain'])}</h1><p class='headline'>{e(report['headline'])}</p>", chain_svg(cells),
        "<h2>Causes</h2>" + table(("cause", "targets", "links"), [(e(c["summary"]), e(c["n_targets"]), e(c["n_instances"])) for c in report["root_causes"] or []]),
        "<h2>Findings</h2>" + table(("id", "target", "found on", "links"), [(e(f["finding_id"]), link(f["url"]), link(f["found_on"]), e(f["occurrences"])) for f in found]),
        "<h2>Not seen</h2>" + table(("position", "reason"), [(e(p["position_id"]), e(p["reason"])) for p in unknown]),
        "<h2>All positions</h2>" + table(("position", "state", "detail"), [(e(p["position_id"]), e(p["status"]), e(p["detail"])) for p in report["positions"]]),
    ]
    page = defang(f"<!doctype html><html><head><meta charset='utf-8'><title>{e(report['domain'])}</title><style>body{{font-family:sans-serif}}td,th{{text-align:left}}.chain{{fill:none;stroke:currentColor}}</style></head><body>{''.join(body)}</body></html>")
    assert_self_contained(page)
    return page
