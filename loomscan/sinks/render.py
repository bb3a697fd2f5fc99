"""Small results as text: plain, XML, Python, Prometheus, CSV, JSON and documentation pages."""

from __future__ import annotations

import csv
import io
import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame


def _show(x) -> str:
    return "None" if x is None else f"{x:.8g}" if isinstance(x, float) else str(x)


def text(tree: dict) -> str:
    """Aligned details, changes in brackets, and a bar of one | a percent for each part of a distribution."""
    out: list[str] = []
    for ns, fields in tree["aggregated-data"].items():
        for name, data in fields.items():
            change = data.get("__diff__", {})
            out.append(f"{tree['info']['path']}:: info: Overall metrics for '{ns}:{name}' metric")
            for title, key in (("Average", "avg"), ("Minimum", "min"), ("Maximum", "max"), ("Total", "total")):
                more = f" [{change[key]:+g}]" if change.get(key) is not None else ""
                out.append(f"\t{title:<15}: {_show(data[key])}{more}")
            zero = " (excluding zero metric values)" if data["nonzero"] else ""
            out.append(f"\tDistribution   : {data['count']} [{change['count']:+d}] regions/files in total{zero}" if "count" in change else f"\tDistribution   : {data['count']} regions/files in total{zero}")
            if data["sup"]:
                out.append(f"\tSuppressed     : {data['sup']}")
            out.append("\t  Metric value : Ratio : R-sum : Number of regions/files")
            total = 0.0
            for bar in data["distribution-bars"]:
                total += bar["ratio"]
                more = f" [{bar['__diff__']:+d}]" if "__diff__" in bar else ""
                out.append(f"\t{bar['metric']:>14} : {bar['ratio']:.3f} : {total:.3f} : {bar['count']}{more}\t{'|' * int(bar['ratio'] * 100)}")
            out.append("")
    for region in tree["file-data"].get("regions", []):
        out += _region_text(region, tree["info"]["path"], 0)
    if tree["subdirs"] or tree["subfiles"]:
        out.append(f"{tree['info']['path']}:: info: Directory content")
        out += [f"\tDirectory      : {d}" for d in tree["subdirs"]] + [f"\tFile           : {f}" for f in tree["subfiles"]]
    return "\n".join(out) + "\n"


def _region_text(region: dict, path: str, depth: int) -> list[str]:
    info = region["info"]
    out = [f"{path}:{info['cursor']}: info: {'. ' * depth}Metrics per '{info['name']}' region ({info['type']}, lines {info['line_begin']}-{info['line_end']})"]
    out += [f"\t{'. ' * depth}{ns}:{k} : {_show(v)}" for ns, fs in region["data"].items() for k, v in fs.items()]
    return out + [x for r in region["subregions"] for x in _region_text(r, path, depth + 1)]


def xml(tree: dict, tag: str = "data") -> str:
    """Sorted keys; plain values are attributes (floats to 8 places), dicts and lists are children; a list's items are
    named by its name without the last letter."""

    def node(x: dict, name: str, pad: str) -> str:
        def value(v) -> str:
            return str(round(v, 8)) if isinstance(v, float) else "" if v is None else str(v)

        attrs = "".join(f" {k}={quoteattr(value(v))}" for k, v in sorted(x.items()) if not isinstance(v, (dict, list)))
        inside = ""
        for k, v in sorted(x.items()):
            if isinstance(v, dict):
                inside += node(v, k, pad + "    ")
            elif isinstance(v, list):
                items = "".join(node(i, k[:-1], pad + "        ") if isinstance(i, dict) else f"{pad}        <{k[:-1]}>{escape(str(i))}</{k[:-1]}>\n" for i in v)
                inside += f"{pad}    <{k}>\n{items}{pad}    </{k}>\n" if v else f"{pad}    <{k} />\n"
        name = name.replace(":", ".")
        return f"{pad}<{name}{attrs}>\n{inside}{pad}</{name}>\n" if inside else f"{pad}<{name}{attrs} />\n"

    return node(tree, tag, "")


def python(tree: dict) -> str:
    return repr(tree) + "\n"


def _flat_regions(regions: list[dict]) -> list[dict]:
    return [x for r in regions for x in (r, *_flat_regions(r["subregions"]))]


def prometheus(tree: dict) -> str:
    """A line a value: metric {file="...", region="..."} value; . and : in names become _, missing values are left out."""

    def line(name: str, labels: dict, value) -> str:
        said = ", ".join(f'{k}="{v}"' for k, v in labels.items())
        return f"{name.replace('.', '_').replace(':', '_').lstrip('_')} {{{said}}} {value}\n"

    out, path = "", tree["info"]["path"]
    for ns, fields in tree["aggregated-data"].items():
        for name, data in fields.items():
            out += "".join(line(f"{ns}:{name}:{k}", {"file": path}, data[k]) for k in ("avg", "min", "max", "total") if data[k] is not None)
    for r in _flat_regions(tree["file-data"].get("regions", [])):
        out += "".join(line(f"{ns}:{k}", {"file": path, "region": r["info"]["name"]}, v) for ns, fs in r["data"].items() for k, v in fs.items() if v is not None)
    return out


FORMATS = {"txt": text, "xml": xml, "python": python, "prometheus": prometheus}


def table_csv(df: DataFrame) -> str:
    """A header and the rows of a small table; large ones go to df.write.csv."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    for row in df.toLocalIterator():
        w.writerow(["" if x is None else x for x in row])
    return out.getvalue()


def warnings_text(rows: list) -> str:
    """Warnings as a compiler would write them."""
    out = ""
    for r in rows:
        out += f"{r['path']}:{r['cursor'] or ''}: warning: Metric '{r['metric']}' {'for region ' + repr(r['region']) + ' ' if r['region'] else ''}exceeds the limit.\n"
        out += f"\tMetric name    : {r['metric']}\n\tRegion name    : {r['region']}\n\tMetric value   : {_show(r['value'])}\n\tModified       : {r['modified']}\n\tChange trend   : {'None' if r['trend'] is None else f'{r['trend']:+g}'}\n\tLimit          : {r['limit']}\n\n"
    return out


def report_text(overview: list, warnings: list, form: str = "txt") -> str:
    """A report: files with their metrics, and the warnings of each; txt, json or doxygen."""
    by_file: dict[str, list] = {}
    for w in warnings:
        by_file.setdefault(w["path"], []).append(w.asDict())
    if form == "json":
        return json.dumps([o.asDict() | {"warnings": by_file.get(o["path"], [])} for o in overview], indent=1, sort_keys=True) + "\n"
    names = [c for c in (overview[0].asDict() if overview else {})]
    if form == "doxygen":
        out = "/*! \\page metrics Metrics overview\n<table>\n<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>\n"
        out += "".join("<tr>" + "".join(f"<td>{escape(str(o[n]))}</td>" for n in names) + "</tr>\n" for o in overview)
        out += "</table>\n"
        for path, ws in sorted(by_file.items()):
            out += f"\\section {path}\n" + "".join(f"\\li {w['region'] or 'file'}: {w['metric']} is {_show(w['value'])}, the limit is {w['limit']}\n" for w in ws)
        return out + "*/\n"
    width = {n: max([len(n), *(len(str(o[n])) for o in overview)]) for n in names}
    out = "  ".join(n.ljust(width[n]) for n in names) + "\n"
    out += "".join("  ".join(str(o[n]).ljust(width[n]) for n in names) + "\n" for o in overview)
    return out + "\n" + warnings_text(warnings)


def dump_html(source: str, regions: list, title: str) -> str:
    """A source with its regions as nested spans."""
    cuts = sorted([(r.begin, 1, -r.end, f'<span title="{escape(r.type)} {escape(r.name)}">') for r in regions] + [(r.end, 0, -r.begin, "</span>") for r in regions])
    out, at = "", 0
    for pos, _, _, tag in cuts:
        out += escape(source[at:pos]) + tag
        at = pos
    return f"<html><head><title>{escape(title)}</title></head><body><pre>{out}{escape(source[at:])}</pre></body></html>\n"
