"""A page that shows a graph. It is drawn by the reader's browser, so it is for graphs of types or small results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..model.errors import ConfigError

_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><svg id="g" width="900" height="900" font-size="11" font-family="sans-serif"></svg>
<script>
const nodes = {nodes}, edges = {edges}, at = {{}}, svg = document.getElementById("g");
const make = (tag, attributes, text) => {{ const e = document.createElementNS(svg.namespaceURI, tag); for (const k in attributes) e.setAttribute(k, attributes[k]); if (text) e.textContent = text; svg.append(e); }};
nodes.forEach((n, i) => at[n.id] = [450 + 380 * Math.cos(6.2832 * i / nodes.length), 450 + 380 * Math.sin(6.2832 * i / nodes.length)]);
for (const e of edges) {{ const a = at[e.from], b = at[e.to]; if (a && b) {{ make("line", {{x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: "#999"}}); make("text", {{x: (a[0] + b[0]) / 2, y: (a[1] + b[1]) / 2, fill: "#777"}}, e.label); }} }}
for (const n of nodes) {{ make("circle", {{cx: at[n.id][0], cy: at[n.id][1], r: 6}}); make("text", {{x: at[n.id][0] + 9, y: at[n.id][1]}}, n.label); }}
</script>"""


def graph_html(nodes: DataFrame, edges: DataFrame, title: str = "graph", most: int = 5_000) -> str:
    """A page of nodes (id, label) and edges (from, to, label); a placeholder where there are no nodes. More than ``most`` rows raise."""
    tables = []
    for df, columns in ((nodes, ("id", "label")), (edges, ("from", "to", "label"))):
        rows = [r.asDict() for r in df.select(*columns).limit(most + 1).collect()]
        if len(rows) > most:
            raise ConfigError(f"a page shows at most {most} nodes and edges")
        # a closing tag inside a label must not end the script
        tables.append(json.dumps(rows, ensure_ascii=False).replace("</", "<\\/"))
    if tables[0] == "[]":
        return "<!doctype html><p>Nothing to show: the graph has no nodes.</p>"
    return _PAGE.format(title=title, nodes=tables[0], edges=tables[1])
