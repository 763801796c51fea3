"""Results as plain text, for people and agents."""

from __future__ import annotations

import os

from ..operators.evaluate import METRICS

RULE = "=" * 40


def hits(rows: list[dict]) -> str:
    if not rows:
        return "No results found."
    one = lambda i, r: f"[{i}] File: {r['file_path']} (chars {r['start_offset']}-{r['end_offset']}) [Score: {r['score']:.4f}]\nContent:\n{r['text'].strip()}\n{RULE}"
    return "\n\n".join(one(i, r) for i, r in enumerate(rows, 1))


def lineage(file_path: str, chunks: list[dict]) -> str:
    if not chunks:
        return f"No lineage found for file: {file_path}"
    head = f"Lineage for {file_path}:\nTotal Chunks: {len(chunks)}\n"
    return "\n".join([head, *(f"Chunk {i}: ID={c['chunk_id']}, Range={c['start_offset']}-{c['end_offset']}\nSnippet: {c['snippet']}...\n" for i, c in enumerate(chunks, 1))])


def neighbourhood(node: dict | None) -> str:
    """node: name, type, confidence, source_file, aliases, neighbors (direction, predicate, neighbour, confidence)."""
    if not node:
        return "No matching entity found in the graph."
    lines = [f"Entity: {node['name']} ({node['type']}) [confidence {node['confidence']:.2f}]", f"Source: {node.get('source_file') or '?'}"]
    if node.get("aliases"):
        lines.append("Aliases: " + ", ".join(node["aliases"]))
    edges = node["neighbors"]
    lines.append(f"Relations ({len(edges)}):" if edges else "(no relations)")
    for e in edges:
        arrow = "->" if e["direction"] == "out" else "<-"
        lines.append(f"  {arrow} {e['predicate']} {arrow} {e['neighbour']} [{e['confidence']:.2f}]")
    return "\n".join(lines)


def concepts(rows: list[dict], prefix: str | None = None) -> str:
    if not rows:
        return "No concepts found" + (f" matching '{prefix}'" if prefix else "") + "."
    tail = lambda r: f"  -> {r['predicate']} {r['related']}" if r["predicate"] else ""
    return "\n".join([f"Concepts ({len(rows)} found):", *(f"  {r['name']} [{r['type']}, conf={r['confidence']:.2f}]{tail(r)}" for r in rows)])


def metrics(means: dict[str, float], k: int, cases: list[dict] | None = None) -> str:
    lines = [f"Retrieval evaluation: {int(means.get('cases', 0))} case(s), k={k}", *(f"  {m:<12}{means.get(m, 0.0):.4f}" for m in METRICS)]
    for c in cases or []:
        lines.append(f"  [{'OK' if c['hit'] else 'MISS'}] rr={c['mrr']:.3f} q={c['query']!r} -> {os.path.basename(c.get('top') or '(none)')}")
    return "\n".join(lines)
