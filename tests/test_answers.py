"""Recorded overviews of any shape."""

import json

from answerlens.sources.answers import scan_answers_serp


def nested(levels, level=0):
    node = {"title": f"t{level}", "text": f" x{level} ", "references": [{"url": f"https://e.example/{level}", "source": "src"}, {"url": ""}]}
    if level < levels:
        node["items"] = [nested(levels, level + 1), {"text": f"after {level}"}, None]
    return node


def walk(node):
    if node:
        yield from (s for s in (node.get("title", "").strip(), node.get("text", "").strip()) if s)
        for child in node.get("items", []):
            yield from walk(child)


def test_overview_of_twenty_levels_in_document_order(spark):
    root = {"type": "ai_overview", **nested(20)}
    flat = {"type": "ai_overview", "text": 'br[ack}et "quoted\\" {[', "items": [{"text": str(k)} for k in range(12)]}
    pages = {"deep": [{"type": "organic"}, root], "flat": [flat, root], "none": [{"type": "organic"}], "empty": []}
    rows = [(k, json.dumps({"tasks": [{"status_code": 20000, "result": [{"items": items}]}]})) for k, items in pages.items()] + [("bad", "{"), ("null", None)]
    got = {r["k"]: r for r in scan_answers_serp(spark.createDataFrame(rows, "k string, payload string")).collect()}
    assert got["deep"]["answer"].split("\n") == list(walk(root))
    assert [(u["url"], u["title"]) for u in got["deep"]["urls"]] == [(f"https://e.example/{n}", "src") for n in range(21)]
    assert got["flat"]["answer"].split("\n") == list(walk(flat))
    assert {k: r["has_overview"] for k, r in got.items()} == {"deep": True, "flat": True, "none": False, "empty": False, "bad": False, "null": False}
    assert all(got[k]["answer"] == "" and got[k]["urls"] == [] for k in ("none", "empty", "bad", "null"))
