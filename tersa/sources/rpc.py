"""JSON-RPC 2.0 by lines, for an agent that talks to the pipeline over standard input and output.

    python -m tersa.sources.rpc [--store PATH] [--target-tokens N] [--salt TEXT]

Three tools: compress a text, retrieve an original, and the session's totals. As in the interface it follows,
the target applies to conversations and not to single texts.
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

# Protocol version and error codes of the interface.
PROTOCOL, NO_METHOD, NO_TOOL = "2024-11-05", -32601, -32602


def _tool(name: str, says: str, required: list[str], **fields: str) -> dict[str, Any]:
    properties = {k: {"type": "string", "description": v} for k, v in fields.items()}
    schema: dict[str, Any] = {"type": "object", "properties": properties}
    return {"name": name, "description": says, "inputSchema": schema | ({"required": required} if required else {})}


TOOLS = [
    _tool("compress", "Shortens a text; originals stay in the store.", ["text"], text="The text", query="What matters in it"),
    _tool("retrieve", "The original behind a reference.", ["ref"], ref="24 hex digits from a marker"),
    _tool("stats", "Tokens saved in this session.", []),
]


class Server:
    def __init__(self, pipeline):
        self.pipeline = pipeline

    def call(self, name: str, given: dict[str, Any]) -> str:
        if name == "compress":
            return self.pipeline.compress_blob(str(given.get("text", "")), str(given.get("query", "")))
        if name == "retrieve":
            ref = str(given.get("ref", ""))
            found = self.pipeline.retrieve_one(ref)
            return found if found is not None else f"no content for ref {ref!r} (expired, evicted, or invalid)"
        return self.pipeline.stats()

    def answer(self, method: str, params: dict[str, Any]) -> tuple[str, Any]:
        """("result", value) or ("error", value)."""
        if method == "initialize":
            return "result", {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tersa", "version": "0.1.0"}}
        if method == "ping":
            return "result", {}
        if method == "tools/list":
            return "result", {"tools": TOOLS}
        if method != "tools/call":
            return "error", {"code": NO_METHOD, "message": f"method not found: {method}"}
        name = params.get("name")
        if name not in {t["name"] for t in TOOLS}:
            return "error", {"code": NO_TOOL, "message": f"unknown tool: {name}"}
        try:
            return "result", {"content": [{"type": "text", "text": self.call(name, params.get("arguments") or {})}]}
        except Exception as failure:  # the session outlives a failed call
            return "result", {"content": [{"type": "text", "text": f"error: {failure}"}], "isError": True}

    def handle(self, message: Any) -> dict[str, Any] | None:
        """The response to one message; None to a notification, and to what is no object."""
        if not isinstance(message, dict):
            return None
        method, number = message.get("method", ""), message.get("id")
        if method in ("notifications/initialized", "notifications/cancelled"):
            return None
        kind, value = self.answer(method, message.get("params") or {})
        return None if kind == "error" and number is None and value["code"] == NO_METHOD else {"jsonrpc": "2.0", "id": number, kind: value}


def serve(server: Server, lines, out) -> None:
    """Blank and malformed lines are skipped."""
    for line in lines:
        try:
            message = json.loads(line) if line.strip() else None
        except ValueError:
            continue
        response = server.handle(message)
        if response is not None:
            out.write(json.dumps(response) + "\n")
            out.flush()


def main() -> None:
    from pyspark.sql import SparkSession

    from tersa.config import Config
    from tersa.pipeline import Pipeline

    parser = argparse.ArgumentParser()
    parser.add_argument("--store")
    parser.add_argument("--target-tokens", type=int, default=Config.target_tokens)
    parser.add_argument("--salt", default="")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("tersa").getOrCreate()
    serve(Server(Pipeline(spark, Config(target_tokens=args.target_tokens, salt=args.salt), args.store)), sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
