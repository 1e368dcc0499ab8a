"""A tool server over stdio: JSON-RPC 2.0, one message a line, two tools that only read.

`validation_plan` {"source": {"type": "files", "files": [...]} | {"type": "changed"} | {"type": "git_diff", "base": ...}}
`explain_impact` {"changed_file", "affected_file", "context": {"type": "current" | "changed" | "git_diff", "base"?}}

Questions are answered one after the other. A question that cannot be answered is a tool result
marked as an error; a malformed message is a protocol error."""

from __future__ import annotations

import json
import os
import sys
from typing import BinaryIO

from rippleframe.errors import AnalysisError, UsageError
from rippleframe.selection import Application, Selection

LINE_LIMIT = 16 * 1024 * 1024  # fixed value: bytes of a message
PROTOCOL = "2025-06-18"
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603  # fixed values of JSON-RPC
ABOUT = "Ask `validation_plan` after Python edits and run all steps that it returns; ask again after further edits. `explain_impact` tells why a file is affected. Nothing is run and no file of the repository is changed."


def _variant(*kinds: tuple[str, dict]) -> dict:
    forms = [{"type": "object", "properties": {"type": {"const": kind}, **fields}, "required": ["type", *fields], "additionalProperties": False} for kind, fields in kinds]
    return {"oneOf": forms}


_TEXT = {"type": "string", "minLength": 1}
_GIT = (("changed", {}), ("git_diff", {"base": _TEXT}))
INPUTS = {
    "validation_plan": {"source": _variant(("files", {"files": {"type": "array", "items": _TEXT, "minItems": 1}}), *_GIT)},
    "explain_impact": {"changed_file": _TEXT, "affected_file": _TEXT, "context": _variant(("current", {}), *_GIT)},
}
TELLS = {"validation_plan": "The impact and the test plan of one change source.", "explain_impact": "One shortest dependency path from an affected file down to a changed one, with evidence."}


class ProtocolError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _fits(value, schema: dict) -> bool:
    """Whether a value fits the few schema words that INPUTS use."""
    if "oneOf" in schema:
        return any(_fits(value, s) for s in schema["oneOf"])
    if "const" in schema:
        return value == schema["const"]
    if schema["type"] == "string":
        return isinstance(value, str) and len(value.strip()) >= schema.get("minLength", 0)
    if schema["type"] == "array":
        return isinstance(value, list) and len(value) >= schema.get("minItems", 0) and all(_fits(v, schema["items"]) for v in value)
    known = schema["properties"]
    return isinstance(value, dict) and set(schema["required"]) <= set(value) <= set(known) and all(_fits(v, known[k]) for k, v in value.items())


def _object(fields: dict) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def tools() -> list[dict]:
    mark = {"readOnlyHint": True, "destructiveHint": False, "openWorldHint": False}
    return [{"name": n, "description": TELLS[n], "inputSchema": _object(fields), "annotations": mark} for n, fields in INPUTS.items()]


def _selection(choice: dict) -> Selection:
    return {"files": lambda: Selection(tuple(choice["files"])), "current": Selection, "changed": lambda: Selection(base="HEAD"), "git_diff": lambda: Selection(base=choice["base"])}[choice["type"]]()


class Server:
    def __init__(self, app: Application):
        self.app = app

    def call(self, name: str, given: dict) -> dict:
        if name not in INPUTS:
            raise ProtocolError(NO_METHOD, f"unknown tool: {name}")
        if not _fits(given, _object(INPUTS[name])):
            raise ProtocolError(INVALID_PARAMS, f"invalid arguments of {name}")
        try:
            if name == "validation_plan":
                found = self.app.plan(_selection(given["source"]))
            else:
                found = self.app.explain(given["changed_file"], given["affected_file"], _selection(given["context"]))
        except AnalysisError as e:
            return {"isError": True, "content": [{"type": "text", "text": str(e)}]}
        return {"isError": False, "structuredContent": found, "content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}]}

    def answer(self, message) -> dict | None:
        """The reply to one parsed message; None for a notification."""
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return _error(None, INVALID_REQUEST, "Invalid request")
        number, method, given = message.get("id"), message["method"], message.get("params") or {}
        if "id" not in message:
            return None
        try:
            if method == "initialize":
                result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "rippleframe", "version": "1"}, "instructions": ABOUT}
            elif method == "ping":
                result = {}
            elif method == "tools/list":
                result = {"tools": tools()}
            elif method == "tools/call":
                result = self.call(given.get("name"), given.get("arguments") or {})
            else:
                raise ProtocolError(NO_METHOD, f"unknown method: {method}")
        except ProtocolError as e:
            return _error(number, e.code, str(e))
        except Exception as e:  # the server stays up; the cause goes to the log
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
            return _error(number, INTERNAL, "the analysis failed unexpectedly")
        return {"jsonrpc": "2.0", "id": number, "result": result}

    def run(self, source: BinaryIO, sink: BinaryIO) -> None:
        while line := source.readline(LINE_LIMIT + 1):
            if len(line) > LINE_LIMIT:
                while line and not line.endswith(b"\n"):
                    line = source.readline(LINE_LIMIT)
                reply = _error(None, PARSE_ERROR, "the message is too long")
            elif not line.strip():
                continue
            else:
                try:
                    reply = self.answer(json.loads(line))
                except ValueError:
                    reply = _error(None, PARSE_ERROR, "Parse error")
            if reply is not None:
                sink.write(json.dumps(reply, ensure_ascii=False).encode() + b"\n")
                sink.flush()


def _error(number, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


def serve(spark, root: str, index: str | None = None) -> None:
    if not os.path.isabs(root):
        raise UsageError("the server takes an absolute root")
    Server(Application(spark, root, index)).run(sys.stdin.buffer, sys.stdout.buffer)
