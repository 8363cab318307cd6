"""Questions answered one at a time over a loaded index: a health check and a chat, as functions and over HTTP."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame

from quarrymill.config import SETTINGS
from quarrymill.operators import external
from quarrymill.plans import jobs
from quarrymill.runtime import stored

log = logging.getLogger(__name__)


class Service:
    """Answers from one index, which is read once; requests give (HTTP status, body)."""

    def __init__(self, index: DataFrame, k: int = SETTINGS.top_k, embed: Callable[[Column], Column] = external.embed, generate: Callable[[Column], Column] = external.complete, question_length: tuple[int, int] = SETTINGS.question_length):
        self.index, self.k, self.embed, self.generate, self.length = stored(index, "index"), k, embed, generate, question_length

    def health(self) -> tuple[int, dict]:
        return 200, {"status": "ok"}

    def chat(self, question: object) -> tuple[int, dict]:
        """The answer and all its sources; 422 for a question of a length that is not allowed, 502 if a stage fails."""
        if not isinstance(question, str) or not self.length[0] <= len(question) <= self.length[1]:
            return 422, {"detail": f"a question has {self.length[0]} to {self.length[1]} characters"}
        try:
            asked = self.index.sparkSession.createDataFrame([(0, question)], "question_id int, text string")
            answers, citations = jobs.answer_job(asked, self.index, self.k, self.embed, self.generate)
            sources = [r.asDict() for r in citations.drop("question_id").orderBy("number").collect()]  # at most k rows
            return 200, {"answer": answers.first()["answer"], "citations": sources}
        except Exception:
            log.exception("no answer")
            return 502, {"detail": "the question could not be answered"}


def serve(service: Service, port: int) -> None:
    """GET /health and POST /chat with a JSON object that has ``question``, until interrupted."""
    handler_of(service, port).serve_forever()


def handler_of(service: Service, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._send(*(service.health() if self.path == "/health" else (404, {"detail": "not found"})))

        def do_POST(self) -> None:
            if self.path != "/chat":
                return self._send(404, {"detail": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            except ValueError:
                body = None
            return self._send(*service.chat(body.get("question") if isinstance(body, dict) else None))

        def log_message(self, *args: object) -> None:
            log.info(*args)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
