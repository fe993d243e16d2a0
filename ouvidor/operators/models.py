"""Single calls of a text model: triage with the error fed back, risk, cluster labels; clients, limits on failing services.

A model is a function of (messages, max_tokens) to an answer, a dict with ``text`` and, where it counts them, ``usage`` and
``stop``; its temperature is 0. What it is told about a complaint is delimited and never an instruction.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from ouvidor.functions import fixed
from ouvidor.functions.text import mask_text
from ouvidor.operators.batching import BUDGETS, Provider, json_part, triage_fields, with_retry

Model = Callable[[list[str], int], dict]
#: What is told of each attempt: action, status, milliseconds, id, details.
Record = Callable[[str, str, float, str | None, dict], None]

_clients: dict = {}
_lock = threading.Lock()


def client(name, make: Callable):
    """One client for each name in a Python worker, made by the first that asks."""
    if name not in _clients:
        with _lock:
            if name not in _clients:
                _clients[name] = make()
    return _clients[name]


class OpenCircuit(Exception):
    """A service that failed too often is not asked."""


class Breaker:
    """Lets calls through until ``most`` in a row have failed, then none for ``rest`` seconds, then one that decides."""

    def __init__(self, most: int = 5, rest: float = 30.0, clock=time.monotonic):
        self.most, self.rest, self.clock, self.failed, self.since = most, rest, clock, 0, 0.0

    def __call__(self, call: Callable):
        if self.failed >= self.most and self.clock() - self.since < self.rest:
            raise OpenCircuit(f"{self.failed} falhas seguidas")
        try:
            value = call()
        except Exception:
            self.failed, self.since = self.failed + 1, self.clock()
            raise
        self.failed = 0
        return value


def with_timeout(call: Callable, seconds: float):
    """The value of ``call``, or TimeoutError; a call that hangs is left behind in a thread that ends with the process."""
    out: list = []

    def run():
        try:
            out.append((True, call()))
        except Exception as error:  # noqa: BLE001 - raised again below
            out.append((False, error))

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if not out:
        raise TimeoutError(f"sem resposta em {seconds} s")
    good, value = out[0]
    if not good:
        raise value
    return value


def _asked(model: Model, messages: list[str], budget: str, action: str, item: str | None, attempt: int, read: Callable, record: Record | None):
    began, answer = time.perf_counter(), {}
    about = {"tentativa": attempt}
    try:
        answer = with_retry(lambda: model(messages, BUDGETS[budget]))
        value = read(answer["text"])
    except Exception as error:
        if record:
            record(action, "erro", round((time.perf_counter() - began) * 1000, 1), item, about | {"erro": str(error)} | answer.get("usage", {}))
        raise
    if record:
        record(action, "ok", round((time.perf_counter() - began) * 1000, 1), item, about | answer.get("usage", {}))
    return value


def classify_one(text: str, model: Model, tries: int = 2, item: str | None = None, record: Record | None = None) -> dict:
    """Classification of one complaint. An answer that isn't valid is told to the model with its error; after ``tries`` a RuntimeError."""
    messages, last = [f"<reclamacao>{text}</reclamacao>"], None
    for attempt in range(1, tries + 1):
        said = messages if last is None else [*messages, f"{fixed.FEEDBACK[0]}{last}{fixed.FEEDBACK[1]}"]
        try:
            return _asked(model, said, "triagem", "chamada_bedrock_triagem", item, attempt, lambda answer: triage_fields(json_part(answer, "{", "}")), record)
        except (ValueError, TypeError, KeyError) as error:
            last = error
    raise RuntimeError(f"Falha ao classificar após {tries} tentativas: {last}")


def risk_message(item: dict) -> str:
    """What a model sees for a risk: text, classification, heuristic level, sources."""
    sources = "\n".join(item.get("fontes_politica") or []) or fixed.NO_CONTEXT
    return f"<reclamacao>{item['texto']}</reclamacao>\n<classificacao>{json.dumps(item.get('classificacao') or {}, ensure_ascii=False)}</classificacao>\n<nivel_heuristico>{item.get('nivel_heuristico')}</nivel_heuristico>\n<politica>\n{sources}\n</politica>"


def assess_one(item: dict, model: Model, record: Record | None = None) -> tuple[str, str]:
    """(level, reason) of one complaint (see risk_message); one attempt, whose error is raised."""

    def read(answer: str) -> tuple[str, str]:
        row = json_part(answer, "{", "}")
        return row["nivel"], row["justificativa"]

    return _asked(model, [risk_message(item)], "risco", "chamada_bedrock_risco", item.get("id"), 1, read, record)


def label_one(sample: list[str], model: Model, cluster: int | None = None, record: Record | None = None) -> str:
    """A short label for a sample of a cluster's texts."""
    message = "<reclamacoes>\n" + "\n".join(f"- {t}" for t in sample) + "\n</reclamacoes>"
    return _asked(model, [message], "rotulo", "chamada_bedrock_rotulagem_cluster", None if cluster is None else str(cluster), 1, lambda answer: json_part(answer, "{", "}")["rotulo"], record)


def single_triage(model: Model) -> Provider:
    """classify_one() as a provider, for items that no batch could answer."""
    return lambda items: {i["id"]: classify_one(i["texto"], model, item=i["id"]) for i in items}


def single_risk(model: Model) -> Provider:
    def run(items: list[dict]) -> dict:
        out = {}
        for i in items:
            level, reason = assess_one(i, model)
            out[i["id"]] = {"nivel": level, "justificativa": mask_text(reason)}
        return out

    return run
