"""Personal data by patterns and a skip-chain conditional random field over each document.

Nodes are the tokens of a document that could be personal data: what stands around an ``@`` and
numbers with or without signs between. A node's label is nothing, email, ip, card or phone. Node
features are its shape; neighbouring nodes share a chain potential, and distant nodes that repeat
a token or are similar to it (same digits, same last digits, same name before the ``@``) share a
skip potential. Messages are passed over the loopy graph until they settle, so that what is clear in
one place decides the same token in another: a number without its country code, an address without
its end. Base matches are observed labels and always stay; the model adds spans.

Weights are fitted by pseudo-likelihood on a bounded sample of documents whose base matches serve
as labels. Each labelled token also stands there a second time with its shape hidden and the same
label, so that skip potentials, not shapes, learn to carry a label on. Every document is then
searched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import arrow_pass, free_name, table, with_text_size

NAME = "op7_personal_data"
#: Most texts the weights are fitted on, whole: those with the smallest hashes among distinct texts
#: of at most so many characters.
SAMPLE_DOCUMENTS = 2_000
SAMPLE_CHARS = 20_000
#: A node is added if the model gives some label at least so much.
CERTAIN = 0.6
#: Messages of a document stop below this change; one that has not settled after so many rounds
#: keeps its last messages.
SETTLED = 1e-4
ROUNDS = 1_000
#: Log potential of the labels an observed node does not have; no number of messages lifts it.
EXCLUDED = -1e9

#: Fixed values of the contract: kinds in their order, patterns, bounds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (13, 19), (9, 15), 255

_ADDRESS = re.compile(r"[^\s@<>,;:\"'()\[\]]{1,64}@[^\s@<>,;:\"'()\[\]]{1,255}")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[0-9]|[\x20().-]{1,2}(?=[0-9(]))*[0-9]")
_LABELS = len(KINDS) + 1
_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW_SPANS = pa.list_(pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
_DIGITS = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        # The name part reaches back over its characters, not into an earlier match or ``@``.
        name = text[free:at]
        start = at - (len(name) - len(name.rstrip(LOCAL)))
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            found.append(("email", start, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p) < 400 and int(p) <= IP_PART for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for kind, pattern, (least, most) in (("card", CARD, CARD_DIGITS), ("phone", PHONE, PHONE_DIGITS)):
        for m in pattern.finditer(text):
            digits = _DIGITS.sub("", m.group())
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                found.append((kind, *m.span()))
    return found


def nodes_of(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """Nodes ``(start, end, label)`` in order; label -1 is open. Base spans are nodes; other
    candidates are those that touch none of them."""
    taken = sorted((a, b) for _, a, b in base)
    nodes = [(a, b, KINDS.index(k) + 1) for k, a, b in base]
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
    patterns = [_ADDRESS] if "@" in text else []
    for pattern in (*patterns, _NUMBER):
        for m in pattern.finditer(text):
            a, b = m.span()
            if pattern is _NUMBER and b - a < 7:
                continue
            i = int(np.searchsorted(starts, b))
            if i == 0 or ends[i - 1] <= a:
                nodes.append((a, b, -1))
    return sorted(set(nodes))


def node_features(token: str) -> np.ndarray:
    """The shape of a token."""
    digits = _DIGITS.sub("", token)
    n, groups = len(digits), token.split(".")
    dotted = len(groups) == 4 and all(g.isdigit() and len(g) <= 3 for g in groups)
    head, _, tail = token.partition("@")
    return np.array([
        1.0, "@" in token, "@" in token and "." in tail, dotted,
        dotted and all(int(g) <= IP_PART for g in groups), n in range(13, 20) and "@" not in token,
        n in range(13, 20) and luhn(digits), token[:1] == "+", "(" in token, n in range(9, 16),
        n in range(7, 9), n < 7, n > 19,
    ], float)


_FEATURES = len(node_features("x"))


def keys_of(token: str) -> list[str]:
    """What similar tokens share: all digits, their last seven, or the name before the ``@``."""
    if "@" in token:
        return [f"a:{token.lower()}", f"n:{token.partition('@')[0].lower()}"]
    digits = _DIGITS.sub("", token)
    keys = [f"d:{digits}"]
    if 7 <= len(digits) <= 15 and token.count(".") != 3:
        keys.append(f"s:{digits[-7:]}")
    return keys


def edges_of(tokens: list[tuple[int, int]], text: str, labels: list[int] | None = None) -> list[tuple[int, int, int]]:
    """``(i, j, type)``: 0 joins neighbours, 1 repeated and 2 similar tokens. Each repeated or
    similar token is joined to the next one like it, and each open one (label -1) also to the first
    token with each observed label like it, so labels arrive at any distance and edges grow with
    the tokens alone."""
    edges = [(i, i + 1, 0) for i in range(len(tokens) - 1)]
    last: dict[str, int] = {}
    keys = [keys_of(text[a:b]) for a, b in tokens]
    for i, mine in enumerate(keys):
        for k, key in enumerate(mine):
            if key in last:
                edges.append((last[key], i, 1 + (k > 0)))
            last[key] = i
    if labels is not None:
        observed: dict[str, dict[int, int]] = {}
        for i, label in enumerate(labels):
            for key in keys[i] if label > 0 else ():
                observed.setdefault(key, {}).setdefault(label, i)
        chained = set(edges)
        for i, label in enumerate(labels):
            for k, key in enumerate(keys[i]) if label < 0 else ():
                for j in observed.get(key, {}).values():
                    edge = (min(i, j), max(i, j), 1 + (k > 0))
                    if edge not in chained:
                        edges.append(edge)
    return edges


def pass_messages(
    nodes: np.ndarray, edges: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS,
    documents: np.ndarray | None = None,
):
    """Label probabilities of all nodes (sum-product over the loopy graph, damped).

    nodes: log potentials, a row per node. edges: ``(i, j, type)``. weights: a label by label table
    per type. documents: the number of each node's document; edges stay inside documents, and each
    document stops by itself when its messages settle.
    """
    logs = nodes.copy()
    owner = np.zeros(len(nodes), int) if documents is None else documents
    messages = np.zeros((2, len(edges), _LABELS))
    fresh = True
    for _ in range(rounds if len(edges) else 0):
        if fresh:  # Only documents that still move are kept.
            used, ends = np.unique(edges[:, :2].T, return_inverse=True)
            source = ends.ravel()
            target = source.reshape(2, -1)[::-1].ravel()
            start = nodes[used]
            table_ = np.concatenate([weights[edges[:, 2]], weights[edges[:, 2]].transpose(0, 2, 1)])
            home = owner[edges[:, 0]]
        flat = messages.reshape(-1, _LABELS)
        belief = start.copy()
        np.add.at(belief, target, flat)
        free = belief[source] - messages[::-1].reshape(-1, _LABELS)
        out = np.logaddexp.reduce(free[:, :, None] + table_, axis=1)
        out -= out.max(axis=1, keepdims=True)
        change = np.abs(out - flat).max(axis=1).reshape(2, -1).max(axis=0)
        moving = np.isin(home, home[change >= SETTLED])
        messages = np.where(np.tile(moving, 2)[:, None], 0.5 * flat + 0.5 * out, flat).reshape(messages.shape)
        fresh = not moving.all()
        if fresh:
            done = np.tile(~moving, 2)
            np.add.at(logs, used[target[done]], messages.reshape(-1, _LABELS)[done])
            edges, messages = edges[moving], messages[:, moving]
            if not len(edges):
                break
    if len(edges):
        np.add.at(logs, edges[:, :2].T[::-1].ravel(), messages.reshape(-1, _LABELS))
    logs = logs - logs.max(axis=1, keepdims=True)
    p = np.exp(logs)
    return p / p.sum(axis=1, keepdims=True)


def fit(texts: list[str], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Weights by pseudo-likelihood: each node given the labels of its neighbours."""
    features, labels, edges, size = [], [], [], 0
    for text in texts:
        nodes = nodes_of(text, base_spans(text))
        features += [node_features(text[a:b]) for a, b, _ in nodes]
        labels += [max(label, 0) for _, _, label in nodes]
        edges += [(i + size, j + size, t) for i, j, t in edges_of([n[:2] for n in nodes], text)]
        more = [(i, label) for i, (*_, label) in enumerate(nodes) if label > 0]
        features += [np.eye(1, _FEATURES)[0] for _ in more]
        labels += [label for _, label in more]
        edges += [(i + size, size + len(nodes) + k, 2) for k, (i, _) in enumerate(more)]
        size += len(nodes) + len(more)
    x = np.array(features, float).reshape(size, _FEATURES)
    y = np.array(labels, int)
    e = np.array(edges, int).reshape(-1, 3)
    near = np.zeros((size, 3, _LABELS))
    for a, b in ((0, 1), (1, 0)):
        np.add.at(near, (e[:, a], e[:, 2], y[e[:, b]]), 1.0)
    near = np.minimum(near, 1.0).reshape(size, 3 * _LABELS)
    inputs = np.concatenate([x, near], axis=1)
    w = np.zeros((inputs.shape[1], _LABELS))
    hot = np.eye(_LABELS)[y]
    for _ in range(steps if size else 0):
        z = inputs @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (inputs.T @ (p - hot) / size + decay * w)
    pairs = w[_FEATURES:].reshape(3, _LABELS, _LABELS)
    # A potential belongs to both ends.
    return {"node": w[:_FEATURES], "pairs": (pairs + pairs.transpose(0, 2, 1)) / 2}


def add_spans(texts: list[str], model: dict) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text: base ones and what the model adds, by kind, then start."""
    out, open_texts = [], []
    for row, text in enumerate(texts):
        base = base_spans(text)
        out.append([(*s, True) for s in base])
        # Without an observed label there is nothing to carry on: tokens that repeat would lift each
        # other over the bound by their shapes alone.
        nodes = nodes_of(text, base) if base else []
        if any(label < 0 for _, _, label in nodes):
            open_texts.append((row, text, nodes))
    if not open_texts:
        return out
    potentials, edges, owners = [], [], []
    for row, text, nodes in open_texts:
        size = len(potentials)
        edges += [(i + size, j + size, t) for i, j, t in edges_of(
            [n[:2] for n in nodes], text, [n[2] for n in nodes])]
        for a, b, label in nodes:
            p = node_features(text[a:b]) @ model["node"]
            if label >= 0:
                p = np.where(np.arange(_LABELS) == label, 0.0, EXCLUDED)
            potentials.append(p)
            owners.append((row, a, b, label))
    beliefs = pass_messages(
        np.array(potentials), np.array(edges, int).reshape(-1, 3), model["pairs"],
        documents=np.array([row for row, *_ in owners]))
    # A token that resembles no other has nothing but its shape, and base patterns judge that.
    alike = {i for a, b, kind in edges if kind for i in (a, b)}
    for i, ((row, a, b, label), p) in enumerate(zip(owners, beliefs)):
        best = int(p[1:].argmax()) + 1
        if label < 0 and i in alike and p[best] >= CERTAIN:
            out[row].append((KINDS[best - 1], a, b, False))
    return [sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])) for spans in out]


def fitted(docs: DataFrame, text: str = "text", documents: int = SAMPLE_DOCUMENTS) -> dict:
    """The model, from at most ``documents`` distinct texts with digits or ``@``."""
    sample = docs.select(F.col(text).alias("text")).filter(
        (F.char_length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9]{3}|@"))
    # Distinct hashes alone are ordered; texts leave the tasks only up to the last one, one of each.
    hashed = sample.select(F.xxhash64("text").alias("h"), "text")
    last = hashed.select("h").distinct().orderBy("h").limit(documents).agg(F.max("h")).first()[0]
    if last is None:
        return fit([])
    chosen = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text"))
    return fit(sorted(r.text for r in chosen.collect()))


def find_personal_data(docs: DataFrame, model: dict | None = None, text: str = "text") -> DataFrame:
    """All rows and columns and, last, ``_spans``: kind, start and end in code points, and whether the
    span is a base match. Where the table has a column of that name, underscores go in front. Null and
    empty texts have none; rows are taken one by one."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fitted(docs, text))
    name = free_name(docs, "_spans")
    schema = T.StructType([*docs.schema, T._parse_datatype_string(f"{name} {_SPANS}")[0]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        spans = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in row]
                 for row in add_spans(texts, shared.value)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(spans, _ARROW_SPANS)], names=[*batch.schema.names, name])

    return arrow_pass(docs, text, schema, work)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    done, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            done += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*done, text[at:]])


def redact_documents(docs: DataFrame, model: dict | None = None, text: str = "text") -> DataFrame:
    """All rows and columns, with personal data replaced in the texts; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fitted(docs, text))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(text).to_pylist()
        spans = add_spans([t or "" for t in raw], shared.value)
        clean = [redacted(t, [x[:3] for x in s]) if s else t for t, s in zip(raw, spans)]
        at = batch.schema.get_field_index(text)
        return batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return with_text_size(arrow_pass(docs, text, docs.schema, work), text)


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base matches by kind, their digest, and all spans."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("_spans")).alias("spans"))
