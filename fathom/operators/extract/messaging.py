"""Messaging: constants, configuration, and who produces or consumes which topic."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from fathom.operators.extract.reading import Token
from fathom.operators.extract.source import Source, unique

HOLE = "{?}"
#: fixed values: messaging systems that a client's name can hold; any other is Kafka
SYSTEMS = ("rabbit", "jms", "sqs", "sns", "pulsar")
_PLACEHOLDER = re.compile(r"\$\{(?P<key>[^:}]+)(?::(?P<default>[^}]*))?\}")
_CONFIG = re.compile(r"(?:^|/)(?:application|bootstrap)[^/]*\.(?:yml|yaml|properties)$")
_DECLARES = re.compile(r"topic|queue|destination|subject", re.I)


def constants(src: Source) -> list[tuple[str, str, int]]:
    """(name, value, order) of string constants: a Java field that is static and final, or a Kotlin const val."""
    tokens, out = src.read().tokens, []
    for i, text in enumerate(src.read().texts[: max(0, len(tokens) - 2)]):
        if text != "=" or not i or tokens[i + 1].kind != "string" or len(tokens[i + 1].value) < 1 or tokens[i + 2].text in "+.":
            continue
        words = [t.text for t in tokens[max(0, i - 8) : i]]
        cut = max((k for k, w in enumerate(words) if w in ";{}"), default=-1) + 1
        words = words[cut:]
        if "val" in words[:-1] and words[max(0, words.index("val") - 1)] == "const":
            out.append((words[words.index("val") + 1], tokens[i + 1].value, tokens[i].at))
        elif {"static", "final"} <= set(words) and words[-2:-1] == ["String"]:
            out.append((words[-1], tokens[i + 1].value, tokens[i].at))
    return out


def is_config(path: str) -> bool:
    return bool(_CONFIG.search(path))


def config(src: Source) -> list[tuple[str, str]]:
    """(dotted key, value) of a properties or YAML file, in order; scalars only."""
    lines = src.text.splitlines()
    if src.suffix == "properties":
        pairs = (re.split(r"\s*[=:]\s*", line.strip(), maxsplit=1) for line in lines if not line.lstrip().startswith("#"))
        return [(p[0], p[1].strip()) for p in pairs if len(p) == 2 and p[0] and " " not in p[0] and p[1].strip()]
    out, above = [], []  # above: (indentation, key) of the enclosing mappings
    for line in lines:
        m = re.match(r"""(?P<indent>\s*)(?P<key>[\w.\-\["'\]]+)\s*:(?:\s+(?P<value>.*)|\s*)$""", line)
        if not m or line.lstrip().startswith("#"):
            continue
        depth = len(m.group("indent").replace("\t", ""))
        above = [a for a in above if a[0] < depth] + [(depth, m.group("key").strip("'\""))]
        value = (m.group("value") or "").strip().strip("'\"")
        if value and value[0] != "#":
            out.append((".".join(k for _, k in above), value.split(" #")[0].strip()))
    return out


def declared(src: Source, pairs: list[tuple[str, str]]) -> list[dict]:
    """topic, config_key, line: topics that a configuration names."""
    out = []
    for key, value in pairs:
        if value and _DECLARES.search(key):
            at = re.search(rf"{re.escape(key.rsplit('.', 1)[-1])}\s*[:=]", src.text)
            out.append({"topic": value, "config_key": key, "line": src.line(at.start()) if at else 1})
    return out


def system_of(receiver: str) -> str:
    return next((s for s in SYSTEMS if s in receiver.lower()), "kafka")


@dataclass(frozen=True)
class Part:
    """A term of an expression: its text as far as it is known, whether it is, and what it was read from."""

    text: str
    known: bool
    via: str | None = None


def _literal(text: str, settings: Mapping[str, str]) -> Part:
    """A string stands for itself, or for the setting that it names, or for its default."""
    m = _PLACEHOLDER.fullmatch(text)
    if not m:
        return Part(text, True)
    value = settings.get(m.group("key"), m.group("default"))
    return Part(text if value is None else value, value is not None, m.group("key"))


def _term(tokens: list[Token], settings: Mapping[str, str], names: Mapping[str, str]) -> Part:
    """A string, or a name (the last of a dotted one) that stands for a constant; anything else is unknown."""
    if len(tokens) == 1 and tokens[0].kind == "string":
        return _literal(tokens[0].value, settings)
    last = tokens[-1].text if tokens and tokens[-1].kind == "word" else ""
    if last in names and all(t.kind == "word" or t.text == "." for t in tokens):
        return Part(names[last], True, last)
    return Part("".join(t.text for t in tokens)[:80], False)


def _apart(tokens: list[Token], mark: str) -> list[list[Token]]:
    """Tokens between marks that no bracket holds."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t.text in "([{") - (t.text in ")]}")
        if t.text == mark and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def evaluated(tokens: list[Token], settings: Mapping[str, str], names: Mapping[str, str]) -> list[tuple[str, bool, str | None]]:
    """(topic, resolved, via) of the expression that stands for a topic: a tree of lists, sums and terms.

    Lists give their strings, each by itself, or without any string their names; a sum is one text with a hole for each unknown part.
    """
    while len(tokens) > 1 and (tokens[0].text, tokens[-1].text) in (("(", ")"), ("{", "}"), ("[", "]")):
        tokens = tokens[1:-1]
    open_ = next((i for i, t in enumerate(tokens) if t.text == "("), 0)
    if open_ and tokens[-1].text == ")" and all(t.kind == "word" or t.text == "." for t in tokens[:open_]):
        return evaluated(tokens[open_ + 1 : -1], settings, names)  # a list that a call makes
    items = _apart(tokens, ",")
    if len(items) > 1:
        said = [x for x in items if any(t.kind == "string" for t in x)]
        return [y for x in said or items for y in evaluated(x, settings, names)]
    terms = _apart(tokens, "+")
    if len(terms) > 1:
        parts = [_term(t, settings, names) for t in terms]
        known = all(p.known for p in parts)
        return [("".join(p.text if p.known else HOLE for p in parts), known, None if known else "runtime concatenation")]
    if not tokens:
        return []
    part = _term(tokens, settings, names)
    return [(part.text, part.known, part.via)] if any(t.kind in ("word", "string") for t in tokens) else []


def resolve(expression: str, settings: Mapping[str, str], names: Mapping[str, str]) -> list[tuple[str, bool, str | None]]:
    return evaluated(Source("", expression).read().tokens, settings, names)


#: annotations that listen, the system they listen to, and their attributes that name topics
LISTENERS = {"KafkaListener": ("kafka", ("topics",)), "RabbitListener": ("rabbit", ("queues", "destination")), "JmsListener": ("jms", ("queues", "destination"))}
SENDS = {"subscribe", "send", "convertAndSend", "ProducerRecord"}
JVM_GATE = r"Listener|[Cc]onsumer|[Tt]emplate|[Pp]roducer"


def jvm_sites(src: Source) -> list[list]:
    """[line, direction, system, tokens of the topic's expression as (kind, text)] of Java and Kotlin code, before any name is looked up."""
    read, sites = src.read(), []  # offset, direction, system, expression
    for note in read.annotations:
        if note.name in LISTENERS:
            system, attributes = LISTENERS[note.name]
            value = note.named(*attributes)
            if value is None and system == "kafka" and len(note.arguments) == 1 and note.literal() is not None:
                value = note.arguments[0]
            if value:
                sites.append((note.at, "consume", system, value))
    for c in read.calls_of(SENDS.__contains__):
        if not c.arguments:
            continue
        on = c.on.lower()
        if c.name == "subscribe" and "consumer" in on:
            sites.append((c.at, "consume", "kafka", c.arguments[0]))
        elif c.name in ("send", "convertAndSend") and ("template" in on or "producer" in on):
            sites.append((c.at, "produce", system_of(c.on), c.arguments[0]))
        elif c.name == "ProducerRecord" and read.text(c.first - 1) == "new":
            sites.append((c.at, "produce", "kafka", c.arguments[0]))
    return [[src.line(at), direction, system, [(t.kind, t.text) for t in value]] for at, direction, system, value in sites]


def edges_of(sites: list[list], settings: Mapping[str, str], names: Mapping[str, str]) -> list[dict]:
    """topic, direction, line, resolved, via, system of sites, with what their names stand for."""
    rows = [
        {"topic": topic, "direction": direction, "line": line, "resolved": known, "via": via, "system": system}
        for line, direction, system, value in sites
        for topic, known, via in evaluated([Token(kind, text, 0) for kind, text in value], settings, names)
    ]
    return unique(rows, "topic", "direction", "line")


def jvm_edges(src: Source, settings: Mapping[str, str], names: Mapping[str, str]) -> list[dict]:
    return edges_of(jvm_sites(src), settings, names)


#: a client library: words that a file which uses it holds, its system, and its calls: name, direction, the argument that names the topic (a place or a name)
CLIENTS = [
    (("amqplib", "amqp"), "rabbit", {"sendToQueue": ("produce", 0), "assertQueue": ("consume", 0), "consume": ("consume", 0)}),
    (("pika",), "rabbit", {"basic_publish": ("produce", "routing_key"), "basic_consume": ("consume", "queue")}),
    (("boto3", "sqs"), "sqs", {"send_message": ("produce", "QueueUrl"), "send_message_batch": ("produce", "QueueUrl"), "receive_message": ("consume", "QueueUrl")}),
    (("nats",), "nats", {"publish": ("produce", 0), "subscribe": ("consume", 0)}),
]
BROKER_GATE = r"(?i)amqp|pika|boto3|sqs|nats"


def broker_edges(src: Source) -> list[dict]:
    """The same of JavaScript, TypeScript and Python clients, where the file names the client's library."""
    words, rows = {w.lower() for w in re.findall(r"[A-Za-z0-9]+", src.text)}, []
    read = src.read(src.suffix == "py")
    for libraries, system, known in CLIENTS:
        if not words & set(libraries):
            continue
        for c in read.calls:
            if c.name not in known:
                continue
            direction, place = known[c.name]
            value = c.named(place) if isinstance(place, str) else c.arguments[0] if c.arguments and (c.on or c.after) else None
            if not value or value[0].kind != "string" or not value[0].value:
                continue
            topic = value[0].value
            via = place if place == "QueueUrl" else None
            rows.append({"topic": topic.rsplit("/", 1)[-1] if via else topic, "direction": direction, "line": src.line(c.at), "resolved": True, "via": via, "system": system})
    return unique(rows, "system", "topic", "direction", "line")
