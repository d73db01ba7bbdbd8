"""Extension points: named rules that yield columns or functions, used by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: Decoded rows that go to Spark together.
DECODED_ROWS = 4096


@dataclass(frozen=True)
class Correlator:
    """Flow key of a transport's messages, the order inside a flow, and metadata columns of the flow."""

    transport: str
    key: Callable[[], Column]
    order: Callable[[], Column]
    metadata: tuple[str, ...] = ()


@dataclass(frozen=True)
class Detector:
    """A condition over (payload, protocol, src_port, dst_port) that names a protocol with a confidence.

    With a transport ("tcp" or "udp") the rule is tried on packets of that transport only.
    """

    name: str
    condition: Callable[[], Column]
    protocol: str
    confidence: float
    version: Callable[[], Column] | None = None
    transport: str | None = None


@dataclass(frozen=True)
class Exporter:
    name: str
    extension: str
    project: Callable[[DataFrame], DataFrame]
    options: tuple[tuple[str, object], ...] = ()
    format: str = "json"


CORRELATORS: dict[str, Correlator] = {}
DETECTORS: dict[str, Detector] = {}
DECODERS: dict[str, tuple[Callable, str]] = {}
EXPORTERS: dict[str, Exporter] = {}
NORMALIZERS: list[Callable[[DataFrame], DataFrame]] = []


def register_correlator(rule: Correlator) -> None:
    CORRELATORS[rule.transport] = rule


def register_detector(rule: Detector) -> None:
    DETECTORS[rule.name] = rule


def register_decoder(protocol: str, function: Callable, schema: str) -> None:
    """function(flow, parts) yields rows of schema; see decode()."""
    DECODERS[protocol] = (function, schema)


def register_exporter(rule: Exporter) -> None:
    EXPORTERS[rule.name] = rule


def register_normalizer(function: Callable[[DataFrame], DataFrame]) -> None:
    NORMALIZERS.append(function)


def stream_bytes(flow, parts: Iterator[bytes]) -> Iterator[tuple]:
    """The least decoder: the number of bytes of a flow."""
    yield flow, sum(map(len, parts))


def length_prefixed(flow, parts: Iterator[bytes]) -> Iterator[tuple]:
    """Messages that follow four bytes of their length each, and what is left at the end (complete false)."""
    held, n = b"", 0
    for part in parts:
        held, at = held + part, 0
        while len(held) - at >= 4 and len(held) - at - 4 >= (size := int.from_bytes(held[at : at + 4])):
            yield flow, n, size, True
            at, n = at + 4 + size, n + 1
        held = held[at:]
    if held:
        yield flow, n, len(held), False


def decode(streams: DataFrame, protocol: str, into: int | None = None) -> DataFrame:
    """The registered decoder over every flow of a table of reassembled streams (flow, dir, epoch, run, part, data).

    A decoder gets a flow's parts one after the other, in order, and holds no more of them than it wants. into: partitions of
    flows, else by compressed bytes (see scan.width).
    """
    if protocol not in DECODERS:
        raise KeyError(f"no decoder for {protocol}")
    function, schema = DECODERS[protocol]
    order = ["flow", *(c for c in ("dir", "epoch", "run", "part") if c in streams.columns)]
    rows = streams.select(*order, "data").repartition(*([into] if into else []), "flow").sortWithinPartitions(*order).select("flow", "data")
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (row for batch in batches for row in zip(batch["flow"], batch["data"], strict=True))
        decoded = (made for flow, group in groupby(each, key=lambda r: r[0]) for made in function(flow, (bytes(r[1]) for r in group)))
        while some := list(islice(decoded, DECODED_ROWS)):
            yield pd.DataFrame(some, columns=names)

    return rows.mapInPandas(run, schema)


def exporter(name: str) -> Exporter:
    if name not in EXPORTERS:
        raise KeyError(f"no exporter {name}; known: {', '.join(sorted(EXPORTERS))}")
    return EXPORTERS[name]


def export(df: DataFrame, name: str, path: str) -> None:
    rule = exporter(name)
    rule.project(df).write.format(rule.format).options(**dict(rule.options)).save(path)


def normalize(df: DataFrame) -> DataFrame:
    for function in NORMALIZERS:
        df = df.transform(function)
    return df
